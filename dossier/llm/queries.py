"""The registered queries of the training-data operators, and their SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import embedding_dedup, line_dedup, mixing, packing, periods, ppm, quality, simhash, token_files, toxicity, url_filters, warc, whitening


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.dedup_lines(docs).select("doc_id", "n_lines", "n_removed", F.md5("text").alias("text_md5"))


OP1_SQL = r"""
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS i FROM d),
w AS (SELECT *, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS w FROM l),
u AS (SELECT w, min((doc_id, i)) AS first_at FROM w WHERE len(w) > 0 GROUP BY w),
n AS (SELECT row_number() OVER () AS k, w, first_at FROM u),
s AS (SELECT k, first_at, list_distinct([array_to_string(w[j:j + 4], ' ') for j in range(1, greatest(2, len(w) - 3))]) AS sh FROM n),
e AS (SELECT k, first_at, len(sh) AS c, unnest(sh) AS t FROM s),
late AS (SELECT DISTINCT b.k FROM (SELECT a.k AS ak, b.k AS bk, count(*) AS common FROM e a JOIN e b ON a.t = b.t AND a.first_at < b.first_at
    GROUP BY a.k, b.k) p JOIN s a ON a.k = ak JOIN s b ON b.k = bk WHERE common >= 0.8 * (len(a.sh) + len(b.sh) - common) - 1e-9),
stay AS (SELECT first_at FROM n WHERE k NOT IN (SELECT k FROM late)),
o AS (SELECT doc_id, i, line, len(w) = 0 OR (doc_id, i) IN (SELECT first_at FROM stay) AS keep FROM w)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE NOT keep) AS n_removed,
    md5(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE keep), '')) AS text_md5
FROM o GROUP BY doc_id
"""


URL_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filters.url_filters(pages, rules).select("page_id", "host", "path", "rule", "verdict")


OP2_SQL = r"""
WITH rules(r_host, r_path, r_verdict) AS (VALUES
  ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
  ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
p AS (SELECT page_id, url, strpos(url, '://') AS cut_at FROM pages),
cut AS (SELECT page_id, CASE WHEN cut_at > 0 THEN substr(url, cut_at + 3) ELSE '' END AS tail FROM p),
parts AS (SELECT row_number() OVER () AS rid, page_id,
    translate(regexp_extract(tail, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(tail, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
hits AS (SELECT rid, r_host || r_path AS rule, r_verdict,
    row_number() OVER (PARTITION BY rid ORDER BY length(r_host || r_path) DESC, length(r_host) DESC) AS k
  FROM parts JOIN rules ON (host = r_host OR ends_with(host, '.' || r_host)) AND starts_with(path, r_path))
SELECT page_id, host, path, rule, coalesce(r_verdict, 'allow') AS verdict
FROM parts LEFT JOIN hits ON parts.rid = hits.rid AND k = 1
"""


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_counts(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))


OP8_SQL = r"""
WITH RECURSIVE h AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
    ('0x' || substr(md5('17/doc/' || coalesce(doc_id::VARCHAR, '~')), 1, 15))::BIGINT AS h FROM documents),
totals AS (SELECT source, sum(size)::BIGINT AS source_size FROM h GROUP BY source),
w AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS i FROM totals),
w2 AS (SELECT *, [5, 2, 1][(i % 3 + 1)::INT] AS weight, 3 * source_size AS cap FROM w),
w3 AS (SELECT *, sum(cap) OVER r - cap AS before_, sum(weight) OVER () - sum(weight) OVER r + weight AS left_,
    sum(source_size) OVER () AS all_ FROM w2 WINDOW r AS (ORDER BY cap::DOUBLE / weight, i)),
w4 AS (SELECT *, max((all_ - before_)::DOUBLE / left_) OVER () AS level FROM w3),
s AS (SELECT source, source_size, least(cap::DOUBLE, level * weight) AS target,
    greatest(1, ceil(source_size::DOUBLE / greatest(50000, ceil(all_::DOUBLE / 65536))))::BIGINT AS n_blocks,
    floor(least(cap::DOUBLE, level * weight) / greatest(source_size, 1))::BIGINT AS rounds FROM w4),
d AS (SELECT h.*, source_size, target, n_blocks, rounds, h % n_blocks AS block
  FROM h JOIN s ON h.source IS NOT DISTINCT FROM s.source),
b AS (SELECT source, block, sum(size)::BIGINT AS words, any_value(target - rounds * source_size) AS rest
  FROM d WHERE size > 0 GROUP BY source, block),
p AS (SELECT *, sum(words) OVER (PARTITION BY source ORDER BY
    ('0x' || substr(md5('17/block/' || coalesce(source, '~') || '/' || block::VARCHAR), 1, 15))::BIGINT, block) AS upto_words FROM b),
m AS (SELECT source, block, words, greatest(least(words::DOUBLE, rest - (upto_words - words)), 0) AS more FROM p),
e AS (SELECT d.source, d.block, more, h, sum(size) AS size FROM d JOIN m
    ON d.source IS NOT DISTINCT FROM m.source AND d.block = m.block
  WHERE d.size > 0 AND more > 0 AND more < words GROUP BY ALL),
f AS (SELECT *, sum(size) OVER (PARTITION BY source, block ORDER BY h) - size / 2 AS mid FROM e),
lim AS (SELECT source, block, coalesce(max(h) FILTER (WHERE mid <= more), -1) AS upto FROM f GROUP BY source, block),
n AS (SELECT source, any_value(rounds) AS rounds, count(*) AS n_pos, count(*) FILTER (WHERE more > 0) AS extra
  FROM (SELECT m.*, s.rounds FROM m JOIN s ON m.source IS NOT DISTINCT FROM s.source) GROUP BY source),
u AS (SELECT source, unnest(range(1, (rounds * n_pos + extra + 1)::BIGINT)) AS u FROM n),
deep AS (SELECT least(12, greatest(3, ceil(log2(greatest(1, ceil(sum(source_size) / 1048576.0))))))::INT AS depth FROM totals),
tree AS (SELECT source, u, 0::BIGINT AS shard, 0 AS level FROM u
  UNION ALL SELECT source, u, 2 * shard + (row_number() OVER (PARTITION BY shard ORDER BY
      ('0x' || substr(md5('17/split/' || level || '/' || coalesce(source, '~') || '/' || u), 1, 15))::BIGINT, source, u)
      > count(*) OVER (PARTITION BY shard) / 2.0)::BIGINT, level + 1 FROM tree, deep WHERE level < depth),
quota AS (SELECT source, shard, count(*) AS n FROM tree, deep WHERE level = depth GROUP BY source, shard),
ends AS (SELECT *, sum(n) OVER (PARTITION BY source ORDER BY shard)::BIGINT AS upto_draw FROM quota),
draws AS (SELECT source, shard, unnest(range(upto_draw - n + 1, upto_draw + 1)) AS draw FROM ends),
pos AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY
    ('0x' || substr(md5('17/block/' || coalesce(source, '~') || '/' || block::VARCHAR), 1, 15))::BIGINT, block) AS pos FROM b),
plan AS (SELECT pos.source, pos.block, shard, draw > rounds * n_pos AS last_round FROM draws
  JOIN n ON n.source IS NOT DISTINCT FROM draws.source
  JOIN pos ON pos.source IS NOT DISTINCT FROM draws.source AND pos.pos = (draw - 1) % n_pos + 1),
took AS (SELECT k.source, k.block, k.h, list(shard ORDER BY shard) AS shards FROM (SELECT DISTINCT source, block, h FROM d) k
  JOIN plan ON plan.source IS NOT DISTINCT FROM k.source AND plan.block = k.block
  JOIN m ON m.source IS NOT DISTINCT FROM k.source AND m.block = k.block
  LEFT JOIN lim ON lim.source IS NOT DISTINCT FROM k.source AND lim.block = k.block
  WHERE NOT last_round OR more = words OR k.h <= upto GROUP BY k.source, k.block, k.h)
SELECT doc_id, d.size, source_size, target, (d.size * coalesce(len(shards), 0))::BIGINT AS taken,
    coalesce(array_to_string(shards, ','), '') AS shards
FROM d LEFT JOIN took ON d.source IS NOT DISTINCT FROM took.source AND d.block = took.block AND d.h = took.h
"""


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return quality.quality_rules(docs, carry=["doc_id"]).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


OP10_SQL = r"""
WITH w AS (SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text, '') AS t,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (SELECT rid, unnest([{'i': i, 'k': ws[i:i + 2]} for i in range(1, len(ws) - 1)]) AS x FROM w),
r AS (SELECT rid, x.i AS i, count(*) OVER (PARTITION BY rid, x.k) AS c FROM g),
rep AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM r WHERE c >= 2) GROUP BY rid),
l AS (SELECT rid, doc_id, lang, source, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
    len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, len(regexp_extract_all(t, '\p{Lu}')) AS n_upper,
    len(regexp_extract_all(t, '[!?]')) AS n_shouts,
    [x for x in string_split(t, chr(10)) if regexp_matches(x, '[^\x20\x09-\x0D]')] AS ls FROM w),
m AS (SELECT l.*, len(ls) AS n_lines, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words,
    n_words < 50 OR 100 * coalesce(n, 0) > 50 * n_words AS base_failed FROM l LEFT JOIN rep ON l.rid = rep.rid),
v AS (SELECT rid, lang, source, base_failed, unnest([
    {'m': 'mean_word', 'x': word_chars::DOUBLE / greatest(n_words, 1), 'guard': 0.1::DOUBLE, 'low': true},
    {'m': 'symbols', 'x': n_symbols::DOUBLE / greatest(n_words, 1), 'guard': 0.05, 'low': false},
    {'m': 'upper', 'x': n_upper::DOUBLE / greatest(word_chars, 1), 'guard': 0.02, 'low': false},
    {'m': 'shouts', 'x': n_shouts::DOUBLE / greatest(n_words, 1), 'guard': 0.05, 'low': false},
    {'m': 'dup_lines', 'x': n_dup_lines::DOUBLE / greatest(n_lines, 1), 'guard': 0.1, 'low': false}]) AS s FROM m),
sk AS (SELECT level, if(level < 2, lang, NULL) AS lang, if(level < 1, source, NULL) AS source, s.m AS m, s.guard AS guard,
    s.low AS low, least(floor(s.x * 1024), 1048576) AS step, count(*) AS n
  FROM v, (VALUES (0), (1), (2)) AS levels(level) WHERE NOT base_failed GROUP BY ALL),
c AS (SELECT *, sum(n) OVER (PARTITION BY level, lang, source, m ORDER BY step) AS upto,
    sum(n) OVER (PARTITION BY level, lang, source, m) AS all_ FROM sk),
q AS (SELECT level, lang, source, m, guard, low, min(step / 1024) FILTER (WHERE upto >= 0.25 * all_) AS q1,
    min(step / 1024) FILTER (WHERE upto >= 0.75 * all_) AS q3 FROM c WHERE all_ >= 50 OR level = 2 GROUP BY ALL),
f AS (SELECT level, lang, source, m, q3 + 4.0::DOUBLE * greatest(q3 - q1, guard) AS hi,
    CASE WHEN low THEN q1 - 4.0::DOUBLE * greatest(q3 - q1, guard) ELSE '-inf'::DOUBLE END AS lo FROM q),
out AS (SELECT rid, bool_or(s.x > coalesce(a.hi, b.hi, d.hi) OR s.x < coalesce(a.lo, b.lo, d.lo)) AS beyond FROM v
  LEFT JOIN f a ON a.level = 0 AND a.m = s.m AND a.lang IS NOT DISTINCT FROM v.lang AND a.source IS NOT DISTINCT FROM v.source
  LEFT JOIN f b ON b.level = 1 AND b.m = s.m AND b.lang IS NOT DISTINCT FROM v.lang
  LEFT JOIN f d ON d.level = 2 AND d.m = s.m GROUP BY rid)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    NOT base_failed AND NOT coalesce(beyond, false) AS kept
FROM m JOIN out ON m.rid = out.rid
"""


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return warc.round_trip(pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP3_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM p)
SELECT page_id, payload_bytes, payload_digest,
    CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to
FROM f
"""


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_vectors(table(spark, sf_dir, "embeddings"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    return toxicity.score(docs, model, keep=["doc_id"]).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.score_texts(table(spark, sf_dir, "documents").select("doc_id", "text"))


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path=tokenizer_path())


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_groups(table(spark, sf_dir, "documents").select("doc_id", "text"))


def byte_tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op11_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    read = token_files.round_trip(docs, tokenizer_path=byte_tokenizer_path(), end_id=2)
    return read.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    runs = periods.collapse_runs(periods.plant_tails(docs))
    best = F.col("best")
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return runs.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), best["start"].alias("start"), best["length"].alias("length"), best["period"].alias("period"),
        F.floor(1000 * best["length"] / best["period"]).cast("long").alias("exponent_milli"),
        F.sha2(F.concat_ws("", lines), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


QUERIES = {
    "op1_line_dedup": op1_line_dedup,
    "op2_url_filters": op2_url_filters,
    "op3_warc": op3_warc,
    "op4_embedding_dedup": op4_embedding_dedup,
    "op5_toxicity": op5_toxicity,
    "op6_lm_score": op6_lm_score,
    "op7_packing": op7_packing,
    "op8_mixing": op8_mixing,
    "op9_simhash": op9_simhash,
    "op10_quality_rules": op10_quality_rules,
    "op11_token_files": op11_token_files,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_whitening": op13_whitening,
}
ORACLES = {
    "op1_line_dedup": OP1_SQL,
    "op2_url_filters": OP2_SQL,
    "op3_warc": OP3_SQL,
    "op8_mixing": OP8_SQL,
    "op10_quality_rules": OP10_SQL,
}
