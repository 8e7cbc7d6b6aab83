"""Queries that apply the operators to whole tables, each with the same question in SQL where SQL can ask it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import evaluate, graph, quotes, record, retrieval, staleness

LOWER = "abcdefghijklmnopqrstuvwxyz"
QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@query("""
SELECT b.item_id, count(d.doc_id) AS n_texts, min(d.doc_id) AS first_text, CASE WHEN count(d.doc_id) > 0 THEN 'cited' ELSE 'speculative' END AS status
FROM benchmark b LEFT JOIN documents d ON contains(d.text, b.text) GROUP BY b.item_id
""")
def quote_support(t) -> DataFrame:
    q = t("benchmark").select(F.col("item_id").alias("quote_id"), F.col("text").alias("quote"))
    hits = quotes.locate_anywhere(q, t("documents").select(F.col("doc_id").alias("text_id"), "text"))
    g = hits.groupBy("quote_id").agg(F.count("*").alias("n_texts"), F.min("text_id").alias("first_text"))
    j = q.select("quote_id").join(g, "quote_id", "left").na.fill(0, ["n_texts"])
    return j.select(F.col("quote_id").alias("item_id"), "n_texts", "first_text", F.when(F.col("n_texts") > 0, "cited").otherwise("speculative").alias("status"))


def conversation_quotes(t) -> DataFrame:
    """A quote for each turn from the same conversation: as it is, in capitals, or a digest that is nowhere."""
    part = F.substring("text", 3, 30)
    quote = F.when(F.col("turn") % 3 == 0, part).when(F.col("turn") % 3 == 1, F.translate(part, LOWER, LOWER.upper())).otherwise(F.md5("text"))
    return t("conversations").select(F.col("conv_id").cast("string").alias("sha"), F.col("turn").alias("quote_id"), quote.alias("quote"), F.col("role").alias("repo"))


LOCATE_SQL = r"""
c AS (SELECT conv_id::VARCHAR AS sha, turn, text, role || turn AS place FROM conversations),
q AS (SELECT conv_id::VARCHAR AS sha, turn AS quote_id, role AS repo,
    CASE turn % 3 WHEN 0 THEN substr(text, 3, 30) WHEN 1 THEN translate(substr(text, 3, 30), 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') ELSE md5(text) END AS quote FROM conversations),
j AS (SELECT q.sha, q.quote_id, q.repo, c.turn, c.place, CASE WHEN contains(c.text, q.quote) THEN 0 ELSE 1 END AS rank FROM q JOIN c ON q.sha = c.sha
    WHERE trim(q.quote) <> '' AND (contains(c.text, q.quote) OR
        contains(lower(trim(regexp_replace(c.text, '\s+', ' ', 'g'))), lower(trim(regexp_replace(q.quote, '\s+', ' ', 'g')))))),
b AS (SELECT *, row_number() OVER (PARTITION BY sha, quote_id ORDER BY rank, turn) AS k FROM j),
l AS (SELECT q.sha, q.quote_id, q.repo, b.place, CASE b.rank WHEN 0 THEN 'exact' WHEN 1 THEN 'loose' ELSE 'absent' END AS match
    FROM q LEFT JOIN b ON q.sha = b.sha AND q.quote_id = b.quote_id AND k = 1)
"""


@query(f"""WITH {LOCATE_SQL} SELECT sha, quote_id, place, match, CASE WHEN match = 'absent' THEN 'speculative' ELSE 'cited' END AS status,
    CASE WHEN match <> 'absent' THEN place || '@' || substr(sha, 1, 12) END AS source FROM l""")
def quote_locations(t) -> DataFrame:
    texts = t("conversations").select(F.col("conv_id").cast("string").alias("sha"), F.col("turn").alias("ord"), F.concat("role", F.col("turn").cast("string")).alias("place"), "text")
    return quotes.assign_status(quotes.locate_quotes(conversation_quotes(t), texts))


@query(f"""WITH {LOCATE_SQL}, n AS (SELECT repo, count(*) FILTER (WHERE match = 'exact') AS present, count(*) FILTER (WHERE match = 'loose') AS loose,
    count(*) FILTER (WHERE match = 'absent') AS absent, count(*) AS quotes, count(*) FILTER (WHERE match <> 'absent' AND place <> 'user0') AS in_diff FROM l GROUP BY ROLLUP (repo)),
u AS (SELECT role AS repo, count(*) AS units, count(*) FILTER (WHERE turn = 1) AS dropped FROM conversations GROUP BY ROLLUP (role))
SELECT n.*, units, dropped FROM n JOIN u ON n.repo IS NOT DISTINCT FROM u.repo""")
def quote_tallies(t) -> DataFrame:
    place = F.concat("role", F.col("turn").cast("string"))
    texts = t("conversations").select(F.col("conv_id").cast("string").alias("sha"), F.col("turn").alias("ord"), F.when(place == "user0", quotes.MESSAGE).otherwise(place).alias("place"), "text")
    q = conversation_quotes(t)
    located = quotes.locate_quotes(q, texts).join(q.select("sha", "quote_id", "repo"), ["sha", "quote_id"])
    units = t("conversations").select(F.col("role").alias("repo"), "turn")
    return quotes.quote_tallies(located, built={"units": units, "dropped": units.where("turn = 1")})


@query(r"""
WITH q AS (SELECT doc_id AS sha, CASE WHEN doc_id % 5 = 0 THEN '' WHEN doc_id % 5 = 1 THEN translate(substr(text, 1, 20), 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') WHEN doc_id % 5 = 2 THEN md5(text)
    ELSE substr(text, length(text) - 11, 12) END AS quote, CASE WHEN doc_id % 2 = 0 THEN 'docs/a' ELSE 'src/a' END AS path,
    substr(text, 1, length(text) // 2) AS before_, text FROM documents),
s AS (SELECT sha, path, CASE WHEN trim(quote) = '' THEN 'Absent' WHEN contains(text, quote) AND NOT contains(before_, quote) THEN 'Added'
    WHEN contains(before_ || chr(10) || text, quote) THEN 'InCommit'
    WHEN contains(lower(trim(regexp_replace(before_ || chr(10) || text, '\s+', ' ', 'g'))), lower(trim(regexp_replace(quote, '\s+', ' ', 'g')))) THEN 'Loose'
    ELSE 'Absent' END AS support, quote FROM q)
SELECT sha, sha AS quote_id, support, CASE WHEN path = 'docs/a' AND (support <> 'Absent' OR quote = '') THEN true ELSE false END AS prose_only FROM s
""")
def quote_support_levels(t) -> DataFrame:
    d = t("documents").select(F.col("doc_id").alias("sha"), "text")
    k, s = F.col("sha") % 5, F.col("text")
    quote = F.when(k == 0, F.lit("")).when(k == 1, F.translate(F.substring(s, 1, 20), LOWER, LOWER.upper())).when(k == 2, F.md5(s)).otherwise(F.expr("substring(text, greatest(1, length(text) - 11), 12)"))
    q = d.select("sha", F.col("sha").alias("quote_id"), quote.alias("quote"))
    path = F.when(F.col("sha") % 2 == 0, F.lit("docs/a")).otherwise(F.lit("src/a"))
    files = d.select("sha", path.alias("path"), F.expr("substring(text, 1, length(text) div 2)").alias("before"), s.alias("after"))
    return quotes.check_quotes(q, files)


@query(r"""
SELECT conv_id, turn, len(list_filter(string_split_regex(text, '[^A-Za-z0-9_]'), lambda t: strlen(t) >= 3 AND NOT regexp_matches(t, '^[0-9]+$'))) AS idents,
    len(list_distinct(list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}_]+'), lambda t: strlen(t) >= 3))) AS words,
    len(list_distinct(list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}_]'), lambda t: strlen(t) > 1 AND NOT list_contains(['a', 'an', 'the', 'and', 'or', 'of', 'to',
        'in', 'on', 'for', 'is', 'are', 'be', 'it', 'its', 'this', 'that', 'with', 'as', 'by', 'at', 'from', 'not', 'no', 'into', 'than', 'so', 'can', 'must', 'when', 'which'], t)))) AS content_words,
    md5(lower(trim(regexp_replace(text, '\s+', ' ', 'g')))) AS flat_md5,
    md5(array_to_string(list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda t: strlen(t) > 2), ' ')) AS wording_md5,
    ceil(strlen(text) / 4.0)::BIGINT AS tokens, substr(sha256(text), 1, 16) AS body_hash FROM conversations
""")
def text_functions(t) -> DataFrame:
    s = F.col("text")
    return t("conversations").select(
        "conv_id", "turn", F.size(T.ident_terms(s)).alias("idents"), F.size(T.word_terms(s)).alias("words"), F.size(T.label_words(s)).alias("content_words"),
        F.md5(T.flat(s)).alias("flat_md5"), F.md5(T.normalise_wording(s)).alias("wording_md5"), T.token_cost(s).alias("tokens"), T.content_hash(s).alias("body_hash"),
    )


@query(r"""
WITH w AS (SELECT doc_id, trim(text) AS t, list_filter(string_split_regex(trim(text), '\s+'), lambda x: x <> '')[1:20] AS ws FROM documents),
g AS (SELECT doc_id, t, array_to_string(ws[1:coalesce(list_max(list_filter(range(1, len(ws) + 1), lambda i: strlen(array_to_string(ws[1:i], ' ')) + CASE WHEN i = 1 THEN 1 ELSE 0 END <= 110)), 0)], ' ') AS g FROM w)
SELECT doc_id, CASE WHEN strlen(g) = strlen(t) THEN g ELSE g || ' …' END AS gist, strlen(g) < strlen(t) AS has_body FROM g
""")
def gists(t) -> DataFrame:
    d = t("documents").select("doc_id", T.gist(F.col("text")).alias("gist"), T.body(F.col("text")).isNotNull().alias("has_body"))
    return d


@query("""
SELECT doc_id, 'd/g' || substr(sha256(text), 1, 12) || CASE WHEN doc_id % 3 > 0 THEN 'r' || (doc_id % 3) ELSE '' END || '-' || (doc_id % 7 + 1) AS label,
    substr(sha256(text), 1, 12) AS sha12, doc_id % 3 AS run, doc_id % 7 + 1 AS d FROM documents
""")
def labels_round_trip(t) -> DataFrame:
    d = t("documents").select("doc_id", T.compose_label(F.lit("d"), F.upper(F.sha2("text", 256)), F.col("doc_id") % 3, F.col("doc_id") % 7 + 1).alias("label"))
    d = d.withColumn("p", T.parse_label(F.col("label")))
    return d.select("doc_id", "label", F.col("p.sha12").alias("sha12"), F.col("p.run").alias("run"), F.col("p.d").alias("d"))


def conversation_units(t) -> DataFrame:
    """Conversations as commits: user turns decide; what follows is a prerequisite, an alternative or a consequence."""
    c = t("conversations").select(F.md5(F.col("conv_id").cast("string")).alias("sha"), F.col("turn").alias("pos"), "text", "role")
    c = c.withColumn("decision", F.floor(F.col("pos") / 2).cast("int") + 1)
    kind = F.when(F.col("pos") % 2 == 0, "decision").otherwise(F.element_at(F.array(*map(F.lit, ["prerequisite", "alternative", "consequence"])), (F.col("decision") % 3 + 1).cast("int")))
    c = record.number_items(c.withColumn("kind", kind))
    found = F.length("text") % 2 == 0
    c = c.withColumns({
        "item_kind": F.lit("act"), "verified": F.lit(False), "run": F.lit(0), "status": F.when(found, "cited").otherwise("speculative"),
        "source": F.when(found, F.concat(F.lit("src/"), F.col("role"), F.lit("@"), F.col("sha"))),
    })
    return record.build_units(c)


UNITS_SQL = """
c AS (SELECT md5(conv_id::VARCHAR) AS sha, turn AS pos, text, role, turn // 2 + 1 AS decision FROM conversations),
i AS (SELECT *, CASE WHEN pos % 2 = 0 THEN 'decision' ELSE ['prerequisite', 'alternative', 'consequence'][(decision % 3 + 1)::INT] END AS item,
    CASE WHEN length(text) % 2 = 0 THEN 'cited' ELSE 'speculative' END AS own FROM c),
u AS (SELECT i.*, CASE WHEN i.item = 'consequence' THEN CASE WHEN h.own = 'speculative' THEN 'speculative' ELSE 'inferred' END ELSE i.own END AS status,
    CASE i.item WHEN 'decision' THEN 'd' WHEN 'prerequisite' THEN 'p' WHEN 'alternative' THEN 'r' ELSE 'q' END || '/g' || substr(i.sha, 1, 12) || '-' || i.decision || CASE WHEN i.item <> 'decision' THEN '-1' ELSE '' END AS label
    FROM i LEFT JOIN i h ON h.sha = i.sha AND h.decision = i.decision AND h.item = 'decision')
"""


@query(f"""WITH {UNITS_SQL} SELECT label, CASE item WHEN 'decision' THEN 'decision' WHEN 'prerequisite' THEN 'constraint' ELSE 'claim' END AS kind, status,
    CASE WHEN status = 'cited' THEN 'src/' || role || '@' || sha END AS source FROM u""")
def unit_table(t) -> DataFrame:
    return conversation_units(t).select("label", "kind", "status", "source")


@query(f"""WITH {UNITS_SQL}, e AS (SELECT item FROM u JOIN (SELECT DISTINCT sha, decision FROM u WHERE item = 'decision') h USING (sha, decision) WHERE item <> 'decision')
SELECT CASE item WHEN 'prerequisite' THEN 'conditions' WHEN 'alternative' THEN 'contrasts' ELSE 'causes' END AS kind, count(*) AS edges FROM e GROUP BY ALL""")
def edge_kinds(t) -> DataFrame:
    u = conversation_units(t)
    # Equal items of different conversations are one unit; edges are counted before they merge.
    heads = u.where("item = 'decision'").select("sha", "decision").distinct()
    e = u.where("item <> 'decision'").join(heads, ["sha", "decision"], "left_semi").withColumn("uid", F.col("label"))
    both = e.unionByName(u.where("item = 'decision'").withColumn("uid", F.col("label")))
    return record.build_edges(both).groupBy("kind").agg(F.count("*").alias("edges"))


@query(f"""WITH {UNITS_SQL} SELECT substr(sha, 1, 12) AS sha12, count(*) FILTER (WHERE item = 'decision') AS decisions, count(*) FILTER (WHERE item = 'prerequisite') AS prerequisites,
    count(*) FILTER (WHERE item = 'alternative') AS alternatives, count(*) FILTER (WHERE item = 'consequence') AS consequences FROM u
    GROUP BY 1""")
def record_counts(t) -> DataFrame:
    return record.record_counts(conversation_units(t).select("label"))


@query("""
WITH s AS (SELECT d.lang AS kind, d.source AS repo, count(*) AS extracted, count(l.doc_id) AS matched, 0 AS pending, count(DISTINCT l.doc_id) AS covered FROM documents d LEFT JOIN labels l
    ON d.doc_id = l.doc_id AND l.quality = 1 GROUP BY ROLLUP (d.lang, d.source) HAVING grouping(d.lang) = 0)
SELECT *, round(matched / extracted, 6) AS precision, round(CASE WHEN matched > 0 THEN covered / matched END, 6) AS recall FROM s
""")
def system_scores(t) -> DataFrame:
    d = t("documents").select(F.col("lang").alias("kind"), F.col("source").alias("repo"), "doc_id", F.lit("c").alias("commit"))
    good = t("labels").where("quality = 1").select("doc_id", F.lit(True).alias("good"))
    gold = d.join(good, "doc_id").select("repo", "commit", "kind", F.col("doc_id").cast("string").alias("id"))
    system = d.join(good, "doc_id", "left").select("repo", "commit", "kind", F.when(F.col("good"), F.col("doc_id").cast("string")).otherwise("none").alias("match"))
    scores, _ = evaluate.score_system(system, gold)
    return scores.select("kind", "repo", "extracted", "matched", "pending", "covered", "precision", "recall")


@query("""
WITH w AS (SELECT conv_id, turn, role, list_distinct(list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{N}_]'), lambda t: strlen(t) > 1 AND NOT list_contains(['a', 'an', 'the', 'and', 'or',
    'of', 'to', 'in', 'on', 'for', 'is', 'are', 'be', 'it', 'its', 'this', 'that', 'with', 'as', 'by', 'at', 'from', 'not', 'no', 'into', 'than', 'so', 'can', 'must', 'when', 'which'], t))) AS w FROM conversations),
j AS (SELECT a.conv_id, a.turn, b.turn AS g, len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w))) AS s FROM w a JOIN w b ON a.conv_id = b.conv_id AND a.turn % 2 = 1 AND b.turn % 2 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY s DESC, lpad(g::VARCHAR, 6, '0')) AS k FROM j WHERE s > 0),
l AS (SELECT conv_id, turn, string_agg(lpad(g::VARCHAR, 6, '0'), ',' ORDER BY k) AS suggest FROM r WHERE k <= 3 GROUP BY ALL)
SELECT c.conv_id::VARCHAR AS commit, c.turn::VARCHAR AS id, coalesce(suggest, '') AS suggest FROM conversations c LEFT JOIN l ON c.conv_id = l.conv_id AND c.turn = l.turn WHERE c.turn % 2 = 1
""")
def label_suggestions(t) -> DataFrame:
    c = t("conversations").select(F.lit("r").alias("repo"), F.col("conv_id").cast("string").alias("commit"), F.lit("decision").alias("kind"), "turn", "text")
    system = c.where("turn % 2 = 1").withColumn("id", F.col("turn").cast("string"))
    gold = c.where("turn % 2 = 0").withColumn("id", F.lpad(F.col("turn").cast("string"), 6, "0"))
    return retrieval.suggest_labels(system, gold).select("commit", "id", F.array_join("suggest", ",").alias("suggest"))


BM25_SQL = r"""
d AS (SELECT doc_id AS doc, list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}_]+'), lambda t: strlen(t) >= 3) AS ts FROM documents),
p AS (SELECT doc, term, count(*) AS tf, max(n) AS n FROM (SELECT doc, len(ts) AS n, unnest(ts) AS term FROM d) GROUP BY ALL),
f AS (SELECT term, count(*) AS df FROM p GROUP BY term)
"""


def words_of(name: str):
    return F.filter(F.split(F.lower(name), r"[^\p{L}\p{N}_]+"), lambda w: F.octet_length(w) >= 3)


@query(f"WITH {BM25_SQL} SELECT df, count(*) AS terms FROM f GROUP BY df")
def term_statistics(t) -> DataFrame:
    post = retrieval.postings(t("documents"), words_of("text"))
    return retrieval.term_stats(post).groupBy("df").agg(F.count("*").alias("terms"))


@query(f"""WITH {BM25_SQL}, a AS (SELECT count(*) AS nd, avg(n) AS al FROM (SELECT doc, max(n) AS n FROM p GROUP BY doc)),
q AS (SELECT DISTINCT item_id AS query, unnest(list_filter(string_split_regex(lower(text), '[^\\p{{L}}\\p{{N}}_]+'), lambda t: strlen(t) >= 3)) AS term FROM benchmark),
h AS (SELECT query, doc, sum(ln(1 + (nd - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / al))) AS score FROM q JOIN p USING (term) JOIN f USING (term), a GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, doc) AS rank FROM h)
SELECT query, doc, rank, round(score, 4) AS score FROM r WHERE rank <= 12""")
def bm25_top(t) -> DataFrame:
    q = t("benchmark").select(F.col("item_id").alias("query"), F.explode(words_of("text")).alias("term"))
    lengths = Observation()
    post = retrieval.postings(t("documents"), words_of("text"), asked=q, lengths=lengths)
    return retrieval.bm25_search(post, q, lengths=lengths).select("query", "doc", "rank", F.round("score", 4).alias("score"))


@query("""
WITH n AS (SELECT doc_id, source, md5(coalesce(text, '')) AS h FROM documents), m AS (SELECT doc_id, source, CASE WHEN doc_id % 11 = 0 THEN 'gone' WHEN doc_id % 7 = 0 THEN 'changed' END AS moved FROM n)
SELECT source AS repo, doc_id::VARCHAR AS item, moved, CASE moved WHEN 'gone' THEN doc_id || ' is no longer in f' ELSE doc_id || ' changed in f' END AS reason FROM m WHERE moved IS NOT NULL
""")
def stale_items(t) -> DataFrame:
    return moved_documents(t)[0].select("repo", "item", "moved", "reason")


def moved_documents(t) -> tuple[DataFrame, DataFrame]:
    """Documents as recorded items; in the version of now every seventh has changed and every eleventh is gone."""
    d = t("documents").select(F.col("source").alias("repo"), F.lit("s").alias("sha"), F.lit("f").alias("file"), F.col("doc_id").cast("string").alias("item"), "doc_id", F.md5(F.coalesce("text", F.lit(""))).alias("body_hash"))
    now = d.where("doc_id % 11 <> 0").withColumn("body_hash", F.when(F.col("doc_id") % 7 == 0, F.md5("body_hash")).otherwise(F.col("body_hash")))
    return staleness.stale_compare(d.drop("doc_id"), now), d


@query("""
SELECT source AS repo, count(*) AS units, count(*) FILTER (WHERE doc_id % 7 = 0 AND doc_id % 11 <> 0) AS changed, count(*) FILTER (WHERE doc_id % 11 = 0) AS gone FROM documents GROUP BY source
""")
def stale_totals(t) -> DataFrame:
    moved, recorded = moved_documents(t)
    return staleness.stale_counts(recorded, moved).drop("sha")


PREMISES_SQL = """e(src, dst) AS (SELECT 'r' || n_regionkey, 'n' || n_nationkey FROM nation UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer
    UNION ALL SELECT 'c' || o_custkey, 'o' || o_orderkey FROM orders)"""


def premises(t) -> DataFrame:
    key = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    return (
        t("nation").select(key("r", "n_regionkey").alias("src"), key("n", "n_nationkey").alias("dst"))
        .union(t("customer").select(key("n", "c_nationkey"), key("c", "c_custkey"))).union(t("orders").select(key("c", "o_custkey"), key("o", "o_orderkey")))
    )


@query(f"""WITH RECURSIVE {PREMISES_SQL}, r(root, node, level) AS (SELECT 'r' || r_regionkey, 'r' || r_regionkey, 0 FROM region UNION SELECT root, dst, level + 1 FROM r JOIN e ON node = src)
SELECT root, level, count(*) AS nodes FROM r WHERE level > 0 GROUP BY ALL""")
def dependents(t) -> DataFrame:
    roots = t("region").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("uid"))
    return graph.dependents_of(roots, premises(t)).groupBy("root", "level").agg(F.count("*").alias("nodes"))


@query("""
WITH c AS (SELECT conv_id || '/' || turn AS sha, turn, max(turn) OVER (PARTITION BY conv_id) AS last FROM conversations)
SELECT sha AS node, last - turn AS level FROM c WHERE turn > last // 2
""")
def commit_range(t) -> DataFrame:
    name = lambda turn: F.concat_ws("/", F.col("conv_id").cast("string"), turn.cast("string"))
    c = t("conversations").select("conv_id", "turn", name(F.col("turn")).alias("sha"), F.when(F.col("turn") > 0, name(F.col("turn") - 1)).alias("parent"))
    last = c.groupBy("conv_id").agg(F.max("turn").alias("last"))
    ends, base = last.select(name(F.col("last")).alias("sha")), last.select(name(F.floor(F.col("last") / 2)).alias("sha"))
    return graph.commits_between(base, ends, c)
