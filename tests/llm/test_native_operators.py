"""Line dedup, URL filters, WARC, mixing and quality rules: SQL on the smallest tables, brute force, edge rows."""

import os
import random
from collections import Counter

import duckdb
import pytest

from dossier.llm import line_dedup, mixing, quality, queries, url_filters, warc
from dossier.llm.common import shared_dir

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.partition('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    got = queries.QUERIES[name](spark, SF)
    cur = con.execute(queries.ORACLES[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(got.columns)
    text = lambda v: "null" if v is None else f"{v:.6f}" if isinstance(v, float) else str(v)
    at = [names.index(c) for c in sorted(names)]
    want = Counter(tuple(text(r[i]) for i in at) for r in cur.fetchall())
    assert Counter(tuple(text(r[c]) for c in sorted(names)) for r in got.collect()) == want


NAMES = ["_id", "_th", "_text", "_row", "_stay", "_sid", "_sth", "_parts", "_all", "h1", "lid", "at", "no"]


def test_line_dedup_edge_rows(spark):
    long_ = " ".join(f"w{i}" for i in range(60))
    near = long_.replace("w3 ", "changed ")
    docs = spark.createDataFrame(
        [(2, f"{long_}\nown line\n\nsame"), (5, f"{near}\nsame\nsame\nlast"), (9, None), (10, ""), (None, "same\nwith null id"), (11, "twice"), (11, "twice"), (1, "same")],
        "doc_id long, text string",
    ).selectExpr("*", "1 as n_lines", "'x' as line", *[f"{i} as {n}" for i, n in enumerate(NAMES)])
    got = sorted((str(r.doc_id), str(r.text), r.n_lines, r.n_removed) for r in line_dedup.dedup_lines(docs).collect())
    assert got == sorted([
        ("1", "same", 1, 0), ("2", f"{long_}\nown line\n", 4, 1), ("5", "last", 4, 3), ("9", "None", 0, 0), ("10", "", 1, 0),
        ("None", "with null id", 2, 1), ("11", "twice", 1, 0), ("11", "twice", 1, 0),
    ])
    assert all(r[n] == i for r in line_dedup.dedup_lines(docs).collect() for i, n in enumerate(NAMES))
    assert line_dedup.dedup_lines(docs.where("doc_id = 99")).count() == 0


def brute_lines(rows):
    """(id, text) to the lines that stay, by comparing all pairs of lines."""
    seen, out = [], {}
    for d, text in sorted(rows):
        stay = []
        for line in text.split("\n"):
            w = line.split()
            s = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}
            if not w or not any(w == x or len(s & t) >= 0.8 * len(s | t) - 1e-9 for x, t in seen):
                stay.append(line)
            if w:
                seen.append((w, s))
        out[d] = "\n".join(stay)
    return out


def test_line_dedup_matches_brute_force(spark):
    rng = random.Random(4)
    pool = [f"v{i}" for i in range(60)]
    base = [" ".join(rng.choices(pool, k=rng.randint(1, 40))) for _ in range(60)]

    def near(line):
        w = line.split(" ")
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(len(w))] = rng.choice(pool)
        return rng.choice(["  ", " "]).join(w) + rng.choice(["", " ", "\t"])

    rows = [(i, "\n".join(near(rng.choice(base)) for _ in range(rng.randint(0, 6)))) for i in range(150)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_lines(rows)
    assert {r.doc_id: r.text for r in line_dedup.dedup_lines(df).collect()} == want
    names = df.selectExpr("cast(10000 + doc_id as string) as doc_id", "text")
    assert {int(r.doc_id) - 10000: r.text for r in line_dedup.dedup_lines(names).collect()} == want


def test_line_dedup_pairs_of_a_large_group(spark):
    # 3,000 near copies of one line: a few pairs each settle them, not all pairs of the group.
    words = [f"w{i}" for i in range(160)]
    texts = [" ".join(words[: i % 155] + [f"x{i}"] + words[i % 155 :]) for i in range(3000)]
    df = spark.createDataFrame(list(enumerate(texts)), "_id long, _text string").withColumn("_th", line_dedup.F.xxhash64("_text"))
    lines = line_dedup.distinct_lines(df, line_dedup.frequent_buckets(df, 5), 0.8, 5)
    assert line_dedup.first_candidates(line_dedup.some_tokens(lines)).count() <= 2 * 3000
    settled = line_dedup.settle(df, lines, 0.8, 5)
    assert settled.count() >= 2900
    assert line_dedup.all_candidates(lines, settled, 0.8).count() <= 100 * 3000


def test_line_dedup_tokens_that_do_not_stand_out(spark, monkeypatch):
    # 20 phrases in 100 lines each: as frequent as a bucket's other tokens together, so that buckets can't tell them.
    monkeypatch.setattr(line_dedup, "BUCKETS", 1 << 8)
    texts = [" ".join([f"a{i}-{k}" for k in range(12)] + [f"p{i % 20}-{k}" for k in range(6)] + [f"b{i}-{k}" for k in range(12)]) for i in range(2000)]
    df = spark.createDataFrame(list(enumerate(texts)), "_id long, _text string").withColumn("_th", line_dedup.F.xxhash64("_text"))
    frequent = line_dedup.frequent_buckets(df, 5)
    assert not frequent[0][0]
    lines = line_dedup.distinct_lines(df, frequent, 0.8, 5)
    none = spark.createDataFrame([], "late long")
    assert line_dedup.all_candidates(lines, none, 0.8).count() <= 2000


@pytest.mark.parametrize("many", [2, 4])
def test_line_dedup_crowded_tokens_match_brute_force(spark, monkeypatch, many):
    monkeypatch.setattr(line_dedup, "MANY", many)
    monkeypatch.setattr(line_dedup, "settle", lambda own, lines, *_: lines.where("false").selectExpr("lid as late"))  # all goes to the last join
    rng = random.Random(many)
    base = [[f"v{rng.randrange(400)}" for _ in range(rng.randint(5, 45))] for _ in range(50)]
    rows = []
    for i in range(200):
        w = list(rng.choice(base))
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = f"v{rng.randrange(400)}"
        if rng.random() < 0.3:
            w += rng.choice(base)[:8]
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.text for r in line_dedup.dedup_lines(df).collect()} == brute_lines(rows)


def test_line_dedup_lines_short_of_spare_tokens(spark):
    # 60 lines of each of 20 phrases, half of a line: those with too few spare tokens meet each other, not all lines.
    texts = [" ".join([f"a{i}-{k}" for k in range(13)] + [f"p{i % 20}-{k}" for k in range(28)] + [f"b{i}-{k}" for k in range(13)]) for i in range(1200)]
    df = spark.createDataFrame(list(enumerate(texts)), "_id long, _text string").withColumn("_th", line_dedup.F.xxhash64("_text"))
    lines = line_dedup.distinct_lines(df, line_dedup.frequent_buckets(df.limit(0), 5), 0.8, 5)
    assert line_dedup.all_candidates(lines, spark.createDataFrame([], "late long"), 0.8).count() <= 10_000


def test_line_dedup_group_below_the_threshold(spark):
    # 400 lines that share 71 of 96 tokens with each other: too few to match, so that no pair is a candidate.
    def text(i):
        return " ".join(f"x{i}-{k}" if (k - i % 7) in (10, 30, 50, 70, 85) else f"w{k}" for k in range(100))

    df = spark.createDataFrame([(i, text(i)) for i in range(400)], "_id long, _text string").withColumn("_th", line_dedup.F.xxhash64("_text"))
    lines = line_dedup.distinct_lines(df, line_dedup.frequent_buckets(df.limit(0), 5), 0.8, 5)
    assert lines.count() == 400
    assert line_dedup.all_candidates(lines, spark.createDataFrame([], "late long"), 0.8).count() <= 400


@pytest.mark.parametrize("threshold", [0.3, 0.5, 0.9])
def test_line_dedup_crowded_tokens_at_other_thresholds(spark, monkeypatch, threshold):
    monkeypatch.setattr(line_dedup, "MANY", 2)
    rng = random.Random(7)
    base = [[f"v{rng.randrange(300)}" for _ in range(rng.randint(5, 45))] for _ in range(12)]
    texts = []
    for _ in range(120):
        w = list(rng.choice(base))
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = f"v{rng.randrange(300)}"
        texts.append(" ".join(w[rng.randint(0, 2) :] if len(w) > 9 else w))
    texts = list(dict.fromkeys(texts))
    df = spark.createDataFrame(list(enumerate(texts)), "_id long, _text string").withColumn("_th", line_dedup.F.xxhash64("_text"))
    lines = line_dedup.distinct_lines(df, line_dedup.frequent_buckets(df, 5), threshold, 5)
    at = {r.lid: r.at.id for r in lines.collect()}
    got = {(at[r.x], at[r.y]) for r in line_dedup.all_candidates(lines, spark.createDataFrame([], "late long"), threshold).collect()}
    want = {(i, k) for k in range(len(texts)) for i in range(k) if _jaccard(texts[i], texts[k]) >= threshold}
    assert want and want <= got


def test_line_dedup_threshold(spark):
    words = [f"w{i}" for i in range(40)]
    line = lambda k: " ".join(words[: 40 - k] + [f"x{k}-{i}" for i in range(k)])
    docs = spark.createDataFrame([(k, line(k)) for k in range(8)], "doc_id long, text string")
    removed = {r.doc_id for r in line_dedup.dedup_lines(docs).collect() if r.n_removed}
    # 36 shingles each; k changed words at the end leave 36 - k in common with the first line.
    want = {k for k in range(1, 8) if any(_jaccard(line(j), line(k)) >= 0.8 for j in range(k))}
    assert removed == want and want and len(want) < 7


def _jaccard(a, b):
    s = [{tuple(x.split()[i : i + 5]) for i in range(len(x.split()) - 4)} for x in (a, b)]
    return len(s[0] & s[1]) / len(s[0] | s[1])


def test_url_edge_rows(spark):
    urls = [
        None, "", "no scheme", "http://", "HTTP://Example.COM/en/x?q#f", "http://a.www.example.com/en/", "http://xexample.com/en/", "http://b.net/es/1", "http://net/fr",
        "http://b.net/fr/#x", "x://y://com/", "http://com", "http://com?/",
    ]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)] + [(1, "")], "page_id long, url string").selectExpr(
        "*", "1 as host", "3 as verdict", *[f"{i} as {n}" for i, n in enumerate(("_short", "_k", "_key", "_host", "_path", "_verdict", "_row"))]
    )
    rules = spark.createDataFrame([*queries.URL_RULES, ("net", "/es/1", "allow"), ("net", "/es/1", "block"), (None, "/", "block")], "host string, path string, verdict string")
    got = {(r.page_id, r.host, r.path, r.rule, r.verdict) for r in url_filters.url_filters(pages, rules).collect()}
    assert got == {
        (0, "", "", None, "allow"), (1, "", "", None, "allow"), (2, "", "", None, "allow"), (3, "", "", None, "allow"), (4, "example.com", "/en/x", "example.com/en/", "block"),
        (5, "a.www.example.com", "/en/", "www.example.com/en/", "allow"), (6, "xexample.com", "/en/", "com/", "allow"), (7, "b.net", "/es/1", "net/es/1", "block"),
        (8, "net", "/fr", None, "allow"), (9, "b.net", "/fr/", "net/fr/", "block"), (10, "y:", "//com/", None, "allow"), (11, "com", "", None, "allow"), (12, "com", "", None, "allow"),
    }
    assert all((r._key, r._row) == (2, 6) for r in url_filters.url_filters(pages, rules).collect())
    long_ = spark.createDataFrame([(1, "http://" + "a." * 5000 + "net/es/" + "x/" * 100_000)], "page_id long, url string")
    assert url_filters.url_filters(long_, rules).first().rule == "net/es/"
    assert url_filters.url_filters(pages.where("page_id = 99"), rules).count() == 0
    assert url_filters.url_filters(pages, rules.where("1 = 0")).where("verdict <> 'allow'").count() == 0


def test_warc_round_trip(spark):
    big = "é" * 80
    rows = [(3, "http://a/\r\nx: y%", big), (1, None, big), (1, None, big), (7, "u", None), (8, "u", ""), (9, "v", "small"), (4, "v", "small"), (None, "w", big), (5, "z", "\r\n\r\nWARC/1.1\r\n" * 40_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as payload_bytes", "2 as archive")
    folder = shared_dir(spark, "test-warc")
    index = warc.write_archives(pages, folder)
    assert index.count() == len(rows) and index.select("archive", "offset").distinct().count() == len(rows)
    got = sorted((str(r.page_id), str(r.url), r.record_type, str(r.refers_to), r.html or "") for r in warc.read_records(index, folder).collect())
    want = [("3", rows[0][1], "revisit", "1", ""), ("1", "None", "response", "None", big), ("1", "None", "response", "None", big), ("None", "w", "revisit", "1", "")]
    want += [(str(i), u, "response", "None", h or "") for i, u, h in rows if i in (4, 5, 7, 8, 9)]
    assert got == sorted(want)
    again = [warc.parse(warc.record(1, None, b"x", 1, "d", "response", None, "a", at))[0]["WARC-Record-ID"] for at in (0, 9)]
    assert again[0] != again[1]  # a row that repeats in one archive
    some = warc.read_records(index.where("page_id = 5"), folder).collect()
    assert [r.page_id for r in some] == [5] and some[0].html == rows[-1][2]
    assert warc.round_trip(pages.where("page_id = 99")).count() == 0


def test_warc_damage_is_noticed(spark):
    pages = spark.createDataFrame([(1, "u", "text")], "page_id long, url string, html string")
    folder = shared_dir(spark, "test-warc")
    index = warc.write_archives(pages, folder).withColumn("payload_digest", warc.F.lit("0" * 64))
    with pytest.raises(Exception, match="indexed"):
        warc.read_records(index, folder).collect()


def water_fill(sizes, weights, cap=3):
    target, open_, left = {}, dict(weights), sum(sizes.values())
    while open_:
        level = left / sum(open_.values())
        over = [s for s in open_ if level * open_[s] > cap * sizes[s]]
        if not over:
            return target | {s: level * w for s, w in open_.items()}
        for s in over:
            target[s] = cap * sizes[s]
            left -= target[s]
            del open_[s]
    return target


def test_mixing(spark):
    docs = [(i, " ".join(["w"] * (i % 40)), "abcdefgh"[i % 8] if i % 11 else None) for i in range(3000)]
    docs += [(None, "x y", "a"), (5, "w " * 5, "f"), (5, "w " * 5, "f"), (9000, None, "empty"), (9001, "", "empty")]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string").selectExpr("*", "1 as size", "2 as block", "3 as shard")
    params = {"block_words": 500, "max_depth": 2}
    rows = mixing.mix_counts(df, **params).collect()
    sizes: Counter = Counter()
    for _, t, s in docs:
        sizes[s] += len((t or "").split())
    names = sorted(s for s in sizes if s is not None) + [None]
    want = water_fill(sizes, {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)})
    by_size = {}
    taken: Counter = Counter()
    source_of = {(d, len((t or "").split())): s for d, t, s in docs}
    for r in rows:
        s = source_of[r.doc_id, r.size]
        assert r.source_size == sizes[s] and abs(r.target - want[s]) < 1e-6 and r.taken <= 3 * r.size
        taken[s] += r.taken
        by_size[s] = r.target
    assert len(rows) == len(docs) and all(abs(taken[s] - want[s]) <= 45 for s in sizes)
    key = lambda r: (str(r.doc_id), r.size, r.taken)
    assert sorted(map(key, rows)) == sorted(map(key, mixing.mix_counts(df, **params).collect()))
    mixed = mixing.mix_sources(df, **params).collect()
    drawn: Counter = Counter()
    for r in mixed:
        drawn[source_of[r.doc_id, len((r.text or "").split())]] += len((r.text or "").split())
    assert {s: n for s, n in drawn.items() if n} == {s: n for s, n in taken.items() if n}
    assert {r.shard for r in mixed} == {0, 1, 2, 3}
    empty = df.where("doc_id = -1")
    assert mixing.mix_counts(empty).count() == 0 and mixing.mix_sources(empty).count() == 0


def test_splitting_tree_keeps_quotas(spark):
    draws = spark.createDataFrame([("a", 13), ("b", 1), (None, 30), ("c", 7)], "source string, n long")
    got = mixing.split_draws(draws, 3, 1).collect()
    total: Counter = Counter()
    shard: Counter = Counter()
    for r in got:
        total[r.source] += r.n
        shard[r.shard] += r.n
    assert total == {"a": 13, "b": 1, None: 30, "c": 7} and max(shard.values()) - min(shard.values()) <= 1


def brute_measures(text):
    words = (text or "").encode().split()
    words = [w.decode() for w in words]
    windows = Counter(zip(words, words[1:], words[2:], strict=False))
    hit = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if x.encode().split()]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(hit)


def test_quality_measures(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.doc_id: r for r in queries.op10_quality_rules(spark, "/root/testdata/sf0.01").collect()}
    for r in docs.collect():
        g = got[r.doc_id]
        want = brute_measures(r.text)
        assert (g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words) == want
        assert g.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0]) and not (g.base_failed and g.kept)
    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    good = [got[d].kept for d, q in labels.items() if q == 1 and not got[d].base_failed]
    bad = [got[d].kept for d, q in labels.items() if q == 0]
    assert sum(good) >= 0.98 * len(good) and sum(bad) <= 0.1 * len(bad)


def test_quality_edge_rows(spark):
    texts = [None, "", "a b a b a b", "a a a a", "x\nx\n \ny", "word " * 60, "##$ &&* " * 40, "Wort " * 30_000]
    docs = spark.createDataFrame([(i, t, None if i % 2 else "en", None) for i, t in enumerate(texts)] + [(1, "", "en", "s")], "doc_id long, text string, lang string, source string")
    docs = docs.selectExpr("*", "1 as n_words", "2 as kept", "3 as _lang", "'x' as reason")
    got = quality.quality_rules(docs, carry=["doc_id"]).collect()
    assert len(got) == len(texts) + 1
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute_measures(texts[r.doc_id])
    assert quality.quality_rules(docs.where("doc_id = 99")).count() == 0
    assert quality.quality_rules(docs.drop("lang", "source")).count() == len(texts) + 1


def test_sessions_without_a_shared_folder_are_told():
    from types import SimpleNamespace

    bare = SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: default), sparkContext=SimpleNamespace(getCheckpointDir=lambda: None))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_dir(bare, "x")
    bare.sparkContext.getCheckpointDir = lambda: "hdfs://c/dir/"
    assert shared_dir(bare, "x").startswith("hdfs://c/dir/x-")


def test_missing_columns_and_empty_tables_of_mixing_and_quality(spark):
    from dossier.llm import mixing, quality

    bare = spark.createDataFrame([(1, "x"), (2, None)], "size long, shard string")
    rows = mixing.mix_counts(bare).collect()
    assert [(r.doc_id, r["size"], r.taken) for r in rows] == [(None, 0, 0)] * 2
    assert mixing.mix_sources(bare).count() == 0
    rows = quality.quality_rules(bare).collect()
    assert sorted((r["size"], r.n_words, r.base_failed, r.kept, r.reason) for r in rows) == [(1, 0, True, False, "base"), (2, 0, True, False, "base")]
    assert mixing.mix_counts(bare.limit(0)).count() == 0 and mixing.mix_sources(bare.limit(0)).count() == 0
    assert quality.quality_rules(bare.limit(0)).count() == 0
