"""Top-k searches by thresholds against scoring every pair."""

import math
import random
from collections import Counter, defaultdict

import pytest

from dossier.operators import retrieval


def brute(docs, queries, most, min_weight=0.0, kinds=None):
    n, avg = len(docs), sum(map(len, docs.values())) / len(docs)
    df = Counter(t for ts in docs.values() for t in set(ts))
    out = {}
    for q, terms in queries.items():
        rows = []
        for d, ts in docs.items():
            tf = Counter(ts)
            w = [math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * tf[t] * 2.2 / (tf[t] + 1.2 * (0.25 + 0.75 * len(ts) / avg)) for t in set(terms) if tf[t]]
            if w and max(w) >= min_weight and (kinds is None or d in kinds):
                rows.append((-round(sum(w), 9), d))
        out[q] = [d for _, d in sorted(rows)[:most]]
    return {q: ds for q, ds in out.items() if ds}


@pytest.mark.parametrize("seed", range(3))
def test_bm25_against_all_pairs(spark, seed, monkeypatch):
    rng = random.Random(seed)
    word = lambda: f"w{int(rng.paretovariate(0.7)) % 400}"  # noqa: E731  few words are frequent
    docs = {i: [word() for _ in range(rng.choice([1, 5, 30, 80]))] for i in range(400)}
    queries = {q: [word() for _ in range(rng.choice([1, 3, 12]))] for q in range(25)} | {98: docs[3][:6], 99: ["absent"]}
    pairs = []
    scored = retrieval.scored
    monkeypatch.setattr(retrieval, "scored", lambda p, *a: pairs.append(p.count()) or scored(p, *a))
    for most, least, kinds in ((3, 0.0, None), (5, 2.0, None), (4, 0.0, set(range(0, 400, 3)))):
        post = spark.createDataFrame([(d, t, n, len(ts)) for d, ts in docs.items() for t, n in Counter(ts).items()], "doc int, term string, tf int, len int")
        asked = spark.createDataFrame([(q, t) for q, ts in queries.items() for t in ts], "query int, term string")
        only = None if kinds is None else spark.createDataFrame([(d,) for d in kinds], "doc int")
        got = defaultdict(list)
        for r in retrieval.bm25_search(post, asked, kinds=only, most=most, min_weight=least).orderBy("query", "rank").collect():
            got[r.query].append(r.doc)
            assert set(r.terms) == set(queries[r.query]) & set(docs[r.doc])
        assert got == brute(docs, queries, most, least, kinds)
    share = sum(bool(set(ts) & set(q)) for ts in docs.values() for q in queries.values())
    assert pairs[1] < share  # not every pair that shares a word is scored


def test_overlaps_keep_ties_and_bonuses(spark):
    sets = {1: "a b c d", 2: "a b c", 3: "b c d", 4: "d", 5: "e", 6: "a b"}
    index = spark.createDataFrame([(d, t, 1.0) for d, s in sets.items() for t in s.split()], "doc int, term string, w double")
    asked = spark.createDataFrame([("q", t) for t in "abcd"], "query string, term string")
    rows = lambda df: sorted((r.doc, r.score) for r in df.collect())
    assert rows(retrieval.top_scores(asked, index, 2)) == [(1, 4.0), (2, 3.0), (3, 3.0)]
    bonus = spark.createDataFrame([("q", 5, 3.5), ("q", 4, 0.5)], "query string, doc int, bonus double")
    assert rows(retrieval.top_scores(asked, index, 2, bonus=bonus)) == [(1, 4.0), (5, 3.5)]
    assert retrieval.top_scores(asked, index.where("doc = 5"), 2).count() == 0


def test_only_pairs_that_reach_the_threshold_are_looked_up(spark, monkeypatch):
    """All documents share a word with all queries, so that every pair was a candidate and met all terms of its query."""
    pairs = []
    scored = retrieval.scored
    monkeypatch.setattr(retrieval, "scored", lambda p, *a: pairs.append(p.count()) or scored(p, *a))
    index = spark.createDataFrame([(d, t, 1.0) for d in range(500) for t in ["all", "both"] + [f"r{d}"] * (d < 8)], "doc int, term string, w double")
    asked = spark.createDataFrame([(q, t) for q in range(4) for t in ["all", "both", "r1", "r2", "r5"]], "query int, term string")
    got = retrieval.top_scores(asked, index, 3)
    assert sorted((r.query, r.doc, r.score) for r in got.collect()) == [(q, d, 3.0) for q in range(4) for d in (1, 2, 5)]
    assert pairs[0] <= 4 * 48 and pairs[1] == 12


def test_scope_of_whole_repositories(spark):
    """Tasks without a shared file take all commits of their repositories, each once; those of one repository without a
    distinct over the pairs."""
    tasks = spark.createDataFrame([(1, "a", "x"), (1, "a", "y"), (2, "a", "x"), (2, "b", "x"), (3, "b", "f"), (4, None, "x")], "task long, repo string, path string")
    files = spark.createDataFrame([("a", 10, "f"), ("a", 10, "g"), ("a", 11, "f"), ("b", 11, "f"), ("b", 12, "h")], "repo string, sha long, path string")
    hits = spark.createDataFrame([(3, 7, 1), (2, 7, 1)], "task long, doc long, rank int")
    units = spark.createDataFrame([(7, "b", 12)], "doc long, repo string, sha long")
    got = retrieval.context_scope(tasks, files, hits, units)
    assert sorted(map(tuple, got.collect())) == [(1, 10), (1, 11), (2, 10), (2, 11), (2, 12), (3, 11), (3, 12)]
    top = got._jdf.queryExecution().optimizedPlan().toString().splitlines()[0]
    assert top.startswith("Union")
