import math
import zlib
from collections import Counter

import numpy as np

from dossier.llm import ppm

SF = "/root/testdata/sf0.001"


def brute_base(rows):
    train = Counter()
    for d, t in rows:
        if d is None or zlib.crc32(str(d).encode()) % 10:
            train.update([*(t or "").encode().lower().split(), b""])
    n, v = sum(train.values()), len(train)
    out = []
    for d, t in rows:
        w = [*(t or "").encode().lower().split(), b""]
        s = sum(math.log10((train[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w)
        out.append((d, len(w), sum(x in train for x in w), n, s))
    return out


def brute_ppm(train, order, least):
    """Probability of a symbol after a context by the recursive definition, over dictionaries."""
    counts = [Counter() for _ in range(order + 1)]
    for t in train:
        s = [256] * order + list(t) + [256]
        for i in range(order, len(s)):
            for k in range(order + 1):
                counts[k][tuple(s[i - k : i + 1])] += 1
    kept, total, kinds = [], [], []
    for c in counts:
        kept.append({g: n for g, n in c.items() if n >= least})
        total.append(Counter())
        for g, n in c.items():
            total[-1][g[:-1]] += n
        kinds.append(Counter(g[:-1] for g in kept[-1]))

    def p(ctx, s, k):
        if k < 0:
            return 1 / 257
        ctx = ctx[len(ctx) - k :]
        q = kinds[k][ctx]
        if not q:
            return p(ctx, s, k - 1)
        if ctx + (s,) in kept[k]:
            return (kept[k][ctx + (s,)] - 0.5) / total[k][ctx]
        mine = [x for x in range(257) if ctx + (x,) in kept[k]]
        n = sum(kept[k][ctx + (x,)] for x in mine)
        escape = (total[k][ctx] - n + q / 2) / total[k][ctx]
        return escape * p(ctx, s, k - 1) / (1 - sum(p(ctx, x, k - 1) for x in mine))

    return p


def model_costs(train, asked, order):
    """Log probabilities of the asked grams, by the operator's own parts."""
    g, n = ppm.chunk_grams([*train, *asked], np.array([True] * len(train) + [False] * len(asked)), order)
    low_order = min(ppm.LOW, order)
    low = [np.unique(x, return_counts=True) for x, _ in ppm.pieces(train, low_order)]
    root = ppm.Low(*ppm.summed(*map(np.concatenate, zip(*low, strict=True))), low_order)
    out = np.empty(len(g))
    part = ppm.part_of(g, 5, order)
    for k in range(5):
        out[part == k] = ppm.branch_costs(g[part == k], n[part == k], root, order)
    return g, out


def test_branches_match_the_definition():
    train = [b"abracadabra", b"abrasion", b"bar bar bar", b""]
    for order in (0, 1, 2, 3, 5):
        p = brute_ppm(train, order, 2)
        for text in (b"abra", b"barn\xc3\xa9", b""):
            keys, cost = model_costs(train, [text], order)
            g = np.concatenate([x for x, _ in ppm.pieces([text], order)])
            s = [256] * order + list(text) + [256]
            want = [math.log(p(tuple(s[i : i + order]), s[i + order], order)) for i in range(len(text) + 1)]
            assert np.allclose(cost[np.searchsorted(keys, g)], want, atol=1e-9)


def test_packed_arrays_come_back():
    for x in (np.array([], np.uint64), np.array([0, 1, 2**63], np.uint64), np.arange(1000, dtype=np.uint32)):
        assert (ppm.unpacked(ppm.packed(x), x.dtype) == x).all()


def test_pieces_cut_long_texts(monkeypatch):
    texts = [b"abc" * 100, b"", b"x", b"yz" * 77]
    whole = {}
    for stride in (10**6, 64):
        monkeypatch.setattr(ppm, "STRIDE", stride)
        got = [(int(o), int(g)) for gs, owner in ppm.pieces(texts, 4) for g, o in zip(gs, owner, strict=True)]
        whole[stride] = got
        assert Counter(o for o, _ in got) == {k: len(t) + 1 for k, t in enumerate(texts)}
    assert sorted(whole[64]) == sorted(whole[10**6])


def test_whole_table(spark, monkeypatch):
    monkeypatch.setattr(ppm, "CHUNK", 1 << 15)  # many chunks and parts
    monkeypatch.setattr(ppm, "PART", 1 << 14)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r.doc_id: r for r in ppm.score_texts(docs).collect()}
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    for d, n, known, total, base in brute_base(rows):
        r = got[d]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n, known, total)
        assert math.isclose(r.base_score, base, rel_tol=1e-9)
        assert r.held_out == (zlib.crc32(str(d).encode()) % 10 == 0) and r.score < 0


def test_held_out_texts_score_above_the_base(spark):
    rows = ppm.score_texts(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).collect()
    held = [r for r in rows if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_edge_rows(spark):
    docs = spark.createDataFrame([(1, None), (None, "a b"), (3, ""), (3, ""), (4, "ab " * 300_000)], "doc_id long, text string")
    docs = docs.selectExpr("*", "1 as _text", "2 as row", "3 as held_out")
    got = ppm.score_texts(docs.select("doc_id", "text", "row")).collect()
    want = brute_base([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    key = lambda x: tuple(map(str, x))
    assert sorted(map(key, [(r.doc_id, r.n_tokens, r.n_known, r.train_tokens) for r in got])) == sorted(map(key, [w[:4] for w in want]))
    assert ppm.score_texts(docs.where("doc_id = 99")).count() == 0
    assert ppm.score_texts(docs).count() == 5


def test_scores_match_the_definition(spark):
    texts = ["abracadabra", "abrasion", "bar bar bar", "", "Abba", "sonar\xe9", "bra", "zoo"] * 3
    rows = [*enumerate(texts), (None, None)]
    train = [(t or "").lower().encode() for d, t in rows if d is None or zlib.crc32(str(d).encode()) % 10]
    assert len(train) < len(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for order in (2, 5):
        p = brute_ppm(train, order, 2)
        got = {r.doc_id: r.score for r in ppm.score_texts(docs, order=order).collect()}
        for d, text in rows:
            s = [256] * order + list((text or "").lower().encode()) + [256]
            want = sum(math.log10(p(tuple(s[i : i + order]), s[i + order], order)) for i in range(len(s) - order))
            assert math.isclose(got[d], want, rel_tol=1e-5)
