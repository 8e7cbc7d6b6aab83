import hashlib
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from dossier.llm import periods, queries

SF = "/root/testdata/sf0.001"


def brute_runs(x, least=6, exponent=4):
    """All runs from every period: maximal stretches of equality q apart, kept if no smaller period fits."""
    x, out = np.asarray(x), []
    for q in range(1, len(x) // exponent + 1):
        same = np.concatenate([[False], x[:-q] == x[q:], [False]])
        turns = np.flatnonzero(same[1:] != same[:-1])
        for a, b in zip(turns[::2].tolist(), turns[1::2].tolist()):
            n = b - a + q
            if n >= max(least, exponent * q) and not any((x[a : a + n - p] == x[a + p : a + n]).all() for p in range(1, q)):
                out.append((a, n, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute_row(doc, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(w), None if doc is None else zlib.crc32(str(doc).encode())
    if n and h is not None and h % 10 == 0:
        g = h // 10
        a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
        w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
    runs = brute_runs(np.unique(w, return_inverse=True)[1] if w else [])
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (
        doc, len(runs), *(best if best else (None,) * 3), best and 1000 * best[1] // best[2],
        sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)),
    )


def rows(df):
    cols = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    return sorted(map(str, [tuple(r[c] for c in cols) for r in df.collect()]))


def test_query_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want = [brute_row(r.doc_id, r.text) for r in docs]
    assert sum(r[1] > 0 for r in want) > 5
    assert rows(queries.op12_periodic_runs(spark, SF)) == sorted(map(str, want))


def planted(rng):
    """A sequence of stretches with periods of its own, nested and overlapping, over few or many letters."""
    parts = []
    for _ in range(rng.integers(1, 6)):
        word = rng.integers(0, rng.choice([2, 3, 200]), rng.integers(1, 40))
        if rng.random() < 0.5:
            word = np.tile(word[:3], 6)[: max(1, len(word))]
        parts.append(np.resize(word, rng.integers(1, 9 * len(word))))
        parts.append(rng.integers(0, rng.choice([1, 2, 5, 300]), rng.integers(0, 30)))
    return np.concatenate(parts)


@pytest.mark.parametrize("seed", range(40))
def test_runs_against_brute_force(seed):
    rng = np.random.default_rng(seed)
    texts = [planted(rng) for _ in range(12)] + [np.zeros(0, int), np.zeros(1, int), np.zeros(6, int), np.zeros(500, int)]
    assert periods.find_runs(texts) == [brute_runs(t) for t in texts]
    assert periods.find_runs(texts, 4, 3) == [brute_runs(t, 4, 3) for t in texts]
    far = [t + 10**6 * (t > 1) for t in texts]  # numbers whose squares need several primes
    assert periods.find_runs(far) == [brute_runs(t) for t in texts]


@pytest.mark.parametrize("p,e,root", periods.PRIMES)
def test_transforms_convolve(p, e, root):
    assert all(p % k for k in range(2, 50_000)) and pow(root, (p - 1) // 2, p) == p - 1 and (p - 1) % (1 << e) == 0
    rng = np.random.default_rng(1)
    for n in (2, 4, 64):
        a, b = rng.integers(0, p, (3, n)), rng.integers(0, p, (3, n))
        got = periods.inverse_ntt(periods.ntt(a.copy(), p, root) * periods.ntt(b.copy(), p, root) % p, p, root)
        want = [[sum(int(a[r, i]) * int(b[r, (k - i) % n]) for i in range(n)) % p for k in range(n)] for r in range(3)]
        assert got.tolist() == want


def test_edge_rows(spark):
    texts = [None, "", " \t\n", "a " * 6, "a b " * 3 + "a", "a b " * 4, "x y z " * 9, "w" * 100_000, "a b c " * 20_000, "a " * 6]
    docs = spark.createDataFrame([(None if i == 5 else i, t) for i, t in enumerate(texts)] + [(3, "a " * 6)], "doc_id long, text string")
    got = periods.collapse_runs(docs.selectExpr("*", "1 as runs", "2 as id", "3 as _w"))
    assert got.columns == ["doc_id", "runs", "best", "collapsed"]
    found = sorted((str(r.doc_id), [tuple(x) for x in r.runs], r.collapsed) for r in got.collect())
    want = [[], [], [], [(0, 6, 1)], [], [(0, 8, 2)], [(0, 18, 2)], [], [(0, 60_000, 3)], [(0, 6, 1)]]
    flat = ["", "", "", "a", "a b a b a b a", "a b", "x y z", "w" * 100_000, "a b c", "a"]
    ids = [str(None if i == 5 else i) for i in range(len(texts))]
    assert found == sorted([*zip(ids, want, flat), ("3", [(0, 6, 1)], "a")])
    assert periods.collapse_runs(docs.where("doc_id = -1")).count() == 0
    assert [r.collapsed for r in periods.collapse_runs(docs.select("doc_id").limit(1)).collect()] == [""]
    again = periods.plant_tails(docs)
    assert again.columns == docs.columns and again.where("doc_id is null").first().text == "a b " * 4
