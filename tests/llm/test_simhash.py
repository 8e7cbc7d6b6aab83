import numpy as np
import pytest
from xxhash import xxh64_intdigest

from dossier.llm import simhash
from dossier.llm.components import components

SF = "/root/testdata/sf0.01"


def brute_print(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    k = min(4, len(words))
    hs = [xxh64_intdigest(b" ".join(words[i : i + k]), 42) for i in range(len(words) - k + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_groups(rows):
    """(id, fingerprint) pairs to the smallest id that each row's fingerprint reaches."""
    fps = sorted({f for _, f in rows})
    root = {f: f for f in fps}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    arr = np.array(fps, np.uint64)
    for i, f in enumerate(fps):
        for j in np.nonzero(np.bitwise_count(arr[i + 1 :] ^ arr[i]) <= 4)[0]:
            root[max(find(f), find(fps[i + 1 + j]))] = min(find(f), find(fps[i + 1 + j]))
    best = {}
    for d, f in rows:
        r = find(f)
        if d is not None:
            best[r] = min(best.get(r, d), d)
    return {f: best.get(find(f)) for f in fps}


def check(spark, docs, monkeypatch=None):
    rows = docs.select("doc_id", "text").collect()
    prints = [(r.doc_id, brute_print(r.text)) for r in rows]
    want = brute_groups(prints)
    got = simhash.simhash_groups(docs).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.fingerprint, str(r.component_id)) for r in got) == sorted(
        (d is None, d or 0, f"{f:016x}", str(want[f])) for d, f in prints
    )
    return got


def test_matches_brute_force(spark):
    check(spark, spark.read.parquet(f"{SF}/documents.parquet"))


@pytest.mark.parametrize("cell", [8192, 16])
def test_trees_and_cells_lose_no_link(spark, monkeypatch, cell):
    monkeypatch.setattr(simhash, "LEAF", 32)
    monkeypatch.setattr(simhash, "CELL", cell)
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 400, dtype=np.uint64)
    fps = [int(x) for x in base]
    for x in base[:150]:
        bits = rng.choice(64, rng.integers(1, 7), replace=False)
        fps.append(int(x) ^ int(sum(1 << int(b) for b in bits)))
    dense = int(base[0])
    fps += [dense ^ (1 << a) ^ (1 << b) for a in range(12) for b in range(a)]
    rows = [(i, int(np.uint64(f).astype(np.int64))) for i, f in enumerate(fps)]
    df = spark.createDataFrame(rows, "doc_id long, _fp long")
    want = brute_groups([(i, f % 2**64) for i, f in rows])
    got = simhash.fingerprint_groups(df, "doc_id").collect()
    assert {r._gfp % 2**64: r.component_id for r in got} == want
    assert sum(r._first for r in got) == len(set(want.values()))


def test_shards_keep_every_near_pair_together():
    rng = np.random.default_rng(8)
    x = rng.integers(0, 2**63, 3000, dtype=np.uint64)
    y = x ^ (np.uint64(1) << rng.integers(0, 21, 3000).astype(np.uint64))
    mask = simhash.masks(simhash.GROUPS)[0]
    tree = simhash.fit_tree(x, mask, 1, 40)
    assert len(tree) > 30
    mine, its = [set() for _ in x], [set() for _ in x]
    for fps, out in ((x, mine), (y, its)):
        for row, leaf in zip(*simhash.shards_of(fps, tree, mask, 1), strict=True):
            out[row].add(int(leaf))
    assert all(a & b for a, b in zip(mine, its, strict=True))


def test_nulls_empty_and_repeated(spark):
    docs = spark.createDataFrame(
        [(1, ""), (None, None), (7, "A b c d e"), (8, "a B c d e"), (8, "a B c d e"), (9, "one"), (None, "only null id here")],
        "doc_id long, text string",
    )
    check(spark, docs)
    names = ["_fp", "component_id", "_gfp", "_cid", "_afp", "_aid", "_id", "_row", "_text", "_first"]
    kept = simhash.simhash_dedup(docs.selectExpr("*", *[f"{i} as {n}" for i, n in enumerate(names)])).collect()
    assert all(r[n] == i for r in kept for i, n in enumerate(names))
    assert sorted(str(r.doc_id) for r in kept) == ["1", "7", "9", "None"]
    empty = docs.where("doc_id = -1")
    assert simhash.simhash_groups(empty).count() == 0 and simhash.simhash_dedup(empty).count() == 0


def test_components(spark):
    rng = np.random.default_rng(1)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 400, (300, 2))] + [(500 + i, 501 + i) for i in range(40)]
    got = {r.node: r.component for r in components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    root = {x: x for p in pairs for x in p}
    for _ in range(50):
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    assert got == {x: root[x] for p in pairs for x in p if p[0] != p[1]}
