import zlib
from collections import defaultdict

import numpy as np
import pytest

from dossier.llm import packing
from dossier.llm.queries import tokenizer_path

SF = "/root/testdata/sf0.001"


def brute_pieces(rows, capacity):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path())
    out = []
    for doc, text in rows:
        ids = [*tok.encode(text or "", add_special_tokens=False).ids, 0]
        for k, at in enumerate(range(0, len(ids), capacity)):
            cut = ids[at : at + capacity]
            out.append((doc, k, at, len(cut), zlib.crc32(np.array(cut, "<u4").tobytes())))
    return out


def check(spark, docs, capacity=2048):
    got = packing.pack(docs, tokenizer_path=tokenizer_path(), capacity=capacity).collect()
    want = brute_pieces([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()], capacity)
    assert sorted(map(str, [(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got])) == sorted(map(str, want))
    by = defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for off, n in sorted(parts):
            assert off == at
            at += n
        assert at <= capacity
    return len(by), -(-sum(r.length for r in got) // capacity)


def test_pieces_and_sequences(spark):
    n, least = check(spark, spark.read.parquet(f"{SF}/documents.parquet"))
    assert n <= 1.02 * least + 1


def test_edge_rows(spark):
    texts = ["", None, "Ein Wort zwei drei 's don't", "x" * 5000, "<|endoftext|> á b", "same", "same", "one two " * 3000]
    docs = spark.createDataFrame([(i if i else None, t) for i, t in enumerate(texts)], "doc_id long, text string")
    check(spark, docs.selectExpr("*", "1 as length", "2 as _id"), 64)
    assert packing.pack(docs.where("doc_id = -1"), tokenizer_path=tokenizer_path()).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_plan_uses_up_the_histogram(seed):
    rng = np.random.default_rng(seed)
    h = rng.poisson(rng.gamma(0.3, 20, 257))
    h[0] = 0
    used, sequences = np.zeros_like(h), 0
    for p, times in packing.plan(h):
        assert sum(p) <= 256 and times > 0
        sequences += times
        for a in p:
            used[a] += times
    assert (used == h).all()
    assert sequences <= sum(times for _, times in packing.best_fit(h))


def test_nnls_never_goes_below_zero():
    h = np.array([0, 5, 0, 9, 2])
    assert (packing.nnls([(3, 1), (1, 1), (2, 1, 1)], h) >= 0).all()
