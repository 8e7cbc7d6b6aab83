import zlib

import numpy as np
import pytest

from dossier.llm import queries, token_files
from dossier.llm.common import shared_dir

SF = "/root/testdata/sf0.001"
ODD = [
    "", " ", None, "a  b", " a b ", "a\n\nb c", "x\ty z", "don't  stop\n now", "<|endoftext|> a<|endoftext|>", "é ñ 漢字 字\n漢", "a \nb",
    "🙂 🙂🙂 👩‍👩‍👧", "\x1c a\x1cb \x85 c", "a\r\nb c", "1 2 33 4's 's", "same same", "same same", "one two\n" * 3000, "x" * 70_000,
]


def brute(rows, end=2):
    """doc_id, start, n_tokens, ids_crc32 from one call a text, in order."""
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(queries.byte_tokenizer_path())
    at, out = 0, []
    for doc, text in rows:
        ids = [*tok.encode(text or "", add_special_tokens=False).ids, end]
        out.append((doc, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def test_query_against_the_tokenizer(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = queries.op11_token_files(spark, SF).collect()
    want = brute(sorted((r.doc_id, r.text) for r in docs))
    assert sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got) == want


def test_edge_rows(spark):
    ids = [None if i == 4 else 7 if i in (15, 16) else i for i in range(len(ODD))]
    docs = spark.createDataFrame(list(zip(ids, ODD)), "doc_id long, text string").selectExpr("*", "1 as ids", "2 as _id", "3 as _text")
    path = queries.byte_tokenizer_path()
    got = token_files.round_trip(docs, tokenizer_path=path, end_id=2).orderBy("start").collect()
    assert [r.doc_id for r in got] == [*sorted(i for i in ids if i is not None), None]
    assert [r.start for r in got] == [0, *np.cumsum([r.n_tokens for r in got])[:-1].tolist()]
    want = sorted((str(doc), n, crc) for doc, _, n, crc in brute(zip(ids, ODD)))
    assert sorted((str(r.doc_id), r.n_tokens, zlib.crc32(r.ids)) for r in got) == want
    empty = token_files.round_trip(docs.where("doc_id = -1"), tokenizer_path=path, end_id=2)
    assert empty.columns == ["doc_id", "start", "n_tokens", "ids"] and empty.count() == 0
    assert [(r.doc_id, r.n_tokens) for r in token_files.round_trip(docs.select("doc_id").where("doc_id < 2"), tokenizer_path=path, end_id=2).collect()] == [(0, 1), (1, 1)]


@pytest.fixture
def many_parts(spark):
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(key, "false")
    yield
    spark.conf.unset(key)


def test_files_map_and_wide_ids(spark, many_parts):
    """Random access outside Spark; an end id beyond 16 bits makes files of 32 bits."""
    docs = spark.createDataFrame([(i, f"text number {i}") for i in range(300)], "doc_id long, text string")
    for end, kind in ((2, "<u2"), (70_000, "<u4")):
        folder = shared_dir(spark, "tokens")
        manifest = token_files.write_tokens(docs, folder, tokenizer_path=queries.byte_tokenizer_path(), end_id=end).collect()
        files = token_files.TokenFiles(folder, manifest)
        assert len(manifest) > 1 and len(files) == 300
        part = token_files.TokenPart(folder, manifest[0]["name"])
        assert isinstance(part.data, np.memmap) and part.data.dtype == np.dtype(kind)
        tok = token_files.tokenizer_for(queries.byte_tokenizer_path(), end).tokenizer
        for k in (0, 17, 299):
            assert files[k].tolist() == [*tok.encode(f"text number {k}").ids, end]
        with pytest.raises(IndexError):
            files[300]


def test_prefix_sums_over_blocks(spark):
    n = 2 * token_files.BLOCK + 5
    df = token_files.prefix_sums(spark.range(n).selectExpr("id as part", "id % 7 as v"), "part", base="v")
    want = np.concatenate([[0], np.cumsum(np.arange(n) % 7)[:-1]])
    assert [r.base for r in df.orderBy("part").collect()] == want.tolist()
