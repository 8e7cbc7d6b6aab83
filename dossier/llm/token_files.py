"""Token-ID files: flat unsigned integers and 64-bit document offsets, memory-mapped.

Writing, documents are range-partitioned and sorted by id; each task tokenizes its run of documents into one flat file
of little-endian unsigned integers (16 bits where the vocabulary allows, else 32) and one index file of 64-bit document
offsets and ids, and returns a manifest row. Prefix sums over the manifest give each part the number of documents and
ids before it, so that no task needs to know what others have written. Only the manifest row of a task that ended names
its files, so files of lost or repeated tasks are never read. Reading, stretches of documents are dealt out, and each
task maps the files it needs into memory.

An index file holds a header of 32 bytes (magic, width of an id in bytes, documents, documents without an id, which come
last), then documents + 1 offsets in ids from the file's start, then the documents' ids, all little-endian 64-bit.
"""

from __future__ import annotations

import bisect
import re
import string
import struct
import uuid

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ensure_columns, shared_dir, stored

MAGIC, HEADER, HEADER_BYTES = b"TOKFILE1", "<8sQQQ", 32
MANIFEST = "part long, name string, n_docs long, n_tokens long"
STRETCH, BLOCK = 1 << 14, 1 << 10
#: A place where the tokenizer's pattern always parts a text: before a single space between other characters.
CUT = re.compile(r"(?<=\S)(?= \S)")
PUNCTUATION = string.punctuation


class ByteTokenizer:
    """A byte-level tokenizer that parts texts at white space, applied to each distinct piece once.

    A text is cut where the tokenizer's own pattern cuts it in any case (before a single space, and around a single line
    feed, between other characters), so its ids are those of its pieces in order. Texts that may hold a special token go
    through the tokenizer whole. Ids are kept as little-endian bytes of ``dtype``.
    """

    def __init__(self, path: str, end_id: int, most: int = 600_000, longest: int = 64):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocab = self.tokenizer.get_vocab()
        top = max(*vocab.values(), end_id)
        self.dtype = np.dtype("<u2" if top < 1 << 16 else "<u4")
        #: Bytes of text that a token stands for: one for each letter of its name.
        self.bytes_of = np.zeros(top + 1, np.int64)
        for token, i in vocab.items():
            self.bytes_of[i] = len(token)
        self.most, self.longest = most, longest
        #: Ids of pieces that start a text or line, and of pieces after a space (without that space).
        self.first: dict[str, bytes] = {}
        self.rest: dict[str, bytes] = {}
        self.older: tuple[dict[str, bytes], dict[str, bytes]] = ({}, {})
        #: Ids of punctuation behind a word.
        self.tails: dict[str, bytes] = {}
        self.feed = self._one("\n")

    def _one(self, text: str) -> bytes:
        return self._ids(text).tobytes()

    def _ids(self, text: str) -> np.ndarray:
        # The fast form leaves out offsets, which are not needed here.
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.dtype)

    def _learn(self, known: dict[str, bytes], new: set[str], mark: str) -> None:
        """Ids of new pieces: a word and the punctuation behind it, which the pattern always parts, one by one."""
        plain, ending = set(), []
        for w in new:
            stem = w.rstrip(PUNCTUATION)
            if len(stem) == len(w) or len(w) > self.longest or not stem[-1:].isalnum():
                plain.add(w)
            else:
                ending.append((w, stem))
                if stem not in known:
                    plain.add(stem)
        self._encode(known, sorted(plain), mark)
        for w, stem in ending:
            tail = w[len(stem) :]
            if tail not in self.tails:
                self.tails[tail] = self._one(tail)
            known[w] = known[stem] + self.tails[tail]

    def _encode(self, known: dict[str, bytes], new: list[str], mark: str) -> None:
        """Ids of new pieces, many in one call: ``mark`` (a space or a line feed) is put before each."""
        for at in range(0, len(new), 256):
            part = new[at : at + 256]
            joined = mark + mark.join(part)
            ids = self._ids(joined)
            after = np.cumsum(self.bytes_of[ids])
            size = np.fromiter(map(len, part if joined.isascii() else [w.encode("utf-8") for w in part]), np.int64, len(part)) + 1
            stop = np.cumsum(size)
            # Where a space belongs to its piece, a piece starts with it; a line feed is a token of its own.
            start = stop - size + (mark == "\n")
            lo, hi = np.searchsorted(after, start, side="right"), np.searchsorted(after, stop, side="right")
            ok = (hi > 0) & (after[hi - 1] == stop) & ((start == 0) | ((lo > 0) & (after[lo - 1] == start)))
            width, data = self.dtype.itemsize, ids.tobytes()
            for w, a, b, good in zip(part, lo.tolist(), hi.tolist(), ok.tolist(), strict=True):
                known[w] = data[width * a : width * b] if good else self._one(w if mark == "\n" else mark + w)

    def pieces(self, text: str) -> list[list[str]] | None:
        """The lines of a text as lists of words, or None where white space is not just single spaces and line feeds."""
        out = []
        for line in text.split("\n"):
            words = line.split()
            if not words or " ".join(words) != line:
                return None
            out.append(words)
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        plan, first, rest, odd = [], set(), set(), set()
        for text in texts:
            if not text or "<|" in text:
                plan.append(None)
                continue
            lines = self.pieces(text)
            if lines is None:
                cut = CUT.split(text)
                lines = [[cut[0], *(w[1:] for w in cut[1:])]]
                odd.update(w for w in lines[0] if w != w.strip())
            plan.append(lines)
            for words in lines:
                first.add(words[0])
                rest.update(words[1:])
        if len(self.first) + len(self.rest) > self.most:
            # The full tables become the older generation; what texts ask for again comes back from it.
            self.older, self.first, self.rest = (self.first, self.rest), {}, {}
            self.tails.clear()
        for known, old, new in ((self.first, self.older[0], first), (self.rest, self.older[1], rest)):
            new.difference_update(known)
            again = old.keys() & new
            known.update(zip(again, map(old.__getitem__, again), strict=True))
            new -= again
        for known, new, mark in ((self.first, first, "\n"), (self.rest, rest, " ")):
            self._learn(known, new - odd if odd else new, mark)
            known.update((w, self._one(w if mark == "\n" else mark + w)) for w in new & odd)
        out = []
        for text, lines in zip(texts, plan, strict=True):
            if lines is None:
                out.append(self._one(text) if text else b"")
            else:
                get = self.rest.__getitem__
                out.append(self.feed.join([self.first[w[0]] + b"".join(map(get, w[1:])) for w in lines]))
        for known, new in ((self.first, first), (self.rest, rest)):
            for w in new:
                if len(w) > self.longest:
                    del known[w]
        return out


_KEPT: dict[tuple[str, int], ByteTokenizer] = {}


def tokenizer_for(path: str, end_id: int) -> ByteTokenizer:
    """The worker's tokenizer: the pieces that it has learned serve its later tasks."""
    if (path, end_id) not in _KEPT:
        _KEPT[path, end_id] = ByteTokenizer(path, end_id)
    return _KEPT[path, end_id]


def _open(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def _mapped(store, path: str) -> np.ndarray:
    """A file's bytes: mapped into memory on a file system that allows it, else read."""
    from pyarrow import fs

    if isinstance(store, fs.LocalFileSystem):
        return np.memmap(path, np.uint8, mode="r")
    with store.open_input_file(path) as f:
        return np.frombuffer(f.read(), np.uint8)


class TokenPart:
    """One part's files, mapped: ``tokens(k)`` are the ids of its document k, ``doc_id(k)`` its id."""

    def __init__(self, folder: str, name: str):
        store, path = _open(folder)
        index = _mapped(store, f"{path}/{name}.idx")
        magic, width, self.n_docs, n_null = struct.unpack(HEADER, index[:HEADER_BYTES].tobytes())
        if magic != MAGIC:
            raise ValueError(f"{name}.idx is not an index of token files")
        numbers = index[HEADER_BYTES:].view("<i8")
        self.offsets, self.ids = numbers[: self.n_docs + 1], numbers[self.n_docs + 1 :]
        self.named = self.n_docs - n_null
        self.data = _mapped(store, f"{path}/{name}.bin").view(f"<u{width}")
        if len(self.data) != self.offsets[-1] or len(self.ids) != self.n_docs:
            raise ValueError(f"{name}: files are cut short")

    def tokens(self, k: int) -> np.ndarray:
        return self.data[self.offsets[k] : self.offsets[k + 1]]

    def doc_id(self, k: int) -> int | None:
        return int(self.ids[k]) if k < self.named else None


class TokenFiles:
    """Random access for a reader outside Spark: document k of all parts, given the manifest's rows."""

    def __init__(self, folder: str, manifest: list):
        self.folder, self.rows = folder, sorted(manifest, key=lambda r: r["base_doc"])
        self.bases = [r["base_doc"] for r in self.rows]
        self.open: dict[str, TokenPart] = {}

    def __len__(self) -> int:
        return sum(r["n_docs"] for r in self.rows)

    def __getitem__(self, k: int) -> np.ndarray:
        if not 0 <= k < len(self):
            raise IndexError(k)
        row = self.rows[bisect.bisect_right(self.bases, k) - 1]
        if row["name"] not in self.open:
            self.open[row["name"]] = TokenPart(self.folder, row["name"])
        return self.open[row["name"]].tokens(k - row["base_doc"])


def prefix_sums(df: DataFrame, order: str, **bases: str) -> DataFrame:
    """Adds, for each ``base=value``, the sum of ``value`` over the rows of smaller ``order`` (whole numbers from 0).

    Two levels: sums within blocks of 1,024 rows, and over the blocks before.
    """
    df = df.withColumn("_block", F.floor(F.col(order) / BLOCK))
    blocks = df.groupBy("_block").agg(*[F.sum(v).alias(f"_{b}") for b, v in bases.items()])
    before = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("_block", *[F.coalesce(F.sum(f"_{b}").over(before), F.lit(0)).alias(f"_{b}") for b in bases])
    inner = Window.partitionBy("_block").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    out = df.withColumns({b: F.coalesce(F.sum(v).over(inner), F.lit(0)) for b, v in bases.items()}).join(blocks, "_block")
    return out.withColumns({b: (F.col(b) + F.col(f"_{b}")).cast("long") for b in bases}).drop("_block", *[f"_{b}" for b in bases])


def write_tokens(
    docs: DataFrame, folder: str, *, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Writes token files of all documents below ``folder`` (a URI), in ascending order of id, and returns the manifest:
    part, name, n_docs, n_tokens, base_doc, base_token (documents and ids of all parts before).

    A document is its text's ids and ``end_id``. Null and empty texts are the end id alone. Rows with a null id come
    last; repeated rows and rows with one id are written each, ordered by a hash of their texts. A missing column counts
    as nulls, other columns of ``docs`` do not matter. An empty table gives no files and no rows.
    """
    docs = ensure_columns(docs, **{id_col: "long", text_col: "string"})

    def run(batches):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        tok = tokenizer_for(tokenizer_path, end_id)
        end, width = np.array([end_id], tok.dtype).tobytes(), tok.dtype.itemsize
        out, name, path, store, offsets, ids, n_null = None, None, None, None, [np.zeros(1, np.int64)], [], 0
        at = 0
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                if out is None:
                    task = TaskContext.get()
                    store, path = _open(folder)
                    store.create_dir(path, recursive=True)
                    name = f"part-{task.partitionId():06d}-{task.taskAttemptId()}-{uuid.uuid4().hex[:8]}"
                    out = store.open_output_stream(f"{path}/{name}.bin", compression=None)
                data = [x + end for x in tok.encode([t or "" for t in part.column(1).to_pylist()])]
                out.write(b"".join(data))
                stops = at + np.cumsum(np.fromiter(map(len, data), np.int64, len(data))) // width
                at = int(stops[-1])
                offsets.append(stops)
                n_null += part.column(0).null_count
                ids.append(part.column(0).fill_null(0).to_numpy(zero_copy_only=False))
        if out is None:
            return
        out.close()
        offsets, ids = np.concatenate(offsets), np.concatenate(ids)
        with store.open_output_stream(f"{path}/{name}.idx", compression=None) as f:
            f.write(struct.pack(HEADER, MAGIC, width, len(ids), n_null) + offsets.astype("<i8").tobytes() + ids.astype("<i8").tobytes())
        row = {"part": [TaskContext.get().partitionId()], "name": [name], "n_docs": [len(ids)], "n_tokens": [at]}
        yield pa.RecordBatch.from_pydict(row)

    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    order = [F.col("_id").asc_nulls_last(), F.xxhash64("_text")]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    manifest = stored(dealt.mapInArrow(run, MANIFEST), "token-parts")
    return stored(prefix_sums(manifest, "part", base_doc="n_docs", base_token="n_tokens"), "token-manifest")


def read_tokens(manifest: DataFrame, folder: str, most: int = 8 << 20) -> DataFrame:
    """The documents that the files of ``manifest`` hold: doc_id, start (ids of all documents before it), n_tokens, ids
    (a binary of little-endian unsigned 32-bit ids).

    ``most`` bounds the bytes of ids that are handed on together (a longer document goes alone).
    """
    first = F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_docs") - 1, F.lit(STRETCH).cast("long")))
    wanted = manifest.where("n_docs > 0").select("name", "n_docs", "base_token", first.alias("first"))
    # As many tasks as files: the manifest itself is too small for Spark to tell what reading its files takes.
    wanted = wanted.repartition(max(1, manifest.count()), "name", "first").sortWithinPartitions("name", "first")
    names = ["doc_id", "start", "n_tokens", "ids"]

    def run(batches):
        part, name = None, None
        for batch in batches:
            for row in batch.to_pylist():
                if row["name"] != name:
                    name = row["name"]
                    part = TokenPart(folder, name)
                rows, size = [], 0
                for k in range(row["first"], min(row["first"] + STRETCH, row["n_docs"])):
                    ids = part.tokens(k)
                    rows.append((part.doc_id(k), row["base_token"] + int(part.offsets[k]), len(ids), ids.astype("<u4").tobytes()))
                    size += 4 * len(ids)
                    if size >= most:
                        yield _batch(rows)
                        rows, size = [], 0
                if rows:
                    yield _batch(rows)

    def _batch(rows):
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return wanted.mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def round_trip(docs: DataFrame, **options) -> DataFrame:
    """Writes all documents to token files in the shared folder and reads every one back."""
    folder = shared_dir(docs.sparkSession, "tokens")
    return read_tokens(write_tokens(docs, folder, **options), folder)
