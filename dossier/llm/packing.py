"""Best-fit packing: length patterns fitted to the length histogram by non-negative least squares.

Documents become token pieces of at most ``capacity`` tokens. Their lengths make a histogram of at most ``capacity``
bins, which is all that the driver sees. There, patterns of one to three pieces that fill a sequence are enumerated,
their repeat counts are fitted to the histogram by non-negative least squares and rounded down, and the residual
histogram is packed by best fit. The plan says, for each length, which slots (sequence, offset) its first, second, ...
piece takes; Spark numbers the pieces of each length and looks their slots up.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ensure_columns, stored

CAPACITY, SALTS = 2048, 256
STOP = re.compile(r"(?<=[a-zà-öø-ÿ])([.,])(?![^ \n\t\r])")


class WordTokenizer:
    """A tokenizer that drops white space, applied to each distinct word once.

    Its normaliser and pre-tokenizer never join text across white space, so a text's ids are those of its words in
    order. Ids are kept as little-endian unsigned 32-bit bytes.
    """

    def __init__(self, path: str, most: int = 800_000, longest: int = 64):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocab = self.tokenizer.get_vocab()
        #: Whether a token ends a word.
        self.final = np.zeros(max(vocab.values()) + 1, bool)
        self.final[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.ids: dict[str, bytes] = {"": b""}
        self.most, self.longest = most, longest

    def _encode(self, words: list[str]) -> list[bytes]:
        """Each word's ids, from one call for all of them."""
        found = self.tokenizer.encode(" ".join(words), add_special_tokens=False)
        ids = np.array(found.ids, "<u4")
        ends = np.nonzero(self.final[ids])[0] + 1
        if len(ends) != len(words) or not all(map(str.isalpha, words)):
            # Words of several parts: a token belongs to the word that its first letter is in.
            first = np.fromiter((o[0] for o in found.offsets), np.int64, len(ids))
            ends = np.searchsorted(first, np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1))
        data, ends = ids.tobytes(), (4 * ends).tolist()
        return [data[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]

    def encode(self, texts: list[str]) -> list[bytes]:
        if len(self.ids) > self.most:
            self.ids.clear()
            self.ids[""] = b""
        split = [self.words(t) for t in texts]
        new = sorted((w for w in set().union(*split) if w not in self.ids), key=str.isalpha)
        for at in range(0, len(new), 1024):
            part = new[at : at + 1024]
            self.ids.update(zip(part, self._encode(part), strict=True))
        out = [b"".join(map(self.ids.__getitem__, words)) for words in split]
        for w in new:
            if len(w) > self.longest:
                del self.ids[w]
        return out

    @staticmethod
    def words(text: str) -> list[str]:
        """The text parted at white space that the tokenizer drops too. In Latin-1 texts, capitals are lowered and a
        comma or stop between a letter and white space is parted off, as the tokenizer does, so fewer words are new."""
        if "<|" not in text:
            try:
                text.encode("latin-1")
                text = STOP.sub(r" \1", text.lower())
            except UnicodeEncodeError:
                pass
        return text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")


_KEPT: dict[str, WordTokenizer] = {}


def tokenizer_for(path: str) -> WordTokenizer:
    """The worker's tokenizer: the words that it has learned serve its later tasks."""
    if path not in _KEPT:
        _KEPT[path] = WordTokenizer(path)
    return _KEPT[path]


def pieces(docs: DataFrame, tokenizer_path: str, id_col: str, text_col: str, capacity: int, end_id: int) -> DataFrame:
    """(id, piece, start, length, ids_crc32): each document's ids and ``end_id``, cut every ``capacity`` ids."""

    def run(batches):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        tok = tokenizer_for(tokenizer_path)
        end, wide = np.array([end_id], "<u4").tobytes(), 4 * capacity
        for pdf in batches:
            for lo in range(0, len(pdf), 500):
                part = pdf.iloc[lo : lo + 500]
                rows = []
                for doc, ids in zip(part["_id"].tolist(), tok.encode([t or "" for t in part["_text"]]), strict=True):
                    ids += end
                    for k, at in enumerate(range(0, len(ids), wide)):
                        cut = ids[at : at + wide]
                        rows.append((doc, k, at // 4, len(cut) // 4, zlib.crc32(cut)))
                yield pd.DataFrame(rows, columns=["_id", "piece", "start", "length", "ids_crc32"]).astype({"_id": pdf["_id"].dtype})

    kind = docs.schema[id_col].dataType.simpleString()
    ids = docs.select(F.col(id_col).cast("string").alias("_id"), F.col(text_col).alias("_text"))
    out = ids.mapInPandas(run, "_id string, piece int, start long, length long, ids_crc32 long")
    return out.withColumn("_id", F.col("_id").cast(kind))


def enumerate_patterns(h: np.ndarray, per_length: int = 6) -> list[tuple[int, ...]]:
    """Patterns of two and three lengths that fill the capacity: every such pair, and for each length the
    ``per_length`` triples whose scarcest length is the most frequent."""
    cap = len(h) - 1
    have = np.nonzero(h)[0]
    have = have[(have > 0) & (have < cap)]
    found = {(a, cap - a) for a in have.tolist() if 2 * a >= cap and h[cap - a]}
    for a in have.tolist():
        b = have[have <= cap - a - 1]
        c = cap - a - b
        worth = np.minimum(h[b], h[c])
        for k in np.argsort(-worth, kind="stable")[: 2 * per_length].tolist():
            if worth[k] > 0:
                found.add(tuple(sorted((a, int(b[k]), int(c[k])), reverse=True)))
    return sorted(found, reverse=True)


def nnls(patterns: list[tuple[int, ...]], h: np.ndarray, sweeps: int = 60) -> np.ndarray:
    """Repeat counts x >= 0 that minimise |A x - h|^2, by coordinate descent over the sparse pattern columns."""
    r = h.astype(float).tolist()
    x = [0.0] * len(patterns)
    cols = [[(a, p.count(a)) for a in dict.fromkeys(p)] for p in patterns]
    norm = [sum(k * k for _, k in c) for c in cols]
    for _ in range(sweeps):
        moved = 0.0
        for j, c in enumerate(cols):
            step = max(-x[j], sum(k * r[a] for a, k in c) / norm[j])
            if step:
                x[j] += step
                moved = max(moved, abs(step))
                for a, k in c:
                    r[a] -= k * step
        if moved < 0.01:
            break
    return np.array(x)


def best_fit(h: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """Packs a histogram by best fit, longest first; equal sequences are packed together."""
    left, cap, out = h.copy(), len(h) - 1, []
    while left.any():
        room, pattern = cap, []
        use: dict[int, int] = {}
        top = int(np.nonzero(left)[0][-1])
        while top:
            use[top] = use.get(top, 0) + 1
            pattern.append(top)
            room -= top
            free = left[: room + 1].copy()
            for a, k in use.items():
                if a <= room:
                    free[a] -= k
            below = np.nonzero(free > 0)[0]
            top = int(below[-1]) if len(below) else 0
        times = min(int(left[a]) // k for a, k in use.items())
        for a, k in use.items():
            left[a] -= times * k
        out.append((tuple(pattern), times))
    return out


def plan(h: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """(pattern, repeats) that use up the histogram ``h`` (h[n] pieces of length n): with patterns of two lengths or
    of two and three, whichever needs fewer sequences (triples take short pieces that long ones may need)."""
    return min((plan_with(h, most) for most in (3, 2)), key=lambda out: sum(times for _, times in out))


def plan_with(h: np.ndarray, most: int) -> list[tuple[tuple[int, ...], int]]:
    left, cap, out = h.copy(), len(h) - 1, []
    if left[cap]:
        out.append(((cap,), int(left[cap])))
        left[cap] = 0
    patterns = [p for p in enumerate_patterns(left) if len(p) <= most]
    x = np.floor(nnls(patterns, left) + 1e-6).astype(np.int64) if patterns else []
    for j in np.argsort(-np.asarray(x), kind="stable").tolist():
        p = patterns[j]
        use = {a: p.count(a) for a in p}
        times = min(int(x[j]), *[int(left[a]) // k for a, k in use.items()])
        if times > 0:
            out.append((p, times))
            for a, k in use.items():
                left[a] -= times * k
    return out + best_fit(left)


def slots(patterns: list[tuple[tuple[int, ...], int]]) -> pd.DataFrame:
    """For each run of slots of one length: its first slot number, the sequence of that slot, the offset there."""
    base, nxt, rows = 0, {}, []
    for p, times in patterns:
        at = 0
        for a in p:
            rows.append((a, nxt.get(a, 0), base, at))
            nxt[a] = nxt.get(a, 0) + times
            at += a
        base += times
    return pd.DataFrame(rows, columns=["length", "first", "sequence", "offset"])


def pack(
    docs: DataFrame,
    *,
    tokenizer_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = CAPACITY,
    end_id: int = 0,
) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset.

    Null and empty texts are one piece of one id (the end id). Repeated rows are packed each; null ids are allowed.
    Columns of ``docs`` other than id and text do not matter. An empty table gives no rows. Sequence numbers and the
    order of equally long pieces carry no meaning.
    """
    docs = ensure_columns(docs, **{id_col: "long", text_col: "string"})
    table = stored(pieces(docs, tokenizer_path, id_col, text_col, capacity, end_id), "pieces")
    # Pieces of one length are numbered in SALTS runs, as one length may hold a third of all pieces.
    table = table.withColumn("_salt", F.pmod(F.xxhash64("_id", "piece", "ids_crc32"), F.lit(SALTS)).cast("int"))
    counts = table.groupBy("length", "_salt").agg(F.count("*").alias("_n"))
    counts = stored(counts, "piece-counts")
    before = Window.partitionBy("length").orderBy("_salt")
    offsets = counts.select(
        F.col("length").alias("_ol"), F.col("_salt").alias("_os"), (F.sum("_n").over(before) - F.col("_n")).alias("_before")
    )
    h = np.zeros(capacity + 1, np.int64)
    for r in counts.groupBy("length").agg(F.sum("_n").alias("n")).collect():  # at most ``capacity`` rows
        h[r["length"]] = r["n"]
    runs = slots(plan(h)).sort_values(["length", "first"])
    key = runs["length"].to_numpy() * (1 << 40) + runs["first"].to_numpy()
    first, seq, off = (runs[c].to_numpy() for c in ("first", "sequence", "offset"))

    def place(batches):
        for pdf in batches:
            n = pdf.pop("_number").to_numpy()
            at = np.searchsorted(key, pdf["length"].to_numpy() * (1 << 40) + n, side="right") - 1
            yield pdf.assign(sequence_id=seq[at] + n - first[at], offset=off[at])

    order = Window.partitionBy("length", "_salt").orderBy("_id", "piece", "ids_crc32")
    numbered = table.withColumn("_row", F.row_number().over(order)).join(
        offsets, (F.col("length") == F.col("_ol")) & (F.col("_salt") == F.col("_os"))
    )
    cols = ["_id", "piece", "start", "length", "ids_crc32"]
    numbered = numbered.select(*cols, (F.col("_before") + F.col("_row") - 1).alias("_number"))
    kind = table.schema["_id"].dataType.simpleString()
    ids = numbered.withColumn("_id", F.col("_id").cast("string"))
    placed = ids.mapInPandas(place, "_id string, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    return placed.withColumn("_id", F.col("_id").cast(kind)).withColumnRenamed("_id", id_col)
