"""Language-model scores by prediction by partial matching over bytes.

Contexts of up to ``order`` bytes are counted over all training texts. A context's node predicts a symbol it has seen
with (count - 1/2) / n (n symbols seen, q kinds of them: escape method D); what is left, q / 2 and the counts of
children seen less than ``LEAST`` times, is the escape to the context one byte shorter, whose predictions exclude the
symbols of the longer one (they are divided by the weight that is left). ``LEAST`` is fixed: the model grows with the
corpus.

Texts are dealt to chunks of about ``CHUNK`` bytes, grams (a context and its symbol) to parts by the last ``NEAR`` bytes
of their context, so that a part holds whole branches of the trie: a node, its children and the longer contexts below.

1. Each chunk sends every part its distinct grams with their training counts, as one sorted and packed row.
2. A part adds the counts of all chunks, walks its branches from shorter to longer contexts, and sends each chunk the
   code lengths of its grams. What lies above the branches, contexts of up to LOW bytes, is one small table: it has at
   most 257**(LOW + 1) rows whatever the corpus, and is the one thing that the driver reads and broadcasts.
3. Each chunk sums up the code lengths of its texts, symbol by symbol.

Both shuffles carry a few bytes a distinct gram of a chunk; the chunks themselves are one exchange that both ends read.

Symbols are the bytes of the text, A-Z lower-cased, and one end symbol, which also stands before a text's start.
A text's code length is the sum over its symbols; scores are log10 probabilities.

The base score is an add-0.1 unigram model over words. Words travel with the grams: a part adds up the counts of the
words that hash to it and sends them back, with how many words and tokens it has in all.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ensure_columns

ORDER, LEAST, LOW, NEAR = 6, 2, 2, 3
BITS, END = 9, 256
STRIDE, CHUNK, PART = 1 << 21, 10 << 20, 1 << 22


def symbols(texts: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """All texts as one array, ``order`` end symbols before each and one after; where each text's symbols start."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    out = np.full(int((lengths + order + 1).sum()), END, np.uint16)
    starts = np.cumsum(lengths + order + 1) - lengths - 1
    for t, s in zip(texts, starts.tolist(), strict=True):
        out[s : s + len(t)] = np.frombuffer(t, np.uint8)
    return out, starts


def grams(sym: np.ndarray, order: int) -> np.ndarray:
    """For each position from ``order`` on, the symbol there and the ``order`` before it in one integer."""
    out = np.zeros(len(sym) - order, np.uint64)
    for i in range(order + 1):
        out = (out << np.uint64(BITS)) | sym[i : len(sym) - order + i]
    return out


def pieces(texts: list[bytes], order: int):
    """(grams, text number of each) in arrays of bounded length, however long a text is."""
    group, size = [], 0
    for k, t in enumerate(texts):
        group.append(k)
        size += len(t)
        if size < STRIDE and k + 1 < len(texts):
            continue
        sym, starts = symbols([texts[i] for i in group], order)
        owner = np.repeat(np.array(group), np.diff([*starts, len(sym) + order]))[: len(sym) - order]
        inside = np.ones(len(sym), bool)
        for s in starts.tolist():
            inside[s - order : s] = False
        for lo in range(0, len(sym) - order, STRIDE):
            hi = min(lo + STRIDE, len(sym) - order)
            use = inside[lo + order : hi + order]
            yield grams(sym[lo : hi + order], order)[use], owner[lo:hi][use]
        group, size = [], 0


def lowered(text: bytes | None) -> bytes:
    return (text or b"").lower()


class Table:
    """Integer keys to their places, by open addressing over arrays."""

    def __init__(self, keys: np.ndarray):
        self.bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 1.5))))
        self.keys = np.full(1 << self.bits, 2**64 - 1, np.uint64)
        self.place = np.zeros(1 << self.bits, np.int32)
        todo, slot = np.arange(len(keys)), self.slot(keys)
        while len(todo):
            free = self.keys[slot] == np.uint64(2**64 - 1)
            self.keys[slot[free]] = keys[todo[free]]
            won = self.keys[slot] == keys[todo]
            self.place[slot[won]] = todo[won]
            todo, slot = todo[~won], (slot[~won] + 1) & ((1 << self.bits) - 1)

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key, -1 where it is not there."""
        slot = self.slot(keys)
        got = self.keys[slot]
        out = np.where(got == keys, self.place[slot], -1)
        rest = np.nonzero((out < 0) & (got != np.uint64(2**64 - 1)))[0]
        slot = slot[rest]
        while len(rest):
            slot = (slot + 1) & ((1 << self.bits) - 1)
            got = self.keys[slot]
            hit = got == keys[rest]
            out[rest[hit]] = self.place[slot[hit]]
            go = ~hit & (got != np.uint64(2**64 - 1))
            rest, slot = rest[go], slot[go]
        return out



def suffix(g: np.ndarray, k: int) -> np.ndarray:
    """The last ``k`` symbols of each gram."""
    return g & np.uint64((1 << (BITS * k)) - 1)


def summed(g: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct grams in order and the sums of their counts."""
    if not len(g):
        return g, n
    o = np.argsort(g, kind="stable")
    g, n = g[o], n[o]
    first = np.nonzero(np.concatenate([[True], g[1:] != g[:-1]]))[0]
    return g[first], np.add.reduceat(n, first)


def level(g: np.ndarray, n: np.ndarray, less: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log probability of each gram of one order, from counts and the log probabilities one context shorter.

    g: distinct grams in order, all kept ones (n >= LEAST) of each context among them. Also returned: the contexts and
    what a symbol that they have not kept costs beyond ``less``.
    """
    if not len(g):
        return np.zeros(0), g, np.zeros(0)
    c = g >> np.uint64(BITS)
    first = np.nonzero(np.concatenate([[True], c[1:] != c[:-1]]))[0]
    size = np.diff(np.concatenate([first, [len(g)]]))
    kept = n >= LEAST
    total = np.add.reduceat(n, first).astype(float)
    kinds = np.add.reduceat(kept.astype(np.int64), first)
    inside = np.add.reduceat(np.where(kept, n, 0), first)
    taken = np.add.reduceat(np.where(kept, np.exp(less), 0.0), first)
    some = kinds > 0
    safe = np.where(some, total, 1)
    escape = np.where(some, np.log(np.where(some, total - inside + kinds / 2, 1) / safe) - np.log(np.maximum(1 - taken, 1e-9)), 0.0)
    cost = np.where(kept, np.log(np.maximum(n - 0.5, 0.5) / np.repeat(safe, size)), np.repeat(escape, size) + less)
    return cost, c[first], escape


class Low:
    """The branches' common root: contexts of up to LOW symbols with all their counts."""

    def __init__(self, g: np.ndarray, n: np.ndarray, order: int):
        self.levels = []
        for k in range(order + 1):
            grams_, counts = summed(suffix(g, k + 1), n)
            cost, contexts, escape = level(grams_, counts, self.cost(grams_, k - 1))
            kept = counts >= LEAST
            self.levels.append((grams_[kept], cost[kept], contexts, escape))

    def cost(self, g: np.ndarray, order: int | None = None) -> np.ndarray:
        """Log probabilities of the last symbols, with contexts of up to ``order``, whether seen or not."""
        out = np.full(len(g), -np.log(END + 1))
        for k, (keys, cost, contexts, escape) in enumerate(self.levels if order is None else self.levels[: order + 1]):
            x = suffix(g, k + 1)
            if len(contexts):
                c = x >> np.uint64(BITS)
                at = np.minimum(np.searchsorted(contexts, c), len(contexts) - 1)
                out += np.where(contexts[at] == c, escape[at], 0.0)
            if len(keys):
                at = np.minimum(np.searchsorted(keys, x), len(keys) - 1)
                out = np.where(keys[at] == x, cost[at], out)
        return out


def branch_costs(g: np.ndarray, n: np.ndarray, low: Low, order: int) -> np.ndarray:
    """Log probability of each gram; g: distinct grams in order of whole branches, n: their training counts."""
    shorter, less = None, None
    for k in range(min(LOW, order), order + 1):
        keys, counts = summed(suffix(g, k + 1), n)
        if shorter is None:
            cost = low.cost(keys)
        else:
            cost = level(keys, counts, less[np.searchsorted(shorter, suffix(keys, k))])[0]
        shorter, less = keys, cost
    return less


def part_of(g: np.ndarray, parts: int, order: int) -> np.ndarray:
    near = suffix(g >> np.uint64(BITS), min(NEAR, order)) + np.uint64(1)
    return ((near * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)) % np.uint64(parts)


def packed(x: np.ndarray) -> bytes:
    """Integers as compressed planes of bytes."""
    return zlib.compress(np.ascontiguousarray(x).view(np.uint8).reshape(len(x), -1).T.tobytes(), 1) if len(x) else b""


def unpacked(data: bytes | None, kind) -> np.ndarray:
    if not data:
        return np.zeros(0, kind)
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(zlib.decompress(data), np.uint8).reshape(width, -1).T).view(kind).reshape(-1)


def chunk_grams(texts: list[bytes], train: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct grams of a chunk's texts, in order, and how often its training texts have them."""
    have, size = [], 0
    for g, owner in pieces(texts, order):
        apart = ~train[owner]
        have.append(np.unique(g[~apart], return_counts=True))
        held = np.unique(g[apart])
        have.append((held, np.zeros(len(held), np.int64)))
        size += len(have[-1][0]) + len(have[-2][0])
        if size > 8_000_000:
            have = [summed(*map(np.concatenate, zip(*have, strict=True)))]
            size = len(have[0][0])
    return summed(*map(np.concatenate, zip(*have, strict=True))) if have else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def low_counts(texts: DataFrame, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Grams of min(LOW, order) + 1 symbols of all texts (_text) and their counts: at most 257**(LOW + 1) rows."""
    low = min(LOW, order)

    def count(batches):
        import pyarrow as pa

        g, n = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for b in batches:
            parts = [(g, n)] + [np.unique(x, return_counts=True) for x, _ in pieces([lowered(t.as_py()) for t in b.column(0)], low)]
            g, n = summed(*map(np.concatenate, zip(*parts, strict=True)))
        for lo in range(0, len(g), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(g[lo : lo + 100_000].astype(np.int64)), pa.array(n[lo : lo + 100_000])], names=["g", "n"])

    rows = texts.select("_text").mapInArrow(count, "g long, n long").groupBy("g").agg(F.sum("n").alias("n")).toPandas()
    return rows["g"].to_numpy(np.int64).astype(np.uint64), rows["n"].to_numpy(np.int64)


SENT = "chunk long, part int, grams binary, counts binary, words binary, n_words long, word_counts binary"
BACK = "chunk long, part int, costs binary, word_counts binary, known long, total long"


def sender(parts: int, order: int):
    """One row for each part from a chunk's texts."""

    def send(key, table):
        import pyarrow as pa

        train = ~table.column("held_out").to_numpy().astype(bool)
        texts = [lowered(t.as_py()) for t in table.column("_text")]
        words: list[Counter] = [Counter() for _ in range(parts)]
        counted: Counter = Counter()
        for t, learn in zip(texts, train.tolist(), strict=True):
            if learn:
                counted.update(t.split())
                counted[b""] += 1
            else:
                for w in (*t.split(), b""):
                    counted.setdefault(w, 0)
        for w, n in counted.items():
            words[zlib.crc32(w) % parts][w] = n
        g, n = chunk_grams(texts, train, order)
        part = part_of(g, parts, order)
        o = np.argsort(part, kind="stable")
        g, n, cut = g[o], n[o].astype(np.uint32), np.searchsorted(part[o], np.arange(parts + 1))
        rows: dict[str, list] = {c.split()[0]: [] for c in SENT.split(", ")}
        for p in range(parts):
            x, w = g[cut[p] : cut[p + 1]], sorted(words[p].items())
            row = (key[0].as_py(), p, packed(np.diff(x, prepend=np.uint64(0))), packed(n[cut[p] : cut[p + 1]]), zlib.compress(b"\n".join(a for a, _ in w), 1),
                len(w), packed(np.array([b for _, b in w], np.uint32)))
            for c, v in zip(rows.values(), row, strict=True):
                c.append(v)
        kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
        return pa.table([pa.array(v, kinds[c.split()[1]]) for c, v in zip(SENT.split(", "), rows.values(), strict=True)], names=list(rows))

    return send


def pricer(model, order: int):
    """For each chunk, code lengths of the grams and counts of the words that it sent to one part."""

    def price(key, table):
        import pyarrow as pa

        low = model.value
        sent = [np.cumsum(unpacked(x.as_py(), np.uint64), dtype=np.uint64) for x in table.column("grams")]
        counts = [unpacked(x.as_py(), np.uint32).astype(np.int64) for x in table.column("counts")]
        g, n = summed(np.concatenate(sent), np.concatenate(counts))
        cost = branch_costs(g, n, low, order).astype(np.float32)
        lists = [zlib.decompress(x.as_py()).split(b"\n")[:k.as_py()] for x, k in zip(table.column("words"), table.column("n_words"), strict=True)]
        total: Counter = Counter()
        for words, x in zip(lists, table.column("word_counts"), strict=True):
            for w, k in zip(words, unpacked(x.as_py(), np.uint32).tolist(), strict=True):
                total[w] += k
        known = sum(k > 0 for k in total.values())
        return pa.table(
            [
                table.column("chunk"), table.column("part"), pa.array([packed(cost[np.searchsorted(g, x)]) for x in sent], pa.binary()),
                pa.array([packed(np.array([total[w] for w in words], np.int64)) for words in lists], pa.binary()),
                pa.array([known] * len(sent), pa.int64()), pa.array([total.total()] * len(sent), pa.int64()),
            ],
            names=[c.split()[0] for c in BACK.split(", ")],
        )

    return price


def scorer(parts: int, order: int):
    """The scores of a chunk's texts from what the parts sent back."""

    def score(left, right):
        import pyarrow as pa

        texts = [lowered(t.as_py()) for t in left.column("_text")]
        train = ~left.column("held_out").to_numpy().astype(bool)
        place = np.argsort(right.column("part").to_numpy())
        back = lambda c, kind: [unpacked(right.column(c)[i].as_py(), kind) for i in place.tolist()]
        g, _ = chunk_grams(texts, train, order)
        part = part_of(g, parts, order)
        cost = np.empty(len(g))
        cost[np.argsort(part, kind="stable")] = np.concatenate(back("costs", np.float32))
        logs = np.zeros(len(texts))
        if len(g):
            table = Table(g)
            for x, owner in pieces(texts, order):
                logs += np.bincount(owner, weights=cost[table.find(x)], minlength=len(texts))
        split = [[*t.split(), b""] for t in texts]
        words: list[set] = [set() for _ in range(parts)]
        for w in set().union(*split):
            words[zlib.crc32(w) % parts].add(w)
        value: dict[bytes, float] = {}
        unseen: set[bytes] = set()
        for mine, n in zip(words, back("word_counts", np.int64), strict=True):
            mine = sorted(mine)
            value.update(zip(mine, np.log10(n + 0.1).tolist(), strict=True))
            unseen.update(mine[i] for i in np.nonzero(n == 0)[0].tolist())
        known, total = (int(right.column(c).to_numpy().sum()) for c in ("known", "total"))
        below = np.log10(total + 0.1 * (known + 1))
        base = [sum(map(value.__getitem__, w)) - len(w) * below for w in split]
        n_known = [len(w) if learn else sum(x not in unseen for x in w) for w, learn in zip(split, train.tolist(), strict=True)]
        n = len(texts)
        return pa.table(
            [
                left.column("_id"), left.column("held_out"), pa.array(list(map(len, split)), pa.int64()), pa.array(n_known, pa.int64()),
                pa.array([total] * n, pa.int64()), pa.array(base if total else [None] * n, pa.float64()), pa.array(logs / np.log(10)),
            ],
            names=["_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
        )

    return score


def score_texts(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER) -> DataFrame:
    """One row per document: the id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Texts whose crc32(id as text) mod 10 is 0 are held out, all others (those without an id too) are learned from.
    A null text is empty: it has the end token alone. Repeated rows are learned from and scored each; rows that repeat
    id and text share a chunk. Other columns do not matter. An empty table gives no rows. Without any training text
    every symbol costs log10(257), and base scores are null (no tokens to estimate from). ``order`` is at most 6.
    """
    if not 0 <= order <= ORDER:
        raise ValueError(f"order must be from 0 to {ORDER}: a gram of more symbols does not fit 64 bits")
    docs = ensure_columns(docs, **{id_col: "long", text_col: "string"})
    held = F.coalesce(F.crc32(F.col(id_col).cast("string")) % 10 == 0, F.lit(False))
    docs = docs.select(F.col(id_col).alias("_id"), held.alias("held_out"), F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("_text"))
    size = docs.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    chunks, parts = max(1, -(-size // CHUNK)), max(8, -(-size // PART))
    low = Low(*low_counts(docs.where("not held_out"), order), min(LOW, order))
    model = docs.sparkSession.sparkContext.broadcast(low)
    texts = docs.withColumn("chunk", F.pmod(F.xxhash64("_id", "_text"), F.lit(chunks)))
    sent = texts.groupBy("chunk").applyInArrow(sender(parts, order), SENT)
    back = sent.groupBy("part").applyInArrow(pricer(model, order), BACK)
    kind = docs.schema["_id"].dataType.simpleString()
    schema = f"_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    out = texts.groupBy("chunk").cogroup(back.groupBy("chunk")).applyInArrow(scorer(parts, order), schema)
    return out.withColumnRenamed("_id", id_col)
