"""Periodic runs of words, found by block convolution, and texts with their runs collapsed.

A run is a stretch of words with smallest period q, at least ``exponent`` periods and ``least`` words long, that no
neighbouring word extends. A run of period q in [B, 2B), B a power of two, holds a whole block of B words that starts at
a multiple of B, and a copy of that block q words on. So at each dyadic scale B, blocks that may lie in a run (each of
their words recurs within 2B words) are convolved with the window of lags B to 2B - 1 that follows: the sum of squared
differences of word numbers, by number-theoretic transforms modulo as many primes as its bound asks for, is zero exactly
where the block occurs again. Each such distance seeds an extension to both sides, which is a run if it is long enough
and has no smaller period. Blocks whose window lies in a run already known are left out: there, the block occurs at
multiples of the run's period only.

Documents are independent; within a task, many are searched at a time, with numbers for words that no two share.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ensure_columns, without, words

# Primes k * 2^e + 1 below 2^31, with e and a primitive root.
PRIMES = [(2013265921, 27, 31), (1811939329, 26, 13), (2113929217, 25, 5)]
CHUNK, CELLS, FAR = 1 << 17, 1 << 18, 1 << 40
RUNS = "array<struct<start: long, length: long, period: long>>"


@lru_cache(maxsize=128)
def twiddles(p: int, root: int, n: int, inverse: bool) -> list[np.ndarray]:
    """The powers of the n-th root of unity that each level of a transform of length n uses, widest first."""
    w = pow(root, (p - 1) // n, p)
    if inverse:
        w = pow(w, p - 2, p)
    powers = np.ones(max(1, n // 2), np.int64)
    have = 1
    while have < len(powers):  # doubling: the second half is the first times a power
        powers[have : 2 * have] = powers[:have] * pow(w, have, p) % p
        have *= 2
    return [powers[:: 1 << k] for k in range(n.bit_length() - 1)]


def ntt(a: np.ndarray, p: int, root: int) -> np.ndarray:
    """The transform of each row of ``a``, in bit-reversed order."""
    m, n = a.shape
    for w in twiddles(p, root, n, False):
        v = a.reshape(m, -1, 2, len(w))
        u, d = v[:, :, 0] + v[:, :, 1], v[:, :, 0] - v[:, :, 1]
        v[:, :, 0], v[:, :, 1] = np.where(u >= p, u - p, u), np.where(d < 0, d + p, d) * w % p
    return a


def inverse_ntt(a: np.ndarray, p: int, root: int) -> np.ndarray:
    """Back from ``ntt``."""
    m, n = a.shape
    for w in reversed(twiddles(p, root, n, True)):
        v = a.reshape(m, -1, 2, len(w))
        u, d = v[:, :, 0].copy(), v[:, :, 1] * w % p
        s, t = u + d, u - d
        v[:, :, 0], v[:, :, 1] = np.where(s >= p, s - p, s), np.where(t < 0, t + p, t)
    return a * pow(n, p - 2, p) % p


def zero_lags(x: np.ndarray, starts: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
    """(row of starts, distance): where x[s:s+B] equals x[s+d:s+d+B] for s in ``starts`` and B <= d < 2B.

    ``x`` holds numbers from 0 and is padded by two blocks at least. Sums of squared differences are at most B times the
    square of the largest number; they are zero if they are so modulo primes whose product exceeds that.
    """
    top, primes, product = int(x.max()), [], 1
    while product <= block * top * top:
        primes.append(PRIMES[len(primes)])
        product *= primes[-1][0]
    primes = primes or PRIMES[:1]
    if 2 * block > 1 << min(e for _, e, _ in primes):
        raise ValueError("a document has too many words for the transforms")
    rows, lags, width = [], [], 2 * block
    for lo in range(0, len(starts), max(1, CELLS // width)):
        s = starts[lo : lo + max(1, CELLS // width)]
        a = x[s[:, None] + np.arange(block)]
        y = x[s[:, None] + np.arange(block, 3 * block)]
        zero = np.ones((len(s), block), bool)
        for p, _, root in primes:
            ya = y % p
            turned = np.zeros_like(ya)
            turned[:, 0], turned[:, : -block : -1] = a[:, 0] % p, a[:, 1:] % p
            both = inverse_ntt(ntt(ya.copy(), p, root) * ntt(turned, p, root) % p, p, root)[:, :block]
            squares = np.concatenate([np.zeros((len(s), 1), np.int64), np.cumsum(ya * ya % p, axis=1)], axis=1)
            window = squares[:, block : 2 * block] - squares[:, :block]
            own = (a % p * (a % p) % p).sum(axis=1)[:, None]
            zero &= (own + window - 2 * both) % p == 0
        r, d = np.nonzero(zero)
        rows.append(r + lo)
        lags.append(d + block)
    return (np.concatenate(rows), np.concatenate(lags)) if rows else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _same(x: np.ndarray, i: int, d: int, most: int, step: int) -> int:
    """How far x[i], x[i+step], ... (at most ``most`` of them) equal their neighbours d on."""
    done, size = 0, 32
    while done < most:
        k = min(size, most - done)
        at = i + step * done
        part = slice(at, at + k) if step > 0 else slice(at - k + 1, at + 1)
        differ = x[part] != x[part.start + d : part.stop + d]
        if differ.any():
            return done + int(np.argmax(differ if step > 0 else differ[::-1]))
        done, size = done + k, 2 * size
    return done


def primitive(x: np.ndarray, start: int, d: int) -> bool:
    """Whether a stretch of period d, 2d words long at least, has no period that divides d."""
    left, f = d, 2
    while left > 1:
        if left % f == 0:
            p = d // f
            if np.array_equal(x[start : start + d], x[start + p : start + p + d]):
                return False
            while left % f == 0:
                left //= f
        f = f + 1 if f * f <= left else max(left, f + 1)
    return True


def find_runs(texts: list[np.ndarray], least: int = 6, exponent: int = 4) -> list[list[tuple[int, int, int]]]:
    """The runs (start, length, period) of each of the sequences of numbers, by start, then period.

    ``exponent`` is 3 at least: with fewer periods, a run need not hold a block and its copy.
    """
    if exponent < 3:
        raise ValueError("exponent must be at least 3")
    sizes = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(sizes)
    n, longest = int(ends[-1]) if len(ends) else 0, int(sizes.max(initial=0))
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    if longest < least:
        return out
    local = np.concatenate(texts).astype(np.int64)
    doc = np.repeat(np.arange(len(texts)), sizes)
    tops = np.array([int(t.max(initial=-1)) + 1 for t in texts], np.int64)
    x = local + (np.cumsum(tops) - tops)[doc]  # no two documents share a number
    order = np.argsort(x, kind="stable")
    recurs = np.full(n, FAR)
    again = x[order[1:]] == x[order[:-1]]
    recurs[order[:-1][again]] = (order[1:] - order[:-1])[again]
    first = ends - sizes
    runs: list[tuple[int, int, int]] = []  # start, end, period
    block, reach, padded = 1, recurs, None
    while 3 * block - 1 <= longest and exponent * block <= longest:
        starts = np.nonzero(reach < 2 * block)[0] * block
        stop = ends[doc[starts]]
        fits = starts + 2 * block <= stop
        starts, stop = starts[fits], stop[fits]
        wide = [r for r in runs if r[1] - r[0] >= 2 * block]
        fresh = np.ones(len(starts), bool)
        for s, e, _ in wide:
            a, b = np.searchsorted(starts, [s, e - block + 1])
            fresh[a:b] &= np.minimum(starts[a:b] + 3 * block - 1, stop[a:b]) > e
        starts, stop = starts[fresh], stop[fresh]
        if len(starts):
            if padded is None or len(padded) < n + 3 * block:
                padded = np.concatenate([local, np.zeros(3 * block, np.int64)])
            row, dist = zero_lags(padded, starts, block)
            at, inside = starts[row], starts[row] + dist + block <= stop[row]
            at, dist = at[inside], dist[inside]
            for s, e, p in wide:
                a, b = np.searchsorted(at, [s, e - block + 1])
                if a < b:
                    known = (dist[a:b] % p == 0) & (at[a:b] + dist[a:b] + block <= e)
                    if known.any():
                        keep = np.ones(len(at), bool)
                        keep[a:b] = ~known
                        at, dist = at[keep], dist[keep]
            last, upto = 0, 0
            for k in np.lexsort((at, dist)).tolist():
                s, d = int(at[k]), int(dist[k])
                if d == last and s + d + block <= upto:
                    continue
                lo, hi = int(first[doc[s]]), int(ends[doc[s]])
                e = s + block + _same(x, s + block, d, hi - d - s - block, 1) + d
                s -= _same(x, s - 1, d, s - lo, -1)
                last, upto = d, e
                if e - s >= max(least, exponent * d) and primitive(x, s, d):
                    runs.append((s, e, d))
        block *= 2
        even = len(reach) // 2 * 2
        reach = np.maximum(reach[0:even:2], reach[1:even:2])
    for s, e, p in sorted(runs):
        k = int(doc[s])
        out[k].append((s - int(first[k]), e - s, p))
    for found in out:
        found.sort(key=lambda r: (r[0], r[2]))
    return out


def split_words(text: str | None) -> list[str]:
    text = text or ""
    for ch in "\t\n\x0b\x0c\r":
        text = text.replace(ch, " ")
    return [w for w in text.split(" ") if w]


def numbered(found: list[str]) -> np.ndarray:
    seen: dict[str, int] = {}
    return np.array([seen.setdefault(w, len(seen)) for w in found], np.int64)


def collapsed(found: list[str], runs: list[tuple[int, int, int]]) -> str:
    """The words joined by one space, without those that any run holds after its first period."""
    if runs:
        change = np.zeros(len(found) + 1, np.int64)
        for start, length, period in runs:
            change[start + period] += 1
            change[start + length] -= 1
        gone = np.cumsum(change) > 0
        found = [w for w, out in zip(found, gone.tolist(), strict=False) if not out]
    return " ".join(found)


def best_of(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run with the greatest length over period; ties go to the smallest start, then period."""
    best = None
    for r in runs:  # by start, then period
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    return best


def collapse_runs(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least: int = 6, exponent: int = 4
) -> DataFrame:
    """One row per document: id, runs (start, length, period in words, by start, then period), best (the run with the
    most periods) and collapsed (the words joined by one space, each run cut to its first period).

    Words are ``[^\\x20\\x09-\\x0D]+``. Null and empty texts have no runs and collapse to the empty string. Repeated rows
    have a row each, null ids stay null. A missing column counts as nulls, other columns of ``docs`` do not matter. An
    empty table gives no rows. A text is searched whole, in one task, up to 2^25 words.
    """
    docs = ensure_columns(docs, **{id_col: "long", text_col: "string"})
    run_type = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
    names = ["id", "runs", "best", "collapsed"]

    def one(ids, texts):
        found = [split_words(t) for t in texts]
        runs = find_runs([numbered(w) for w in found], least, exponent)
        as_row = lambda r: None if r is None else dict(zip(("start", "length", "period"), r, strict=True))
        return pa.RecordBatch.from_arrays(
            [
                ids, pa.array([[as_row(r) for r in rs] for rs in runs], pa.list_(run_type)), pa.array([as_row(best_of(rs)) for rs in runs], run_type),
                pa.array([collapsed(w, rs) for w, rs in zip(found, runs, strict=True)], pa.string()),
            ],
            names,
        )

    def run(batches):
        for batch in batches:
            size = batch.column(1).fill_null("").to_pylist()
            lo, letters = 0, 0
            for k, text in enumerate(size):
                letters += len(text)
                if letters >= 6 * CHUNK or k + 1 == len(size):
                    yield one(batch.column(0).slice(lo, k + 1 - lo), size[lo : k + 1])
                    lo, letters = k + 1, 0

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    out = rows.mapInArrow(run, f"id {kind}, runs {RUNS}, best struct<start: long, length: long, period: long>, collapsed string")
    return out.withColumnRenamed("id", id_col)


def plant_tails(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with periodic tails planted into the texts whose id's CRC-32 h is a multiple of 10.

    With n words and g = h div 10, each word from a = g mod n on becomes word a + (i - a) mod p, p = 1 + (n - a) div
    (3 + g mod 8). Texts without words and rows without an id stay as they are.
    """
    h = F.crc32(F.col(id_col).cast("string"))
    docs = docs.withColumns({"_g": F.floor(h / 10).cast("long"), "_w": F.when(h % 10 == 0, words(F.col(text_col)))})
    n, a = F.size("_w").cast("long"), F.col("_g") % F.size("_w")
    docs = docs.withColumns({"_a": F.when(n > 0, a), "_p": F.when(n > 0, 1 + F.floor((n - a) / (3 + F.col("_g") % 8)).cast("long"))})
    places = F.sequence(F.lit(0).cast("long"), n - 1)
    tail = F.transform(places, lambda i: F.get("_w", (F.when(i < F.col("_a"), i).otherwise(F.col("_a") + (i - F.col("_a")) % F.col("_p"))).cast("int")))
    text = F.when(F.col("_a").isNotNull(), F.array_join(tail, " ")).otherwise(F.col(text_col))
    return without(docs.withColumn(text_col, text), "_g", "_w", "_a", "_p")
