"""Toxicity: a lexicon learned from labels, matched through Levenshtein automata, scored in its context.

1. Document frequencies of words and of word beginnings (stems) are counted for both labels over all labelled
   training documents, each distinct text once. All terms whose weight (the lower bound of the smoothed log odds) is
   high enough form the lexicon.
2. The lexicon is a trie. Each distinct word of all texts is matched once: exactly, by stem, or by intersecting the
   whole trie with the word's Levenshtein automaton, which finds misspelled terms. The automata of many words walk the
   trie together, as bit vectors; a branch ends where no automaton is left with a live state. Words near a term that
   clean documents use are no misspellings. The words that match are a stored table.
3. Each hit is weighed by its context window: quoted hits count apart from the others.
4. A logistic model on the sums of both, fitted on about ``fit_rows`` labelled rows, gives the score.

Counting, matching and scoring cover all documents; the driver holds the lexicon, and the table of matching words only
if it has at most ``HITS`` rows; a larger one is joined with the words of each document.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ensure_columns, stored, without

TOKEN = re.compile(r"[^\W_]+")
QUOTES = "\"“”„‟«»‹›‘’`"
#: Inside a word, or at the end of one that nothing opened, these are apostrophes.
APOSTROPHE = re.compile(r"(?<=\w)[’`](?=\w)")
WINDOW = 60
STEMS = (4, 5, 6)
#: The greatest label table that is sent to every executor; a longer one is joined by a shuffle.
BROADCAST_LABELS = 4_000_000
#: The greatest table of matching words that is sent to every task.
HITS = 1 << 19
#: Longer terms are matched exactly only.
LONGEST = 60


def edits_for(term: str) -> int:
    """How many edits still leave a term recognisable."""
    return 0 if len(term) < 5 else 1 if len(term) < 9 else 2


class Automata:
    """The Levenshtein automata of many words (of up to 62 letters), as bit vectors.

    Bit i of state d is set if the letters read so far are within d edits of the word's first i letters.
    """

    def __init__(self, words: list[str]):
        wide = max(map(len, words), default=1)
        self.codes = np.array(words, f"<U{wide}").view(np.uint32).reshape(len(words), wide)
        self.place = np.uint64(1) << np.arange(wide, dtype=np.uint64)
        length = np.fromiter(map(len, words), np.uint64, len(words))
        self.end = np.uint64(1) << length
        self.all = (self.end << np.uint64(1)) - np.uint64(1)
        self.letters: dict[str, np.ndarray] = {}

    def start(self) -> tuple[np.ndarray, ...]:
        return tuple(np.uint64((2 << d) - 1) & self.all for d in range(3))

    def step(self, rows: np.ndarray, state: tuple[np.ndarray, ...], ch: str) -> tuple[np.ndarray, ...]:
        """The states of the given words after one more letter."""
        if ch not in self.letters:
            self.letters[ch] = ((self.codes == ord(ch)) * self.place).sum(axis=1, dtype=np.uint64)
        same, one, whole = self.letters[ch][rows], np.uint64(1), self.all[rows]
        out: list[np.ndarray] = []
        for d, s in enumerate(state):
            new = (s & same) << one
            if d:
                new |= state[d - 1] | (state[d - 1] << one) | (out[-1] << one)
            out.append(new & whole)
        return tuple(out)


@dataclass
class Lexicon:
    """Terms and stems with their weights."""

    terms: dict[str, float]
    stems: dict[str, float]

    def __post_init__(self):
        #: Nodes of the trie: children by letter, the term that ends here, the most edits of any term from here on.
        self.trie: dict = {"edits": 0}
        self.longest = 0
        for term in sorted(t for t in self.terms if edits_for(t) and len(t) <= LONGEST):
            node, k = self.trie, edits_for(term)
            self.longest = max(self.longest, len(term) + k)
            for ch in term:
                node = node.setdefault(ch, {"edits": 0})
                node["edits"] = max(node["edits"], k)
            node["term"] = term

    def near(self, words: list[str]) -> list[str | None]:
        """For each word the weightiest term within its number of edits, the first by name of several; else None."""
        asked = [i for i, w in enumerate(words) if 4 <= len(w) <= self.longest]
        best: list[str | None] = [None] * len(words)
        if not asked:
            return best
        auto = Automata([words[i] for i in asked])
        weight = np.full(len(asked), -np.inf)
        todo = [(self.trie, np.arange(len(asked)), auto.start())]
        while todo:
            node, rows, state = todo.pop()
            if term := node.get("term"):
                hit = (state[edits_for(term)] & auto.end[rows]) != 0
                for i in rows[hit & (weight[rows] < self.terms[term])].tolist():
                    weight[i], best[asked[i]] = self.terms[term], term
            for ch in sorted((c for c in node if len(c) == 1), reverse=True):
                after = auto.step(rows, state, ch)
                alive = after[node[ch]["edits"]] != 0
                if alive.any():
                    todo.append((node[ch], rows[alive], tuple(s[alive] for s in after)))
        return best

    def direct(self, word: str) -> tuple[int, float] | None:
        """(kind, weight) of a word that is a term (0) or starts with a stem (1)."""
        if word in self.terms:
            return 0, self.terms[word]
        stems = [self.stems[word[:n]] for n in STEMS if len(word) > n and word[:n] in self.stems]
        return (1, max(stems)) if stems else None


FEATURES = ("strong", "sum", "rate", "misspelled", "quoted")


def features(text: str, hits: dict[str, tuple[int, float]]) -> tuple[float, ...]:
    """Context-weighted features of one whole text, from the words that match (kind 2: misspelled) and their weights."""
    low = text.lower()
    tokens = TOKEN.findall(low)
    if hits.keys().isdisjoint(tokens):
        return (0.0,) * len(FEATURES)
    strong = total = misspelled = quoted = 0.0
    for m in TOKEN.finditer(low):
        if not (hit := hits.get(m.group())):
            continue
        kind, weight = hit
        before = low[max(0, m.start() - WINDOW) : m.start()].rpartition("\n")[2]
        after = low[m.end() : m.end() + WINDOW].partition("\n")[0]
        if quoted_between(before, after):
            quoted += weight
        elif kind == 2:
            misspelled += weight
        else:
            strong, total = max(strong, weight), total + weight
    return strong, math.log1p(total), math.log1p(100 * total / max(20, len(tokens))), math.log1p(misspelled), math.log1p(quoted)


def quoted_between(before: str, after: str) -> bool:
    """Whether quotation marks stand on both sides; apostrophes are none. A single closing mark needs an opening one."""
    before, after = (APOSTROPHE.sub("", x) for x in (before, after))
    opened = any(c in QUOTES and c != "’" for c in before)
    return opened and any(c in QUOTES for c in after)


@dataclass
class Model:
    lexicon: Lexicon
    weights: np.ndarray
    #: (term): words that clean documents use, which are never misspellings; None without a lexicon.
    used: DataFrame | None = None



def probability(x: np.ndarray, weights: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(weights[0] + x @ weights[1:], -30, 30)))


def fit_logistic(x: np.ndarray, y: np.ndarray, prior: np.ndarray, ridge: float = 1.0, rounds: int = 40) -> np.ndarray:
    """Newton's method for logistic regression with a ridge towards ``prior``; the first weight is the intercept."""
    a = np.column_stack([np.ones(len(x)), x])
    w = prior.astype(float).copy()
    pull = np.diag([0.01] + [ridge] * x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + pull, a.T @ (y - p) - pull @ (w - prior))
        w += np.clip(step, -2, 2)
        if abs(step).max() < 1e-6:
            break
    return w


def labelled(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """(_text, _y) of the labelled training rows: those whose crc32(id as text) mod 4 is not 2."""
    own = labels.where(f"`{label_col}` is not null and `{id_col}` is not null")
    own = own.groupBy(F.col(id_col).alias("_lid")).agg(F.max(F.col(label_col).cast("int")).alias("_y"))
    own = own.where(F.crc32(F.col("_lid").cast("string")) % 4 != 2)
    if labels.count() <= BROADCAST_LABELS:
        own = F.broadcast(own)
    return docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(own, F.col("_id") == F.col("_lid")).select("_id", "_text", "_y")


def first_copies(train: DataFrame) -> DataFrame:
    """One row of each distinct text and label of stored rows (_row, _text, _y)."""
    firsts = stored(train.groupBy(F.md5(F.coalesce("_text", F.lit(""))).alias("_h"), F.col("_y") > 0).agg(F.min("_row").alias("_row")).select("_row"), "first-copies")
    if firsts.count() <= BROADCAST_LABELS:
        firsts = F.broadcast(firsts)
    return train.join(firsts, "_row", "left_semi")


def term_counts(train: DataFrame) -> DataFrame:
    """(term, y, n): in how many documents of label y a word, or a stem (ending in ``*``), occurs."""

    def run(batches):
        counts: tuple[Counter, Counter] = (Counter(), Counter())
        for pdf in batches:
            for text, y in zip(pdf["_text"], pdf["_y"], strict=True):
                found = set(TOKEN.findall((text or "").lower()))
                counts[y > 0].update(found)
                counts[y > 0].update({w[:n] + "*" for w in found for n in STEMS if len(w) > n})
            if sum(map(len, counts)) > 500_000:
                yield from out(counts)
        yield from out(counts)

    def out(counts):
        for y, c in enumerate(counts):
            if c:
                yield pd.DataFrame({"term": list(c), "y": np.int32(y), "n": np.array(list(c.values()), np.int64)})
                c.clear()

    parts = train.select("_text", "_y").mapInPandas(run, "term string, y int, n long")
    return parts.groupBy("term").agg(
        F.sum(F.when(F.col("y") == 1, F.col("n")).otherwise(0)).alias("bad"), F.sum(F.when(F.col("y") == 0, F.col("n")).otherwise(0)).alias("good")
    )


def fit(
    docs: DataFrame,
    labels: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    fit_rows: int = 10_000,
    min_docs: int = 5,
    min_weight: float = 1.0,
) -> Model:
    """The model of the label. Without rows of both labels the lexicon is empty and every score is the labels' rate."""
    train = labelled(docs, labels, id_col, text_col, label_col)
    train = stored(train.withColumn("_row", F.monotonically_increasing_id()), "labelled", compression="zstd")
    n = {r["_y"] > 0: r["count"] for r in train.groupBy((F.col("_y") > 0).cast("int").alias("_y")).count().collect()}
    bad, good = n.get(True, 0), n.get(False, 0)
    none = np.zeros(1 + len(FEATURES))
    none[0] = math.log((bad + 0.5) / (good + 0.5)) if bad + good else -10.0
    if not bad or not good:
        return Model(Lexicon({}, {}), none)
    share = min(1.0, fit_rows / (bad + good))
    once = first_copies(train)
    n = {r["_y"] > 0: r["count"] for r in once.groupBy((F.col("_y") > 0).cast("int").alias("_y")).count().collect()}
    bad, good = n.get(True, 0), n.get(False, 0)
    counts = stored(term_counts(once), "term-counts", compression="zstd")
    weight = (
        F.log((F.col("bad") + 0.5) / (bad + 1)) - F.log((F.col("good") + 0.5) / (good + 1))
        - 1.64 * F.sqrt(1 / (F.col("bad") + 0.5) + 1 / (F.col("good") + 0.5))
    )
    rows = counts.where(F.col("bad") >= min_docs).withColumn("w", weight).where(F.col("w") >= min_weight).collect()
    found = {r["term"]: float(r["w"]) for r in rows}
    lexicon = Lexicon({t: w for t, w in found.items() if t[-1] != "*"}, {t[:-1]: w for t, w in found.items() if t[-1] == "*"})
    used = counts.where("good >= 1 and term not like '%*'").where(weight < min_weight).select("term")

    # A share of the labelled rows by a hash of the id: about fit_rows of them.
    sample = train.where(F.pmod(F.xxhash64("_id"), F.lit(1 << 20)) < int(share * (1 << 20)))
    x = with_features(sample, Model(lexicon, none, used), "_text", ["_y"]).toPandas()
    # Misspelled terms are rare in labels: what is learned of them starts from what terms are worth.
    prior = none.copy()
    prior[1 + FEATURES.index("misspelled")] = 1.0
    return Model(lexicon, fit_logistic(x[list(FEATURES)].to_numpy(float), (x["_y"] > 0).to_numpy(float), prior), used)


def matches(docs: DataFrame, model: Model, text_col: str) -> DataFrame:
    """(word, kind, weight) of the distinct words of all texts that match the lexicon; kind 2 is a misspelling."""
    lexicon = model.lexicon

    def words(batches):
        new: set[str] = set()
        for b in batches:
            for t in b.column(0):
                new.update(TOKEN.findall((t.as_py() or "").lower()))
            if len(new) > 500_000:
                yield from out(new)
        yield from out(new)

    def out(new):
        import pyarrow as pa

        some = [w for w in new if 4 <= len(w) <= lexicon.longest or lexicon.direct(w)]
        new.clear()
        for lo in range(0, len(some), 20_000):
            yield pa.RecordBatch.from_arrays([pa.array(some[lo : lo + 20_000], pa.string())], names=["word"])

    def match(batches):
        for pdf in batches:
            for lo in range(0, len(pdf), 10_000):
                part = pdf["word"].iloc[lo : lo + 10_000].tolist()
                found = []
                for w, term in zip(part, lexicon.near(part), strict=True):
                    if hit := lexicon.direct(w):
                        found.append((w, *hit))
                    elif term:
                        found.append((w, 2, lexicon.terms[term]))
                yield pd.DataFrame(found, columns=["word", "kind", "weight"])

    distinct = docs.select(F.col(text_col)).mapInArrow(words, "word string").distinct()
    hits = distinct.mapInPandas(match, "word string, kind int, weight double")
    if model.used is not None:
        clean = model.used.select(F.col("term").alias("_clean"), F.lit(2).alias("_kind"))
        hits = hits.join(clean, (F.col("word") == F.col("_clean")) & (F.col("kind") == F.col("_kind")), "left_anti")
    return stored(hits, "toxic-words")


def with_features(docs: DataFrame, model: Model, text_col: str, keep: list[str]) -> DataFrame:
    """The ``keep`` columns and the features of the text."""
    row = F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in keep])
    texts = docs.select(row.alias("_row"), F.col(text_col).alias("_text"))
    hits = matches(texts, model, "_text") if model.lexicon.terms or model.lexicon.stems else None
    if hits is None or hits.count() <= HITS:
        table = {} if hits is None else {r["word"]: (r["kind"], r["weight"]) for r in hits.collect()}
        texts = texts.withColumn("_hits", F.lit(None).cast("array<struct<word:string,kind:int,weight:double>>"))
    else:
        table = None
        texts = with_hits(texts, hits)

    def run(batches):
        import pyarrow as pa

        for b in batches:
            rows, own = [], [None] * b.num_rows if table is not None else b.column(2).to_pylist()
            for t, mine in zip(b.column(1), own, strict=True):
                found = table if table is not None else {h["word"]: (h["kind"], h["weight"]) for h in mine or ()}
                rows.append(features(t.as_py() or "", found))
            x = np.array(rows, float).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(x[:, i]) for i in range(len(FEATURES))]], names=["_row", *FEATURES])

    schema = texts.select("_row", *[F.lit(0.0).alias(f) for f in FEATURES]).schema
    found = texts.mapInArrow(run, schema)
    return found.select(*[F.col(f"_row.`{c}`").alias(c) for c in keep], *FEATURES)


def with_hits(texts: DataFrame, hits: DataFrame) -> DataFrame:
    """``texts`` with ``_hits``: the rows of the table that each text's words match."""
    texts = stored(texts.withColumn("_no", F.monotonically_increasing_id()), "texts", compression="zstd")

    def words(batches):
        import pyarrow as pa

        for b in batches:
            for no, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                found = list(set(TOKEN.findall((t.as_py() or "").lower())))
                yield pa.RecordBatch.from_arrays([pa.array([no] * len(found), pa.int64()), pa.array(found, pa.string())], names=["_of", "_word"])

    own = texts.select("_no", "_text").mapInArrow(words, "_of long, _word string")
    mine = own.join(hits, F.col("_word") == F.col("word")).groupBy("_of").agg(F.collect_list(F.struct("word", "kind", "weight")).alias("_hits"))
    return texts.join(mine, F.col("_no") == F.col("_of"), "left").select("_row", "_text", "_hits")


def score(docs: DataFrame, model: Model, *, text_col: str = "text", keep: list[str] | None = None, threshold: float = 0.3) -> DataFrame:
    """The ``keep`` columns (all by default) with score (0 to 1) and predicted (1 if score >= threshold).

    Only the text is scored, and all of it. Null and empty texts get the score of a text without hits. Repeated rows
    are scored each. Columns named score, predicted or like a feature are replaced.
    """
    from pyspark.sql.functions import pandas_udf

    docs = without(ensure_columns(docs, **{text_col: "string"}), "score", "predicted", *FEATURES)
    keep = [c for c in (keep or docs.columns) if c in docs.columns]

    weights = model.weights

    @pandas_udf("double")
    def value(*cols: pd.Series) -> pd.Series:
        return pd.Series(probability(np.column_stack(cols), weights))

    d = with_features(docs, model, text_col, keep).withColumn("score", value(*FEATURES))
    d = d.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
    return d.select(*[F.col(f"`{c}`") for c in keep], "score", "predicted")
