"""SimHash near-duplicates by vantage-point trees over Hamming distance.

The 64 bits are cut into ``GROUPS`` = 3 groups; two fingerprints within ``radius`` = 4 bits are within 4 // 3 = 1 bit of
each other in at least one of them. For each group there is one vantage-point tree under the Hamming distance of its
bits, fitted on a sample: a node holds a vantage fingerprint and a limit, fingerprints within the limit of the vantage
go left, others right. By the triangle inequality a pair within 1 bit is parted only if its right one is at most 1
beyond the limit, so fingerprints of that shell are queried against the left side too: they go into both shards. All
other branches are pruned. Of several vantages and limits a node takes that with the smallest shards, overlap included.

(One tree over all 64 bits with the full radius must take a third of all fingerprints to both sides at every node, or
two thirds with visits both ways: at 240,000 fingerprints 20 rows each, and 13 times the rows for five times the input.)

A shard is one group of a Spark job; shards with very many fingerprints are cut into cells of bounded size. Within a
cell, fingerprints are dealt into shells by their full distance to a vantage fingerprint, and each is compared exactly
with its own shell and those within ``radius`` of it. The links are returned as a forest (a row for each linked
fingerprint, never all pairs).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ensure_columns, stored
from .components import components, forest

RADIUS, GROUPS = 4, 3
#: The trees are fitted on one fingerprint in 64, but SAMPLE[0] at least and about SAMPLE[1] at most.
SAMPLE, LEAF, CELL = (20_000, 1 << 20), 2_048, 8_192


def fingerprint(text: str | None, width: int = 4) -> int:
    """64-bit SimHash of the text's word shingles, A-Z lower-cased, each occurrence counting."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined, ends = b" ".join(words), np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(width, len(words))
    hashes = [xxh64_intdigest(joined[a:b], 42) for a, b in zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)]
    over = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65_536):
        part = np.array(hashes[at : at + 65_536], "<u8")
        over += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return sum(1 << i for i in np.nonzero(2 * over > len(hashes))[0].tolist())


def with_fingerprint(docs: DataFrame, text_col: str, keep: list[str]) -> DataFrame:
    """The ``keep`` columns and ``_fp``, the fingerprint as a signed long."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            texts = b.column(b.num_columns - 1)
            fps = np.array([fingerprint(t.as_py()) for t in texts], np.uint64).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(fps)], names=[*b.schema.names[:-1], "_fp"])

    cols = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(text_col).alias("__whole_text__"))
    schema = docs.select(*[F.col(f"`{c}`") for c in keep]).withColumn("_fp", F.lit(0).cast("long")).schema
    for f in schema.fields:
        f.nullable = True
    return cols.mapInArrow(run, schema)


def masks(groups: int) -> list[int]:
    """The groups that share out the 64 bits."""
    cut = [64 * i // groups for i in range(groups + 1)]
    return [(1 << b) - (1 << a) for a, b in zip(cut, cut[1:], strict=False)]


def fit_tree(sample: np.ndarray, mask: int, near: int, most: float, depth: int = 64) -> list[tuple[int, int, int, int]]:
    """Nodes (vantage, limit, left, right) until ``most`` of the sample are left; negative children are -1 - leaf."""
    nodes: list = []
    leaves = [0]

    def best(part: np.ndarray) -> tuple[float, int, int]:
        some = part[:: max(1, len(part) // 4096)]
        found = (0.9 * len(some) ** 2, -1, -1)
        for p in some[:: max(1, len(some) // 12)][:12]:
            below = np.cumsum(np.bincount(np.bitwise_count((some ^ p) & np.uint64(mask)), minlength=65 + near))
            left, right = below[near : near + 64].astype(float), len(some) - below[:64].astype(float)
            pairs = np.where((left < len(some)) & (right < len(some)), left**2 + right**2, np.inf)
            if pairs.min() < found[0]:
                found = float(pairs.min()), int(p), int(pairs.argmin())
        return found

    def grow(part: np.ndarray, level: int) -> int:
        _, p, m = best(part) if level < depth and len(part) > most else (0, -1, -1)
        if m < 0:
            leaves[0] += 1
            return -leaves[0]
        d = np.bitwise_count((part ^ np.uint64(p)) & np.uint64(mask))
        at = len(nodes)
        nodes.append(None)
        left = grow(part[d <= m + near], level + 1)
        nodes[at] = (p, m, left, grow(part[d > m], level + 1))
        return at

    return nodes if grow(sample, 0) == 0 else []


def shards_of(fps: np.ndarray, tree: list, mask: int, near: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, leaf): the shards that each fingerprint is in, its own and those whose boundary it is near to."""
    rows_out, leaves = [], []
    todo = [(0 if tree else -1, np.arange(len(fps)))]
    while todo:
        at, rows = todo.pop()
        if at < 0:
            rows_out.append(rows)
            leaves.append(np.full(len(rows), -1 - at))
        elif len(rows):
            p, m, left, right = tree[at]
            d = np.bitwise_count((fps[rows] ^ np.uint64(p)) & np.uint64(mask))
            todo += [(left, rows[d <= m + near]), (right, rows[d > m])]
    return np.concatenate(rows_out), np.concatenate(leaves)


def cell_links(a: np.ndarray, b: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Forest of the links within ``a``, or between ``a`` and ``b``: linked fingerprints and their roots."""
    fps = a if b is None else np.concatenate([a, b])
    if not len(a):
        return fps[:0], fps[:0]
    shell = np.bitwise_count(fps ^ a[0]).astype(np.int64)
    side = np.arange(len(fps)) >= len(a)
    order = np.argsort(shell, kind="stable")
    from_, to = (order, order) if b is None else (order[~side[order]], order[side[order]])
    to_shell = shell[to]
    label = np.arange(len(fps))
    for at in range(0, len(from_), 256):
        rows = from_[at : at + 256]
        lo = np.searchsorted(to_shell, shell[rows[0]] - radius)
        hi = np.searchsorted(to_shell, shell[rows[-1]] + radius, side="right")
        lo = max(lo, at) if b is None else lo  # within one cell the earlier rows have met these
        i, j = np.nonzero(np.bitwise_count(fps[rows][:, None] ^ fps[to[lo:hi]][None, :]) <= radius)
        i, j = label[rows[i]], label[to[lo:hi][j]]
        if (i != j).any():
            label = forest(len(fps), i, j)[label]
    linked = np.nonzero(label != np.arange(len(fps)))[0]
    return fps[linked], fps[label[linked]]


def near_links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Distinct fingerprints (_fp) to a table (u, v) of links whose components are those of all links."""
    n, near = fps.count(), radius // GROUPS
    wanted = min(max(SAMPLE[0], n // 64), SAMPLE[1])
    # A share by a hash is a uniform sample that does not depend on how the rows are dealt out.
    share = int(min(1.0, wanted / max(1, n)) * (1 << 30))
    rows = fps.where(F.pmod(F.xxhash64("_fp"), F.lit(1 << 30)) < share).select("_fp").toArrow() if n > LEAF else None
    sample = np.sort(rows.column(0).to_numpy().astype(np.uint64)) if rows is not None else np.zeros(0, np.uint64)
    most = max(8, LEAF * len(sample) / max(1, n))
    trees = [(fit_tree(sample, m, near, most), m) for m in masks(GROUPS)]

    def deal(batches):
        for pdf in batches:
            x = pdf["_fp"].to_numpy().astype(np.uint64)
            for k, (tree, mask) in enumerate(trees):
                at, leaf = shards_of(x, tree, mask, near)
                yield pd.DataFrame({"tree": np.full(len(at), k, np.int32), "leaf": leaf, "fp": x[at].astype(np.int64)})

    dealt = stored(fps.select("_fp").mapInPandas(deal, "tree int, leaf long, fp long"), "vantage-leaves")
    counts = dealt.groupBy("tree", "leaf").agg(F.ceil(F.count("*") / CELL).cast("int").alias("k")).select(
        F.col("tree").alias("_t"), F.col("leaf").alias("_l"), "k"
    )
    cells = dealt.join(counts, (F.col("tree") == F.col("_t")) & (F.col("leaf") == F.col("_l")))
    cells = cells.withColumn("c", F.pmod(F.xxhash64("fp"), F.col("k")).cast("int"))
    cells = cells.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    cells = cells.select("tree", "leaf", F.least("c", "o").alias("c1"), F.greatest("c", "o").alias("c2"), "c", "fp")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        x, c = pdf["fp"].to_numpy().astype(np.uint64), pdf["c"].to_numpy()
        c1, c2 = int(pdf["c1"].iloc[0]), int(pdf["c2"].iloc[0])
        u, v = cell_links(x, None, radius) if c1 == c2 else cell_links(x[c == c1], x[c == c2], radius)
        return pd.DataFrame({"u": u.astype(np.int64), "v": v.astype(np.int64)})

    return cells.groupBy("tree", "leaf", "c1", "c2").applyInPandas(compare, "u long, v long")


def fingerprint_groups(prints: DataFrame, id_col: str) -> DataFrame:
    """Rows (id_col, _fp) to one row a distinct fingerprint: _gfp, component_id, _group, _first.

    ``_group`` is the group's name (a fingerprint), component_id its smallest id, _first true for the fingerprint
    that the smallest id has.
    """
    fps = stored(prints.groupBy("_fp").agg(F.min(id_col).alias("_rep")), "fingerprints")
    comps = stored(components(near_links(fps.select("_fp"))), "fingerprint-components")
    named = fps.join(comps, F.col("_fp") == F.col("node"), "left").withColumn("_group", F.coalesce("component", "_fp"))
    order = F.struct(F.col("_rep").isNull().alias("none"), "_rep", "_fp")
    best = named.groupBy("_group").agg(F.min(order).alias("_best"))
    best = best.withColumnRenamed("_group", "_g").withColumn("_k", F.xxhash64("_g"))
    named = named.withColumn("_kk", F.xxhash64("_group")).join(best, (F.col("_group") == F.col("_g")) & (F.col("_kk") == F.col("_k")))
    out = named.select(
        F.col("_fp").alias("_gfp"), F.col("_best._rep").alias("component_id"), "_group",
        (F.col("_fp") == F.col("_best._fp")).alias("_first"),
    )
    return stored(out, "fingerprint-groups")


def simhash_groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: the id, fingerprint (16 hex digits), component_id (smallest id reachable by links).

    Null and empty texts have fingerprint zero and are linked like others. Null ids never name a component while
    another id is there. Repeated rows are returned each; other columns do not matter.
    """
    docs = ensure_columns(docs, **{id_col: "long", text_col: "string"}).select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    prints = stored(with_fingerprint(docs, "_text", ["_id"]), "document-fingerprints")
    groups = fingerprint_groups(prints, "_id")
    joined = prints.join(groups, F.col("_fp") == F.col("_gfp"), "left")
    return joined.select(F.col("_id").alias(id_col), F.lower(F.lpad(F.hex("_fp"), 16, "0")).alias("fingerprint"), "component_id")


def simhash_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of each group the row with the smallest id stays.

    Of rows that repeat an id and a fingerprint one stays. All columns are kept, whatever they are called. Documents
    without words are one group. A missing id or text column counts as nulls. An empty table gives no rows.
    """
    docs = ensure_columns(docs, **{id_col: "long", text_col: "string"})
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    own = docs.select(F.col(id_col).alias("_id"), row.alias("_row"), F.col(text_col).alias("_text"))
    table = stored(with_fingerprint(own, "_text", ["_id", "_row"]), "documents-with-fingerprint")
    groups = fingerprint_groups(table.select("_id", "_fp"), "_id")
    chosen = groups.where("_first").select("_gfp", F.col("component_id").alias("_cid"))
    stay = table.join(chosen, (F.col("_fp") == F.col("_gfp")) & F.col("_id").eqNullSafe(F.col("_cid"))).select("_id", "_fp", "_row")
    again = table.groupBy("_fp", "_id").count().where("count > 1").select(F.col("_fp").alias("_afp"), F.col("_id").alias("_aid"))
    same = (F.col("_fp") == F.col("_afp")) & F.col("_id").eqNullSafe(F.col("_aid"))
    once = stay.join(again, same, "left_anti")
    several = stay.join(again, same, "left_semi").dropDuplicates(["_fp", "_id"])
    return once.unionByName(several).select(*[F.col(f"_row.`{c}`").alias(c) for c in docs.columns])
