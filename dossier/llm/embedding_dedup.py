"""Near-duplicate vectors by NN-descent.

1. Equal vectors of one label become one node with its number of copies.
2. A first neighbour graph comes from ``tables`` sorted orders (label, sign bits of random projections, one
   projection): each node is compared with the next ``WINDOW`` nodes of its label. Orders are range-partitioned, so a
   dense spot is cut like any other.
3. Each round joins neighbours of neighbours: a node's neighbours, forward and reverse, are compared with one another,
   and every node keeps its ``k`` best. A node whose whole list is above the threshold is saturated: its ``k`` doubles.
   Rounds end when no list grows and the links in the lists grow by no more than GAIN of them.
4. Every compared pair at or above the threshold is a link. Lists stop growing at ``MOST`` neighbours. A list still
   saturated then can hide links to another component only: the members of each component are compared exactly for their
   counts, in cells of bounded size. Pivots of the components with such lists are therefore put in sorted orders of their
   own, and components whose pivots are within three times the threshold's angle are compared with each other exactly.
5. Recall is audited in each label: the links of every 100th node, and of about AUDIT nodes whose best neighbour found
   is a link or a near miss, are counted by brute force over the label. Labels with less than ``recall`` of them are
   searched again with new orders, and after ``tries`` searches compared exactly. What was measured can be written out.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ensure_columns, stored
from .components import components

WINDOW, MOST, CELL, AUDIT = 10, 32, 1024, 256
#: How far below the threshold a best neighbour makes a node a near miss.
MISS = 0.03
#: The least share of new links in the lists that is worth another round.
GAIN = 0.001


def unit(vectors) -> np.ndarray:
    x = np.stack([np.asarray(v, np.float64) for v in vectors])
    x = x / np.abs(x).max(axis=1, keepdims=True)  # so that no square overflows or vanishes
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def nodes_of(rows: DataFrame) -> DataFrame:
    """Rows (vec_id, vec, label) to nodes: nid, label, dim, vec, rep (smallest id), copies. Rows that can't link are left out."""
    finite = F.forall("vec", lambda x: F.coalesce(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    some = F.exists("vec", lambda x: x != 0)
    good = rows.where(F.col("label").isNotNull() & F.col("vec").isNotNull()).where(finite).where(some)
    g = good.groupBy("label", "vec").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"))
    return stored(g.select(F.monotonically_increasing_id().alias("nid"), "label", F.size("vec").alias("dim"), "vec", "rep", "copies"), "vectors")


def window_pairs(nodes: DataFrame, seed: int, tables: int) -> DataFrame:
    """(u, v, s): similarities of nodes that are close in one of the sorted orders; a label's size sets its sign bits."""
    few = F.greatest(F.lit(1), F.least(F.lit(30), F.floor(F.log2(F.count("*") / WINDOW)))).cast("int")
    nodes = nodes.join(nodes.groupBy("label", "dim").agg(few.alias("bits")), ["label", "dim"])

    def keys(batches):
        for pdf in batches:
            for dim, part in pdf.groupby("dim"):
                x = unit(part["vec"])
                for t in range(tables):
                    r = np.random.default_rng([seed, t, int(dim)]).standard_normal((int(dim), 31))
                    p = x @ r
                    key = ((p[:, :30] > 0) @ (1 << np.arange(30, dtype=np.int64))).astype(np.int64) & ((1 << part["bits"].to_numpy(np.int64)) - 1)
                    yield part[["label", "dim", "nid", "vec"]].assign(t=np.int32(t), key=key, proj=p[:, 30])

    def near(batches):
        tail = None
        for pdf in batches:
            new = len(pdf)
            pdf = pdf if tail is None else pd.concat([tail, pdf], ignore_index=True)
            for (_, _, dim), part in pdf.groupby(["t", "label", "dim"], sort=False):
                x, ids, fresh = unit(part["vec"]), part["nid"].to_numpy(), part.index.to_numpy() >= len(pdf) - new
                for o in range(1, min(WINDOW, len(part) - 1) + 1):
                    use = fresh[o:]  # pairs within the tail have been compared before
                    s = np.einsum("ij,ij->i", x[:-o][use], x[o:][use])
                    yield pd.DataFrame({"u": ids[:-o][use], "v": ids[o:][use], "s": s})
            tail = pdf.iloc[-WINDOW:]

    label, vec = (nodes.schema[c].dataType.simpleString() for c in ("label", "vec"))
    dealt = nodes.select("label", "dim", "nid", "vec", "bits").mapInPandas(
        keys, f"label {label}, dim int, nid long, vec {vec}, t int, key long, proj double"
    )
    order = ["t", "label", "dim", "key", "proj", "nid"]
    return dealt.repartitionByRange(*order).sortWithinPartitions(*order).mapInPandas(near, "u long, v long, s double")


def best(pairs: DataFrame, least: int, threshold: float) -> DataFrame:
    """(u, v, s, k, saturated, kth): the k best neighbours of each node; k is the greatest that a row of the pairs
    (u, v, s, k) names for its node u, ``least`` if none does."""
    both = pairs.select("u", "v", "s", "k").union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v"), "s", F.lit(None).cast("int").alias("k")))
    # Dealt by node, pairs need no further shuffle to be grouped and ranked.
    both = both.where("u <> v").repartition("u").groupBy("u", "v").agg(F.max("s").alias("s"), F.max("k").alias("k"))
    node = Window.partitionBy("u")
    both = both.withColumn("k", F.coalesce(F.max("k").over(node), F.lit(least)))
    kept = both.withColumn("r", F.row_number().over(node.orderBy(F.desc("s"), "v"))).where("r <= k")
    kept = kept.withColumns({"kth": F.min("s").over(node), "n": F.count("*").over(node)})
    return kept.select("u", "v", "s", "k", ((F.col("n") == F.col("k")) & (F.col("kth") >= threshold)).alias("saturated"), "kth")


def linked(pairs: DataFrame, threshold: float) -> DataFrame:
    """(u, v) of the links among the pairs, the smaller node first."""
    return pairs.where(F.col("s") >= threshold).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))


def descend(graph: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """(u, v, s): pairs among the neighbours of each node that are links or better than the worst one of either's list."""
    kth = graph.groupBy("u").agg(F.min("kth").alias("kth")).withColumnRenamed("u", "kid")
    reverse = Window.partitionBy("v").orderBy(F.desc("s"), "u")
    back = graph.withColumn("r", F.row_number().over(reverse)).where("r <= k").select(F.col("v").alias("w"), F.col("u").alias("x"))
    around = graph.select(F.col("u").alias("w"), F.col("v").alias("x")).union(back).distinct()
    ends = nodes.select("nid", "vec").join(kth, F.col("nid") == F.col("kid")).drop("kid")
    lists = around.join(ends, F.col("x") == F.col("nid")).groupBy("w").agg(F.collect_list(F.struct("nid", "kth", "vec")).alias("l"))

    def compare(batches):
        import pyarrow as pa

        for b in batches:
            lists_ = b.column(0)
            flat = lists_.flatten()
            ids, kth_ = (flat.field(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            vec = flat.field(2)
            values = vec.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            starts = np.concatenate([[0], np.cumsum(vec.value_lengths().to_numpy(zero_copy_only=False))])
            ends_ = np.cumsum(lists_.value_lengths().to_numpy(zero_copy_only=False))
            out = []
            for a, z in zip([0, *ends_[:-1].tolist()], ends_.tolist(), strict=True):
                if z - a < 2:
                    continue
                x = values[starts[a] : starts[z]].reshape(z - a, -1)
                x = unit(x)
                s = x @ x.T
                i, j = np.nonzero(np.triu((s >= threshold) | (s > np.minimum(kth_[a:z, None], kth_[None, a:z])), 1))
                out.append((ids[a + i], ids[a + j], s[i, j]))
            cols = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["u", "v", "s"])

    # The neighbours of a node have its label and length, as every pair in the graph has.
    return lists.select("l").mapInArrow(compare, "u long, v long, s double")


def exact_counts(nodes: DataFrame, comps: DataFrame, threshold: float) -> DataFrame:
    """(cid, more): for each node of a component, the copies of other nodes of it at or above the threshold."""
    shared = max(1, -(-comps.count() // CELL))  # groups of about CELL nodes
    sizes = comps.groupBy("component").agg(F.ceil(F.count("*") / CELL).cast("int").alias("chunks")).withColumnRenamed("component", "_c")
    m = comps.join(sizes, F.col("component") == F.col("_c")).join(nodes.select("nid", "vec", "copies"), F.col("node") == F.col("nid"))
    m = m.withColumn("c", F.pmod(F.xxhash64("nid"), F.col("chunks")).cast("int"))
    m = m.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    # Small components share groups, a large one has its cells to itself.
    group = F.when(F.col("chunks") == 1, F.pmod(F.xxhash64("component"), F.lit(shared))).otherwise(F.col("component") + shared)
    m = m.select(group.alias("g"), "component", F.least("c", "o").alias("c1"), F.greatest("c", "o").alias("c2"), "c", "nid", "vec", "copies")

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, part in pdf.groupby("component"):
            c1, c2 = int(part["c1"].iloc[0]), int(part["c2"].iloc[0])
            x, n, ids, c = unit(part["vec"]), part["copies"].to_numpy(), part["nid"].to_numpy(), part["c"].to_numpy()
            if c1 == c2:
                hit = x @ x.T >= threshold
                np.fill_diagonal(hit, False)
                out.append(pd.DataFrame({"cid": ids, "more": hit @ n}))
            else:
                a, b = c == c1, c == c2
                hit = x[a] @ x[b].T >= threshold
                out += [pd.DataFrame({"cid": ids[a], "more": hit @ n[b]}), pd.DataFrame({"cid": ids[b], "more": hit.T @ n[a]})]
        return pd.concat(out)

    cells = m.groupBy("g", "c1", "c2").applyInPandas(count, "cid long, more long")
    return cells.groupBy("cid").agg(F.sum("more").alias("more"))


def spanning(hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that join the same rows as all hits do, one fewer than rows for each group."""
    new, u, v = np.ones(len(hit), bool), [], []
    for first in range(len(hit)):
        todo = [first] if new[first] else []
        new[first] = False
        while todo:
            i = todo.pop()
            more = np.nonzero(hit[i] & new)[0]
            new[more] = False
            u.append(np.full(len(more), i))
            v.append(more)
            todo += more.tolist()
    return (np.concatenate(u), np.concatenate(v)) if u else (np.zeros(0, int), np.zeros(0, int))


def exact_links(nodes: DataFrame, labels: DataFrame, threshold: float) -> DataFrame:
    """(u, v): links that join all nodes of the given (label, dim) that are joined, by comparing every cell of them."""
    m = nodes.join(labels, ["label", "dim"], "left_semi")
    sizes = m.groupBy("label", "dim").agg(F.ceil(F.count("*") / CELL).cast("int").alias("chunks"))
    m = m.join(sizes, ["label", "dim"]).withColumn("c", F.pmod(F.xxhash64("nid"), F.col("chunks")).cast("int"))
    m = m.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    m = m.select("label", "dim", F.least("c", "o").alias("c1"), F.greatest("c", "o").alias("c2"), "nid", "vec")

    def link(pdf: pd.DataFrame) -> pd.DataFrame:
        x, ids = unit(pdf["vec"]), pdf["nid"].to_numpy()
        u, v = spanning(x @ x.T >= threshold)
        return pd.DataFrame({"u": ids[u], "v": ids[v]})

    return m.groupBy("label", "dim", "c1", "c2").applyInPandas(link, "u long, v long")


def neighbours_links(nodes: DataFrame, graph: DataFrame, comps: DataFrame, threshold: float, seed: int, tables: int) -> DataFrame:
    """(u, v): links that join the components with saturated lists to those next to them.

    Of such a component, the least saturated node and about one saturated node in MOST are pivots. Two components are
    next to each other if pivots of theirs meet in one of the sorted orders of all pivots and lie within three times the
    threshold's angle: one for the link, and one on each side as members lie around pivots. All pairs between both are
    compared, in cells.
    """
    full = graph.where("saturated").select(F.col("u").alias("node")).distinct().join(comps, "node")
    least = full.groupBy("component").agg(F.min("node").alias("least")).withColumnRenamed("component", "_c")
    pivots = full.join(least, F.col("component") == F.col("_c"))
    some = F.pmod(F.xxhash64("node", F.lit(3)), F.lit(MOST)) == 0
    pivots = stored(pivots.where((F.col("node") == F.col("least")) | some).select("node", "component"), "vector-pivots")
    if pivots.isEmpty():
        return nodes.sparkSession.createDataFrame([], "u long, v long")
    near = window_pairs(nodes.join(pivots, F.col("nid") == F.col("node"), "left_semi"), seed, tables)
    near = near.where(F.col("s") >= float(np.cos(min(np.pi, 3 * np.arccos(min(1.0, threshold))))))
    side = lambda s: pivots.select(F.col("node").alias(s), F.col("component").alias(f"c{s}"))
    near = near.join(side("u"), "u").join(side("v"), "v").where("cu <> cv")
    near = stored(near.select(F.least("cu", "cv").alias("a"), F.greatest("cu", "cv").alias("b")).distinct(), "vector-neighbours")
    sizes = comps.groupBy("component").agg(F.ceil(F.count("*") / CELL).cast("int").alias("chunks"))
    size = lambda s: sizes.select(F.col("component").alias(s), F.col("chunks").alias(f"n{s}"))
    near = near.join(size("a"), "a").join(size("b"), "b")
    # A cell is one chunk of component a beside one chunk of component b.
    part = lambda s, o: near.select("a", "b", F.col(s).alias("component"), F.col(f"n{s}").alias("own"), F.col(f"n{o}").alias("other"), F.lit(s).alias("s"))
    m = part("a", "b").union(part("b", "a")).join(comps, "component").join(nodes.select("nid", "vec"), F.col("node") == F.col("nid"))
    m = m.withColumn("c", F.pmod(F.xxhash64("nid"), F.col("own")).cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("other") - 1)))
    ca, cb = (F.when(F.col("s") == s, F.col("c")).otherwise(F.col("o")).alias(f"c{s}") for s in "ab")
    m = m.select("a", "b", ca, cb, "s", "nid", "vec")

    def link(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y = pdf[pdf["s"] == "a"], pdf[pdf["s"] == "b"]
        if not len(x) or not len(y):
            return pd.DataFrame({"u": [], "v": []}).astype("int64")
        # Both components are joined in themselves, so one link is enough.
        i, j = np.nonzero(unit(x["vec"]) @ unit(y["vec"]).T >= threshold)
        return pd.DataFrame({"u": x["nid"].to_numpy()[i[:1]], "v": y["nid"].to_numpy()[j[:1]]})

    return m.groupBy("a", "b", "ca", "cb").applyInPandas(link, "u long, v long")


def audit(nodes: DataFrame, graph: DataFrame, counts: DataFrame, threshold: float, recall: float) -> DataFrame:
    """(label, dim, asked, of_links, of_nodes, failed): how many nodes with links were asked, and what was found of theirs.

    Every 100th node of a label, AUDIT nodes at least, and about AUDIT nodes whose best neighbour in the graph (u, s) is
    within MISS of the threshold or above it, are compared with all nodes of the label, in cells. Both the share of
    links found and its mean over linked nodes must reach ``recall``, else the label has ``failed``. Labels without links
    are left out.
    """
    sizes = nodes.groupBy("label", "dim").agg(F.count("*").alias("n_all"))
    share = F.greatest(F.lit(1), F.least(F.lit(100), F.floor(F.col("n_all") / AUDIT)))
    chunks = F.ceil(F.col("n_all") / CELL).cast("int")
    sizes = sizes.select("label", "dim", share.alias("share"), chunks.alias("chunks"), (F.ceil(chunks / share) + 1).cast("int").alias("blocks"))
    h = F.xxhash64("nid", F.lit(5))
    close = graph.where(F.col("s") >= threshold - MISS).select(F.col("u").alias("_u")).distinct().join(nodes.select("nid", "label", "dim"), F.col("_u") == F.col("nid"))
    some = close.groupBy("label", "dim").agg(F.greatest(F.lit(1), F.floor(F.count("*") / AUDIT)).alias("some"))
    close = close.join(some, ["label", "dim"]).where(F.pmod(F.xxhash64("nid", F.lit(6)), "some") == 0).select("_u")
    m = nodes.select("label", "dim", "nid", "vec", "copies").join(sizes, ["label", "dim"]).join(close, F.col("nid") == F.col("_u"), "left")
    all_ = m.select("label", "dim", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("b"), F.pmod(F.xxhash64("nid"), "chunks").cast("int").alias("c"),
        F.lit(False).alias("asked"), "nid", "vec", "copies")
    asked = m.where((F.pmod(h, "share") == 0) | F.col("_u").isNotNull()).select(
        "label", "dim", F.pmod(F.xxhash64("nid", F.lit(9)), "blocks").cast("int").alias("b"),
        F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("c"), F.lit(True).alias("asked"), "nid", "vec", "copies")

    def brute(pdf: pd.DataFrame) -> pd.DataFrame:
        q, x = pdf[pdf["asked"]], pdf[~pdf["asked"]]
        if not len(q) or not len(x):
            return pd.DataFrame({"q": [], "n": []}).astype("int64")
        hit = (unit(q["vec"]) @ unit(x["vec"]).T >= threshold) & (q["nid"].to_numpy()[:, None] != x["nid"].to_numpy()[None, :])
        return pd.DataFrame({"q": q["nid"].to_numpy(), "n": hit @ x["copies"].to_numpy()})

    true = all_.union(asked).groupBy("label", "dim", "b", "c").applyInPandas(brute, "q long, n long").groupBy("q").agg(F.sum("n").alias("n"))
    both = true.where("n > 0").join(counts, F.col("q") == F.col("cid"), "left").join(nodes.select("nid", "label", "dim"), F.col("q") == F.col("nid"))
    got = F.least(F.coalesce("more", F.lit(0)), "n")
    shares = [(F.sum(got) / F.sum("n")).alias("of_links"), F.avg(got / F.col("n")).alias("of_nodes")]
    seen = both.groupBy("label", "dim").agg(F.count("*").alias("asked"), *shares)
    return seen.withColumn("failed", F.least("of_links", "of_nodes") < recall)


def near_vectors(
    df: DataFrame, *, id_col="vec_id", vec_col="embedding", label_col="label", threshold=0.98, k=8, tables=6, tries=3, recall=0.95, seed=11,
    audit_path: str | None = None,
) -> DataFrame:
    """One row per row of ``df``: the id, n_links, component_id, kept.

    Only vectors of one label and one length are compared. A null label, a null, empty or zero vector and one with a
    null or non-finite component link with nothing: n_links is 0 and component_id the row's own id. Equal vectors
    link; each row counts. kept tells whether the id is its component's smallest (false for null ids). Repeated rows
    are returned each. Components stay as they come (float, or double for all other types); cosines are computed in
    double precision. ``audit_path`` names a new folder for what the audits measured, a row for each search and each
    label that has links. A missing label column leaves all rows without links; an empty table gives no rows.
    """
    df = ensure_columns(df, **{id_col: "long", vec_col: "array<float>", label_col: "int"})
    kind = df.schema[vec_col].dataType
    kind = "array<float>" if kind.simpleString() == "array<float>" else "array<double>"
    rows = df.select(F.col(id_col).alias("vec_id"), F.col(vec_col).cast(kind).alias("vec"), F.col(label_col).alias("label"))
    nodes = nodes_of(rows)
    links = failing = None
    for attempt in range(tries):
        todo = nodes if failing is None else nodes.join(failing, ["label", "dim"], "left_semi")
        pairs = stored(window_pairs(todo, seed + attempt, tables), "vector-pairs")
        found = linked(pairs, threshold)
        pairs, seen = pairs.withColumn("k", F.lit(None).cast("int")), None
        while True:
            graph = stored(best(pairs, k, threshold), "vector-graph")
            growing, n = graph.agg(F.max(F.col("saturated") & (F.col("k") < MOST)), F.count_if(F.col("s") >= threshold)).first()
            if seen is not None and not growing and n - seen <= GAIN * n:
                break
            grown = F.when(F.col("saturated"), F.least(2 * F.col("k"), F.lit(MOST))).otherwise(F.col("k"))
            new, seen = stored(descend(graph, nodes, threshold), "vector-pairs"), n
            found = found.union(linked(new, threshold))
            pairs = graph.select("u", "v", "s", grown.alias("k")).union(new.withColumn("k", F.lit(None).cast("int")))
        links = stored((found if links is None else links.union(found)).distinct(), "vector-found")
        comps = stored(components(links), "vector-components")
        more = stored(neighbours_links(nodes, graph, comps, threshold, seed + attempt, tables), "vector-found")
        if not more.isEmpty():
            links = links.union(more)
            comps = stored(components(links), "vector-components")
        counts = stored(exact_counts(nodes, comps, threshold), "vector-links")
        measured = stored(audit(todo, graph, counts, threshold, recall), "vector-audit")
        if audit_path:
            measured.withColumn("search", F.lit(attempt)).write.mode("append").parquet(audit_path)
        failing = measured.where("failed").select("label", "dim")
        if failing.isEmpty():
            break
    else:
        links = links.union(exact_links(nodes, failing, threshold))
        comps = stored(components(links), "vector-components")
        counts = stored(exact_counts(nodes, comps, threshold), "vector-links")
    reps = comps.join(nodes.select("nid", "rep"), F.col("node") == F.col("nid")).groupBy("component").agg(F.min("rep").alias("first"))
    reps = reps.select(F.col("component").alias("_c"), "first")
    named = comps.join(reps, F.col("component") == F.col("_c")).select("node", "first")
    info = nodes.join(named, F.col("nid") == F.col("node"), "left").join(counts, F.col("nid") == F.col("cid"), "left")
    info = stored(
        info.select(
            F.xxhash64("label", "vec").alias("_h"), F.col("label").alias("_label"), F.col("vec").alias("_vec"),
            F.coalesce("first", "rep").alias("_first"), (F.col("copies") - 1 + F.coalesce("more", F.lit(0))).alias("_links"),
        ), "vector-nodes",
    )
    same = (F.xxhash64("label", "vec") == F.col("_h")) & (F.col("label") == F.col("_label")) & (F.col("vec") == F.col("_vec"))
    out = rows.join(info, same, "left")
    component = F.when(F.col("_h").isNull(), F.col("vec_id")).otherwise(F.col("_first"))
    return out.select(
        F.col("vec_id").alias(id_col), F.coalesce("_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"),
    )
