"""Connected components of a link table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def _linked_min(edges: DataFrame) -> DataFrame:
    """Every edge (u, v) with m, the least node among u and its neighbours.

    The hash in the join key makes Spark deal both sides anew, so that a node with very many links can be split.
    """
    least = edges.groupBy("u").agg(F.min("v").alias("m")).select(
        F.col("u").alias("mu"), F.xxhash64("u").alias("mk"), F.least("u", "m").alias("m")
    )
    keyed = edges.withColumn("k", F.xxhash64("u"))
    return keyed.join(least, (F.col("u") == F.col("mu")) & (F.col("k") == F.col("mk"))).select("u", "v", "m")


def _round(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    large = _linked_min(both).where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    small = _linked_min(large)
    hooks = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return hooks.union(small.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(u, v) links between long ids to (node, component): the least id that each linked node reaches.

    Nodes without links to another node are not returned; null ends are ignored. The driver sees one count and one
    checksum a round. The number of rounds grows with the logarithm of the largest component.
    """
    edges = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where(
        "u is not null and v is not null and u <> v"
    )
    edges = stored(edges.distinct(), "links")
    seen = None
    for _ in range(max_rounds):
        mark = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen or not mark[0]:
            break
        seen = mark
        edges = stored(_round(edges), "links")
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    leaves = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return leaves.union(roots)


def forest(n: int, i, j):
    """Labels of n nodes under links i-j (numpy): nodes with one label are linked. For one task's links only."""
    import numpy as np

    label = np.arange(n)
    while len(i):
        a, b = label[i], label[j]
        differ = a != b
        if not differ.any():
            break
        i, j, a, b = i[differ], j[differ], a[differ], b[differ]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while True:
            jumped = label[label]
            if (jumped == label).all():
                break
            label = jumped
    return label
