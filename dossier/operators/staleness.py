"""What moved under the record: recorded items against items now."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def latest(df: DataFrame, keys: list[str], order: str = "seq") -> DataFrame:
    """The last record of each key."""
    w = Window.partitionBy(*keys).orderBy(F.desc(order))
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def stale_compare(recorded: DataFrame, now: DataFrame) -> DataFrame:
    """Recorded items (repo, sha, file, item, body_hash) that changed or are gone now; keyed by file and item."""
    n = now.select("repo", "file", "item", F.col("body_hash").alias("now_hash"))
    j = recorded.join(n, ["repo", "file", "item"], "left")
    moved = F.when(F.col("now_hash").isNull(), "gone").when(F.col("now_hash") != F.col("body_hash"), "changed")
    j = j.withColumn("moved", moved).where("moved is not null")
    return j.select("repo", "sha", "file", "item", "moved", T.change_reason(F.col("item"), F.col("file"), F.col("moved")).alias("reason"))


def stale_decisions(moved: DataFrame, anchors: DataFrame, edges: DataFrame) -> DataFrame:
    """Decisions that touch a moved item: anchors (uid, gist = file::item), touches edges decision -> anchor."""
    m = moved.withColumn("gist", F.concat_ws("::", "file", "item"))
    a = m.join(anchors.select("gist", F.col("uid").alias("dst")), "gist")
    e = edges.where("kind = 'x.code/touches'").select("src", "dst")
    return a.join(e, "dst").groupBy("repo", "sha", "file", "item", "moved").agg(F.array_sort(F.collect_set("src")).alias("decisions"))


def stale_counts(recorded: DataFrame, moved: DataFrame) -> DataFrame:
    """Units, changed and gone items of each recorded commit, fresh ones included."""
    r = recorded.groupBy("repo", "sha").agg(F.count("*").alias("units"))
    m = moved.groupBy("repo", "sha").agg(F.count_if(F.col("moved") == "changed").alias("changed"), F.count_if(F.col("moved") == "gone").alias("gone"))
    return r.join(m, ["repo", "sha"], "left").na.fill(0, ["changed", "gone"])


def stale_report(moved: DataFrame, counts: DataFrame, decisions: DataFrame | None = None) -> DataFrame:
    """One nested row for each stale commit: its counts and its moved items, each with the decisions that touch it
    (``stale_decisions``)."""
    on = ["repo", "sha", "file", "item"]
    if decisions is not None:
        moved = moved.join(decisions.select(*on, "decisions"), on, "left")
    else:
        moved = moved.withColumn("decisions", F.lit(None).cast("array<string>"))
    moved = moved.withColumn("decisions", F.coalesce("decisions", F.array().cast("array<string>")))
    items = moved.groupBy("repo", "sha").agg(F.array_sort(F.collect_list(F.struct("file", "item", "moved", "reason", "decisions"))).alias("items"))
    return items.join(counts, ["repo", "sha"])
