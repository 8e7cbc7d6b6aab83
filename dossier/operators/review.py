"""Merged logs, versions of documents, and the review log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def merge_store(a: DataFrame, b: DataFrame, key: str = "record_id") -> DataFrame:
    """The union of two record logs, a record once; merging again or in another order changes nothing."""
    return a.unionByName(b).dropDuplicates([key])


def merge_versions(ours: DataFrame, theirs: DataFrame, key: str = "record_id") -> tuple[DataFrame, DataFrame]:
    """Two versions of documents (doc, record_id, text, …) merged, and versions with text but no records."""
    both = ours.withColumn("side", F.lit("ours")).unionByName(theirs.withColumn("side", F.lit("theirs")))
    refused = both.groupBy("doc", "side").agg(F.max(F.length(F.trim("text"))).alias("n"), F.count(key).alias("records")).where("n > 0 and records = 0").select("doc", "side")
    kept = both.join(refused, ["doc", "side"], "left_anti").where(f"{key} is not null")
    return kept.drop("side").dropDuplicates(["doc", key]), refused


def live_edges(edges: DataFrame, log: DataFrame) -> DataFrame:
    """Edges that no withdrawal names."""
    gone = log.where("kind = 'withdrawal'").select(F.col("target").alias("rid")).distinct()
    return edges.join(gone, "rid", "left_anti")


def review_queue(edges: DataFrame, contentions: DataFrame, log: DataFrame) -> DataFrame:
    """What waits for a person: backs and exercises edges without a human attestation or a withdrawal, rebuttals and
    contentions without a resolution; unresolved ones (1) before others, then by description."""
    target = lambda where: log.where(where).select(F.col("target").alias("id")).distinct()
    e = live_edges(edges, log).select(F.col("rid").alias("id"), "kind", F.concat_ws(" ", "kind", "src", "dst").alias("description"))
    waiting = e.where("kind in ('backs', 'x.code/exercises')").join(target("kind = 'attestation' and agent_kind = 'human'"), "id", "left_anti")
    open_ = e.where("kind = 'rebuts'").unionByName(contentions.select(F.col("label").alias("id"), F.lit("contention").alias("kind"), F.concat(F.lit("contention "), "label").alias("description")))
    open_ = open_.join(target("kind = 'resolution'"), "id", "left_anti")
    rows = waiting.withColumn("unresolved", F.lit(False)).unionByName(open_.withColumn("unresolved", F.lit(True)))
    return rows.orderBy(F.desc("unresolved"), "description")


def apply_review(actions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Actions (seq, action, target, target_kind, agent, reason) to log rows, and the refused ones.

    confirm attests; reject states a reason, attests and withdraws; close notes, attests and resolves. A rejection needs
    a reason, and contentions are only closed.
    """
    blank = F.coalesce(F.trim("reason"), F.lit("")) == ""
    why = F.when((F.col("action") == "reject") & blank, "a reason is needed").when(
        (F.col("target_kind") == "contention") & (F.col("action") != "close"), "contentions are only closed"
    ).when(~F.col("action").isin("confirm", "reject", "close"), "unknown action")
    a = actions.withColumn("refused", why)
    uid = F.sha2(F.concat_ws("\x1f", "target", "reason"), 256)
    row = lambda kind, target, step, note=None: F.struct(
        F.lit(kind).alias("kind"), target.alias("target"), F.lit(step).alias("step"), (uid if note else F.lit(None).cast("string")).alias("reason_uid")
    )
    t = F.col("target")
    rows = (
        F.when(F.col("action") == "confirm", F.array(row("attestation", t, 0)))
        .when(F.col("action") == "reject", F.array(row("reason", uid, 0, 1), row("attestation", uid, 1, 1), row("withdrawal", t, 2, 1)))
        .otherwise(F.array(row("note", uid, 0, 1), row("attestation", uid, 1, 1), row("resolution", t, 2, 1)))
    )
    done = a.where("refused is null").select("seq", "agent", F.lit("human").alias("agent_kind"), F.explode(rows).alias("r"))
    return done.select("seq", "agent", "agent_kind", "r.*"), a.where("refused is not null").drop("target_kind")
