"""Sinks: commits, the merged store, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.store import read_store, replace_store


def record_commits(units: DataFrame, folder: str) -> None:
    """Writes each commit's records to its own partition; writing a commit again replaces it and changes nothing else."""
    units.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("repo", "sha12").parquet(folder)


def rebuild_store(spark: SparkSession, commits: str, store: str, key: str = "record_id", buckets: int = 64) -> DataFrame:
    """The merged store derived from all commits: a new version of what is in ``store``."""
    all_ = spark.read.parquet(commits)
    replace_store(spark, store, all_, key, buckets=buckets)
    return read_store(spark, store, all_)


def write_readings_csv(readings: DataFrame, folder: str) -> None:
    """test, commit, outcome, run_seconds, toolchain; commas inside fields become semicolons."""
    clean = [F.replace(F.col(c).cast("string"), F.lit(","), F.lit(";")).alias(c) for c in ("test", "commit", "outcome", "run_seconds", "toolchain")]
    readings.select(*clean).write.mode("overwrite").csv(folder, header=True)


def write_report(report: DataFrame, folder: str) -> None:
    report.write.mode("overwrite").json(folder)


def append_review(rows: DataFrame, folder: str) -> None:
    """Appends log rows; nothing is ever rewritten."""
    rows.write.mode("append").parquet(folder)
