"""The folder that driver and executors share, and tables written there once."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder below ``spark.checkpoint.dir``, else below what setCheckpointDir was given."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        raise RuntimeError("set spark.checkpoint.dir (or SparkContext.setCheckpointDir) to a folder that driver and executors share")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet and read back, for what would else be computed for each of several uses."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, row_bytes: int, most: int = 64 << 20) -> DataFrame:
    """The stored ``df`` marked for broadcast if its rows, of about ``row_bytes`` bytes each, take at most ``most`` bytes."""
    return F.broadcast(df) if df.count() * row_bytes <= most else df
