"""Small helpers that the training-data operators share."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, else what setCheckpointDir was given.

    A session that names neither has no such folder, and none is made up for it: the error says what to set.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        raise RuntimeError("set spark.checkpoint.dir (or SparkContext.setCheckpointDir) to a folder that driver and executors share")
    return root.rstrip("/")


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared one."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, **options) -> DataFrame:
    """``df`` written once as Parquet to the shared folder and read back: its lineage ends there."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ensure_columns(df: DataFrame, **types: str) -> DataFrame:
    """Adds each missing column as nulls of the given type."""
    have = {c.lower() for c in df.columns}
    for name, kind in types.items():
        if name.lower() not in have:
            df = df.withColumn(name, F.lit(None).cast(kind))
    return df


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` without the columns whose names an operator is about to write (in any letter case)."""
    drop = {n.lower() for n in names}
    return df.select([F.col(f"`{c}`") for c in df.columns if c.lower() not in drop])


def words(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text, in order; none for a null text.

    White space becomes spaces first: parting at one plain character is faster than at a pattern.
    """
    spaced = F.coalesce(text, F.lit(""))
    for ch in "\t\n\x0b\x0c\r":
        spaced = F.replace(spaced, F.lit(ch), F.lit(" "))
    return F.array_remove(F.split(spaced, " "), "")


def small(df: DataFrame, row_bytes: int, most: int = 64 << 20) -> DataFrame:
    """The stored ``df`` marked for broadcast if its rows, of about ``row_bytes`` bytes each, take at most ``most``
    bytes; a larger one is left to a shuffle join."""
    return F.broadcast(df) if df.count() * row_bytes <= most else df


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def stable_hash(*parts) -> Column:
    """A 60-bit hash of the parts' texts that SQL engines agree on (the first 15 hex digits of an MD5)."""
    texts = [F.coalesce(p.cast("string"), F.lit("~")) if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    return F.conv(F.substring(F.md5(F.concat_ws("/", *texts)), 1, 15), 16, 10).cast("long")
