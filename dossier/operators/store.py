"""The record store: hash buckets, a Bloom filter for each, and a manifest that is swapped in one step.

Below a store's folder, ``data/_merge=…/_bucket=…`` holds the records that each merge added, ``filters/_merge=…`` the
words of the Bloom filters (bucket, word, bits) of those records, and ``manifest`` one small file a version that names the
batches which count. A merge looks its keys up in the filters, reads (of the store) the keys of those buckets only whose
filter may hold one, writes what is new, and then renames a new manifest into place. What a merge wrote before it was
lost is in no manifest, so nobody sees it. The filter is blocked: a key sets four bits of one word, so that a lookup is
one equality join, and filters of several batches are joined by ``bit_or``.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from .shared import stored

#: Keys that share a word of a filter on average, when the filter's size follows the store's.
KEYS_A_WORD = 4


@dataclass
class Manifest:
    """A version of a store: its batches (id to number of records) and the shape that all of them have."""

    version: int = 0
    buckets: int = 64
    words: int = 1 << 14
    batches: dict[str, int] = field(default_factory=dict)

    @property
    def total(self) -> int:
        return sum(self.batches.values())


def _files(spark: SparkSession, folder: str):
    """(file system, a function from a name to its path) of a folder, by Spark's own access to it."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    return path(folder).getFileSystem(spark._jsc.hadoopConfiguration()), path


def _versions(spark: SparkSession, folder: str) -> list[int]:
    fs, path = _files(spark, folder)
    at = path(f"{folder}/manifest")
    names = [x.getPath().getName() for x in fs.listStatus(at)] if fs.exists(at) else []
    return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))


def load_manifest(spark: SparkSession, folder: str) -> Manifest | None:
    """The newest version, or None where there is no store yet."""
    versions = _versions(spark, folder)
    if not versions:
        return None
    fs, path = _files(spark, folder)
    stream = fs.open(path(f"{folder}/manifest/{versions[-1]:012d}.json"))
    try:
        return Manifest(**json.loads(bytes(stream.readAllBytes()).decode("utf-8")))
    finally:
        stream.close()


def _commit(spark: SparkSession, folder: str, manifest: Manifest) -> None:
    """Makes ``manifest`` the newest version: one rename of a whole file. Another writer's version is not replaced."""
    fs, path = _files(spark, folder)
    final = path(f"{folder}/manifest/{manifest.version:012d}.json")
    draft = path(f"{folder}/manifest/.{uuid.uuid4().hex}")
    out = fs.create(draft, False)
    out.write(bytearray(json.dumps(asdict(manifest)).encode("utf-8")))
    out.close()
    if fs.exists(final) or not fs.rename(draft, final):
        fs.delete(draft, False)
        raise RuntimeError(f"version {manifest.version} of {folder} was written by another merge: merge again")


def _placed(df: DataFrame, by: Column, m: Manifest) -> DataFrame:
    """Adds bucket, filter word and the word's four bits of a key."""
    h = F.xxhash64(by)
    rest = F.xxhash64(F.lit(1), by)
    bit = lambda k: F.expr(f"shiftleft(1L, cast((shiftright(_rest, {6 * k}) & 63) as int))")
    df = df.withColumns({"_bucket": F.pmod(h, F.lit(m.buckets)).cast("int"), "_word": F.pmod(F.shiftright(h, 20), F.lit(m.words)).cast("int"), "_rest": rest})
    return df.withColumn("_bits", bit(0).bitwiseOR(bit(1)).bitwiseOR(bit(2)).bitwiseOR(bit(3))).drop("_rest")


def _batches(spark: SparkSession, folder: str, kind: str, batches, schema) -> DataFrame:
    paths = [f"{folder}/{kind}/_merge={b}" for b in batches]
    if not paths:
        return spark.createDataFrame([], schema)
    names = schema.names if isinstance(schema, StructType) else [c.split()[0] for c in schema.split(", ")]
    return spark.read.schema(schema).option("basePath", f"{folder}/{kind}").parquet(*paths).select(*names)


def _with_bucket(like: DataFrame) -> StructType:
    return StructType([*like.schema.fields, StructField("_bucket", IntegerType())])


def read_store(spark: SparkSession, folder: str, like: DataFrame, buckets: list[int] | None = None) -> DataFrame:
    """The records of the newest version (with the columns of ``like``), or of some of its buckets. Empty where there is
    no store yet."""
    m = load_manifest(spark, folder) or Manifest()
    rows = _batches(spark, folder, "data", m.batches, _with_bucket(like))
    if buckets is not None:
        rows = rows.where(F.col("_bucket").isin(buckets))
    return rows.drop("_bucket")


def may_hold(spark: SparkSession, folder: str, m: Manifest, keys: DataFrame) -> DataFrame:
    """Of keys (placed by ``_placed``), those that the filters cannot rule out."""
    filters = _batches(spark, folder, "filters", m.batches, "_word int, bits long, _bucket int")
    joined = filters.groupBy("_bucket", "_word").agg(F.bit_or("bits").alias("bits"))
    return keys.join(joined, ["_bucket", "_word"]).where(F.col("bits").bitwiseAND(F.col("_bits")) == F.col("_bits")).drop("bits")


def _write(spark: SparkSession, folder: str, batch: str, rows: DataFrame, by: str, m: Manifest, columns: list[str]) -> int:
    """Writes records and filter words of a batch; its number of records. Large buckets are split over tasks."""
    data = f"{folder}/data/_merge={batch}"
    placed = _placed(rows, F.col(by), m).select(*columns, "_bucket")
    placed.hint("rebalance", "_bucket").write.partitionBy("_bucket").parquet(data)
    back = spark.read.schema(placed.schema).parquet(data)
    words = _placed(back.select(by), F.col(by), m).groupBy("_bucket", "_word").agg(F.bit_or("_bits").alias("bits"))
    words.repartition("_bucket").write.partitionBy("_bucket").parquet(f"{folder}/filters/_merge={batch}")
    return back.count()


def _add(spark: SparkSession, folder: str, batch: DataFrame, key: str, by: str, buckets: int) -> tuple[Manifest, str | None, int, list[int]]:
    """Adds what ``batch`` holds and the store does not: (version before, batch written, added, buckets read)."""
    m = load_manifest(spark, folder) or Manifest(buckets=buckets)
    one = stored(_placed(batch.where(F.col(key).isNotNull()), F.col(by), m), "store-batch")
    # Whole records are shuffled for it only if keys are repeated.
    if not one.groupBy(key).count().where("count > 1").isEmpty():
        one = stored(one.dropDuplicates([key]), "store-batch")
    read: list[int] = []
    if m.batches:
        maybe = stored(may_hold(spark, folder, m, one.select(key, "_bucket", "_word", "_bits")).select(key, "_bucket"), "store-maybe")
        read = sorted(r["_bucket"] for r in maybe.select("_bucket").distinct().collect())  # a number for each bucket at most
        if read:
            have = read_store(spark, folder, batch.select(key), read)
            one = one.join(maybe.join(have, key, "left_semi").select(key), key, "left_anti")
    name = uuid.uuid4().hex
    added = _write(spark, folder, name, one, by, m, batch.columns)
    return m, name if added else None, added, read


def merge_into(
    spark: SparkSession, folder: str, batch: DataFrame, key: str = "record_id", *, label: str | None = None, uid: str | None = None, buckets: int = 64
) -> DataFrame:
    """Adds a batch of records to the store in ``folder``; returns one row: added, total, grew, contentions, buckets_read.

    Records are known by ``key``; repeated ones count once, and merging a batch again adds nothing. With ``label`` and
    ``uid``, contentions are the labels that a record which was added binds to a unit while another record, of the batch
    or the store, binds them to another one. Records without a key are left out. ``buckets`` is the number of buckets of
    a store that does not exist yet.
    """
    m, name, added, read = _add(spark, folder, batch, key, key, buckets)
    contended = 0
    if name:
        if label and uid:
            new = read_store_batch(spark, folder, batch, name)
            contended = _contentions(spark, f"{folder}/bindings", new, label, uid, buckets)
        _commit(spark, folder, Manifest(m.version + 1, m.buckets, m.words, m.batches | {name: added}))
    row = (added, m.total + added, added > 0, contended, len(read))
    return spark.createDataFrame([row], "added long, total long, grew boolean, contentions long, buckets_read int")


def read_store_batch(spark: SparkSession, folder: str, like: DataFrame, name: str) -> DataFrame:
    return _batches(spark, folder, "data", [name], _with_bucket(like)).drop("_bucket")


def _contentions(spark: SparkSession, folder: str, new: DataFrame, label: str, uid: str, buckets: int) -> int:
    """Contended labels among the bindings of new records. Bindings are a store of their own, dealt out by label.

    A merge that is lost after this and before its manifest leaves bindings of records that are not there; merging them
    again adds neither twice.
    """
    pair = new.where(F.col(label).isNotNull() & F.col(uid).isNotNull()).select(F.col(label).alias("label"), F.col(uid).alias("uid")).distinct()
    pair = stored(pair.withColumn("binding", F.sha2(F.concat_ws("\x1f", "label", "uid"), 256)), "store-bindings")
    before = load_manifest(spark, folder)
    known = pair.select("label", "uid")
    if before:
        placed = _placed(pair.select("label").distinct(), F.col("label"), before)
        maybe = stored(may_hold(spark, folder, before, placed).select("label", "_bucket"), "store-labels")
        read = sorted(r["_bucket"] for r in maybe.select("_bucket").distinct().collect())  # a number for each bucket at most
        if read:
            known = known.unionByName(read_store(spark, folder, pair, read).join(maybe, "label", "left_semi").select("label", "uid")).distinct()
    many = known.groupBy("label").agg(F.min("uid").alias("low"), F.max("uid").alias("high")).where("low < high")
    count = many.count()
    m, name, added, _ = _add(spark, folder, pair, "binding", "label", buckets)
    if name:
        _commit(spark, folder, Manifest(m.version + 1, m.buckets, m.words, m.batches | {name: added}))
    return count


def replace_store(spark: SparkSession, folder: str, records: DataFrame, key: str = "record_id", *, buckets: int | None = None) -> Manifest:
    """Makes ``records``, each once, the newest version of the store: one batch, with filters as large as it asks for.

    Older versions stay until ``vacuum``.
    """
    m = load_manifest(spark, folder) or Manifest()
    one = stored(records.where(F.col(key).isNotNull()).dropDuplicates([key]), "store-records")
    n = buckets or m.buckets
    words = 1 << max(6, (one.count() // (n * KEYS_A_WORD)).bit_length())
    new = Manifest(m.version + 1, n, words)
    name = uuid.uuid4().hex
    added = _write(spark, folder, name, one, key, new, records.columns)
    new.batches = {name: added} if added else {}
    _commit(spark, folder, new)
    return new


def compact(spark: SparkSession, folder: str, like: DataFrame, key: str = "record_id", *, buckets: int | None = None) -> Manifest:
    """Rewrites the store's many batches as one."""
    return replace_store(spark, folder, read_store(spark, folder, like), key, buckets=buckets)


def vacuum(spark: SparkSession, folder: str) -> int:
    """Removes what the newest version does not name: older versions and what lost merges left. Not for use while a merge
    or a reader of an older version runs. How many batch folders went."""
    m = load_manifest(spark, folder) or Manifest()
    fs, path = _files(spark, folder)
    gone = 0
    for kind in ("data", "filters"):
        at = path(f"{folder}/{kind}")
        for x in fs.listStatus(at) if fs.exists(at) else []:
            if x.getPath().getName().removeprefix("_merge=") not in m.batches:
                gone += bool(fs.delete(x.getPath(), True))
    for v in _versions(spark, folder)[:-1]:
        fs.delete(path(f"{folder}/manifest/{v:012d}.json"), False)
    return gone
