"""Document frequencies kept up to date: each batch of documents adds what it changes, rewrites take back what they replace.

Versions of documents are a record store (``store.py``), dealt out by document. A batch's changes are written beside it,
below ``deltas/_merge=…``, before the manifest that names the batch: both count, or neither. The statistics are sums over
the changes of the manifest's batches, so no document is read again for them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import store
from .shared import small, stored

DELTA = "term string, df long, n_docs long, n_terms long"


def update_term_stats(spark: SparkSession, folder: str, batch: DataFrame, buckets: int = 64) -> int:
    """Takes in versions of documents (doc string, version long, terms array<string>) and returns how many were new.

    The greatest version of a document counts, in whatever order versions arrive; null or empty terms take the document
    out. A version that is there already changes nothing, so a batch may come twice.
    """
    rows = batch.select("doc", "version", "terms", F.concat_ws("@", "doc", F.col("version").cast("string")).alias("key"))
    rows = rows.where("doc is not null and version is not null")
    m, name, added, _ = store._add(spark, folder, rows, "key", "doc", buckets)
    if not name:
        return 0
    new = store.read_store_batch(spark, folder, rows, name)
    docs = stored(store._placed(new.select("doc").distinct(), F.col("doc"), m), "documents")
    maybe = store.may_hold(spark, folder, m, docs)
    read = sorted(r["_bucket"] for r in maybe.select("_bucket").distinct().collect())  # a number for each bucket at most
    # Which versions count is told by their numbers alone. Word lists are read once, of those that come or go.
    old = store.read_store(spark, folder, rows, read)
    known = old.select("doc", "version").join(docs.select("doc"), "doc", "left_semi")
    both = known.withColumn("was", F.lit(True)).unionByName(new.select("doc", "version", F.lit(False).alias("was")))
    last = both.groupBy("doc").agg(F.max(F.when(F.col("was"), F.col("version"))).alias("before"), F.max(F.when(~F.col("was"), F.col("version"))).alias("after"))
    last = stored(last.where("before is null or after > before"), "versions")
    come = last.select("doc", F.col("after").alias("version"))
    go = last.where("before is not null").select("doc", F.col("before").alias("version"))
    after = new if come.count() == added else new.join(small(come, 64), ["doc", "version"], "left_semi")
    before = old.join(small(go, 64), ["doc", "version"], "left_semi")
    changed = before.withColumn("sign", F.lit(-1)).unionByName(after.withColumn("sign", F.lit(1)))
    # A document's length goes with the first of its terms.
    each = changed.select("sign", F.size("terms").alias("n"), F.posexplode(F.array_distinct("terms")).alias("i", "term"))
    first = lambda c: F.sum(F.when(F.col("i") == 0, c).otherwise(0)).alias
    deltas = each.groupBy("term").agg(F.sum("sign").alias("df"), first(F.col("sign"))("n_docs"), first(F.col("sign") * F.col("n"))("n_terms"))
    deltas = deltas.where("df <> 0 or n_docs <> 0 or n_terms <> 0")
    deltas.write.parquet(f"{folder}/deltas/_merge={name}")
    store._commit(spark, folder, store.Manifest(m.version + 1, m.buckets, m.words, m.batches | {name: added}))
    return added


def _deltas(spark: SparkSession, folder: str) -> DataFrame:
    m = store.load_manifest(spark, folder)
    if not m:
        return spark.createDataFrame([], DELTA)
    return spark.read.schema(DELTA).parquet(*[f"{folder}/deltas/_merge={b}" for b in m.batches])


def kept_term_stats(spark: SparkSession, folder: str) -> DataFrame:
    """(term, df) of the newest versions."""
    return _deltas(spark, folder).where("term is not null").groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")


def kept_lengths(spark: SparkSession, folder: str) -> DataFrame:
    """One row: n_docs (documents with terms) and n_terms (their terms, repeats counted)."""
    d = _deltas(spark, folder)
    return d.agg(F.coalesce(F.sum("n_docs"), F.lit(0)).alias("n_docs"), F.coalesce(F.sum("n_terms"), F.lit(0)).alias("n_terms"))
