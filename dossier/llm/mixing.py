"""Mixing sources to target weights with exact quotas, disjoint permuted blocks and a splitting tree.

1. Words are counted for each source; weights become target words (``source_targets``).
2. Each source is cut into hash blocks of about ``block_words`` words, permuted by a hash. Its target is a number of
   block draws: as many whole rounds of its permuted blocks as fit, then further blocks, the last one in part.
3. The draws of all sources are split among the output shards by a binary tree: each node shuffles its draws and
   gives half of them to each child, so the counts of the sources in a shard follow the multivariate hypergeometric
   distribution and add up exactly to the quotas.
4. Every shard takes the next disjoint run of each source's permuted blocks, as many as its quota says, and shuffles
   its documents by a hash: rows are dealt out by shard and sorted by that hash there.

The tree has as many levels as bring a shard to about ``shard_words`` words, from 3 to ``max_depth``. There are at most ``max_blocks`` blocks plus one for each source, so the tree and the windows over blocks work on a
table of bounded size whatever the corpus; documents themselves are hashed, aggregated and joined.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ensure_columns, n_words, stable_hash, stored, without


def source_targets(totals: DataFrame, weights: tuple[int, ...] = (5, 2, 1), cap: int = 3) -> DataFrame:
    """(source, source_size) with weight and target.

    Sources in code point order, null last, take the weights in turn. Targets share the sum of all sizes by weight,
    but stop at ``cap`` times the source's size; the excess is shared again by weight until none is above. In closed
    form: target = least(cap * size, level * weight), where level is the greatest of the levels at which the first
    k sources by cap / weight are at their cap and the others share what is left. The table has one row a source; it is
    ordered in one task, which takes some millions of sources.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    n = len(weights)
    t = totals.withColumn("_i", F.row_number().over(by_name) - 1)
    t = t.withColumn("weight", F.element_at(F.array(*[F.lit(int(w)) for w in weights]), F.col("_i") % n + 1))
    t = t.withColumn("_cap", F.col("source_size") * cap)
    by_ratio = Window.orderBy((F.col("_cap") / F.col("weight")).asc(), F.col("_i").asc())
    all_rows = Window.partitionBy(F.lit(1))
    before = F.sum("_cap").over(by_ratio) - F.col("_cap")
    left = F.sum("weight").over(all_rows) - F.sum("weight").over(by_ratio) + F.col("weight")
    t = t.withColumn("_level", (F.sum("source_size").over(all_rows) - before) / left)
    level = F.max("_level").over(all_rows)
    t = t.withColumn("target", F.least(F.col("_cap").cast("double"), level * F.col("weight")))
    return t.select("source", "source_size", "weight", "target")


def split_draws(draws: DataFrame, depth: int, seed: int) -> DataFrame:
    """(source, n) draws to (source, shard, n): a binary tree of multivariate hypergeometric splits."""
    units = draws.withColumn("_u", F.explode(F.sequence(F.lit(1), F.col("n").cast("int")))).select("source", "_u")
    units = units.withColumn("shard", F.lit(0))
    for level in range(depth):
        node = Window.partitionBy("shard")
        order = node.orderBy(stable_hash(seed, "split", level, F.col("source"), F.col("_u")), "source", "_u")
        units = units.withColumns({"_rank": F.row_number().over(order), "_all": F.count("*").over(node)})
        units = units.withColumn("shard", 2 * F.col("shard") + (F.col("_rank") > F.col("_all") / 2).cast("int"))
    return units.groupBy("source", "shard").agg(F.count("*").alias("n"))


def plan_mix(sized: DataFrame, *, weights, cap, seed, block_words, max_blocks, shard_words, max_depth) -> tuple[DataFrame, DataFrame]:
    """Sources with their targets and block counts; draws (source, block, shard, upto).

    sized: (_id, source, size). ``upto`` is null where a draw takes the whole block, else the greatest document hash
    that it takes. Sources without words take no part.
    """
    totals = stored(sized.groupBy("source").agg(F.sum("size").alias("source_size")), "mix-totals")
    words = totals.agg(F.sum("source_size")).first()[0] or 0
    depth = min(max_depth, max(3, (-(-int(words) // shard_words) - 1).bit_length()))
    everything = F.sum("source_size").over(Window.partitionBy(F.lit(1)))
    sources = source_targets(totals, weights, cap).withColumn(
        "_bw", F.greatest(F.lit(block_words), F.ceil(everything / max_blocks))
    )
    sources = sources.withColumn("n_blocks", F.greatest(F.lit(1), F.ceil(F.col("source_size") / F.col("_bw"))).cast("long"))
    sources = stored(sources.withColumn("rounds", F.floor(F.col("target") / F.greatest("source_size", F.lit(1)))).drop("_bw"), "mix-sources")
    b = with_block(sized, sources, seed)
    blocks = b.where("size > 0").groupBy("source", "block").agg(F.sum("size").alias("words"))
    perm = Window.partitionBy("source").orderBy(stable_hash(seed, "block", F.col("source"), F.col("block")), "block")
    blocks = blocks.withColumns({"pos": F.row_number().over(perm), "upto_words": F.sum("words").over(perm)})
    blocks = blocks.join(sources.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    rest = F.col("target") - F.col("rounds") * F.col("source_size")
    # What this block gives beyond the whole rounds: all of it, a part, or nothing.
    more = F.least(F.col("words").cast("double"), rest - (F.col("upto_words") - F.col("words")))
    blocks = stored(blocks.withColumn("more", F.greatest(more, F.lit(0.0))), "mix-blocks")

    parts = blocks.where("more > 0 and more < words").select(
        F.col("source").alias("_s"), F.col("block").alias("_b"), F.col("more").alias("_more")
    )
    edge = b.where("size > 0").join(parts, F.col("source").eqNullSafe(F.col("_s")) & (F.col("block") == F.col("_b")))
    same = edge.groupBy("source", "block", "_more", "_h").agg(F.sum("size").alias("_size"))
    run = Window.partitionBy("source", "block").orderBy("_h")
    same = same.withColumn("_mid", F.sum("_size").over(run) - F.col("_size") / 2)
    limits = same.groupBy("source", "block").agg(
        F.coalesce(F.max(F.when(F.col("_mid") <= F.col("_more"), F.col("_h"))), F.lit(-1).cast("long")).alias("upto")
    ).select(F.col("source").alias("_ls"), F.col("block").alias("_lb"), "upto")

    per_source = blocks.groupBy("source").agg(
        F.max("rounds").alias("rounds"), F.count("*").alias("n_pos"), F.sum((F.col("more") > 0).cast("long")).alias("extra")
    )
    draws = per_source.select("source", (F.col("rounds") * F.col("n_pos") + F.col("extra")).alias("n")).where("n > 0")
    quotas = split_draws(draws, depth, seed)
    upto = Window.partitionBy("source").orderBy("shard")
    quotas = quotas.withColumn("_end", F.sum("n").over(upto))
    taken = quotas.withColumn("_draw", F.explode(F.sequence(F.col("_end") - F.col("n") + 1, F.col("_end")))).select(
        F.col("source").alias("_qs"), "shard", "_draw"
    )
    n_pos = per_source.select(F.col("source").alias("_ps"), "n_pos", "rounds")
    taken = taken.join(n_pos, F.col("_qs").eqNullSafe(F.col("_ps")))
    taken = taken.withColumn("_pos", ((F.col("_draw") - 1) % F.col("n_pos")) + 1)
    taken = taken.join(
        blocks.select("source", "block", "pos", "more", "words"),
        F.col("_qs").eqNullSafe(F.col("source")) & (F.col("_pos") == F.col("pos")),
    )
    last_round = F.col("_draw") > F.col("rounds") * F.col("n_pos")
    taken = taken.join(limits, F.col("source").eqNullSafe(F.col("_ls")) & (F.col("block") == F.col("_lb")), "left")
    partial = last_round & (F.col("more") < F.col("words"))
    plan = taken.select("source", "block", "shard", F.when(partial, F.col("upto")).alias("upto"))
    return sources, stored(plan, "mix-draws")


def with_block(sized: DataFrame, sources: DataFrame, seed: int) -> DataFrame:
    """Adds the document's hash and its block within its source."""
    s = sources.select(F.col("source").alias("_s"), "n_blocks", "source_size", "target")
    d = sized.join(s, F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s")
    d = d.withColumn("_h", stable_hash(seed, "doc", F.col("_id")))
    return d.withColumn("block", F.pmod(F.col("_h"), F.col("n_blocks")))


def sizes(docs: DataFrame, id_col: str, text_col: str, source_col: str, carry: list[str] = ()) -> DataFrame:
    return docs.select(
        F.col(id_col).alias("_id"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size"),
        *[F.struct(*[F.col(f"`{c}`") for c in carry]).alias("_row")] * bool(carry),
    )


DEFAULTS = {"weights": (5, 2, 1), "cap": 3, "seed": 17, "block_words": 50_000, "max_blocks": 65_536, "shard_words": 1 << 20, "max_depth": 12}


def mix_counts(docs: DataFrame, *, id_col="doc_id", text_col="text", source_col="source", **params) -> DataFrame:
    """One row per input row: the id column, size, source_size, target, taken (size times the copies drawn), shards.

    ``shards`` lists the shards that draw the row, by number, parted by commas; taken counts what is listed there.

    Null ids hash alike and null sources are a source of their own, last in order. Null and empty texts have size 0.
    Rows that repeat an id are drawn together. A source without words has target 0. Reruns give the same result. A
    missing id, text or source column counts as nulls; an empty table gives no rows. Other columns do not matter.
    """
    p = DEFAULTS | params
    docs = ensure_columns(docs, **{id_col: "long", text_col: "string", source_col: "string"})
    sized = stored(sizes(docs, id_col, text_col, source_col), "mix-sizes")
    sources, plan = plan_mix(sized, **p)
    # A block is drawn as a whole up to ``cap`` times, and in part once.
    drawn = plan.groupBy("source", "block").agg(
        F.collect_list(F.when(F.col("upto").isNull(), F.col("shard"))).alias("whole"), F.max("upto").alias("upto"),
        F.max(F.when(F.col("upto").isNotNull(), F.col("shard"))).alias("part"),
    ).select(F.col("source").alias("_ws"), F.col("block").alias("_wb"), "whole", "upto", "part")
    d = with_block(sized, sources, p["seed"])
    d = d.join(drawn, F.col("source").eqNullSafe(F.col("_ws")) & (F.col("block") == F.col("_wb")), "left")
    none = F.array().cast("array<int>")
    shards = F.array_sort(F.concat(F.coalesce("whole", none), F.when(F.col("_h") <= F.col("upto"), F.array("part")).otherwise(none)))
    d = d.withColumn("_shards", shards)
    return d.select(
        F.col("_id").alias(id_col), "size", "source_size", "target", (F.col("size") * F.size("_shards")).alias("taken"),
        F.array_join(F.col("_shards").cast("array<string>"), ",").alias("shards"),
    )


def mix_sources(docs: DataFrame, *, id_col="doc_id", text_col="text", source_col="source", **params) -> DataFrame:
    """The mix itself: the rows of ``docs``, each as often as it is drawn, with ``shard`` and ``shard_order``.

    Rows without words are not drawn, except that a block takes its own along. Columns of ``docs`` named ``shard`` or
    ``shard_order`` are replaced; a missing id, text or source column is added as nulls. Rows are dealt out by shard and stand there in ``shard_order``, which shuffles them.
    """
    p = DEFAULTS | params
    docs = without(ensure_columns(docs, **{id_col: "long", text_col: "string", source_col: "string"}), "shard", "shard_order")
    small = stored(sizes(docs, id_col, text_col, source_col), "mix-sizes")
    sources, plan = plan_mix(small, **p)
    draws = plan.select(F.col("source").alias("_ws"), F.col("block").alias("_wb"), "shard", "upto").withColumn("_n", F.monotonically_increasing_id())
    d = with_block(sizes(docs, id_col, text_col, source_col, docs.columns), sources, p["seed"])
    d = d.join(draws, F.col("source").eqNullSafe(F.col("_ws")) & (F.col("block") == F.col("_wb")))
    d = d.where("upto is null or _h <= upto")
    d = d.withColumn("shard_order", stable_hash(p["seed"], "order", F.col("_id"), F.col("_n")))
    d = d.select(*[F.col(f"_row.`{c}`").alias(c) for c in docs.columns], "shard", "shard_order")
    return d.repartition("shard").sortWithinPartitions("shard", "shard_order")
