"""Quality rules: fixed base rules, and fences that adapt to each language and source.

The measures of every text are summarised for each (language, source) by quantile sketches: counts on a grid of
1 / GRID, at most TOP * GRID + 1 of them a measure, which merge by adding up and give the same quantiles on every rerun.
Small groups are merged upwards: a group with fewer than ``min_rows`` texts takes its language's fences, a small
language those of all texts. A text is kept if it passes the base rules and lies inside all fences of its group.

Only DataFrame functions are used; every row is measured once, the measures are stored and read back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ensure_columns, small, stored, words

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
#: measure -> (expression, tie guard, fence sides). Where the middle half of a group is narrower than the guard (most
#: texts have no symbols at all, say), it counts as that wide, so that a single one is not beyond the fence.
MEASURES = {
    "mean_word": ("word_chars / n_words", 0.1, "both"),
    "symbols": ("n_symbols / n_words", 0.05, "high"),
    "upper": ("n_upper / word_chars", 0.02, "high"),
    "shouts": ("n_shouts / n_words", 0.05, "high"),
    "dup_lines": ("n_dup_lines / n_lines", 0.1, "high"),
}
#: Steps of the sketches' grid in one unit; values from TOP on share its last step.
GRID, TOP = 1024, 1024


def repeat_words(tokens: str) -> Column:
    """How many words lie in a 3-word window that occurs twice or more; ``tokens`` names an array column.

    Sorted (window hash, position) pairs put equal windows side by side; the flagged positions, sorted again, cover
    min(3, gap) words each. Windows are compared by XXH64 of their three words.
    """
    w = F.col(tokens)
    windows = F.transform(
        F.sequence(F.lit(1), F.size(w) - 2),
        lambda i: F.struct(F.xxhash64(F.get(w, i - 1), F.get(w, i), F.get(w, i + 1)).alias("h"), i.alias("i")),
    )
    return F.when(F.size(w) >= 4, F.sort_array(windows))


def measured(docs: DataFrame, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    d = docs.withColumn("_w", words(F.col(text_col)))
    d = d.withColumn("_s", repeat_words("_w"))
    s = F.col("_s")
    same = lambda e, k: (F.get(s, k - 1)["h"] == e["h"]) | (F.get(s, k + 1)["h"] == e["h"])
    d = d.withColumn(
        "_p", F.sort_array(F.transform(F.filter(s, lambda e, k: F.coalesce(same(e, k), F.lit(False))), lambda e: e["i"]))
    )
    p = F.col("_p")
    covered = F.aggregate(
        F.zip_with(p, F.slice(p, 2, F.greatest(F.size(p), F.lit(1))), lambda a, b: F.least(F.lit(3), F.coalesce(b - a, F.lit(3)))),
        F.lit(0).cast("long"),
        lambda acc, x: acc + x,
    )
    d = d.withColumn("_l", F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    joined = F.array_join("_w", "")
    d = d.withColumns(
        {
            "n_words": F.size("_w").cast("long"),
            "word_chars": F.length(joined).cast("long"),
            "n_symbols": F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long"),
            "n_dup_lines": (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long"),
            "n_repeat_words": F.coalesce(covered, F.lit(0)).cast("long"),
            "n_lines": F.size("_l").cast("long"),
            "n_upper": F.regexp_count(text, F.lit(r"\p{Lu}")).cast("long"),
            "n_shouts": F.regexp_count(text, F.lit("[!?]")).cast("long"),
        }
    )
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    d = d.withColumn("base_failed", failed)
    for name, (expr, _, _) in MEASURES.items():
        top, bottom = expr.split(" / ")
        d = d.withColumn(f"_m_{name}", F.col(top) / F.greatest(F.col(bottom), F.lit(1)))
    return d.drop("_w", "_s", "_p", "_l")


def sketches(good: DataFrame) -> DataFrame:
    """(lang, source, measure, step, n): how many texts of a group lie in each step of a measure's grid."""
    steps = [F.struct(F.lit(m).alias("measure"), F.least(F.floor(F.col(f"_m_{m}") * GRID), F.lit(TOP * GRID)).cast("int").alias("step")) for m in MEASURES]
    s = good.select(F.col("_lang").alias("lang"), F.col("_source").alias("source"), F.explode(F.array(*steps)).alias("s"))
    return stored(s.groupBy("lang", "source", "s.measure", "s.step").agg(F.count("*").alias("n")), "quality-sketches")


def fences(parts: DataFrame, whiskers: float, min_rows: int) -> DataFrame:
    """(level, lang, source, fences) of all groups, languages and the whole with enough texts, from merged sketches."""
    level = lambda k, lang, source: parts.select(F.lit(k).alias("level"), lang.alias("lang"), source.alias("source"), "measure", "step", "n")
    none = F.lit(None).cast("string")
    every = level(0, F.col("lang"), F.col("source")).union(level(1, F.col("lang"), none)).union(level(2, none, none))
    merged = every.groupBy("level", "lang", "source", "measure", "step").agg(F.sum("n").alias("n"))
    own = Window.partitionBy("level", "lang", "source", "measure")
    merged = merged.withColumns({"upto": F.sum("n").over(own.orderBy("step")), "all": F.sum("n").over(own)})
    quantile = lambda q: F.min(F.when(F.col("upto") >= q * F.col("all"), F.col("step") / GRID))
    q = merged.groupBy("level", "lang", "source", "measure").agg(quantile(0.25).alias("q1"), quantile(0.75).alias("q3"), F.max("all").alias("all"))
    q = q.where((F.col("all") >= min_rows) | (F.col("level") == 2))
    out = []
    for m, (_, guard, sides) in MEASURES.items():
        reach = whiskers * F.greatest(F.col("q3") - F.col("q1"), F.lit(guard))
        out.append(F.max(F.when(F.col("measure") == m, F.col("q3") + reach)).alias(f"hi_{m}"))
        out.append(F.max(F.when(F.col("measure") == m, F.col("q1") - reach if sides == "both" else F.lit(float("-inf")))).alias(f"lo_{m}"))
    f = q.groupBy("level", "lang", "source").agg(*out)
    return f.select("level", "lang", "source", F.struct(*[c for c in f.columns[3:]]).alias("fences"))


def quality_rules(
    docs: DataFrame,
    *,
    text_col: str = "text",
    lang_col: str = "lang",
    source_col: str = "source",
    carry: list[str] | None = None,
    min_rows: int = 50,
    whiskers: float = 4.0,
) -> DataFrame:
    """One row per document: the carried columns (all by default), the base measures, base_failed, kept, reason.

    A fence lies ``whiskers`` times the width of the middle half of a group's texts beyond that half. Documents that
    fail the base rules do not enter the sketches. Quantiles are exact up to one step of the grid, 1 / GRID.

    Null and empty texts have no words, fail the base rules and are not kept. Null languages and sources are groups
    of their own. Repeated rows count and return each. Columns named like a result column are replaced. Only texts
    themselves are compared, so ties do not matter. A missing text, language or source column counts as null; an empty
    table gives no rows.
    """
    docs = ensure_columns(docs, **{text_col: "string", lang_col: "string", source_col: "string"})
    names = [*BASE, "n_lines", "n_upper", "n_shouts", "kept", "reason"]
    carry = [c for c in (docs.columns if carry is None else carry) if c.lower() not in {n.lower() for n in names}]
    # What is carried travels in one column, out of the way of all others.
    row = F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in carry])
    d = docs.select(row.alias("_row"), F.col(text_col).alias("_text"), F.col(lang_col).alias("_lang"), F.col(source_col).alias("_source"))
    d = measured(d, "_text").drop("_text")
    d = stored(d, "quality-measures")
    kept_cols = [F.col(f"_row.`{c}`").alias(c) for c in carry]

    f = stored(fences(sketches(d.where("not base_failed")), whiskers, min_rows), "quality-fences")
    at = lambda k, tag: f.where(f"level = {k}").select(*[F.col(c).alias(f"{tag}_{c}") for c in ("lang", "source", "fences")])
    g, lang, whole = at(0, "_g"), at(1, "_l"), at(2, "_a")
    table = (
        d.select("_lang", "_source").distinct()
        .join(g, F.col("_lang").eqNullSafe(F.col("_g_lang")) & F.col("_source").eqNullSafe(F.col("_g_source")), "left")
        .join(lang, F.col("_lang").eqNullSafe(F.col("_l_lang")), "left")
        .join(F.broadcast(whole), F.lit(True), "left")  # one row
        .select(F.col("_lang").alias("_tl"), F.col("_source").alias("_ts"), F.coalesce("_g_fences", "_l_fences", "_a_fences").alias("_f"))
    )
    table = small(stored(table, "quality-groups"), 512)
    joined = d.join(table, F.col("_lang").eqNullSafe(F.col("_tl")) & F.col("_source").eqNullSafe(F.col("_ts")), "left")
    reason = F.when(F.col("base_failed"), F.lit("base"))
    for m in MEASURES:
        reason = reason.when(
            (F.col(f"_m_{m}") > F.col(f"_f.hi_{m}")) | (F.col(f"_m_{m}") < F.col(f"_f.lo_{m}")), F.lit(m)
        )
    return joined.withColumn("reason", reason).withColumn("kept", F.col("reason").isNull()).select(*kept_cols, *names)
