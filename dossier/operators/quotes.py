"""Where quotes come from: containment joins behind an equality key, status, support and tallies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .shared import stored

#: The place of a commit's own message.
MESSAGE = "<message>"
#: Ordered support levels.
SUPPORT = ["Prompt", "Absent", "Loose", "InCommit", "Added"]


def locate_quotes(quotes: DataFrame, texts: DataFrame) -> DataFrame:
    """(sha, quote_id, quote) x (sha, ord, place, text) to one row a quote: place, match (exact, loose or absent).

    Exact containment in any text beats containment with white space and case folded; then the lowest ord wins. Blank
    quotes are absent. The containment test runs behind the equality of sha.
    """
    exact = F.contains("t.text", "q.quote")
    hit = (F.col("q.sha") == F.col("t.sha")) & (F.trim("q.quote") != "") & (exact | F.contains(T.flat(F.col("t.text")), T.flat(F.col("q.quote"))))
    j = quotes.alias("q").join(texts.alias("t"), hit, "left")
    rank = F.when(F.col("t.sha").isNull(), 2).when(exact, 0).otherwise(1)
    best = F.min(F.struct(rank.alias("rank"), F.col("t.ord").alias("ord"), F.col("t.place").alias("place")))
    g = j.groupBy(F.col("q.sha").alias("sha"), F.col("q.quote_id").alias("quote_id")).agg(best.alias("b"))
    match = F.element_at(F.array(*map(F.lit, ["exact", "loose", "absent"])), F.col("b.rank") + 1)
    return g.select("sha", "quote_id", F.col("b.place").alias("place"), match.alias("match"))


#: Word grams and windows, longest first: of ``gram + window - 1`` words that a quote and a text share, one gram is the
#: least of a window in both.
WINNOW = [(4, 5), (2, 1), (1, 1)]


def bound(value: Column, f) -> Column:
    """``f`` of a value that is computed once, however often ``f`` reads it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def winnowed(words: Column, gram: int, window: int) -> Column:
    """The least hash of each ``window`` of neighbouring grams of ``gram`` words, each once."""
    none = F.array().cast("array<bigint>")

    def each(items: Column, width: int, f) -> Column:
        places = F.sequence(F.lit(0), F.greatest(F.size(items) - width, F.lit(0)))
        return F.when(F.size(items) >= width, F.transform(places, lambda i: f(*[F.get(items, i + j) for j in range(width)]))).otherwise(none)

    least = (lambda *g: F.least(*g)) if window > 1 else lambda g: g
    return F.array_distinct(bound(words, lambda w: bound(each(w, gram, F.xxhash64), lambda g: each(g, window, least))))


def locate_anywhere(quotes: DataFrame, texts: DataFrame) -> DataFrame:
    """(quote_id, quote) x (text_id, text) to (quote_id, text_id) of all texts that contain a quote whole.

    Without a commit to join on, quotes meet texts by winnowed word grams: a text has a row for each gram that is the
    least of a window (one in three of its words for quotes of eight inner words and more), a quote one row, its first
    window's. A quote may start or end inside a word, so only its inner words are sure to be words of the text. Quotes
    of fewer inner words meet texts by pairs of words or one word, quotes without by their first three characters or the
    first. Only hashes that a quote has leave the scan of the texts. Blank quotes are in no text.
    """
    words = lambda c: F.array_remove(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), "")
    q = quotes.where(F.trim("quote") != "").select("quote_id", "quote", words(F.col("quote")).alias("w"))
    q = q.withColumn("w", F.slice("w", F.lit(2), F.greatest(F.size("w") - 2, F.lit(0)))).withColumn("n", F.size("w"))
    way = F.lit(None).cast("int")
    for k, (gram, window) in reversed(list(enumerate(WINNOW))):
        way = F.when(F.col("n") >= gram + window - 1, k).otherwise(way)
    way = F.coalesce(way, F.when(F.length("quote") >= 3, len(WINNOW)).otherwise(len(WINNOW) + 1))
    q = stored(q.withColumn("way", way), "quotes")
    ways = sorted(r["way"] for r in q.select("way").distinct().collect())  # five numbers at most
    keyed, held = None, None
    for k in ways:
        mine = q.where(F.col("way") == k)
        if k < len(WINNOW):
            gram, window = WINNOW[k]
            mine = mine.withColumn("f", F.get(winnowed(F.slice("w", 1, gram + window - 1), gram, window), F.lit(0)))
            at = texts.where("text is not null").select("text_id", winnowed(words(F.col("text")), gram, window).alias("f"))
        else:
            length = 3 if k == len(WINNOW) else 1
            mine = mine.withColumn("f", F.xxhash64(F.substring("quote", 1, length)))
            places = F.sequence(F.lit(1), F.greatest(F.length("text") - length + 1, F.lit(1)))
            at = texts.where("text is not null").withColumn("f", F.array_distinct(F.transform(places, lambda i: F.xxhash64(F.substring(F.col("text"), i, F.lit(length))))))
        mine = mine.select("quote_id", "quote", F.xxhash64(F.lit(k), "f").alias("k"))
        hit = at.select("text_id", F.explode("f").alias("f")).select("text_id", F.xxhash64(F.lit(k), "f").alias("k"))
        hit = hit.join(mine.select("k").distinct(), "k", "left_semi")
        keyed, held = (mine, hit) if held is None else (keyed.unionByName(mine), held.unionByName(hit))
    if held is None:
        return texts.select(F.lit(None).cast(quotes.schema["quote_id"].dataType).alias("quote_id"), "text_id").limit(0)
    pairs = held.join(keyed, "k").select("quote_id", "quote", "text_id").distinct()
    return pairs.join(texts, "text_id").where(F.contains("text", "quote")).select("quote_id", "text_id").distinct()


def check_quotes(quotes: DataFrame, files: DataFrame, framing: list[str] = ()) -> DataFrame:
    """Support of each quote by its commit's files (sha, path, before, after): support and prose_only.

    Prompt if the quote is part of a framing text or holds one; else the best of Added (in after, not in before),
    InCommit, Loose (white space and case folded) and Absent over all files. Null quotes and blank ones are Absent; of these
    only the empty quote is in every file.
    """
    fold = lambda c: T.flat(F.coalesce(F.col(c), F.lit("")))
    both = F.concat_ws("\n", "f.before", "f.after")
    level = (
        F.when(F.contains(F.coalesce("f.after", F.lit("")), F.col("q.quote")) & ~F.contains(F.coalesce("f.before", F.lit("")), F.col("q.quote")), 4)
        .when(F.contains(both, F.col("q.quote")), 3)
        .when(F.contains(T.flat(both), T.flat(F.col("q.quote"))), 2)
        .otherwise(1)
    )
    j = quotes.alias("q").join(files.alias("f"), F.col("q.sha") == F.col("f.sha"), "left")
    j = j.select("q.sha", "q.quote_id", "q.quote", "f.path", level.alias("level"))
    found = (F.col("level") >= 2) & ((F.trim("quote") != "") | (F.col("quote") == ""))
    g = j.groupBy("sha", "quote_id").agg(
        F.first("quote").alias("quote"), F.max("level").alias("level"),
        F.coalesce(F.bool_and(F.when(found, T.is_prose_path(F.col("path")))), F.lit(False)).alias("prose_only"),
    )
    prompted = F.lit(False)
    for text in framing:
        prompted = prompted | F.contains(T.flat(F.lit(text)), fold("quote")) | F.contains(fold("quote"), T.flat(F.lit(text)))
    level = F.when((F.trim("quote") != "") & prompted, 0).when(F.trim("quote") == "", 1).otherwise(F.col("level"))
    name = F.element_at(F.array(*map(F.lit, SUPPORT)), level + 1)
    return g.select("sha", "quote_id", name.alias("support"), "prose_only")


def assign_status(located: DataFrame) -> DataFrame:
    """Adds status and source: a quote that was found is cited, any other speculative and without source."""
    found = F.col("match") != "absent"
    return located.withColumns({
        "status": F.when(found, "cited").otherwise("speculative"),
        "source": F.when(found, T.assign_source(F.col("place"), F.col("sha"))),
    })


def check_consequences(items: DataFrame, texts: DataFrame) -> DataFrame:
    """Consequences (sha, pos, claimed, check) with verified, check_status and check_source: a consequence is verified if
    it says so and its verification quote is found in its commit's texts (sha, ord, place, text)."""
    asked = items.where("claimed and check is not null").select("sha", F.col("pos").alias("quote_id"), F.col("check").alias("quote"))
    found = assign_status(locate_quotes(asked, texts)).where("match <> 'absent'")
    found = found.select("sha", F.col("quote_id").alias("pos"), F.col("status").alias("check_status"), F.col("source").alias("check_source"))
    return items.join(found, ["sha", "pos"], "left").withColumn("verified", F.col("check_status").isNotNull())


def quote_tallies(located: DataFrame, repo: str = "repo", built: dict[str, DataFrame] | None = None) -> DataFrame:
    """Present, loose and absent quotes for each repository, those found in its diffs, and in all (null repository).

    ``built`` names more to count by repository: what a build made and left out (units, edges, dropped), say.
    """
    found = F.col("match") != "absent"
    out = located.rollup(repo).agg(
        F.count_if(F.col("match") == "exact").alias("present"), F.count_if(F.col("match") == "loose").alias("loose"),
        F.count_if(F.col("match") == "absent").alias("absent"), F.count("*").alias("quotes"),
        F.count_if(found & (F.col("place") != MESSAGE)).alias("in_diff"),
    )
    for name, rows in (built or {}).items():
        n = rows.rollup(repo).agg(F.count("*").alias(name)).withColumnRenamed(repo, "_repo")
        out = out.join(n, F.col(repo).eqNullSafe(F.col("_repo")), "left").drop("_repo").na.fill(0, [name])
    return out


def support_histogram(checked: DataFrame) -> DataFrame:
    """Quotes by support level for each commit, and in all (null sha)."""
    counts = [F.count_if(F.col("support") == s).alias(s.lower()) for s in SUPPORT]
    return checked.rollup("sha").agg(F.count("*").alias("kept"), *counts, F.count_if("prose_only").alias("prose_only"))


def quote_filters(checked: DataFrame, *, drop_prompted=True, drop_prose_only=False, drop_not_added=False) -> tuple[DataFrame, DataFrame]:
    """Kept quotes, and the dropped ones with the filter that dropped them."""
    why = F.lit(None).cast("string")
    for on, name, test in (
        (drop_not_added, "not added", F.col("support") != "Added"), (drop_prose_only, "prose only", F.col("prose_only")),
        (drop_prompted, "prompted", F.col("support") == "Prompt"),
    ):
        why = F.when(test, F.lit(name)).otherwise(why) if on else why
    marked = checked.withColumn("dropped_by", why)
    return marked.where("dropped_by is null").drop("dropped_by"), marked.where("dropped_by is not null")


def cap_decisions(items: DataFrame, most: int = 36, *, best_first: bool = False) -> DataFrame:
    """At most ``most`` decisions a commit, in order of position or best supported first."""
    level = F.array_position(F.array(*map(F.lit, SUPPORT)), F.col("support"))
    w = Window.partitionBy("sha").orderBy(*([F.desc(level)] if best_first else []), "pos")
    return items.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= most).drop("_r")
