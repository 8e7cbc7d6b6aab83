"""Line dedup: an exact set-similarity join of lines, in DataFrame functions only.

A line's tokens are its shingles of five words (fewer words: the whole line). Lines match if they are equal word for
word or the Jaccard similarity of their tokens is at least ``threshold``; a line is removed if it matches an earlier
one, earlier by document id, then line number.

1. Of a line's n distinct tokens, lowest hashes first, the first n - ceil(threshold * n) + SHARED are sought in other
   lines. Two lines that match have at least ceil(threshold * n) tokens in common, for either's n, so the first SHARED of
   these (or all, if fewer) are among the tokens sought of both. A line with fewer sought tokens that another line seeks
   too matches none and is left out of all that follows. Equal lines become one, standing where the first of them does.
   Lines of fewer than five words match nothing else.
2. All tokens of the lines left are counted, each by itself. Those of one line are shared with none and come first, then
   the others by their counts. The first n - ceil(threshold * n) + 1 in that order are a line's prefix; lines that match
   share a prefix token.
3. A line needs one earlier match only. First it is compared with the earliest line of two of its prefix tokens; where
   many lines share a token, those left are compared with the next few, twice. This settles most members of a group of
   near copies with a bounded number of pairs each. (It only affects speed: whatever it leaves goes on to step 4.)
4. Lines that are not settled are joined, as the later ones, with all lines on all prefix tokens. The length filter
   and the positional filter (tokens left after the shared one can't make up the overlap) are part of the join.
5. Pairs are verified on all tokens of both lines: on their hashes first, then on the words.

What is broadcast has a checked size (``common.small``), else Spark joins by shuffle. No group is collected.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ensure_columns, small, stored

#: Tokens that a line must share with others before all its tokens are read. (It only affects speed.)
SHARED = 3
#: Hash buckets of tokens. What is frequent stands out from the mean of a bucket; all other tokens are equally rare.
BUCKETS, STEPS = 1 << 20, (2, 8, 32)
#: Lines of a crowded token, lines that the others of a token are compared with, and how often.
MANY, LEADERS, ROUNDS = 32, 16, 2


def normal(line: Column) -> Column:
    """A line's words joined by single spaces; other white space than spaces must have been replaced."""
    s = F.trim(line)
    return F.when(F.contains(s, F.lit("  ")), F.regexp_replace(s, " +", " ")).otherwise(s)


def parted(text: Column) -> Column:
    """The lines of a text, with white space inside them turned into spaces."""
    spaced = text
    for ch in "\t\x0b\x0c\r":
        spaced = F.replace(spaced, F.lit(ch), F.lit(" "))
    other = F.contains(text, F.lit("\t")) | F.contains(text, F.lit("\x0b")) | F.contains(text, F.lit("\x0c")) | F.contains(text, F.lit("\r"))
    return F.split(F.when(other, spaced).otherwise(text), "\n")


def all_lines(own: DataFrame) -> DataFrame:
    """(_id, _th, _text) to (_id, _th, no, line): all lines with words, as words parted by single spaces."""
    lines = own.select("_id", "_th", F.posexplode(parted(F.col("_text"))).alias("no", "line"))
    return lines.withColumn("line", normal(F.col("line"))).where("line <> ''")


def n_words(line: str) -> Column:
    """How many words a line has, which single spaces part."""
    return F.length(line) - F.length(F.replace(F.col(line), F.lit(" "), F.lit(""))) + 1


def hashes(line: Column) -> Column:
    return F.transform(F.split(line, " "), lambda w: F.xxhash64(w))


def frequent_buckets(own: DataFrame, width: int) -> list[list[list[int]]]:
    """For each of STEPS the hash buckets of tokens that hold at least so many times the mean of a bucket, as lists of
    the low eight bits by the high ones."""
    lines = all_lines(own).where(n_words("line") >= width).select(hashes(F.col("line")).alias("h"))
    at = lines.select("h", F.explode(F.sequence(F.lit(0), F.size("h") - width)).alias("i"))
    bucket = F.xxhash64(*[F.get("h", F.col("i") + k) for k in range(width)]).bitwiseAND(BUCKETS - 1)
    counts = stored(at.groupBy(bucket.alias("b")).agg(F.count("*").alias("n")), "token-counts")
    mean = max(1, (counts.agg(F.sum("n")).first()[0] or 0) // BUCKETS)
    out: list[list[list[int]]] = [[[] for _ in range(BUCKETS >> 8)] for _ in STEPS]
    for r in counts.where(F.col("n") >= STEPS[0] * mean).collect():  # half of the buckets at most, a few hundredths as a rule
        for k, step in enumerate(STEPS):
            if r["n"] >= step * mean:
                out[k][r["b"] >> 8].append(r["b"] & 255)
    return out


def tokens(h: str, width: int) -> Column:
    """A hash of every ``width`` neighbours of the array column ``h``; none if there are fewer."""
    at = F.sequence(F.lit(0), F.size(h) - width)
    some = F.transform(at, lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(width)]))
    return F.when(F.size(h) >= width, some).otherwise(F.array().cast("array<bigint>"))


def ordered(t: str, frequent: list[list[list[int]]]) -> Column:
    """Distinct tokens in the order of step 1: by hash. Those of ``frequent`` buckets come last, as integers of how many
    of the STEPS their bucket reaches, then the hash; dedup_lines names none, as counting them costs more than it saves."""
    if not frequent:
        return F.sort_array(F.array_distinct(t))
    tables = [F.from_json(F.lit(json.dumps(x, separators=(",", ":"))), "array<array<int>>") for x in frequent]  # constants: each is read once
    high, low = lambda x: F.shiftright(x.bitwiseAND(BUCKETS - 1), 8).cast("int"), lambda x: x.bitwiseAND(255).cast("int")

    def rank(x, k=0):  # a bucket that does not reach a step reaches none of those after it
        return F.when(F.array_contains(F.get(tables[k], high(x)), low(x)), 1 + rank(x, k + 1)).otherwise(F.lit(0)) if k < len(tables) else F.lit(0)

    name = lambda x: F.shiftleft(rank(x).cast("long"), 57).bitwiseOR(F.shiftrightunsigned(x, 7))
    return F.sort_array(F.array_distinct(F.transform(t, name)))


def order(lines: DataFrame) -> Column:
    """What never decreases with ``at``: the id where ids are integers, else 0."""
    if lines.select("at.id").schema["id"].dataType.typeName() not in ("byte", "short", "integer", "long"):
        return F.lit(0).cast("long")
    return F.coalesce(F.greatest(F.col("at.id").cast("long"), F.lit(0)), F.lit((1 << 63) - 1))


def sought_lines(own: DataFrame, frequent: list[list[list[int]]], threshold: float, width: int) -> DataFrame:
    """All lines with words, each once: lid, at (where the first stands), n tokens, sought (the tokens of step 1).

    Equal lines are found by two 64-bit hashes.
    """
    at = F.struct(F.col("_id").isNull().alias("none"), F.col("_id").alias("id"), F.col("_th").alias("th"), F.col("no").alias("no"))
    lines = all_lines(own).select(at.alias("at"), F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(7), "line").alias("h2"), hashes(F.col("line")).alias("h"))
    lines = lines.select("at", "h1", "h2", tokens("h", width).alias("t")).select("at", "h1", "h2", ordered("t", frequent).alias("t"))
    lines = lines.select("at", "h1", "h2", "t", F.size("t").alias("n"))
    sought = F.slice("t", F.lit(1), prefix_length(F.col("n"), threshold) + (SHARED - 1))
    lines = lines.select("at", "h1", "h2", "n", sought.alias("sought"))
    once = lines.groupBy("h1", "h2").agg(F.min("at").alias("at"), *[F.first(c).alias(c) for c in ("n", "sought")])
    return stored(once.select(F.monotonically_increasing_id().alias("lid"), "at", "n", "sought"), "lines")


def sharing_lines(lines: DataFrame, threshold: float) -> DataFrame:
    """(kid): lines with as many sought tokens in other lines as step 1 asks for."""
    t = lines.where("n > 0").select("lid", "n", F.explode("sought").alias("t"))
    more = stored(t.groupBy("t").agg(F.count("*").alias("k")).where("k > 1").select(F.col("t").alias("tk")), "shared-tokens")
    hit = t.join(small(more, 24), F.col("t") == F.col("tk")).groupBy("lid", "n").agg(F.count("*").alias("k"))
    least = F.least(F.lit(SHARED), F.ceil(F.col("n") * F.lit(threshold) - 1e-9))
    return stored(hit.where(F.col("k") >= least).select(F.col("lid").alias("kid")), "sharing-lines")


def distinct_lines(own: DataFrame, frequent: list[list[list[int]]], threshold: float, width: int) -> DataFrame:
    """All lines with words, each once: lid, at (where the first stands), o, n tokens, shared, prefix, line.

    ``shared`` are the tokens that other lines have too, rarest first, and ``prefix`` those of them that are in the
    prefix; both, and the line itself, are null for lines that match no other.
    """
    once = sought_lines(own, frequent, threshold, width)
    kept = small(sharing_lines(once, threshold), 24)
    asked = asked_lines(own, once.join(kept, F.col("lid") == F.col("kid"), "left_semi").select("lid", "at"), width)
    t = asked.select("lid", F.explode("t").alias("t"))
    shared = t.withColumn("k", F.count("*").over(Window.partitionBy("t"))).where("k > 1")
    shared = shared.groupBy(F.col("lid").alias("sid")).agg(F.sort_array(F.collect_list(F.struct("k", "t"))).alias("s"))
    lines = asked.select("lid", "at", F.size("t").alias("n"), "line").join(shared, F.col("lid") == F.col("sid"), "left")
    lines = lines.select("lid", "at", "n", F.col("s.t").alias("shared"), "line")
    used = F.greatest(F.lit(0), prefix_length(F.col("n"), threshold) - (F.col("n") - F.size("shared")))
    lines = lines.select("lid", "at", "n", "shared", F.slice("shared", F.lit(1), used).alias("prefix"), "line")
    rest = once.join(kept, F.col("lid") == F.col("kid"), "left_anti").select("lid", "at", "n")
    lines = lines.unionByName(rest, allowMissingColumns=True)
    return stored(lines.select("lid", "at", order(lines).alias("o"), "n", "shared", "prefix", "line"), "lines-ranked", compression="zstd")


def prefix_length(n: Column, threshold: float) -> Column:
    return F.when(n > 0, n - F.ceil(n * F.lit(threshold) - 1e-9) + 1).otherwise(0).cast("int")


def may_match(a: dict, b: dict, threshold: float) -> Column:
    """The length and positional filters for lines with n tokens that share the one at place i."""
    need = F.ceil((a["n"] + b["n"]) * F.lit(threshold / (1 + threshold)) - 1e-9)
    return (F.least(a["n"], b["n"]) >= F.greatest(a["n"], b["n"]) * F.lit(threshold) - 1e-9) & (
        F.least(a["n"] - a["i"], b["n"] - b["i"]) >= need
    )


def some_tokens(lines: DataFrame) -> DataFrame:
    """(lid, o, t): the last and the middle one of each line's prefix tokens."""
    two = F.array_distinct(F.array(F.get("prefix", F.size("prefix") - 1), F.get("prefix", F.floor(F.size("prefix") / 2).cast("int"))))
    return lines.where("size(prefix) > 0").select("lid", "o", F.explode(two).alias("t"))


def first_candidates(t: DataFrame) -> DataFrame:
    """(x, y): each line y with the earliest line x of each of its tokens (lid, o, t)."""
    first = t.groupBy("t").agg(F.min_by("lid", "o").alias("x"), F.count("*").alias("k")).where("k > 1").select(F.col("t").alias("tx"), "x")
    return t.select("lid", "t").join(first, F.col("t") == F.col("tx")).where("x <> lid").select("x", F.col("lid").alias("y")).distinct()


def leading_candidates(t: DataFrame) -> DataFrame:
    """(x, y): each line y with the LEADERS earliest lines x of each of its tokens."""
    rank = F.row_number().over(Window.partitionBy("t").orderBy("o", "lid"))
    first = t.withColumn("r", rank).where(F.col("r") <= LEADERS).select(F.col("t").alias("tx"), F.col("o").alias("ox"), F.col("lid").alias("x"))
    return t.join(first, F.col("t") == F.col("tx")).where("x <> lid and ox <= o").select("x", F.col("lid").alias("y")).distinct()


def crowded(t: DataFrame) -> DataFrame:
    """The rows (lid, o, t) of tokens that MANY lines or more have."""
    many = t.groupBy("t").agg(F.count("*").alias("k")).where(F.col("k") >= MANY).select(F.col("t").alias("tk"))
    return t.join(many, F.col("t") == F.col("tk"), "left_semi")


def settle(_: DataFrame, lines: DataFrame, threshold: float, width: int) -> DataFrame:
    """(late): lines that match the earliest line of one of two tokens. Where many lines share a token, those that are
    left are compared with the earliest few of them, ROUNDS times, each time without the lines compared with before."""
    t = some_tokens(lines)
    pairs = stored(first_candidates(t), "line-pairs")
    done = matched(lines, pairs, threshold, width)
    t = stored(crowded(t), "crowded-tokens")
    for _ in range(ROUNDS):
        gone = done.union(pairs.select("x")).distinct().withColumnRenamed("late", "gone")
        t = stored(crowded(t.join(gone, F.col("lid") == F.col("gone"), "left_anti")), "crowded-tokens")
        if t.isEmpty():
            break
        pairs = stored(leading_candidates(t), "line-pairs")
        done = done.union(matched(lines, pairs, threshold, width))
    return stored(done.distinct(), "settled-lines")


def all_candidates(lines: DataFrame, settled: DataFrame, threshold: float) -> DataFrame:
    """(x, y): each line y that is not settled with all lines x, not later, that it may match."""
    flagged = lines.where("size(prefix) > 0").join(small(settled.withColumnRenamed("late", "done"), 24), F.col("lid") == F.col("done"), "left")
    # q is o for open lines and -1 - o for settled ones, which no o is below.
    q = F.when(F.col("done").isNull(), F.col("o")).otherwise(-1 - F.col("o"))
    # Tokens that no other line has stand before the shared ones.
    t = flagged.select(q.alias("q"), "lid", "n", (F.col("n") - F.size("shared")).alias("own"), F.posexplode("prefix").alias("i", "t"))
    t = t.select("t", "lid", "q", F.shiftleft(F.col("n").cast("long"), 32).bitwiseOR((F.col("own") + F.col("i")).cast("long")).alias("m"))
    side = lambda s: t.select(F.col("t").alias(f"t{s}"), F.col("lid").alias(s), F.col("q").alias(f"q{s}"), F.col("m").alias(f"m{s}"))
    n_i = lambda s: {"n": F.shiftright(f"m{s}", 32), "i": F.col(f"m{s}").bitwiseAND(0xFFFFFFFF)}
    not_later = F.col("qx").bitwiseXOR(F.shiftright("qx", 63)) <= F.col("qy")
    # Both sides are one exchange, as no condition is on one of them alone.
    on = (F.col("tx") == F.col("ty")) & (F.col("x") != F.col("y")) & not_later & may_match(n_i("x"), n_i("y"), threshold)
    return side("x").join(side("y"), on).select("x", "y").distinct()


def asked_lines(own: DataFrame, places: DataFrame, width: int) -> DataFrame:
    """(lid, at, line, t) of the lines (lid, at), with hashes ``t`` of their distinct tokens."""
    # One row for each document, so that its text is parted once.
    here = places.groupBy(F.col("at.id").alias("_aid"), F.col("at.th").alias("_ath")).agg(F.collect_list(F.struct("at.no", "lid", "at")).alias("_wanted"))
    here = small(stored(here, "lines-wanted"), 256)
    found = own.select("_id", "_th", "_text").join(here, F.col("_id").eqNullSafe(F.col("_aid")) & (F.col("_th") == F.col("_ath")))
    # Arrays that a lambda reads are bound by a lambda themselves: Spark then computes each once for a row.
    line = lambda parts: lambda x: F.struct(x["lid"].alias("lid"), x["at"].alias("at"), F.get(parts, x["no"]).alias("line"))
    texts = F.flatten(F.transform(F.array(parted(F.col("_text"))), lambda parts: F.transform(F.col("_wanted"), line(parts))))
    found = found.select(F.explode(texts).alias("f")).select("f.lid", "f.at", normal(F.col("f.line")).alias("line"))
    # Rows that repeat id and text give a line twice.
    found = found.groupBy("lid").agg(F.min("at").alias("at"), F.min("line").alias("line"))
    found = found.withColumn("h", hashes(F.col("line")))
    return stored(found.select("lid", "at", "line", F.array_distinct(tokens("h", width)).alias("t")), "lines-asked", compression="zstd")


def matched(lines: DataFrame, pairs: DataFrame, threshold: float, width: int) -> DataFrame:
    """(late): the later line y of each pair that matches."""
    end = lambda s, c: lines.where("shared is not null").select(F.col("lid").alias(f"l{s}"), *[F.col(k).alias(f"{k}{s}") for k in c])
    # Each side meets the pairs first, so that only lines in pairs are shuffled.
    joined = lambda p, c: p.join(end("x", c), F.col("x") == F.col("lx")).join(p.join(end("y", c), F.col("y") == F.col("ly")), ["x", "y"])
    enough = lambda common, n: common >= (n - common) * F.lit(threshold) - 1e-9
    likely = joined(small(pairs, 32), ["at", "n", "shared"]).where("atx < aty").withColumn("c", F.size(F.array_intersect("sharedx", "sharedy")))
    likely = small(stored(likely.where(enough(F.col("c"), F.col("nx") + F.col("ny"))).select("x", "y"), "likely-pairs"), 32)
    run = lambda w: lambda i: F.array_join(F.slice(w, i, F.lit(width)), " ")
    shingles = lambda w: F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(w) - width + 1), run(w)))
    words = F.array(F.struct(F.split("linex", " ").alias("a"), F.split("liney", " ").alias("b")))
    sets = F.transform(words, lambda p: F.struct(shingles(p["a"]).alias("a"), shingles(p["b"]).alias("b")))
    sure = F.exists(sets, lambda p: enough(F.size(F.array_intersect(p["a"], p["b"])), F.size(p["a"]) + F.size(p["b"])))
    return stored(joined(likely, ["line"]).where(sure).select(F.col("y").alias("late")).distinct(), "late-lines")


def late_lines(own: DataFrame, threshold: float, width: int) -> tuple[DataFrame, DataFrame]:
    """The distinct lines of (_id, _th, _text), and those of them (late) that match an earlier one."""
    lines = distinct_lines(own, [], threshold, width)
    settled = settle(own, lines, threshold, width)
    rest = matched(lines, stored(all_candidates(lines, settled, threshold), "line-pairs"), threshold, width)
    return lines, settled.union(rest)


def dedup_lines(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8, width: int = 5
) -> DataFrame:
    """``docs`` with matching later lines taken out of the text; n_lines and n_removed say how many it had and lost.

    Lines are parted by ``\\n`` and stay as they are otherwise. Lines without words match nothing and stay. A matched
    line counts as earlier for others even if it is removed itself. Documents are ordered by id, null ids last, then
    by a hash of the text; rows that repeat id and text stand in one place and do not remove each other's lines. Null
    texts stay null, with no lines. All rows and columns are returned, whatever other columns are called; columns named
    n_lines or n_removed are replaced. A missing id or text column counts as nulls; an empty table gives no rows.
    """
    docs = ensure_columns(docs, **{id_col: "long", text_col: "string"})
    keep = [c for c in docs.columns if c.lower() not in ("n_lines", "n_removed")]
    row = F.struct(*[F.col(f"`{c}`") for c in keep if c not in (id_col, text_col)], F.lit(0).alias("__n"))
    full = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.xxhash64(F.col(text_col)).alias("_th"), row.alias("_row"))
    lines, late = late_lines(full.where("_text is not null").select("_id", "_th", "_text"), threshold, width)
    # First places of the lines that stay; everything else with words goes.
    stay = lines.select("lid", "at").join(small(late, 24), F.col("lid") == F.col("late"), "left_anti")
    stay = stay.groupBy(F.col("at.id").alias("_sid"), F.col("at.th").alias("_sth")).agg(F.array_sort(F.collect_list("at.no")).alias("_stay"))
    found = full.join(small(stored(stay, "lines-that-stay"), 128), F.col("_id").eqNullSafe(F.col("_sid")) & (F.col("_th") == F.col("_sth")), "left")
    d = found.withColumn("_parts", F.coalesce(F.split("_text", "\n"), F.array().cast("array<string>")))
    # Numbers of the lines without words, which stay.
    blank = F.filter(
        F.transform("_parts", lambda line, i: F.when(~line.rlike(r"[^\x20\x09-\x0D]"), i)), lambda i: i.isNotNull()
    )
    d = d.withColumn("_all", F.sort_array(F.array_union(F.coalesce("_stay", F.array().cast("array<int>")), blank)))
    # The parts are bound by a lambda, so that they are made once for a text, whichever columns are asked for.
    joined = F.transform(F.array(F.col("_parts")), lambda p: F.array_join(F.transform(F.col("_all"), lambda i: F.get(p, i)), "\n"))
    new = F.when(F.col("_text").isNotNull(), F.get(joined, F.lit(0)))
    out = {id_col: F.col("_id"), text_col: new} | {c: F.col(f"_row.`{c}`") for c in keep if c not in (id_col, text_col)}
    n_lines = F.size("_parts").cast("long")
    return d.select(*[out[c].alias(c) for c in keep], n_lines.alias("n_lines"), (n_lines - F.size("_all")).cast("long").alias("n_removed"))
