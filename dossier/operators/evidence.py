"""Test evidence: readings, links, mutants, vacuous tests, build coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .shared import stored

# A mutation replaces the first of these that a line has, in this order.
MUTATIONS = [(" == ", " != "), (" != ", " == "), (" < ", " >= "), (" > ", " <= "), (" && ", " || "), ("true", "false"), (" + ", " - ")]
STRETCH = 256
#: Lines of a log that one task folds together, by their positions.
BLOCK = 1 << 16


def log_events(lines: DataFrame) -> DataFrame:
    """Lines of test output with test, outcome (of tests) and result, time (of a suite's result lines); others are
    dropped. Names with spaces and other outcomes are no tests."""
    line = F.regexp_replace("line", r"^\s+|\s+$", "")
    verdict = F.regexp_extract(line, r"^test (\S+) \.\.\. +(ok$|FAILED|ignored)", 2)
    outcome = F.when(verdict == "ok", "passed").when(verdict == "FAILED", "failed").when(verdict == "ignored", "ignored")
    result = F.startswith(line, F.lit("test result:"))
    time = F.regexp_extract(line, r"finished in ([0-9.]+)s?", 1).try_cast("double")
    d = lines.withColumns({"test": F.regexp_extract(line, r"^test (\S+) \.\.\. ", 1), "outcome": outcome, "result": result, "time": F.when(result, time)})
    return d.where("outcome is not null or result").drop("line")


def read_test_log(lines: DataFrame, block: int = BLOCK) -> DataFrame:
    """(suite, pos, line) of test output to (suite, pos, test, outcome, run_seconds).

    A test takes the first non-zero time that its suite reports after it; a result line without a time repeats the one
    before.

    A suite may be one long log: its lines are folded in blocks of ``block`` positions, each by its own task. A block
    hands on two numbers: the last time that it tells, which later blocks repeat, and, once those are known, the first
    non-zero time that its lines stand for, which earlier blocks wait for.
    """
    key = ["suite", "_block"]
    d = stored(log_events(lines).withColumn("_block", F.floor(F.col("pos") / block)), "log-events")
    past, ahead = (Window.partitionBy(*key).orderBy("pos").rowsBetween(*ends) for ends in ((Window.unboundedPreceding, 0), (0, Window.unboundedFollowing)))
    ends = d.groupBy(*key).agg(F.max_by("time", F.when(F.col("time").isNotNull(), F.col("pos"))).alias("_last"))
    before = Window.partitionBy("suite").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(*key, F.coalesce(F.last("_last", ignorenulls=True).over(before), F.lit(0.0)).alias("_carried"))
    said = F.when(F.col("result"), F.coalesce(F.last("time", ignorenulls=True).over(past), F.col("_carried")))
    d = d.join(carried, key).withColumn("_said", said).withColumn("_said", F.when(F.col("_said") > 0, F.col("_said")))
    starts = d.groupBy(*key).agg(F.min_by("_said", F.when(F.col("_said").isNotNull(), F.col("pos"))).alias("_first"))
    after = Window.partitionBy("suite").orderBy("_block").rowsBetween(1, Window.unboundedFollowing)
    awaited = starts.select(*key, F.coalesce(F.first("_first", ignorenulls=True).over(after), F.lit(0.0)).alias("_awaited"))
    d = d.join(awaited, key).withColumn("run_seconds", F.coalesce(F.first("_said", ignorenulls=True).over(ahead), F.col("_awaited")))
    return d.where("outcome is not null").select("suite", "pos", "test", "outcome", "run_seconds")


def link_readings(links: DataFrame, readings: DataFrame) -> DataFrame:
    """Links (claim, test, kind) to the first reading whose test name ends with the link's, or the reverse."""
    last = lambda c: F.element_at(F.split(c, "::"), -1)
    r = readings.select(F.col("test").alias("reading"), "outcome", last("test").alias("seg"))
    j = links.withColumn("seg", last("test")).join(r, "seg")
    j = j.where(F.endswith("reading", "test") | F.endswith("test", "reading"))
    w = Window.partitionBy("claim", "test").orderBy("reading")
    return j.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r", "seg")


def edge_from_link(linked: DataFrame) -> DataFrame:
    """(claim, reading, kind, outcome) to edges: backs, rebuts, x.code/exercises; unrelated links and tests without a
    reading give none."""
    kind = (
        F.when((F.col("kind") == "verifies") & (F.col("outcome") == "passed"), "backs").when(F.col("kind") == "verifies", "rebuts")
        .when(F.col("kind") == "exercises", "x.code/exercises")
    )
    e = linked.where("outcome is not null").select(kind.alias("edge"), F.col("reading").alias("src"), F.col("claim").alias("dst"))
    return e.where("edge is not null").withColumnRenamed("edge", "kind")


def reading_attestations(units: DataFrame, importer: str) -> DataFrame:
    """(target, kind, agent, agent_kind): the importer attests each unit made from a reading."""
    return units.select(F.col("uid").alias("target"), F.lit("attestation").alias("kind"), F.lit(importer).alias("agent"), F.lit("tool").alias("agent_kind")).distinct()


def readings_to_units(readings: DataFrame) -> DataFrame:
    """Each reading as a measured data unit, identified by its content."""
    gist = F.format_string("%s %s at %s", "test", "outcome", "commit")
    u = readings.select(F.lit("data").alias("kind"), gist.alias("gist"), F.lit("measured").alias("status"), "test", "commit", "run_seconds")
    return u.withColumn("uid", F.sha2(F.to_json(F.struct("kind", "test", "commit", "gist", "status")), 256))


def mutant_rows(lines: DataFrame, functions: DataFrame, most: int = 5) -> DataFrame:
    """Source lines (file, line, text) inside functions (file, label, start, end) to at most ``most`` mutants each.

    An interval join: functions stand in each stretch of ``STRETCH`` lines that they reach into, a line meets those of its
    own stretch only. Comments, attributes and lines with quotes are left alone.
    """
    t = F.ltrim("text")
    code = lines.where(~t.rlike(r'^(//|#\[|#!|\*)') & ~F.contains("text", F.lit('"')))
    after, operator = F.lit(None).cast("string"), F.lit(None).cast("string")
    for a, b in reversed(MUTATIONS):
        at = F.instr("text", a)
        swapped = F.concat(F.expr(f"substring(text, 1, instr(text, '{a}') - 1)"), F.lit(b), F.expr(f"substring(text, instr(text, '{a}') + {len(a)})"))
        after = F.when(at > 0, swapped).otherwise(after)
        operator = F.when(at > 0, F.lit(f"{a.strip()} to {b.strip()}")).otherwise(operator)
    code = code.withColumns({"after": after, "operator": operator}).where("after is not null")
    code = code.withColumn("_at", F.floor(F.col("line") / STRETCH))
    spans = F.sequence(F.floor(F.col("start") / STRETCH), F.floor(F.col("end") / STRETCH))
    inside = functions.where("start <= end").withColumn("_at", F.explode(spans))
    j = code.join(inside, ["file", "_at"]).where("line between start and end")
    w = Window.partitionBy("file", "label").orderBy("line")
    return j.withColumn("n", F.row_number().over(w)).where(F.col("n") <= most).select("file", "label", "line", F.col("text").alias("before"), "after", "operator")


def mutation_score(outcomes: DataFrame) -> DataFrame:
    """(test, mutant, ran, passed) to caught, missed, unviable, backs and a reason. A mutant that did not run is
    unviable; it is missed if every run of it passed."""
    m = outcomes.groupBy("test", "mutant").agg(F.bool_or("ran").alias("ran"), F.bool_and(F.when(F.col("ran"), F.col("passed"))).alias("passed"))
    g = m.groupBy("test").agg(
        F.count_if(F.col("ran") & ~F.col("passed")).alias("caught"), F.count_if(F.col("ran") & F.col("passed")).alias("missed"), F.count_if(~F.col("ran")).alias("unviable")
    )
    viable = F.col("caught") + F.col("missed")
    reason = (
        F.when(viable == 0, F.format_string("%d mutants, not one could be run", "unviable"))
        .when(F.col("caught") == 0, F.format_string("notices none of %d mutants", "missed"))
        .otherwise(F.format_string("notices %d of %d mutants", F.col("caught"), viable))
    )
    return g.withColumns({"backs": (viable == 0) | (F.col("caught") > 0), "reason": reason})


def top_level_parts(args: Column) -> Column:
    """Arguments parted by commas that are in no bracket and no string."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now"), F.lit(0).alias("deep"), F.lit(False).alias("text"))

    def step(a, c):
        quote = c == '"'
        text = F.when(quote, ~a["text"]).otherwise(a["text"])
        deep = a["deep"] + F.when(a["text"], 0).when(c.isin("(", "[", "{"), 1).when(c.isin(")", "]", "}"), -1).otherwise(0)
        cut = (c == ",") & (a["deep"] == 0) & ~a["text"]
        return F.struct(
            F.when(cut, F.concat(a["done"], F.array(F.trim(a["now"])))).otherwise(a["done"]).alias("done"),
            F.when(cut, F.lit("")).otherwise(F.concat(a["now"], c)).alias("now"), deep.alias("deep"), text.alias("text"),
        )

    return F.aggregate(F.split(args, ""), start, step, lambda a: F.concat(a["done"], F.array(F.trim(a["now"]))))


def vacuous_tests(events: DataFrame) -> DataFrame:
    """Macro events (test, macro, args) to tests with the reasons why they assert nothing. White space between tokens
    does not tell arguments apart.

    Arguments are parted only where they may be a reason: without white space, equal sides are the same text twice around
    a comma, and a constant stands at the start.
    """
    equal, constant = F.col("macro").isin("assert_eq", "assert_ne"), F.col("macro") == "assert"
    twice = F.regexp_replace("args", r"\s+", "").rlike(r"(?s)^(.*),\1(,.*)?$")
    suspect = (equal & twice) | (constant & F.col("args").rlike(r"^\s*(true|1\s+==\s+1|!\s*false)\s*(,|$)"))
    parts = F.transform(top_level_parts(F.when(suspect, F.col("args"))), lambda p: F.trim(F.regexp_replace(p, r"\s+", " ")))
    same = equal & (F.size(parts) >= 2) & (parts[0] == parts[1])
    sure = constant & parts[0].isin("true", "1 == 1", "! false", "!false")
    why = F.when(same, F.lit("equal sides")).when(sure, F.lit("always true"))
    says = ["always true", "equal sides"]
    g = events.select("test", "macro", why.alias("why")).groupBy("test").agg(
        *[F.count_if(F.col("why") == w).alias(w) for w in says], F.count_if(F.startswith("macro", F.lit("assert"))).alias("asserts")
    )
    reasons = F.array_compact(F.array(*[F.when(F.col(w) > 0, F.lit(w)) for w in says]))
    g = g.withColumn("reasons", F.when(F.col("asserts") == 0, F.array(F.lit("no assertion"))).otherwise(reasons))
    return g.where(F.size("reasons") > 0).select("test", "reasons")


def feature_coverage(items: DataFrame, needs: DataFrame, builds: DataFrame) -> DataFrame:
    """Items (item), what they need (item, feature, negated) and builds (build, feature) to always, some, never, unknown.

    An item holds in a build if every needed feature is there and no negated one is. Counted by joins on the feature:
    an item fails a build for each missing or forbidden feature.
    """
    n = builds.select("build").distinct().count()
    have = builds.select("build", "feature").distinct()
    per = needs.distinct().groupBy("item").agg(F.count_if(~F.col("negated")).alias("needed"))
    hits = needs.distinct().join(have, "feature").groupBy("item", "build").agg(
        F.count_if(~F.col("negated")).alias("has"), F.count_if(F.col("negated")).alias("bad")
    )
    j = hits.join(per, "item")
    good = j.groupBy("item").agg(F.count_if((F.col("has") == F.col("needed")) & (F.col("bad") == 0)).alias("good"), F.count("*").alias("met"))
    g = items.join(per, "item", "left").join(good, "item", "left")
    # Builds that have none of an item's features hold it if it needs none.
    holds = F.coalesce("good", F.lit(0)) + F.when(F.col("needed") == 0, F.lit(n) - F.coalesce("met", F.lit(0))).otherwise(0)
    holds = F.when(F.col("needed").isNull(), F.lit(n)).otherwise(holds)
    state = F.when(F.col("needed").isNull(), "always").when(F.lit(n) == 0, "unknown").when(holds == n, "always").when(holds == 0, "never").otherwise("some")
    return g.select("item", state.alias("coverage"), holds.alias("builds"))


def is_prose_fact(kind: Column, doc: Column, events: Column) -> Column:
    """A string constant, or a documented function all of whose events are prose."""
    return (kind == "string") | ((kind == "function") & (F.coalesce(doc, F.lit("")) != "") & F.forall(events, lambda e: e["prose"]))


def is_test_fact(cfg: Column, file_cfg: Column) -> Column:
    return F.array_contains(cfg, "test") | F.exists(file_cfg, lambda c: F.contains(c, F.lit("test")))


def shortlist_reasons(shortlist: DataFrame, vacuous: DataFrame) -> DataFrame:
    return shortlist.join(vacuous.withColumnRenamed("test", "label"), "label", "left")


def render_fact(facts: DataFrame) -> DataFrame:
    """(fact, name, params, returns, file, line, is_test, cfg, doc, events (kind, prose, text)) to one text each: the
    signature and its place, then documentation and prose events marked as prose, other events as they are."""
    head = F.format_string("%s(%s)%s, %s line %d", "name", "params", F.when(F.col("returns") != "", F.concat(F.lit(" -> "), "returns")).otherwise(""), "file", "line")
    tags = F.concat(F.when(F.col("is_test"), F.lit(" [test]")).otherwise(""), F.when(F.size("cfg") > 0, F.concat(F.lit(" ["), F.array_join("cfg", " "), F.lit("]"))).otherwise(""))
    doc = F.when(F.coalesce("doc", F.lit("")) != "", F.concat(F.lit("prose: "), F.element_at(F.split("doc", "\n"), 1)))
    lines = F.transform("events", lambda e: F.concat(F.when(e["prose"], F.lit("prose ")).otherwise(""), e["kind"], F.lit(": "), e["text"]))
    return facts.select("fact", F.concat_ws("\n", F.concat(head, tags), doc, F.array_join(lines, "\n")).alias("text"))


def brief_text(text: Column, lines: int) -> Column:
    """The first lines, and how many more there are."""
    parts = F.split(text, "\n")
    more = F.size(parts) - lines
    return F.concat_ws("\n", F.slice(parts, 1, lines), F.when(more > 0, F.format_string("… %d more line(s)", more)))


def facts_summary(facts: DataFrame) -> DataFrame:
    return facts.agg(
        F.count_distinct("file").alias("files"), F.count_if(F.col("item_kind") == "function").alias("functions"),
        F.sum("n_events").alias("events"), F.count_if(F.col("item_kind") != "function").alias("other_items"),
    )


def claim_terms(text: Column) -> Column:
    return T.identifier_terms(text)
