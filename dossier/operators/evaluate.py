"""Scoring systems against gold labels, detectors against cases, and runs against one another."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

ON = ["repo", "commit", "kind"]


def validate_gold(gold: DataFrame) -> DataFrame:
    """(repo, commit, kind, id, decision, text, error): repeated ids, blank texts, children of unlabelled decisions."""
    n = F.count("*").over(Window.partitionBy("repo", "commit", "id"))
    heads = gold.where("kind = 'decision'").select("repo", "commit", F.col("id").alias("decision"), F.lit(True).alias("known")).distinct()
    g = gold.withColumn("n", n).join(heads, ["repo", "commit", "decision"], "left")
    errors = F.array_compact(F.array(
        F.when(F.col("n") > 1, F.lit("repeated id")), F.when(F.trim("text") == "", F.lit("blank text")),
        F.when((F.col("kind") != "decision") & F.col("decision").isNotNull() & F.col("known").isNull(), F.lit("unlabelled decision")),
    ))
    return g.select(*ON, "id", F.explode(errors).alias("error"))


def normalise_extracted(items: DataFrame) -> DataFrame:
    """(repo, commit, kind, pos, text, reason) to ids D1.., P1.., A1.. and texts; an alternative carries its reason."""
    w = Window.partitionBy(*ON).orderBy("pos")
    letter = F.upper(F.substring("kind", 1, 1))
    full = F.when((F.col("kind") == "alternative") & (F.coalesce("reason", F.lit("")) != ""), F.concat_ws(" — ", "text", "reason")).otherwise(F.col("text"))
    return items.select(*ON, F.concat(letter, F.row_number().over(w).cast("string")).alias("id"), full.alias("text"))


def carry_adjudications(system: DataFrame, earlier: DataFrame) -> DataFrame:
    """System items with the match that the same kind, id and text had before, else pending ('')."""
    e = earlier.select("kind", "id", "text", F.col("match").alias("m")).dropDuplicates(["kind", "id", "text"])
    return system.join(e, ["kind", "id", "text"], "left").withColumn("match", F.coalesce("m", F.lit(""))).drop("m")


def score_system(system: DataFrame, gold: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Precision and recall of system items (repo, commit, kind, match) by kind and repository and in all (null repo),
    and the matches that name no gold id.

    '' is pending and 'none' no match. Precision leaves pending items out; recall is null while any is pending.
    """
    ids = gold.select(*ON, F.col("id").alias("match"), F.lit(True).alias("is_gold")).distinct()
    j = system.join(ids, [*ON, "match"], "left")
    named = ~F.col("match").isin("", "none")
    good = j.where(~named | F.col("is_gold"))
    s = good.groupBy("kind", "repo").agg(
        F.count("*").alias("extracted"), F.count_if(named).alias("matched"), F.count_if(F.col("match") == "").alias("pending"),
        F.count_distinct(F.when(named, F.struct("repo", "commit", "match"))).alias("covered"),
    )
    g = gold.groupBy("kind", "repo").agg(F.count("*").alias("labels"))
    both = s.join(g, ["kind", "repo"], "full_outer").na.fill(0)
    total = both.groupBy("kind").agg(*[F.sum(c).alias(c) for c in ("extracted", "matched", "pending", "covered", "labels")])
    rows = both.unionByName(total.withColumn("repo", F.lit(None).cast("string")))
    rows = rows.withColumns({
        "precision": F.round(F.try_divide("matched", F.col("extracted") - F.col("pending")), 6),
        "recall": F.when(F.col("pending") == 0, F.round(F.try_divide("covered", "labels"), 6)),
    })
    return rows, j.where(named & F.col("is_gold").isNull()).drop("is_gold")


def label_status(files: DataFrame, gold: DataFrame) -> DataFrame:
    """Label files (repo, commit, status) by status with their items of each kind."""
    kinds = gold.groupBy("repo", "commit").agg(*[F.count_if(F.col("kind") == k).alias(k + "s") for k in ("decision", "prerequisite", "alternative")])
    j = files.join(kinds, ["repo", "commit"], "left").na.fill(0)
    return j.groupBy("status").agg(F.count("*").alias("files"), *[F.sum(k + "s").alias(k + "s") for k in ("decision", "prerequisite", "alternative")])


def run_outcome(runs: DataFrame) -> DataFrame:
    """Adds outcome: harness-error, stopped (no changed lines), violated (tests pass, oracle exits 1) or intact."""
    passed = F.forall("tests", lambda t: t["exit"] == 0)
    outcome = (
        F.when(F.col("is_error"), "harness-error").when(F.col("diff_lines") == 0, "stopped")
        .when(passed & (F.col("oracle_exit") == 1), "violated").otherwise("intact")
    )
    return runs.withColumn("outcome", outcome)


OUTCOMES = ["violated", "harness-error", "stopped", "intact"]


def run_matrix(runs: DataFrame) -> DataFrame:
    """Runs (task, arm, outcome, cost) by task and arm, and by arm in all (null task)."""
    counts = [F.count_if(F.col("outcome") == o).alias(o.replace("-", "_")) for o in OUTCOMES]
    return runs.groupBy("arm", "task").agg(*counts, F.round(F.sum("cost"), 6).alias("cost")).unionByName(
        runs.groupBy("arm").agg(F.lit(None).cast(runs.schema["task"].dataType).alias("task"), *counts, F.round(F.sum("cost"), 6).alias("cost"))
    )


def run_gate(runs: DataFrame, corpus: str, control: str) -> DataFrame:
    """passed if the corpus arm violates at most half as often as the control arm; undecided where control has none."""
    v = runs.agg(F.count_if((F.col("arm") == corpus) & (F.col("outcome") == "violated")).alias("corpus"), F.count_if((F.col("arm") == control) & (F.col("outcome") == "violated")).alias("control"))
    return v.withColumn("gate", F.when(F.col("control") == 0, "undecided").when(F.col("corpus") * 2 <= F.col("control"), "passed").otherwise("failed"))


def pattern_hits(findings: DataFrame, patterns: DataFrame) -> DataFrame:
    """(id) of cases with a finding whose text matches its task's pattern, in any letter case."""
    j = findings.join(patterns, "task").where(F.regexp_like("text", F.concat(F.lit("(?i)"), "pattern")))
    return j.select("id").distinct()


def relabel_cases(results: DataFrame, registry: DataFrame) -> DataFrame:
    """Results with the registry's truth columns over their own."""
    r = registry.select("id", *[F.col(c).alias("r_" + c) for c in ("kind", "task", "contradicting")])
    j = results.join(r, "id", "left")
    return j.withColumns({c: F.coalesce("r_" + c, c) for c in ("kind", "task", "contradicting")}).drop("r_kind", "r_task", "r_contradicting")


def upper_median(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by, value): the element at place floor(n / 2) of each group's values in order, from counts of distinct values."""
    n = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_n"))
    own = Window.partitionBy(*by)
    n = n.withColumns({"_upto": F.sum("_n").over(own.orderBy(value)), "_all": F.sum("_n").over(own)})
    return n.where(F.col("_upto") > F.floor(F.col("_all") / 2)).groupBy(*by).agg(F.min(value).alias(value))


def missed_cases(cases: DataFrame, findings: DataFrame, hits: DataFrame) -> DataFrame:
    """(id, task, flags) of contradicting cases that have findings, none of which matches their task's pattern."""
    n = findings.groupBy("id").agg(F.count("*").alias("flags"))
    return cases.where("contradicting").select("id", "task").join(hits.select("id"), "id", "left_anti").join(n, "id")


def detector_report(cases: DataFrame, findings: DataFrame, hits: DataFrame, dropped: DataFrame | None = None) -> DataFrame:
    """By kind of case and in all (null): cases, flagged, flags, contradicting, recalled, missed (contradicting cases with
    other findings only), recall, tokens, upper median of seconds, and drops: the verdicts (id) that validation left out.
    ``tokens`` is null where cases have none."""
    n = findings.groupBy("id").agg(F.count("*").alias("flags"))
    j = cases.join(n, "id", "left").join(hits.select("id", F.lit(True).alias("hit")), "id", "left").na.fill(0, ["flags"])
    out = cases.select("id").limit(0) if dropped is None else dropped
    j = j.join(out.groupBy("id").agg(F.count("*").alias("drops")), "id", "left").na.fill(0, ["drops"])
    if "tokens" not in j.columns:
        j = j.withColumn("tokens", F.lit(None).cast("long"))
    truth, hit = F.coalesce("contradicting", F.lit(False)), F.coalesce("hit", F.lit(False))
    both = j.select("kind", "seconds", F.lit(1).alias("level")).union(j.select(F.lit(None).cast("string"), "seconds", F.lit(0)))
    middle = upper_median(both, ["level", "kind"], "seconds").select("level", F.col("kind").alias("_kind"), "seconds")
    r = j.rollup("kind").agg(
        F.count("*").alias("cases"), F.count_if(F.col("flags") > 0).alias("flagged"), F.sum("flags").alias("flags"),
        F.count_if(truth).alias("contradicting"), F.count_if(truth & hit).alias("recalled"), F.count_if(truth & ~hit & (F.col("flags") > 0)).alias("missed"),
        F.sum("tokens").alias("tokens"), F.sum("drops").alias("drops"), (1 - F.grouping("kind")).cast("int").alias("_level"),
    )
    r = r.join(middle, F.col("kind").eqNullSafe(F.col("_kind")) & (F.col("_level") == F.col("level")), "left")
    recall = F.round(F.try_divide("recalled", "contradicting"), 6)
    return r.select("kind", "cases", "flagged", "flags", "contradicting", "recalled", "missed", recall.alias("recall"), "tokens", "seconds", "drops")


def task_recall(cases: DataFrame, hits: DataFrame) -> DataFrame:
    """Of each task's contradicting cases, how many have a finding that matches the task's pattern."""
    j = cases.where("contradicting").join(hits.select("id", F.lit(True).alias("hit")), "id", "left")
    return j.groupBy("task").agg(F.count_if("hit").alias("recalled"), F.count("*").alias("cases"))


def run_report(runs: DataFrame, corpus: str, control: str) -> DataFrame:
    """One row a run group (runs: (run, task, arm, is_control, violated)): violations of the two arms outside control
    tasks, violations on control tasks (any of them makes the group invalid), and the gate."""
    plain = ~F.col("is_control") & F.col("violated")
    g = runs.groupBy("run").agg(
        F.count_if(plain & (F.col("arm") == control)).alias("control_arm"), F.count_if(plain & (F.col("arm") == corpus)).alias("corpus_arm"),
        F.count_if(F.col("is_control") & F.col("violated")).alias("on_controls"),
    )
    gate = F.when(F.col("control_arm") == 0, "undecided").when(F.col("corpus_arm") * 2 <= F.col("control_arm"), "met").otherwise("not met")
    return g.withColumns({"gate": gate, "valid": F.col("on_controls") == 0})


def detector_gate(flags: DataFrame, cases: DataFrame) -> DataFrame:
    """Adjudicated flags (id, verdict) and cases (id, contradicting, hit): precision, recall, share of other cases with
    a wrong flag, and whether all three bounds (0.80, 0.70, 0.10) hold. Arguable flags are wrong; none make 1.0."""
    f = flags.agg(F.count("*").alias("n"), F.count_if(F.col("verdict") == "correct").alias("right"), F.count_if(F.col("verdict").isNull()).alias("open"))
    wrong = flags.where("verdict <> 'correct'").select("id", F.lit(True).alias("wrong")).distinct()
    truth = F.coalesce("contradicting", F.lit(False))
    c = cases.join(wrong, "id", "left").agg(
        F.try_divide(F.count_if(truth & F.col("hit")), F.count_if(truth)).alias("recall"),
        F.try_divide(F.count_if(~truth & F.col("wrong")), F.count_if(~truth)).alias("wrong_share"),
    )
    j = f.withColumn("k", F.lit(1)).join(c.withColumn("k", F.lit(1)), "k")
    j = j.withColumn("precision", F.when(F.col("n") == 0, 1.0).otherwise(F.try_divide("right", "n")))
    ok = (F.col("precision") >= 0.80) & (F.col("recall") >= 0.70) & (F.coalesce("wrong_share", F.lit(0.0)) <= 0.10)
    gate = F.when(F.col("open") > 0, "unadjudicated").when(ok, "gate").otherwise("advisory")
    return j.select(F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"), F.round("wrong_share", 6).alias("wrong_share"), gate.alias("gate"))


def pass_tally(findings: DataFrame, hits: DataFrame) -> DataFrame:
    """Hits, flags and flagged changes of each named pass (the agreed set is one)."""
    h = hits.groupBy("pass").agg(F.count_distinct("id").alias("hits"))
    f = findings.groupBy("pass").agg(F.count("*").alias("flags"), F.count_distinct("change").alias("flagged"))
    return f.join(h, "pass", "left").na.fill(0, ["hits"])


def alternate_split(cases: DataFrame, by: list[str]) -> DataFrame:
    """Even positions, oldest first, to dev and odd ones to held-out."""
    w = Window.partitionBy(*by).orderBy("at", "id")
    return cases.withColumn("split", F.when((F.row_number().over(w) - 1) % 2 == 0, "dev").otherwise("held-out"))


def case_registry(patches: DataFrame, runs: DataFrame, commits: DataFrame, labelled: DataFrame) -> DataFrame:
    """One registry of patch, agent-run (with a diff) and commit cases; labelled commits are left out."""
    cols = ["id", "repo", "kind", "at", "contradicting"]
    r = runs.where("diff_lines > 0")
    c = commits.join(labelled.select("id"), "id", "left_anti")
    return alternate_split(patches.select(*cols).unionByName(r.select(*cols)).unionByName(c.select(*cols)), ["repo", "kind"])


def compare_runs(a: DataFrame, b: DataFrame, columns: list[str], by: list[str] = ()) -> DataFrame:
    """Cases in one or both runs, and how many agree in each column, for each group ``by``."""
    key = [*by, "id"]
    x = a.select(*key, *[F.col(c).alias("a_" + c) for c in columns], F.lit(True).alias("in_a"))
    y = b.select(*key, *[F.col(c).alias("b_" + c) for c in columns], F.lit(True).alias("in_b"))
    j = x.join(y, key, "full_outer")
    same = [F.count_if(F.col("in_a") & F.col("in_b") & F.col("a_" + c).eqNullSafe(F.col("b_" + c))).alias("same_" + c) for c in columns]
    both, only_a, only_b = F.col("in_a") & F.col("in_b"), F.col("in_b").isNull(), F.col("in_a").isNull()
    return j.groupBy(*by).agg(F.count_if(both).alias("both"), F.count_if(only_a).alias("only_a"), F.count_if(only_b).alias("only_b"), *same)


def corpus_variants(cases: DataFrame, ancestors: DataFrame, recorded: DataFrame) -> DataFrame:
    """(id, base) to (id, variant, commits): cases whose base reaches the same recorded commits share a variant.

    A variant is the number of commits and the sums of two 60-bit parts of their names' MD5: the same for any order, and
    added up before the shuffle.
    """
    half = lambda at: F.conv(F.substring(F.md5("node"), at, 15), 16, 10).cast("decimal(20,0)")
    have = ancestors.join(recorded.select(F.col("sha").alias("node")).distinct(), "node", "left_semi").select(F.col("root").alias("base"), "node")
    sums = have.groupBy("base").agg(F.count("*").alias("commits"), F.sum(half(1)).alias("a"), F.sum(half(16)).alias("b"))
    g = cases.select("id", "base").distinct().join(sums, "base", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("string")
    return g.select("id", F.concat_ws(":", zero("commits"), zero("a"), zero("b")).alias("variant"), F.coalesce("commits", F.lit(0)).alias("commits"))


SLICES = 1024


def shuffled(rows: DataFrame, seed: int, id_col: str = "id") -> DataFrame:
    """``rows`` with _n, a number from 1 in an order by a hash of the id. The order is cut into SLICES of the hash, which
    are numbered apart and set off by the sizes of those before."""
    h = F.xxhash64(F.lit(seed), F.col(id_col))
    d = rows.withColumns({"_h": h, "_s": F.shiftrightunsigned(h, 54)})  # the ten highest bits
    sizes = d.groupBy("_s").agg(F.count("*").alias("_c"))  # at most SLICES rows
    sizes = sizes.select(F.col("_s").alias("_t"), (F.sum("_c").over(Window.orderBy("_s")) - F.col("_c")).alias("_before"))
    own = Window.partitionBy("_s").orderBy("_h", id_col)
    d = d.withColumn("_r", F.row_number().over(own)).join(F.broadcast(sizes), F.col("_s") == F.col("_t"))
    return d.withColumn("_n", F.col("_before") + F.col("_r")).drop("_h", "_s", "_t", "_c", "_before", "_r")


def blind_sheet(flags: DataFrame, seed: int) -> tuple[DataFrame, DataFrame]:
    """Flags shuffled and numbered: the sheet without provenance, and the key."""
    named = shuffled(flags, seed).withColumn("flag", F.format_string("F%03d", "_n"))
    return named.select("flag", "text"), named.select("flag", "id", "change")


def blind_pairs(answers: DataFrame, seed: int) -> tuple[DataFrame, DataFrame]:
    """Pairs of answers (id, question, first, second) as A and B in an order by a hash of the id, record ids scrubbed;
    and the key, which says which of them A is."""
    swap = F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(2)) == 1
    a, b = F.when(swap, F.col("second")).otherwise(F.col("first")), F.when(swap, F.col("first")).otherwise(F.col("second"))
    sheet = answers.select("id", "question", T.scrub_ids(a).alias("a"), T.scrub_ids(b).alias("b"))
    return sheet, answers.select("id", F.when(swap, "second").otherwise("first").alias("a_is"))
