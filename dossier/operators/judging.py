"""Answers and verdicts: reading, validating, agreement of passes, and the verdict policy. Rejects are returned."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

VERDICT = "label STRING, verdict STRING, line INT, diff_line STRING, reason STRING"


def parse_answers(answers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(ask, answer) to verdict rows, and the answers that are no object, no array and not empty objects.

    An object holds its rows in ``verdicts``; a bare array holds them itself; ``{}`` has none.
    """
    t = F.trim("answer")
    objects = F.from_json(F.when(F.startswith(t, F.lit("{")), t), f"verdicts ARRAY<STRUCT<{VERDICT.replace(' STRING', ': STRING').replace(' INT', ': INT')}>>, _bad STRING", {"columnNameOfCorruptRecord": "_bad"})
    arrays = F.from_json(F.when(F.startswith(t, F.lit("[")), t), f"ARRAY<STRUCT<{VERDICT.replace(' STRING', ': STRING').replace(' INT', ': INT')}>>")
    a = answers.withColumns({"_o": objects, "_a": arrays})
    broken = (F.col("_o").isNull() & F.col("_a").isNull()) | F.col("_o._bad").isNotNull()
    rows = a.where(~F.coalesce(broken, F.lit(True))).select("ask", F.explode(F.coalesce("_o.verdicts", "_a", F.array())).alias("v"))
    rows = rows.where("v is not null").select("ask", "v.*")
    return rows, a.where(F.coalesce(broken, F.lit(True))).select("ask", "answer")


def verdict_is_contradiction(df: DataFrame) -> DataFrame:
    return df.where(F.lower(F.trim("verdict")) == "contradicts")


def split_truncated(answers: DataFrame, window: int) -> tuple[DataFrame, DataFrame]:
    """Answers whose prompt stayed below the window, and those that reached it."""
    full = F.coalesce(F.col("prompt_tokens") >= window, F.lit(False))
    return answers.where(~full), answers.where(full)


def validate_verdicts(verdicts: DataFrame, judged: DataFrame, view: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Verdicts on judged d/p/r units that point at a shown line by number, else by its text; first of a label.

    judged: (change, label); view: (change, shown_no, content). The others are returned with a reason.
    """
    v = verdicts.withColumns({"label": T.clean_label(F.col("label")), "quoted": T.clean_line(F.col("diff_line"))})
    v = v.join(judged.select("change", "label", F.lit(True).alias("asked")).distinct(), ["change", "label"], "left")
    shown = view.where("shown_no is not null and trim(content) <> ''")
    by_no = shown.select("change", F.col("shown_no").alias("line"), F.trim("content").alias("at_line"))
    by_text = shown.select("change", F.trim("content").alias("quoted"), F.lit(True).alias("at_text")).distinct()
    v = v.join(by_no, ["change", "line"], "left").join(by_text, ["change", "quoted"], "left")
    found = F.coalesce("at_line", F.when(F.col("at_text"), F.col("quoted")))
    w = Window.partitionBy("change", "label").orderBy("seq")
    base = F.when(F.col("asked").isNull() | ~F.col("label").rlike("^[dpr]/"), "not judged").when(found.isNull(), "line not shown")
    v = v.withColumns({"found": found, "why": base})
    first = F.row_number().over(Window.partitionBy("change", "label", F.col("why").isNull()).orderBy("seq"))
    v = v.withColumn("why", F.when(F.col("why").isNull() & (first > 1), "repeated").otherwise(F.col("why")))
    cols = ["change", "label", "seq", "verdict", "line", "reason"]
    return v.where("why is null").select(*cols, F.col("found").alias("diff_line")), v.where("why is not null").select(*cols, F.col("why").alias("dropped"))


def validate_citations(citations: DataFrame, shown: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(claim, run, part, fact, kind, covered) to (claim, run, covered, uncovered, prose_used), and unknown facts.

    A part whose cited facts were all unknown is uncovered; prose_used tells that covered parts rest on prose only.
    """
    j = citations.join(shown.select("claim", "fact", F.lit(True).alias("known")).distinct(), ["claim", "fact"], "left")
    part = j.groupBy("claim", "run", "part").agg(
        F.bool_or(F.col("covered") & F.col("known").isNotNull()).alias("ok"), F.bool_and(F.when(F.col("known").isNotNull(), F.col("kind") == "P")).alias("prose")
    )
    ok = F.coalesce("ok", F.lit(False))
    g = part.groupBy("claim", "run").agg(
        F.array_sort(F.collect_set(F.when(ok, F.col("part")))).alias("covered"), F.array_sort(F.collect_set(F.when(~ok, F.col("part")))).alias("uncovered"),
        F.coalesce(F.bool_and(F.when(ok, F.col("prose"))), F.lit(False)).alias("prose_used"),
    )
    return g, j.where("known is null and fact is not null").select("claim", "run", "fact").distinct()


def validate_links(links: DataFrame, shortlist: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links (claim, test, kind, seq) to shortlisted tests, first of a test; and the invented ones."""
    on = ["claim", "test"]
    keys = shortlist.select(*on).distinct()
    w = Window.partitionBy(*on).orderBy("seq")
    kept = links.join(keys, on, "left_semi").withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")
    return kept, links.join(keys, on, "left_anti")


def normative_of(verdicts: DataFrame, units: DataFrame) -> DataFrame:
    """Verdicts (claim label) with normative: whether the one unit that bears the label is; false where none or several do."""
    u = units.groupBy("label").agg(F.count_distinct("uid").alias("_n"), F.bool_or("normative").alias("normative")).where("_n = 1")
    j = verdicts.join(u.select(F.col("label").alias("claim"), "normative"), "claim", "left")
    return j.withColumn("normative", F.coalesce("normative", F.lit(False)))


def dedupe_decisions(parts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Decisions (sha, part, pos, text) with text, one for each wording of a commit, from its first part; and how many of
    each commit were left out."""
    d = parts.where(F.trim(F.coalesce("text", F.lit(""))) != "").withColumn("_w", T.normalise_wording(F.col("text")))
    d = d.withColumn("_r", F.row_number().over(Window.partitionBy("sha", "_w").orderBy("part", "pos")))
    left = d.groupBy("sha").agg(F.count_if(F.col("_r") > 1).alias("duplicates")).where("duplicates > 0")
    return d.where("_r = 1").drop("_r", "_w"), left


def first_per_key(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def agree_passes(findings: DataFrame, passes: int) -> tuple[DataFrame, DataFrame]:
    """Findings of the last pass whose label every pass reports, and how many of its findings each change lost."""
    n = findings.groupBy("change", "label").agg(F.count_distinct("pass").alias("n")).where(F.col("n") == passes)
    last = findings.where(F.col("pass") == passes - 1)
    agreed = last.join(n.select("change", "label"), ["change", "label"], "left_semi")
    lost = last.join(n.select("change", "label"), ["change", "label"], "left_anti").groupBy("change").agg(F.count("*").alias("dropped"))
    return agreed, lost


def union_parts(parts: list[DataFrame]) -> DataFrame:
    """Findings of a change's parts, one for each label and line."""
    out = parts[0].withColumn("_p", F.lit(0))
    for k, p in enumerate(parts[1:], 1):
        out = out.unionByName(p.withColumn("_p", F.lit(k)))
    return first_per_key(out, ["change", "label", "line"], ["_p"]).drop("_p")


def decide_verdicts(claims: DataFrame, runs: DataFrame) -> DataFrame:
    """Claims (claim, normative, person) and runs (claim, run, covered, uncovered, prose_used, contradicted) to verdicts.

    In this order: a contradiction; nothing covered; covered in all, but by no run alone and without prose; a part
    uncovered in a run and covered in none; a rule; a person's word or two such runs; else one run is not enough.
    """
    full = (F.size("uncovered") == 0) & (F.size("covered") > 0)
    sound = full & ~F.col("prose_used")
    g = runs.groupBy("claim").agg(
        F.bool_or("contradicted").alias("contradicted"), F.flatten(F.collect_list("covered")).alias("cov"), F.flatten(F.collect_list("uncovered")).alias("unc"),
        F.bool_or(sound).alias("structural"), F.count_distinct(F.when(sound & ~F.col("contradicted"), F.col("run"))).alias("agreeing"),
    )
    j = claims.join(g, "claim", "left").withColumn("open", F.array_sort(F.array_except(F.coalesce("unc", F.array()), F.coalesce("cov", F.array()))))
    none = F.coalesce(F.size("cov"), F.lit(0)) == 0
    whole = F.size("open") == 0
    verdict = (
        F.when(F.col("cov").isNull(), "unknown").when(F.col("contradicted"), "contradicted").when(none, "unknown")
        .when(whole & ~F.col("structural"), "prose-only").when(~whole, "partial").when(F.col("normative"), "implemented-by")
        .when(F.col("person") | (F.col("agreeing") >= 2), "supported").otherwise("partial")
    )
    gaps = F.when(verdict.isin("partial", "unknown"), F.col("open")).otherwise(F.array().cast("array<string>"))
    return j.select("claim", verdict.alias("verdict"), gaps.alias("uncovered"))


def token_usage(calls: DataFrame) -> DataFrame:
    """Predicted and charged tokens of each change, and in all (null change)."""
    return calls.rollup("change").agg(
        F.count("*").alias("calls"), F.sum("predicted").alias("predicted"), F.sum("charged").alias("charged"),
        F.round(F.try_divide(F.sum("charged"), F.sum("predicted")), 6).alias("ratio"),
    )


def with_settings(rows: DataFrame, *, prompt: str, chars_per_token: float, **more) -> DataFrame:
    """``rows`` with what they were made with: prompt_print, a fingerprint of the system prompt, chars_per_token, and any
    other settings by their names."""
    known = {"prompt_print": T.fingerprint(F.lit(prompt)), "chars_per_token": F.lit(float(chars_per_token))}
    return rows.withColumns(known | {k: F.lit(v) for k, v in more.items()})


def ask_all(asks: DataFrame, judge: Callable[[str], tuple[str, int]], *, partitions: int | None = None) -> DataFrame:
    """Runs a user's judge over asks (ask, prompt): (ask, answer, tokens, warning). A failed call is a warning row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for ask, prompt in zip(pdf["ask"], pdf["prompt"], strict=True):
                try:
                    answer, tokens = judge(prompt)
                    rows.append((ask, answer, tokens, None))
                except Exception as e:  # a user's function may fail in any way
                    rows.append((ask, None, None, f"a call failed: {e}"))
            yield pd.DataFrame(rows, columns=["ask", "answer", "tokens", "warning"]).astype({"tokens": "Int64"})

    asks = asks.repartition(partitions) if partitions else asks
    return asks.select(F.col("ask").cast("string"), "prompt").mapInPandas(run, "ask string, answer string, tokens long, warning string")
