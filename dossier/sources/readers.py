"""Readers: files and raw lines to tables, with explicit schemas and what was refused."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T

# The commands that build something.
BUILD_COMMANDS = ["test", "build", "clippy", "doc", "run", "install"]
EXTRACTION = """
decisions ARRAY<STRUCT<decision: STRING, kind: STRING, rationale: STRING, quote: STRING>>,
prerequisites ARRAY<STRUCT<decision: INT, text: STRING, kind: STRING, normative: BOOLEAN, quote: STRING>>,
alternatives ARRAY<STRUCT<decision: INT, alternative: STRING, reason: STRING, quote: STRING>>,
consequences ARRAY<STRUCT<decision: INT, text: STRING, quote: STRING, verified: BOOLEAN, verification_quote: STRING>>
"""
RESULT = "id STRING, task INT, kind STRING, contradicting BOOLEAN, findings ARRAY<STRUCT<label: STRING, kind: STRING, text: STRING, source: STRING, diff_line: STRING, reason: STRING>>, warnings ARRAY<STRING>"
GOLD = "repo STRING, commit STRING, kind STRING, id STRING, decision STRING, text STRING, item_kind STRING, normative BOOLEAN, evidence STRING"
ADJUDICATION = "system STRING, repo STRING, commit STRING, kind STRING, id STRING, text STRING, suggest ARRAY<STRING>, match STRING"


def read_extractions(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """One JSON document a commit, at …/<recipe>/<repo>/<sha>.json, to four item tables with 1-based ordinals."""
    raw = spark.read.text(path, wholetext=True).withColumn("_f", F.col("_metadata.file_path"))
    part = lambda i: F.regexp_extract("_f", r"([^/]+)/([^/]+)/([^/]+)\.json$", i)
    return explode_extractions(raw.select(part(1).alias("recipe"), part(2).alias("repo"), part(3).alias("sha"), "value"))


def explode_extractions(documents: DataFrame) -> dict[str, DataFrame]:
    """Documents (recipe, repo, sha, value) to the item tables; what is no JSON object has no items."""
    raw = documents.select("recipe", "repo", "sha", F.from_json("value", EXTRACTION).alias("d")).select("recipe", "repo", "sha", "d.*")
    out = {}
    for name in ("decisions", "prerequisites", "alternatives", "consequences"):
        rows = raw.select("recipe", "repo", "sha", F.posexplode(name).alias("pos", "item"))
        out[name] = rows.select("recipe", "repo", "sha", (F.col("pos") + 1).alias("ordinal"), "item.*")
    out["decisions"] = out["decisions"].withColumn("kind", T.decision_kind(F.col("kind")))
    return out


def read_json_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines with a fixed schema; missing fields are null."""
    return spark.read.schema(schema).json(path)


def read_case_results(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Case results of several runs, later runs last: those with findings, the latest of each id."""
    out = None
    for k, path in enumerate(paths):
        r = spark.read.schema(RESULT).json(path).where("findings is not null").withColumn("run", F.lit(k))
        out = r if out is None else out.unionByName(r)
    w = Window.partitionBy("id").orderBy(F.desc("run"))
    return out.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def split_failed(results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Results whose calls all came back, and those to be tried again."""
    failed = F.exists(F.coalesce("warnings", F.array().cast("array<string>")), lambda w: F.startswith(w, F.lit("a call failed")))
    return results.where(~failed), results.where(failed)


def load_commit_texts(files: DataFrame) -> DataFrame:
    """Raw changed files (sha, path, before, after) without the texts that are binary or above one MiB."""
    # A NUL among the first 8 KiB, in bytes, is what makes a text binary.
    binary = lambda c: F.hex(F.substring(F.col(c).cast("binary"), 1, 8192)).rlike("^(..)*?00")
    keep = lambda c: F.when((F.octet_length(c) <= 1 << 20) & ~binary(c), F.col(c))
    return files.withColumns({"before": keep("before"), "after": keep("after")})


def read_queue(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Lines (value) to commits and refused lines: 7 to 40 hex digits; longer runs of whole ids are parted."""
    v = F.trim("value")
    hexed = v.rlike("^[0-9a-fA-F]+$")
    long_ = hexed & (F.length(v) > 40) & (F.length(v) % 40 == 0)
    ids = F.when(long_, F.transform(F.sequence(F.lit(0), (F.length(v) / 40).cast("int") - 1), lambda i: F.substring(v, i * 40 + 1, F.lit(40)))).when(
        hexed & F.length(v).between(7, 40), F.array(v)
    )
    q = lines.withColumn("ids", ids)
    why = F.when(v == "", "blank").when(~hexed, "not hex").otherwise("length")
    return q.where("ids is not null").select(F.explode("ids").alias("sha")), q.where("ids is null").select("value", why.alias("reason"))


def read_ci_builds(lines: DataFrame, matrix: DataFrame | None = None) -> DataFrame:
    """Workflow lines (repo, file, line) to builds (repo, command, all_features, default_features, features).

    A line that interpolates stands for every flag entry of its file's matrix: the list items of the same file that
    start with two dashes, or ``matrix`` (repo, file, flags) where it is given. All ``--features`` lists of a line count,
    but for names that are options themselves. A toolchain before the command is taken for the command, as it is for the
    lines' own reader, so such lines give no build.
    """
    bare = lambda c, what: F.regexp_replace(c, rf"^{what}+|{what}+$", "")
    if matrix is None:
        item = bare(F.col("line"), r"\s")
        matrix = lines.where(F.startswith(item, F.lit("- "))).select("repo", "file", bare(F.substring(item, 3, 1 << 30), "[\"']").alias("flags"))
        matrix = matrix.where(F.startswith("flags", F.lit("--")))
    after = F.when(F.contains("line", F.lit("cargo ")), F.substring_index(F.regexp_replace("line", r"^.*?cargo ", "\n"), "\n", -1))
    rest = lines.select("repo", "file", after.alias("rest")).where("rest is not null")
    rest = rest.withColumn("command", F.regexp_extract("rest", r"^\s*\+*(\S*)", 1)).where(F.col("command").isin(BUILD_COMMANDS))
    m = matrix.select(F.col("repo").alias("_mr"), F.col("file").alias("_mf"), F.col("flags").alias("_flags")).distinct()
    j = rest.join(m, F.contains("rest", F.lit("${{")) & (F.col("repo") == F.col("_mr")) & (F.col("file") == F.col("_mf")), "left")
    full = F.concat_ws(" ", "rest", "_flags")
    # What follows is looked at without being passed over: the next list may start in it.
    lists = F.regexp_extract_all(full, F.lit(r"--features(?=[ =]*\s*(\S*))"), 1)
    names = F.transform(F.flatten(F.transform(lists, lambda x: F.split(x, ","))), lambda x: bare(x, "[\"',]"))
    names = F.filter(names, lambda x: (x != "") & ~F.startswith(x, F.lit("--")))
    return j.select(
        "repo", "command", F.contains(full, F.lit("--all-features")).alias("all_features"), (~F.contains(full, F.lit("--no-default-features"))).alias("default_features"),
        F.array_sort(F.array_distinct(names)).alias("features"),
    ).distinct()
