"""URL rules: host-suffix and path-prefix expressions joined to a rule table on short hash prefixes.

Each distinct (host, path) is expanded into the expressions a rule could be written for, the 4-byte prefixes
of their SHA-256 digests are equi-joined with those of the rules, full digests confirm, and the longest
confirmed rule decides. The join carries 8 hex digits for each expression, so a rule table of any size works;
Spark broadcasts it where it is small and shuffles it otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ensure_columns

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
HEX = 8


def host_of(url: Column) -> Column:
    """From after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_suffixes(host: Column, most: int) -> Column:
    """``a.b.c`` gives ``c``, ``b.c`` and ``a.b.c``, up to ``most`` labels."""
    labels = F.split(host, r"\.")
    return F.transform(
        F.sequence(F.lit(1), F.least(F.size(labels), F.lit(most))), lambda k: F.array_join(F.slice(labels, F.size(labels) - k + 1, k), ".")
    )


def path_prefixes(path: Column, most: int) -> Column:
    """The empty path and the path cut after each of its first ``most`` slashes: what rules are keyed by."""
    parts = F.split(path, "/", most + 1)
    return F.transform(
        F.sequence(F.lit(0), F.size(parts) - 1),
        lambda i: F.when(i == 0, F.lit("")).otherwise(F.concat(F.array_join(F.slice(parts, F.lit(1), i), "/"), F.lit("/"))),
    )


def rule_keys(rules: DataFrame) -> DataFrame:
    """Rules with their digest. A rule is keyed by its path up to the last ``/``; the rest is compared as text.

    Of several rules with one host and path, ``block`` wins. Rules with a null host or path are left out.
    """
    r = rules.select(
        F.translate(F.col("host"), UPPER, LOWER).alias("r_host"),
        F.col("path").alias("r_path"),
        F.col("verdict").alias("r_verdict"),
    ).where("r_host is not null and r_path is not null and r_host <> ''")
    r = r.groupBy("r_host", "r_path").agg(F.max("r_verdict").alias("r_verdict"))
    digest = F.sha2(F.concat("r_host", F.regexp_extract("r_path", r"(?s)^(.*/)?", 0)), 256)
    return r.withColumn("r_digest", digest).withColumn("r_short", F.substring("r_digest", 1, HEX))


def url_filters(pages: DataFrame, rules: DataFrame, *, url_col: str = "url", default: str = "allow") -> DataFrame:
    """``pages`` with host, path, rule and verdict.

    rules: (host, path, verdict), verdict ``allow`` or ``block``. A rule fits its host and all subdomains if the
    URL's path starts with the rule's. The longest rule (host and path) wins; of equally long ones that with the
    longer host. Without a fitting rule, rule is null and the verdict is ``default``.

    Null URLs and URLs without ``://`` have an empty host and path and no rule. Repeated rows are each returned.
    Columns of ``pages`` named like a result column are replaced, all others are kept whatever they are called; a
    missing URL column counts as nulls. An empty rule table gives ``default`` for all, an empty page table no rows.
    URLs are expanded as far as the deepest rule's host and path go, which no longer expression can equal, so a very
    long URL costs no more than its length.
    """
    out = ("host", "path", "rule", "verdict")
    pages = ensure_columns(pages, **{url_col: "string"})
    keep = [c for c in pages.columns if c.lower() not in out]
    row = F.struct(*[F.col(f"`{c}`") for c in keep], F.lit(0).alias("__n"))
    url = F.col(f"`{url_col}`")
    rows = pages.select(row.alias("_row"), host_of(url).alias("host"), path_of(url).alias("path"))
    # Each distinct pair is judged once, however many pages share it.
    sites = rows.select("host", "path").where("host <> ''").distinct()
    keys = rule_keys(rules)
    depth = keys.agg(F.max(F.size(F.split("r_host", r"\."))), F.max(F.size(F.split("r_path", "/")) - 1)).first()
    asked = (
        sites.withColumn("_suffix", F.explode(host_suffixes(F.col("host"), depth[0] or 1)))
        .withColumn("_prefix", F.explode(path_prefixes(F.col("path"), depth[1] or 0)))
        .withColumn("_digest", F.sha2(F.concat("_suffix", "_prefix"), 256))
        .withColumn("_short", F.substring("_digest", 1, HEX))
    )
    hits = asked.join(keys, F.col("_short") == F.col("r_short")).where(
        (F.col("_digest") == F.col("r_digest"))
        & (F.col("_suffix") == F.col("r_host"))
        & F.startswith(F.col("path"), F.col("r_path"))
    )
    rank = F.struct(
        (F.length("r_host") + F.length("r_path")).alias("size"),
        F.length("r_host").alias("host_size"),
        F.concat("r_host", "r_path").alias("rule"),
        F.col("r_verdict").alias("verdict"),
    )
    best = hits.groupBy("host", "path").agg(F.max(rank).alias("_best"))
    # The digest joins the key, so that both sides are dealt anew and a site that many pages share can be split.
    key = F.xxhash64("host", "path")
    best = best.select(
        key.alias("_k"),
        F.col("host").alias("_host"),
        F.col("path").alias("_path"),
        F.col("_best.rule").alias("rule"),
        F.col("_best.verdict").alias("_verdict"),
    )
    joined = rows.withColumn("_key", key).join(
        best,
        (F.col("_key") == F.col("_k")) & (F.col("host") == F.col("_host")) & (F.col("path") == F.col("_path")),
        "left",
    )
    verdict = F.coalesce("_verdict", F.lit(default))
    return joined.select(*[F.col(f"_row.`{c}`").alias(c) for c in keep], "host", "path", "rule", verdict.alias("verdict"))
