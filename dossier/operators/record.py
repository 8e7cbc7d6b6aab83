"""From extracted items to units, edges and labels, and rows to text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

UNIT = ["kind", "code_kind", "gist", "body", "status", "source", "grounds", "payload"]
PREFIX = {"decision": "d", "prerequisite": "p", "alternative": "r", "consequence": "q", "evidence": "e"}


def number_items(items: DataFrame) -> DataFrame:
    """1-based number of each item within its commit, kind and decision, in order of position."""
    w = Window.partitionBy("sha", "kind", "decision").orderBy("pos")
    return items.withColumn("n", F.row_number().over(w))


def split_dangling(children: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Children whose decision exists in their commit, and the others."""
    on = ["sha", "decision"]
    keys = decisions.select(*on).distinct()
    return children.join(keys, on, "left_semi"), children.join(keys, on, "left_anti")


def split_empty(items: DataFrame, text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Items with text, and the blank ones."""
    blank = F.trim(F.coalesce(F.col(text_col), F.lit(""))) == ""
    return items.where(~blank), items.where(blank)


def unit_uid(cols: list[str] = UNIT) -> Column:
    """Content identity over a fixed order of fields; the label is no part of it."""
    return F.sha2(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}), 256)


def build_units(items: DataFrame) -> DataFrame:
    """Items (sha, kind, decision, n, text, item_kind, status, source, run) to units with labels and uids.

    A decision becomes a decision, a prerequisite a constraint, a rejected alternative a claim ``Rejected: …``, a
    verified consequence a finding, any other consequence an inferred claim, and an anchor an artifact-ref. An
    anticipated claim is speculative if its decision is.

    With columns check, check_status and check_source (the verification quote and where it was found, see
    ``quotes.check_consequences``) a verified consequence also gives an evidence unit ``Check: …``, which backs it.
    """
    if "check" in items.columns:
        checks = items.where("kind = 'consequence' and verified").select(
            "sha", F.lit("evidence").alias("kind"), "decision", "n", F.concat(F.lit("Check: "), "check").alias("text"), "item_kind",
            F.col("check_status").alias("status"), F.col("check_source").alias("source"), "run", F.lit(False).alias("verified"),
        )
        items = items.drop("check", "check_status", "check_source").unionByName(checks, allowMissingColumns=True)
    by_kind = {
        "decision": ("decision", T.decision_kind(F.col("item_kind"))), "prerequisite": ("constraint", F.col("item_kind")),
        "alternative": ("claim", F.lit("rejected-alternative")), "anchor": ("artifact-ref", F.lit(None)), "evidence": ("evidence", F.lit(None)),
    }
    kind, code = F.when(F.col("verified"), "finding").otherwise("claim"), F.when(F.col("verified"), "verified-consequence").otherwise("anticipated")
    for name, (k, c) in by_kind.items():
        kind = F.when(F.col("kind") == name, F.lit(k)).otherwise(kind)
        code = F.when(F.col("kind") == name, c.cast("string")).otherwise(code)
    text = F.when(F.col("kind") == "alternative", F.concat(F.lit("Rejected: "), F.col("text"))).otherwise(F.col("text"))
    heads = items.where("kind = 'decision'").select("sha", F.col("decision").alias("_d"), F.col("status").alias("_ds"))
    j = items.join(heads.withColumnRenamed("sha", "_s"), (F.col("sha") == F.col("_s")) & (F.col("decision") == F.col("_d")), "left")
    anticipated = (F.col("kind") == "consequence") & ~F.coalesce(F.col("verified"), F.lit(False))
    status = F.when(anticipated, F.when(F.col("_ds") == "speculative", "speculative").otherwise("inferred")).otherwise(F.col("status"))
    prefix = F.lit("a")
    for name, p in PREFIX.items():
        prefix = F.when(F.col("kind") == name, F.lit(p)).otherwise(prefix)
    n = F.when(F.col("kind") != "decision", F.col("n"))
    label = T.compose_label(prefix, F.col("sha"), F.col("run"), F.col("decision"), n)
    u = j.select(
        label.alias("label"), "sha", "decision", F.col("kind").alias("item"), kind.alias("kind"), code.alias("code_kind"),
        T.gist(T.one_paragraph(text)).alias("gist"), T.body(T.one_paragraph(text)).alias("body"), status.alias("status"),
        F.when(status == "cited", F.col("source")).alias("source"), F.array().cast("array<string>").alias("grounds"),
        F.create_map(F.lit("code:kind"), code).alias("payload"),
    )
    heads = u.where("item = 'decision'").select(F.col("sha").alias("_hs"), F.col("decision").alias("_hd"), unit_uid().alias("_head"))
    u = u.join(heads, (F.col("sha") == F.col("_hs")) & (F.col("decision") == F.col("_hd")), "left")
    u = u.withColumn("grounds", F.when(F.col("code_kind") == "anticipated", F.array("_head")).otherwise(F.col("grounds")))
    return u.drop("_hs", "_hd", "_head").withColumn("uid", unit_uid())


def build_edges(units: DataFrame) -> DataFrame:
    """(rid, kind, src, dst) between a decision and its items, and from evidence to what it backs, by uid."""
    heads = units.where("item = 'decision'").select("sha", "decision", F.col("uid").alias("head"))
    j = units.where("item not in ('decision', 'evidence')").join(heads, ["sha", "decision"])
    forward = F.col("item").isin("prerequisite", "alternative")
    kind = (
        F.when(F.col("item") == "prerequisite", "conditions").when(F.col("item") == "alternative", "contrasts")
        .when(F.col("item") == "anchor", "x.code/touches").otherwise("causes")
    )
    src, dst = F.when(forward, F.col("uid")).otherwise(F.col("head")), F.when(forward, F.col("head")).otherwise(F.col("uid"))
    e = j.select(kind.alias("kind"), src.alias("src"), dst.alias("dst"))
    # Evidence has its finding's label with another first letter.
    of = lambda item: units.where(F.col("item") == item).select(F.expr("substring(label, 2)").alias("of"), "sha", F.col("uid").alias(item))
    backs = of("evidence").join(of("consequence"), ["of", "sha"]).select(F.lit("backs").alias("kind"), F.col("evidence").alias("src"), F.col("consequence").alias("dst"))
    e = e.unionByName(backs).distinct()
    return e.select(F.sha2(F.to_json(F.struct("kind", "src", "dst")), 256).alias("rid"), "kind", "src", "dst")


def record_counts(labels: DataFrame) -> DataFrame:
    """Decisions, prerequisites, alternatives and consequences of each commit, from labels."""
    parsed = labels.select(T.parse_label(F.col("label")).alias("p")).where("p.kind is not null")
    g = parsed.groupBy(F.col("p.sha12").alias("sha12"))
    names = {"d": "decisions", "p": "prerequisites", "r": "alternatives", "q": "consequences"}
    return g.agg(*[F.count_if(F.col("p.kind") == k).alias(n) for k, n in names.items()])


def label_contentions(labels: DataFrame) -> DataFrame:
    """Labels bound to more than one uid."""
    return labels.groupBy("label").agg(F.count_distinct("uid").alias("uids")).where("uids > 1")


def resolve_labels(asked: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Asked labels with their one uid, and those that are unbound or ambiguous."""
    bound = labels.groupBy("label").agg(F.count_distinct("uid").alias("uids"), F.min("uid").alias("uid"))
    j = asked.select("label").distinct().join(bound, "label", "left")
    problem = F.when(F.col("uids").isNull(), "unbound").when(F.col("uids") > 1, "ambiguous")
    j = j.withColumn("problem", problem)
    return j.where("problem is null").select("label", "uid"), j.where("problem is not null").select("label", "problem")


def inner_edges(edges: DataFrame, selection: DataFrame) -> DataFrame:
    """Edges with both ends among the selection's uids."""
    ids = selection.select("uid").distinct()
    return edges.join(ids.select(F.col("uid").alias("src")), "src", "left_semi").join(ids.select(F.col("uid").alias("dst")), "dst", "left_semi")


def render_units(units: DataFrame, edges: DataFrame, detail: int = 1) -> DataFrame:
    """One text per unit: label, kind, status, source, gist, body, outgoing edges inside the selection."""
    names = units.select(F.col("uid").alias("dst"), F.col("label").alias("to"))
    out = inner_edges(edges, units).join(names, "dst").groupBy(F.col("src").alias("uid"))
    out = out.agg(F.array_sort(F.collect_set(F.concat(F.lit("  "), F.col("kind"), F.lit(" -> "), F.col("to")))).alias("links"))
    head = F.concat_ws(" ", "label", F.concat(F.lit("("), F.concat_ws(", ", "kind", "status", "source"), F.lit(")")))
    lines = [head, F.col("gist"), *([F.col("body")] if detail else [])]
    return units.join(out, "uid", "left").select("label", F.concat_ws("\n", *lines, F.concat_ws("\n", "links")).alias("block"))


#: Kinds of items: their headings in text and in Markdown.
SECTIONS = [("prerequisite", "needs", "Rests on:"), ("alternative", "not", "Turned down:"), ("consequence", "so", "So:")]


def render_record(units: DataFrame, markdown: bool = False, touches: DataFrame | None = None, footer: str = "") -> DataFrame:
    """One document for each commit (sha): a line of counts, then its decisions in order of their numbers, with why they
    were taken, what they touch (``touches``: sha, decision, anchor), need, turn down and lead to.

    Text always shows a unit's status, Markdown only if it is not cited; ``footer`` ends a Markdown document. Items whose
    decision is not there are counted only.
    """
    cat = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    many = lambda items, f: F.array_join(F.transform(items, f), "")
    some = lambda items, text: F.when(F.size(items) > 0, text).otherwise(F.lit(""))
    of = lambda kind: F.col("item") == kind
    item = F.struct(F.length("label").alias("n"), "label", "gist", "status")  # numbers end a label
    heads = F.max(F.when(of("decision"), F.struct("label", "gist", "status", F.coalesce("body", F.lit("")).alias("body"))))
    g = units.groupBy("sha", "decision").agg(heads.alias("h"), *[F.array_sort(F.collect_list(F.when(of(k), item))).alias(k) for k, _, _ in SECTIONS]).where("h is not null")
    if touches is None:
        g = g.withColumn("anchors", F.array().cast("array<string>"))
    else:
        seen = touches.groupBy("sha", "decision").agg(F.array_sort(F.collect_set("anchor")).alias("anchors"))
        g = g.join(seen, ["sha", "decision"], "left").withColumn("anchors", F.coalesce("anchors", F.array().cast("array<string>")))
    body = F.col("h.body")
    if markdown:
        mark = lambda s: F.when(s != "cited", cat(" _(", s, ")_")).otherwise(F.lit(""))
        lists = [some(k, cat(f"\n{name}\n", many(k, lambda i: cat("- ", i["gist"], mark(i["status"]), "\n")))) for k, _, name in SECTIONS]
        block = cat(
            "\n**", F.col("h.gist"), "**", mark(F.col("h.status")), "\n", F.when(body != "", cat("\n", body, "\n")).otherwise(F.lit("")), *lists,
            some("anchors", cat("\nTouches: `", F.array_join("anchors", "`, `"), "`\n")),
        )
    else:
        line = lambda name: lambda i: cat(f"  {name}: ", i["gist"], " [", i["status"], "]\n")
        lists = [many(k, line(name)) for k, name, _ in SECTIONS]
        block = cat(
            "\n", F.col("h.label"), " [", F.col("h.status"), "]\n  ", F.col("h.gist"), "\n", F.when(body != "", cat("  because: ", body, "\n")).otherwise(F.lit("")),
            many("anchors", lambda a: cat("  touches: ", a, "\n")), *lists,
        )
    blocks = g.groupBy("sha").agg(F.array_sort(F.collect_list(F.struct("decision", block.alias("text")))).alias("blocks"))
    n = units.groupBy("sha").agg(*[F.count_if(of(k)).cast("string").alias(k) for k in ("decision", *[k for k, _, _ in SECTIONS])])
    counts = cat(F.col("decision"), " decision(s), ", F.col("prerequisite"), " prerequisite(s), ", F.col("alternative"), " alternative(s), ", F.col("consequence"), " consequence(s)")
    top = cat("### Why this change\n\nRecorded from `", F.col("sha"), "` — ", counts, ".\n") if markdown else cat(F.col("sha"), ": ", counts, "\n")
    all_ = F.coalesce(many("blocks", lambda b: b["text"]), F.lit(""))
    return n.join(blocks, "sha", "left").select("sha", cat(top, all_, footer if markdown else "").alias("document"))


def commit_input(files: DataFrame, messages: DataFrame) -> DataFrame:
    """Message, then ``--- path ---`` and text for each file in path order, as one string."""
    part = F.struct("path", F.concat(F.lit("--- "), F.col("path"), F.lit(" ---\n"), F.coalesce("after", F.lit(""))).alias("text"))
    g = files.groupBy("sha").agg(F.array_sort(F.collect_list(part)).alias("parts"))
    j = messages.join(g, "sha", "left")
    return j.select("sha", F.concat_ws("\n", "message", F.array_join(F.transform("parts", lambda p: p["text"]), "\n")).alias("input"))


def touched_items(before: DataFrame, after: DataFrame) -> DataFrame:
    """Items (sha, path, item, body_hash) of ``after`` that are new or whose body differs from ``before``."""
    b = before.select("sha", "path", "item", F.col("body_hash").alias("old"))
    j = after.join(b, ["sha", "path", "item"], "left")
    return j.where(~F.col("body_hash").eqNullSafe(F.col("old"))).drop("old")


def anchor_touches(decisions: DataFrame, anchors: DataFrame) -> DataFrame:
    """Each decision quoted from a file to every anchor of that file in its commit; (src, dst)."""
    j = decisions.withColumn("path", T.source_path(F.col("source"))).where("path is not null")
    return j.select("sha", "path", F.col("uid").alias("src")).join(anchors.select("sha", "path", F.col("uid").alias("dst")), ["sha", "path"])


def corpus_only_commits(files: DataFrame, folder: str) -> DataFrame:
    """Commits with at least one file, all of them below the record's folder."""
    return files.groupBy("sha").agg(F.bool_and(F.startswith("path", F.lit(folder.rstrip("/") + "/"))).alias("only")).where("only").select("sha")


def not_recorded(commits: DataFrame, recorded: DataFrame, corpus_only: DataFrame) -> DataFrame:
    return commits.join(recorded.select("sha"), "sha", "left_anti").join(corpus_only.select("sha"), "sha", "left_anti")


def backlog(commits: DataFrame, recorded: DataFrame, corpus_only: DataFrame) -> DataFrame:
    """Of each repository's commits (repo, sha, age: 0 is the newest) those newer than the first recorded one."""
    seen = recorded.select("sha", F.lit(1).alias("seen"))
    w = Window.partitionBy("repo").orderBy("age").rowsBetween(Window.unboundedPreceding, 0)
    j = commits.join(seen, "sha", "left").withColumn("past", F.max(F.coalesce("seen", F.lit(0))).over(w))
    return j.where("past = 0").select("repo", "sha", "age").join(corpus_only.select("sha"), "sha", "left_anti")


def cost_estimate(files: DataFrame) -> DataFrame:
    """Bytes and estimated minutes for each commit, and in all (null sha)."""
    size = F.coalesce(F.octet_length("after"), F.lit(0))
    per = files.groupBy("sha").agg(F.sum(size).alias("bytes")).withColumn("minutes", T.estimate_minutes(F.col("bytes")))
    return per.unionByName(per.agg(F.lit(None).cast("string").alias("sha"), F.sum("bytes").alias("bytes"), F.sum("minutes").alias("minutes")))
