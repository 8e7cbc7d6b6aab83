"""Retrieval: document frequencies, BM25, anchors, shortlists by shared terms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .graph import premise_closure
from .shared import stored

# The kinds a change can contradict.
JUDGED_KINDS = ["act", "decline", "existing-behaviour", "invariant", "tool-setting", "prior-change", "assumption", "rejected-alternative"]
K1, B = 1.2, 0.75


def ranked(df: DataFrame, by: list[str], order: list[Column], most: int, name: str = "rank") -> DataFrame:
    """The first ``most`` rows of each group, numbered."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w)).where(F.col(name) <= most)


def postings(docs: DataFrame, terms: Column, id_col: str = "doc_id", asked: DataFrame | None = None, lengths: Observation | None = None) -> DataFrame:
    """(doc, term, tf, len) of an array column of terms; with ``asked`` (term), of those terms only.

    ``lengths`` sees all documents pass, and tells their number and length once the postings have been read.
    """
    d = docs.select(F.col(id_col).alias("doc"), terms.alias("terms"))
    if lengths is not None:
        n = F.size("terms")
        d = d.observe(lengths, F.count_if(n > 0).alias("n_docs"), F.sum(F.greatest(n, F.lit(0))).alias("n_terms"))
    d = d.select("doc", F.size("terms").alias("len"), F.explode("terms").alias("term"))
    if asked is not None:
        d = d.join(asked.select("term").distinct(), "term", "left_semi")
    return d.groupBy("doc", "term").agg(F.count("*").alias("tf"), F.max("len").alias("len"))


def term_stats(post: DataFrame) -> DataFrame:
    """(term, df): in how many documents each term occurs."""
    return post.groupBy("term").agg(F.count("*").alias("df"))


#: What sums of scores may differ by when they are added up in another order.
SLACK = 1e-6
#: Postings that a task sums up for all queries.
POSTINGS = 1 << 19


def bm25_search(
    post: DataFrame, queries: DataFrame, *, kinds: DataFrame | None = None, most: int = 12, min_weight: float = 0.0, lengths: Observation | None = None
) -> DataFrame:
    """(query, term) against an index (doc, term, tf, len) to the ``most`` best (query, doc, score, terms, rank).

    Frequencies and lengths are those of the whole index (``lengths`` has seen them, where ``post`` holds asked terms
    only); ``kinds`` (doc) restricts results before the limit. A hit counts only if one of its terms contributes at least
    ``min_weight``. Ties (to nine places) go to the smaller doc.
    """
    asked = stored(queries.select("query", "term").distinct(), "asked-terms")
    if lengths is None:
        n, avg = post.groupBy("doc").agg(F.max("len").alias("len")).agg(F.count("*"), F.avg("len")).first()  # two numbers
        post = post.join(asked.select("term").distinct(), "term", "left_semi")
    index = stored(post, "postings")
    if lengths is not None:
        n, avg = lengths.get["n_docs"] or 0, (lengths.get["n_terms"] or 0) / max(1, lengths.get["n_docs"] or 0)
    idf = F.log(1 + (F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    tf = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.lit(avg or 1.0)))
    index = index.join(term_stats(index), "term")
    if kinds is not None:
        index = index.join(kinds.select("doc"), "doc", "left_semi")
    index = stored(index.select("doc", "term", (idf * tf).alias("w")), "weights")
    top = top_scores(asked, index, most, min_weight=min_weight)
    best = stored(ranked(top, ["query"], [F.desc(F.round("score", 9)), F.col("doc")], most), "best-hits")
    return best.join(shared_terms(best, asked, index), ["query", "doc"]).select("query", "doc", "score", "terms", "rank")


def shared_terms(pairs: DataFrame, asked: DataFrame, index: DataFrame) -> DataFrame:
    """(query, doc, terms) of pairs: the terms that they share, heaviest first."""
    hits = pairs.select("query", "doc").join(asked.select("query", "term"), "query").join(index, ["doc", "term"])
    g = hits.groupBy("query", "doc").agg(F.array_sort(F.collect_list(F.struct(-F.col("w"), "term"))).alias("ts"))
    return g.select("query", "doc", F.transform("ts", lambda t: t["term"]).alias("terms"))


def top_scores(asked: DataFrame, index: DataFrame, most: int, *, min_weight: float = 0.0, bonus: DataFrame | None = None) -> DataFrame:
    """(query, term) against an index (doc, term, w), both stored, to (query, doc, score): for each query the ``most``
    documents with the greatest sums of weights over shared terms, and those that tie with the last (to nine places).

    Documents count only if one shared term weighs at least ``min_weight``. ``bonus`` (query, doc, bonus) is added to the
    sum, and is a document's score where no term is shared.

    Documents under a query's rarest terms are scored first; the ``most``-th of them sets the query's threshold. Then one
    pass over the index, dealt out by document, sums up each document's weights for all queries that it shares a term
    with, and only pairs that reach the threshold leave their task.
    """
    bounds = index.groupBy("term").agg(F.count("*").alias("n"))
    asked = stored(asked.select("query", "term").join(bounds, "term"), "query-terms")
    extra = None if bonus is None else stored(bonus, "bonus")
    first = stored(scored(first_hits(asked, index, 16 * most), asked, index, min_weight, extra), "first-hits")
    reached = ranked(first, ["query"], [F.desc("score")], most).groupBy("query").agg(F.count("*").alias("k"), F.min("score").alias("least"))
    reached = stored(reached.where(F.col("k") == most).select("query", (F.col("least") - SLACK).alias("least")), "thresholds")
    pairs = stored(candidates(asked, reached, index, min_weight, extra), "candidates")
    all_ = scored(pairs, asked, index, min_weight, extra)
    return all_.withColumn("_r", F.rank().over(Window.partitionBy("query").orderBy(F.desc(F.round("score", 9))))).where(F.col("_r") <= most).drop("_r")


def first_hits(asked: DataFrame, index: DataFrame, enough: int) -> DataFrame:
    """(query, doc) under each query's rarest terms, ``enough`` postings at most: any will do for a threshold."""
    w = Window.partitionBy("query").orderBy("n", "term").rowsBetween(Window.unboundedPreceding, -1)
    rare = asked.withColumn("before", F.coalesce(F.sum("n").over(w), F.lit(0))).where(F.col("before") < enough)
    hits = rare.select("query", "term", "n").join(index, "term")
    return ranked(hits, ["query"], [F.col("n"), F.col("term"), F.col("doc")], enough).select("query", "doc").distinct()


def scored(pairs: DataFrame, asked: DataFrame, index: DataFrame, min_weight: float, bonus: DataFrame | None) -> DataFrame:
    """(query, doc, score) of pairs (and of those with a bonus) by all of the query's terms."""
    if bonus is not None:
        pairs = pairs.union(bonus.select("query", "doc")).distinct()
    hits = pairs.join(asked.select("query", "term"), "query").join(index, ["doc", "term"])
    g = hits.groupBy("query", "doc").agg(F.sum("w").alias("score"), F.max("w").alias("top")).where(F.col("top") >= min_weight).drop("top")
    if bonus is None:
        return g
    both = g.join(bonus, ["query", "doc"], "full_outer")
    return both.select("query", "doc", (F.coalesce("score", F.lit(0.0)) + F.coalesce("bonus", F.lit(0.0))).alias("score"))


def candidates(asked: DataFrame, reached: DataFrame, index: DataFrame, min_weight: float, bonus: DataFrame | None) -> DataFrame:
    """(query, doc) whose shared terms reach the query's threshold (query, least), with the greatest bonus where there is
    one; all that share a term where the query has no threshold."""
    most = (bonus.agg(F.max("bonus")).first()[0] or 0.0) if bonus is not None else 0.0  # one number
    parts = max(index.sparkSession.sparkContext.defaultParallelism, index.count() // POSTINGS)
    # All postings of a document are in one partition, so that its sums need no further shuffle.
    hits = index.repartition(parts, "doc").join(asked.select("query", "term"), "term")
    g = hits.groupBy("doc", "query").agg(F.sum("w").alias("score"), F.max("w").alias("top")).where(F.col("top") >= min_weight)
    return g.join(reached, "query", "left").where(F.col("least").isNull() | (F.col("score") + most >= F.col("least"))).select("query", "doc")


def context_scope(tasks: DataFrame, files: DataFrame, hits: DataFrame, units: DataFrame, most: int = 6) -> DataFrame:
    """(task, sha): the commits of each task's scope.

    tasks: (task, repo, path), a row for each file; files: (repo, sha, path) of all commits; hits: (task, doc, rank) by
    search; units: (doc, repo, sha). Commits that share a file with the task, and those of its ``most`` best units; all of
    the repository where no commit shares one. A task of one repository meets each of its commits once, so these rows, most
    of all, need no distinct.
    """
    touched = tasks.join(files.select("repo", "sha", "path").distinct(), ["repo", "path"]).select("task", "repo", "sha").distinct()
    asked = tasks.select("task", "repo").distinct()
    known = touched.select("task").distinct()
    found = hits.where(F.col("rank") <= most).select("task", "doc").join(units.select("doc", "repo", "sha"), "doc")
    found = found.join(asked.join(known, "task", "left_semi"), ["task", "repo"]).select("task", "sha")
    rest = asked.join(known, "task", "left_anti").where("repo is not null").groupBy("task").agg(F.collect_list("repo").alias("repos"))
    commits = files.select("repo", "sha").distinct()
    whole = lambda some: some.select("task", F.explode("repos").alias("repo")).join(commits, "repo").select("task", "sha")
    one, many = whole(rest.where(F.size("repos") == 1)), whole(rest.where(F.size("repos") > 1)).distinct()
    return touched.select("task", "sha").union(found).distinct().union(one).union(many)


def diff_query(lines: DataFrame, files: DataFrame, most: int = 80) -> DataFrame:
    """(change, term): the most frequent identifiers of changed lines (change, pos, content), ties by first place, and
    the path parts of at least three bytes."""
    t = lines.select("change", "pos", F.posexplode(T.ident_terms(F.col("content"))).alias("i", "term"))
    g = t.groupBy("change", "term").agg(F.count("*").alias("n"), F.min(F.struct("pos", "i")).alias("at"))
    top = ranked(g, ["change"], [F.desc("n"), F.col("at")], most).select("change", "term")
    parts = files.select("change", F.explode(F.filter(F.split("file", "[/._-]"), lambda p: F.octet_length(p) >= 3)).alias("term"))
    return top.union(parts).distinct()


def units_anchored_to_files(units: DataFrame, files: DataFrame) -> DataFrame:
    """(change, label) of units whose source is one of the change's files: an equality join on the source's path."""
    u = units.withColumn("file", T.source_path(F.col("source"))).where("file is not null")
    return u.join(files.select("change", "file").distinct(), "file").select("change", "label").distinct()


def merge_candidates(hits: DataFrame, anchored: DataFrame, most: int = 12) -> DataFrame:
    """BM25 hits (change, label, score) and anchored units: score + half the best hit if anchored, best first."""
    w = Window.partitionBy("change")
    a = anchored.select("change", "label", F.lit(True).alias("anchored"))
    j = hits.select("change", "label", "score").join(a, ["change", "label"], "full_outer")
    best = F.greatest(F.lit(1.0), F.coalesce(F.max("score").over(w), F.lit(0.0)))
    total = F.coalesce("score", F.lit(0.0)) + F.when(F.col("anchored"), best / 2).otherwise(0.0)
    j = j.withColumn("anchored", F.coalesce("anchored", F.lit(False))).withColumn("score", total)
    j = j.where("score > 0").where(F.col("label").rlike("^[dpr]/"))
    return ranked(j, ["change"], [F.desc("score"), F.col("label")], most)


def shortlist_tests(claims: DataFrame, tests: DataFrame, most: int = 10) -> DataFrame:
    """Claims (claim, text, files) against tests (label, file, text): weight of shared terms, plus 1 if the file is touched.

    A term weighs max(ln(N / (1 + df)), 0.1) over all tests.
    """
    post = tests.select(F.col("label").alias("doc"), F.explode(T.identifier_terms(F.col("text"))).alias("term"))
    weight = F.greatest(F.log(F.lit(float(tests.count())) / (1 + F.col("df"))), F.lit(0.1))
    asked = stored(claims.select(F.col("claim").alias("query"), F.explode(T.identifier_terms(F.col("text"))).alias("term")).distinct(), "asked-terms")
    post = stored(post.join(asked.select("term").distinct(), "term", "left_semi"), "postings")
    df = post.groupBy("term").agg(F.count_distinct("doc").alias("df"))
    index = stored(post.join(df.select("term", weight.alias("w")), "term").select("doc", "term", "w"), "weights")
    touched = claims.select("claim", F.explode("files").alias("file")).join(tests.select("label", "file"), "file")
    touched = touched.select(F.col("claim").alias("query"), F.col("label").alias("doc"), F.lit(1.0).alias("bonus")).distinct()
    top = top_scores(asked, index, most, bonus=touched).where("score > 0")
    best = stored(ranked(top, ["query"], [F.desc(F.round("score", 9)), F.col("doc")], most), "shortlist")
    out = best.join(shared_terms(best, asked, index), ["query", "doc"], "left")
    return out.select(F.col("query").alias("claim"), F.col("doc").alias("label"), "score", "terms", "rank")


def retrieve_facts(claims: DataFrame, facts: DataFrame, *, structural: int = 30, prose: int = 10, room: int = 20_000) -> DataFrame:
    """Claims (claim, text) to facts (fact, text, prose) with most shared words: two quotas, then a cut at ``room`` bytes."""
    asked = stored(claims.select(F.col("claim").alias("query"), F.explode(T.word_terms(F.col("text"))).alias("term")).distinct(), "asked-terms")
    words = facts.select(F.col("fact").alias("doc"), F.coalesce("prose", F.lit(False)).alias("prose"), F.explode(T.word_terms(F.col("text"))).alias("term"))
    index = stored(words.join(asked.select("term").distinct(), "term", "left_semi").withColumn("w", F.lit(1.0)), "postings")
    hits = None
    for kind, most in ((False, structural), (True, prose)):
        top = top_scores(asked, index.where(F.col("prose") == kind).drop("prose"), most)
        top = top.select(F.col("query").alias("claim"), F.col("doc").alias("fact"), F.col("score").cast("long").alias("shared"), F.lit(kind).alias("prose"))
        hits = top if hits is None else hits.unionByName(top)
    # Texts settle ties only, so that they join what is left.
    hits = hits.join(facts.select("fact", "text"), "fact")
    w = Window.partitionBy("claim", "prose").orderBy(F.desc("shared"), "text", "fact")
    hits = hits.withColumn("r", F.row_number().over(w)).where(F.col("r") <= F.when(F.col("prose"), prose).otherwise(structural))
    order = Window.partitionBy("claim").orderBy("prose", "r").rowsBetween(Window.unboundedPreceding, 0)
    return hits.withColumn("bytes", F.sum(F.octet_length("text")).over(order)).where(F.col("bytes") <= room).select("claim", "fact", "shared", "prose", "r", "bytes")


def anchor_function(retrieved: DataFrame, facts: DataFrame) -> DataFrame:
    """The first retrieved structural fact of each claim that is not a test."""
    j = retrieved.where("not prose").join(facts.where("not is_test").select("fact"), "fact", "left_semi")
    return ranked(j, ["claim"], [F.col("r")], 1).select("claim", "fact")


def suggest_labels(system: DataFrame, gold: DataFrame, most: int = 3) -> DataFrame:
    """System items (repo, commit, kind, id, text) to the gold ids of their commit and kind with the best Jaccard."""
    on = ["repo", "commit", "kind"]
    s = system.select(*on, "id", T.label_words(F.col("text")).alias("sw"))
    g = gold.select(*on, F.col("id").alias("gold_id"), T.label_words(F.col("text")).alias("gw"))
    j = s.join(g, on).withColumn("score", T.jaccard(F.col("sw"), F.col("gw"))).where("score > 0")
    top = ranked(j, [*on, "id"], [F.desc("score"), F.col("gold_id")], most)
    got = top.groupBy(*on, "id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "gold_id"))), lambda x: x["gold_id"]).alias("suggest"))
    return system.select(*on, "id").join(got, [*on, "id"], "left").withColumn("suggest", F.coalesce("suggest", F.array().cast("array<string>")))


def judged_units(candidates: DataFrame, packed: DataFrame, most: int = 24) -> DataFrame:
    """Candidates (change, label, rank) first, then packed d/p/r units by label; distinct, at most ``most`` a change."""
    first = candidates.select("change", "label", F.lit(0).alias("from_pack"), "rank")
    then = packed.where(F.col("label").rlike("^[dpr]/")).select("change", "label", F.lit(1).alias("from_pack"), F.lit(0).alias("rank"))
    one = first.unionByName(then).groupBy("change", "label").agg(F.min(F.struct("from_pack", "rank")).alias("o"))
    return ranked(one, ["change"], [F.col("o"), F.col("label")], most, "pos").select("change", "label", "pos")


def rotate_units(units: DataFrame, seed: int) -> DataFrame:
    """Positions of each change's units rotated left by ``seed`` places."""
    n = F.count("*").over(Window.partitionBy("change"))
    return units.withColumn("pos", F.pmod(F.col("pos") - 1 - seed, n).cast("int") + 1)


def chunk_units(units: DataFrame, size: int = 6) -> DataFrame:
    """Groups of ``size`` units of a change; 0 makes one group."""
    return units.withColumn("chunk", F.floor((F.col("pos") - 1) / size).cast("int") if size else F.lit(0))


def count_anchored_units(units: DataFrame, files: DataFrame) -> DataFrame:
    """(change, units): how many labels ``units_anchored_to_files`` gives each change.

    Labels of one file are counted by file, and only these counts meet the changes; only labels of several files meet
    them one by one.
    """
    u = units.select("label", T.source_path(F.col("source")).alias("file")).where("file is not null").repartition("label")
    # Dealt out first, a label is grouped once, in its own partition.
    g = u.groupBy("label").agg(F.min("file").alias("file"), F.max("file").alias("_last"))
    once = g.where("file = _last").groupBy("file").agg(F.count("*").alias("n"))
    many = u.join(g.where("file <> _last").select("label"), "label", "left_semi")
    f = files.select("change", "file").distinct()
    both = f.join(once, "file").select("change", "n")
    both = both.unionByName(f.join(many, "file").groupBy("change").agg(F.count_distinct("label").alias("n")))
    return both.groupBy("change").agg(F.sum("n").alias("units"))


def order_files_by_corpus(files: DataFrame, units: DataFrame) -> DataFrame:
    """Files (change, file, ord) by how many units are anchored to them, their own order on ties."""
    u = units.select(T.source_path(F.col("source")).alias("file")).where("file is not null").groupBy("file").agg(F.count("*").alias("anchored"))
    j = files.join(u, "file", "left").withColumn("anchored", F.coalesce("anchored", F.lit(0)))
    w = Window.partitionBy("change").orderBy(F.desc("anchored"), "ord")
    return j.withColumn("new_ord", F.row_number().over(w))


def pack_prefix(closure: DataFrame, costs: DataFrame, budget: int) -> DataFrame:
    """Closure (change, uid, rank) with costs (uid, cost): the longest run of focus ranks whose closures fit the budget."""
    per = closure.join(costs, "uid").groupBy("change", "rank").agg(F.sum("cost").alias("cost"))
    w = Window.partitionBy("change").orderBy("rank")
    fits = per.withColumn("used", F.sum("cost").over(w)).where(F.col("used") <= budget)
    last = fits.groupBy("change").agg(F.max("rank").alias("last"))
    return closure.join(last, "change").where("rank <= last").select("change", "uid", "rank")


def pack_fill(packed: DataFrame, candidates: DataFrame, costs: DataFrame, budget: int) -> DataFrame:
    """Packed units (change, uid, rank) and what still fits of the candidates (change, uid, rank), best ranks first:
    the longest run of them whose cost, added to that of the packed units, stays within the budget."""
    used = packed.select("change", "uid").distinct().join(costs, "uid").groupBy("change").agg(F.sum("cost").alias("base"))
    rest = candidates.join(packed.select("change", "uid"), ["change", "uid"], "left_anti").join(costs, "uid").join(used, "change", "left")
    w = Window.partitionBy("change").orderBy("rank", "uid").rowsBetween(Window.unboundedPreceding, 0)
    rest = rest.withColumn("used", F.coalesce("base", F.lit(0)) + F.sum("cost").over(w)).where(F.col("used") <= budget)
    return packed.select("change", "uid", "rank").unionByName(rest.select("change", "uid", "rank"))


def pack_task(hits: DataFrame, seeds: DataFrame, edges: DataFrame, costs: DataFrame, budget: int, most: int = 6) -> DataFrame:
    """(change, uid, rank) for a task's context: hits (change, uid, rank) and what they rest on, then seeds.

    The focus is the ``most`` best hits, less the last ones until it fits the budget with all its premises. What is left
    of the budget goes to seeds (change, uid), the units that come from the task's files, in order of their ids. Tasks of
    which not even the best hit fits have no rows.
    """
    packed = stored(pack_prefix(premise_closure(hits.where(F.col("rank") <= most), edges), costs, budget), "packed")
    order = Window.partitionBy("change").orderBy("uid")
    wanted = seeds.select("change", "uid").distinct().join(packed.select("change").distinct(), "change", "left_semi")
    return pack_fill(packed, wanted.withColumn("rank", F.row_number().over(order)), costs, budget)
