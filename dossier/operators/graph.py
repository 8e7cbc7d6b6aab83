"""Reach over premise edges and histories.

Premise graphs are shallow: a round for each level, newest rows only. Histories are long: whole runs of first parents are
followed by doubling, so that rounds grow with the logarithm of their length and with how deep merges are nested. Every
round is a table in the shared folder; only counts reach the driver.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import stored


def reach(starts: DataFrame, edges: DataFrame, *, max_levels: int | None = None) -> DataFrame:
    """(root, node) and edges (src, dst) to (root, node, level): all that each root reaches along edges, itself at 0.

    Each level joins the newest nodes with the edges and drops those already reached, so cycles end; only the test for
    an empty level is answered on the driver.
    """
    e = edges.select("src", "dst").distinct()
    new = stored(starts.select("root", "node").distinct().withColumn("level", F.lit(0)), "reach")
    seen = new
    level = 0
    while max_levels is None or level < max_levels:
        level += 1
        step = new.join(e, F.col("node") == F.col("src")).select("root", F.col("dst").alias("node")).distinct()
        new = stored(step.join(seen.select("root", "node"), ["root", "node"], "left_anti").withColumn("level", F.lit(level)), "reach")
        if new.isEmpty():
            break
        seen = seen.unionByName(new)
    return seen


def dependents_of(starts: DataFrame, edges: DataFrame) -> DataFrame:
    """(root, node, level) of everything that rests on each root, without the root itself. Edges: src is the premise."""
    return reach(starts.select(F.col("uid").alias("root"), F.col("uid").alias("node")), edges).where("level > 0")


def premise_closure(focus: DataFrame, edges: DataFrame) -> DataFrame:
    """(change, uid, rank) to (change, uid, rank): the focus units and all they rest on, with the best focus rank.

    A row for each change and unit, whatever number of focus units rests on it: a round hands the ranks that have just
    become better on to the premises, and a rank that is no better goes no further. Cycles end as ranks only fall.
    """
    back = stored(edges.select(F.col("dst").alias("uid"), F.col("src").alias("premise")).distinct(), "premises")
    best = stored(focus.groupBy("change", "uid").agg(F.min("rank").alias("rank")), "closure")
    new = best
    while True:
        step = new.join(back, "uid").groupBy("change", F.col("premise").alias("uid")).agg(F.min("rank").alias("rank"))
        known = best.select("change", "uid", F.col("rank").alias("had"))
        new = stored(step.join(known, ["change", "uid"], "left").where("had is null or rank < had").drop("had"), "closure-step")
        if new.isEmpty():
            return best
        best = stored(best.unionByName(new).groupBy("change", "uid").agg(F.min("rank").alias("rank")), "closure")


def first_parent_jumps(parents: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """(jumps, others) of a history (sha, parent, and pos where parents have an order).

    ``jumps[k]`` (node, up) leads from a commit 2^k first parents on; as many tables as the longest run asks for.
    ``others`` (node, up) are the edges to further parents. Commits that are their own ancestors are followed as often
    as there are commits and no further.
    """
    p = parents.where("sha is not null and parent is not null")
    order = F.min(F.struct(*[c for c in ("pos", "parent") if c in p.columns]))["parent"]
    first = stored(p.groupBy(F.col("sha").alias("node")).agg(order.alias("up")), "jumps")
    others = stored(p.select(F.col("sha").alias("node"), F.col("parent").alias("up")).distinct().exceptAll(first), "merge-parents")
    n = first.count()
    jumps = [first] if n else []
    for _ in range(max(0, math.ceil(math.log2(n + 1)) - 1) if n else 0):
        last = jumps[-1]
        twice = last.join(last.select(F.col("node").alias("up"), F.col("up").alias("far")), "up").select("node", F.col("far").alias("up"))
        twice = stored(twice, "jumps")
        if twice.isEmpty():
            break
        jumps.append(twice)
    return jumps, others


def _nearer(rows: DataFrame, best: DataFrame | None) -> DataFrame:
    """Of (root, node, level), the least level of each pair, where it is less than the one known."""
    rows = rows.groupBy("root", "node").agg(F.min("level").alias("level"))
    if best is None:
        return rows
    known = best.select("root", "node", F.col("level").alias("had"))
    return rows.join(known, ["root", "node"], "left").where("had is null or level < had").drop("had")


def _along(new: DataFrame, jumps: list[DataFrame], best: DataFrame | None, most: int | None) -> DataFrame:
    """``new`` (root, node, level) and all their first parents. After jump k each row has gone on 0 to 2^(k+1) - 1 times.

    What is no nearer than ``best`` says is dropped: all beyond it is in ``best`` as near.
    """
    for k, jump in enumerate(jumps):
        if most is not None and 1 << k > most:
            break
        step = new.join(jump, "node").select("root", F.col("up").alias("node"), (F.col("level") + (1 << k)).alias("level"))
        if most is not None:
            step = step.where(F.col("level") <= most)
        new = stored(_nearer(new.unionByName(step), best), "ancestors")
    return new


def history_reach(starts: DataFrame, parents: DataFrame, *, max_levels: int | None = None) -> DataFrame:
    """(root, node) and (sha, parent) to (root, node, level): each root's start commits and all their ancestors, with the
    least number of steps. Rounds: the logarithm of the longest run of first parents, once for each depth of merges."""
    jumps, others = first_parent_jumps(parents)
    best = _along(stored(starts.where("node is not null").select("root", "node").distinct().withColumn("level", F.lit(0)), "ancestors"), jumps, None, max_levels)
    new = best
    while not others.isEmpty():
        step = new.join(others, "node").select("root", F.col("up").alias("node"), (F.col("level") + 1).alias("level"))
        if max_levels is not None:
            step = step.where(F.col("level") <= max_levels)
        new = stored(_nearer(step, best), "ancestors")
        if new.isEmpty():
            break
        new = _along(new, jumps, best, max_levels)
        best = stored(best.unionByName(new).groupBy("root", "node").agg(F.min("level").alias("level")), "ancestors")
    return best


def commit_ancestors(starts: DataFrame, parents: DataFrame, *, max_levels: int | None = None) -> DataFrame:
    """(sha) and (sha, parent) to (root, node, level): each start and all its ancestors."""
    return history_reach(starts.select(F.col("sha").alias("root"), F.col("sha").alias("node")), parents, max_levels=max_levels)


def commits_between(base: DataFrame, to: DataFrame, parents: DataFrame, limit: int | None = None) -> DataFrame:
    """Commits (node, level) that ``to`` reaches and ``base`` does not, nearest first."""
    sides = to.select(F.lit("to").alias("root"), F.col("sha").alias("node")).unionByName(base.select(F.lit("base").alias("root"), F.col("sha").alias("node")))
    got = history_reach(sides, parents)
    out = got.where("root = 'to'").select("node", "level").join(got.where("root = 'base'").select("node"), "node", "left_anti").orderBy("level", "node")
    return out if limit is None else out.limit(limit)


def scope_select(facts: DataFrame, calls: DataFrame, starts: DataFrame, hops: int = 1) -> DataFrame:
    """Facts (label, name) chosen from starts (label, reason) by hops over calls (label, callee).

    A hop adds facts that the selection calls by name (``Calls``) and functions that call a selected name
    (``CalledBy``); a fact's reason is the first of Touched, Named, Calls, CalledBy that chose it, Calls before
    CalledBy within a hop.
    """
    order = ["Touched", "Named", "Calls", "CalledBy"]
    rank = F.array_position(F.array(*map(F.lit, order)), F.col("reason")).cast("int")
    got = starts.withColumn("rank", rank).groupBy("label").agg(F.min("rank").alias("rank"))
    c = calls.select("label", "callee").distinct()
    for _ in range(hops):
        called = got.join(c, "label").select(F.col("callee").alias("name")).distinct().join(facts, "name").select("label", F.lit(3).alias("rank"))
        names = got.join(facts, "label").select(F.col("name").alias("callee")).distinct()
        callers = c.join(names, "callee", "left_semi").select("label", F.lit(4).alias("rank"))
        new = called.union(callers).groupBy("label").agg(F.min("rank").alias("rank")).join(got.select("label"), "label", "left_anti")
        got = stored(got.unionByName(new), "scope")
    return got.select("label", F.element_at(F.array(*map(F.lit, order)), F.col("rank")).alias("reason"))
