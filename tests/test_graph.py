"""Histories by doubling and closures by least rank, against plain walks."""

import random
from collections import deque

import pytest

from dossier.operators import graph


def walk(starts, parents):
    """Least steps from each start to all its ancestors."""
    up = {}
    for sha, parent in parents:
        up.setdefault(sha, []).append(parent)
    out = {}
    for root in starts:
        at, todo = {root: 0}, deque([root])
        while todo:
            x = todo.popleft()
            for y in up.get(x, []):
                if y is not None and y not in at:
                    at[y] = at[x] + 1
                    todo.append(y)
        out |= {(root, n): d for n, d in at.items()}
    return out


def got(df):
    return {(r.root, r.node): r.level for r in df.collect()}


def test_a_long_chain_takes_few_rounds(spark, monkeypatch):
    n, rounds = 100_000, []
    save = graph.stored
    monkeypatch.setattr(graph, "stored", lambda df, name: rounds.append(name) or save(df, name))
    parents = spark.range(n).selectExpr("id as sha", "if(id > 0, id - 1, null) as parent")
    frame = lambda *ids: spark.createDataFrame([(i,) for i in ids], "sha long")
    out = graph.commits_between(frame(20_000), frame(n - 1), parents)
    r = out.selectExpr("count(*) as n", "min(node) as lo", "max(level) as far", "sum(node + level) as s").first()
    assert (r.n, r.lo, r.far, r.s) == (n - 20_001, 20_001, n - 20_002, (n - 1) * (n - 20_001))
    assert rounds.count("jumps") <= 20 and rounds.count("ancestors") <= 20
    assert [x.node for x in graph.commits_between(frame(20_000), frame(n - 1), parents, limit=2).collect()] == [n - 1, n - 2]


@pytest.mark.parametrize("seed", range(3))
def test_merges_against_a_walk(spark, seed):
    """Branches, merges of merges, several parents, unknown parents and rows without one."""
    rng = random.Random(seed)
    parents = [(0, None), (7, 1000), (None, 3)]
    for i in range(1, 120):
        parents.append((i, i - 1 if rng.random() < 0.7 else rng.randrange(i)))
        for _ in range(rng.choice([0, 0, 1, 2])):
            parents.append((i, rng.randrange(i)))
    p = spark.createDataFrame(parents, "sha int, parent int")
    starts = [119, 60, 3, 555]
    s = spark.createDataFrame([(i,) for i in starts], "sha int")
    want = walk(starts, parents)
    assert got(graph.commit_ancestors(s, p)) == want
    assert got(graph.commit_ancestors(s, p, max_levels=3)) == {k: v for k, v in want.items() if v <= 3}
    base, to = s.where("sha = 60"), s.where("sha in (119, 555)")
    over = {n for r, n in want if r == 60}
    near = {}
    for (r, n), d in want.items():
        if r in (119, 555) and n not in over:
            near[n] = min(d, near.get(n, d))
    assert {r.node: r.level for r in graph.commits_between(base, to, p).collect()} == near


def test_cycles_and_empty_histories_end(spark):
    p = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 3)], "sha int, parent int")
    s = spark.createDataFrame([(4,)], "sha int")
    assert got(graph.commit_ancestors(s, p)) == {(4, 4): 0, (4, 3): 1, (4, 1): 2, (4, 2): 3}
    assert got(graph.commit_ancestors(s, p.where("sha = 9"))) == {(4, 4): 0}
    assert graph.commit_ancestors(s.where("sha = 9"), p).count() == 0
    focus = spark.createDataFrame([("x", 1, 5), ("x", 4, 2), ("y", 2, 1)], "change string, uid int, rank int")
    edges = spark.createDataFrame([(2, 1), (3, 2), (1, 3), (3, 4), (None, 1)], "src int, dst int")
    rows = {(r.change, r.uid): r["rank"] for r in graph.premise_closure(focus, edges).where("uid is not null").collect()}
    assert rows == {("x", 4): 2, ("x", 3): 2, ("x", 1): 2, ("x", 2): 2, ("y", 2): 1, ("y", 3): 1, ("y", 1): 1}


def test_closure_rows_are_bounded_by_pairs(spark, monkeypatch):
    """A hundred focus units over one chain of premises: a row a unit, not a row for each focus unit and premise."""
    most = []
    save = graph.stored
    monkeypatch.setattr(graph, "stored", lambda df, name: (x := save(df, name), most.append(x.count()))[0])
    edges = spark.createDataFrame([(i, i + 1) for i in range(8)] + [(8, 100 + k) for k in range(100)], "src int, dst int")
    focus = spark.createDataFrame([("x", 100 + k, k) for k in range(100)], "change string, uid int, rank int")
    out = graph.premise_closure(focus, edges).collect()
    assert len(out) == 109 and all(r["rank"] == 0 for r in out if r.uid < 100) and max(most) <= 109
