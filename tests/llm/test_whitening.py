import numpy as np
import pytest

from dossier.llm import queries, whitening

SF = "/root/testdata/sf0.001"


def brute(vectors, most=4):
    """n, deviations, whitened, explained by numpy's eigensolver over the distinct quantised vectors."""
    x = np.floor(256 * np.array(vectors, float)).astype(np.int64)
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(axis=0)
    y = fit - s / n
    e, v = np.linalg.eigh(y.T @ y / n)
    e, v = e[::-1][:most], v[:, ::-1][:, :most]
    return n, ((n * x - s) ** 2).sum(axis=1), (x - s / n) @ v / np.sqrt(e), e / np.trace(y.T @ y / n)


def against(rows, ids, vectors):
    n, dev, z, share = brute(vectors)
    by = {(r.vec_id, r.component): r for r in rows}
    assert len(rows) == len(by) == 4 * len(ids)
    for c in range(4):
        got = [by[i, c + 1] for i in ids]
        assert {r.n for r in got} == {n} and [r.deviation for r in got] == dev.tolist()
        w = np.array([r.whitened for r in got])
        sign = np.sign(w @ z[:, c])
        assert np.abs(sign * w - z[:, c]).max() < 1e-8
        assert abs(got[0].explained / share[c] - 1) < 1e-10 and len({r.explained for r in got}) == 1
    assert len({r.identity_error for r in rows}) == 1 and rows[0].identity_error < 1e-9


def test_query_against_numpy(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    good = [r for r in rows if r.embedding is not None and all(c is not None and np.isfinite(c) for c in r.embedding)]
    against(queries.op13_whitening(spark, SF).collect(), [r.vec_id for r in good], [r.embedding for r in good])


def test_edge_rows(spark):
    rng = np.random.default_rng(3)
    good = (rng.normal(size=(60, 6)) * [3, 2.5, 2, 1.5, 1, 0.01]).tolist()
    good[7] = good[8] = [-0.0, 0.0, -1e-9, 0.5, 1.0, 2.0]
    bad = [None, [], [1.0, None, 0.0, 0.0, 0.0, 0.0], [float("nan")] + [0.0] * 5, [float("inf")] + [0.0] * 5, [1.0, 2.0]]
    rows = [(i, v, 1) for i, v in enumerate(good)] + [(100 + i, v, 2) for i, v in enumerate(bad)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>, n int").selectExpr("*", "1 as _x", "2 as component")
    against(whitening.whiten(vectors).collect(), list(range(60)), good)
    assert whitening.whiten(vectors.where("vec_id >= 100 and vec_id < 105")).count() == 0
    assert whitening.whiten(vectors.where("vec_id = 3")).count() == 0  # one vector: no component
    assert whitening.whiten(vectors.select("vec_id")).count() == 0
    few = whitening.whiten(vectors.where("vec_id in (7, 8, 9)")).collect()  # two distinct vectors: rank 1
    assert sorted((r.vec_id, r.component, r.n, round(abs(r.whitened), 9)) for r in few) == [(7, 1, 2, 1.0), (8, 1, 2, 1.0), (9, 1, 2, 1.0)]
    nulls = whitening.whiten(vectors.selectExpr("cast(null as long) as vec_id", "embedding"))
    assert nulls.where("vec_id is null").count() == 240
    large = whitening.whiten(spark.createDataFrame([(0, [2.0**40, 0.0]), (1, [0.0, 1.0])], "vec_id long, embedding array<double>")).collect()
    assert [r.deviation for r in large] == [None, None]


@pytest.mark.parametrize("seed", range(6))
def test_eigen_against_numpy(seed):
    rng = np.random.default_rng(seed)
    d, rank = int(rng.integers(1, 40)), int(rng.integers(1, 40))
    a = rng.normal(size=(d, rank)) * np.exp(rng.normal(size=rank) * 2)
    s = a @ a.T
    values, comps = whitening.eigen(s)
    assert len(values) <= min(d, rank)
    assert np.allclose(comps.T @ comps, np.eye(len(values)), atol=1e-12)
    assert np.allclose((comps * values) @ comps.T, s, atol=1e-12 * np.trace(s))
    assert np.allclose(values, np.linalg.eigvalsh(s)[::-1][: len(values)], atol=1e-12 * np.trace(s))


def test_small_eigenvalues_keep_their_digits():
    """A graded matrix whose smallest eigenvalue lies far below the rounding of its largest."""
    low = np.tril(np.ones((5, 5))) * np.array([1e6, 1e3, 1.0, 1e-3, 1e-6])
    u, norms = whitening.one_sided_jacobi(low)
    assert abs(np.prod(norms) - 1) < 1e-12 and np.allclose(u.T @ u, np.eye(5), atol=1e-13)
    assert len(whitening.eigen(np.zeros((3, 3)))[0]) == 0
