"""Embedding whitening: pivoted Cholesky of the centred scatter, one-sided Jacobi on the triangular factor.

Spark finds the distinct vectors, their count and sums, and the centred scatter, a row of the matrix in each group, added
up with ``math.fsum`` so that no order of arrival changes it. Only count, sums and the scatter (the square of the
dimension) reach the driver. There the scatter's pivoted Cholesky factor L (P'SP = LL') is turned from the right by
Jacobi rotations until its columns are orthogonal: LJ = UD. Then S = P U D^2 U' P': the squared column norms are the
eigenvalues and the normalised columns, in the old order of rows, the components. The scatter is never multiplied by
itself or by a rotation, so small eigenvalues keep their leading digits. Whitened rows are one pass over all vectors.
"""

from __future__ import annotations

import math
from collections import namedtuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ensure_columns, stored, without

Whitening = namedtuple("Whitening", "n sums mean components eigenvalues trace")
LIMIT = (1 << 63) - 1


def pivoted_cholesky(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(L, order) with ``s[order][:, order] == L @ L.T``: the largest remaining diagonal entry is the next pivot.

    L has a column for each pivot above the rounding of the largest: the rank of ``s``.
    """
    s = np.array(s, float)
    d = len(s)
    order, low, left = np.arange(d), np.zeros((d, d)), np.diagonal(s).copy()
    least = d * np.finfo(float).eps * max(left.max(initial=0.0), 0.0)
    for k in range(d):
        p = k + int(np.argmax(left[k:]))
        if not left[p] > least:
            return low[:, :k], order
        if p != k:
            for x in (left, order, low):
                x[[k, p]] = x[[p, k]]
            s[[k, p]] = s[[p, k]]
            s[:, [k, p]] = s[:, [p, k]]
        low[k, k] = math.sqrt(left[k])
        low[k + 1 :, k] = (s[k + 1 :, k] - low[k + 1 :, :k] @ low[k, :k]) / low[k, k]
        left[k + 1 :] -= low[k + 1 :, k] ** 2
    return low, order


def one_sided_jacobi(low: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """(U, norms): the columns of ``low`` rotated pairwise until all are orthogonal, normalised, by falling norm.

    A sweep meets every pair once, in rounds of disjoint pairs that are rotated together.
    """
    a = np.array(low, float).T.copy()  # a row for each column
    r, d = a.shape
    seats = np.arange(r + r % 2)
    half, tol = len(seats) // 2, max(d, 8) ** 0.5 * np.finfo(float).eps
    for _ in range(sweeps if r > 1 else 0):
        turned = False
        for _ in range(len(seats) - 1):
            i, j = np.minimum(seats[:half], seats[::-1][:half]), np.maximum(seats[:half], seats[::-1][:half])
            i, j = i[j < r], j[j < r]
            x, y = a[i], a[j]
            xx, yy, xy = (np.einsum("kd,kd->k", u, v) for u, v in ((x, x), (y, y), (x, y)))
            need = np.abs(xy) > tol * np.sqrt(xx * yy)
            if need.any():
                turned = True
                i, j, x, y, xx, yy, xy = (v[need] for v in (i, j, x, y, xx, yy, xy))
                zeta = (yy - xx) / (2 * xy)
                t = np.where(zeta < 0, -1.0, 1.0) / (np.abs(zeta) + np.hypot(1.0, zeta))
                c = 1 / np.hypot(1.0, t)
                c, s = c[:, None], (c * t)[:, None]
                a[i], a[j] = c * x - s * y, s * x + c * y
            seats[1:] = np.roll(seats[1:], 1)
        if not turned:
            break
    norms = np.sqrt(np.einsum("kd,kd->k", a, a))
    rank = np.argsort(-norms, kind="stable")
    return (a[rank] / norms[rank, None]).T, norms[rank]


def eigen(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, unit eigenvectors as columns) of a symmetric positive semi-definite matrix, by falling eigenvalue;
    as many as its rank."""
    low, order = pivoted_cholesky(s)
    u, norms = one_sided_jacobi(low)
    out = np.empty_like(u)
    out[order] = u
    return norms**2, out


def quantised(rows: DataFrame, vector_col: str, scale: int, dim: int | None) -> DataFrame:
    """``rows`` with ``_x``, the vector's entries as floor(scale * c) in a long's range; rows that cannot be whitened go."""
    v = F.col(vector_col)
    fine = F.coalesce(F.forall(v, lambda c: F.coalesce((c.cast("double") - c.cast("double")) == 0, F.lit(False))), F.lit(False))
    rows = rows.where(fine & (F.size(v) > 0))
    if dim is None:
        # The most frequent length, the smaller one of two: a row for each length comes back at most.
        top = rows.groupBy(F.size(v).alias("d")).count().orderBy(F.desc("count"), "d").first()
        dim = top["d"] if top else 0
    return rows.where(F.size(v) == dim).withColumn("_x", F.transform(v, lambda c: F.floor(c.cast("double") * scale).cast("long")))


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """A batch's vectors as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def summed(parts: DataFrame) -> dict[int, list[float]]:
    """Rows (i, row) of partial matrices added up by i, each entry rounded once whatever the order."""

    def add(table: pa.Table) -> pa.Table:
        m = np.array(table["row"].to_pylist())
        total = [math.fsum(c) for c in m.T.tolist()]
        return pa.table({"i": table["i"][:1], "row": pa.array([total], pa.list_(pa.float64()))})

    return {r["i"]: r["row"] for r in parts.groupBy("i").applyInArrow(add, "i int, row array<double>").collect()}  # a row for each dimension


def scatter(distinct: DataFrame, mean: np.ndarray) -> np.ndarray:
    """The sum of (x - mean)(x - mean)' over ``distinct`` (_x)."""

    def run(batches):
        total = np.zeros((len(mean), len(mean)))
        for batch in batches:
            y = matrix(batch.column(0), len(mean)) - mean
            total += y.T @ y
        yield pa.RecordBatch.from_pydict({"i": pa.array(range(len(mean)), pa.int32()), "row": pa.array(total.tolist(), pa.list_(pa.float64()))})

    rows = summed(distinct.select("_x").mapInArrow(run, "i int, row array<double>"))
    return np.array([rows[i] for i in range(len(mean))])


def fit(distinct: DataFrame) -> Whitening | None:
    """Count, sums, mean, components (columns), eigenvalues and trace of the fit list ``distinct`` (_x), a stored table.

    None where it is empty. A covariance of rank r has r components.
    """
    totals = distinct.select(F.posexplode("_x").alias("i", "v")).groupBy("i").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("s"), F.count("*").alias("n")).collect()
    if not totals:  # a row for each dimension
        return None
    totals.sort(key=lambda r: r["i"])
    n, sums = totals[0]["n"], [int(r["s"]) for r in totals]
    mean = np.array([s / n for s in sums])
    cov = scatter(distinct, mean) / n
    values, comps = eigen(cov)
    return Whitening(n, sums, mean, comps, values, float(np.trace(cov)))


def identity_error(distinct: DataFrame, model: Whitening, most: int) -> float:
    """The largest absolute entry of the whitened fit list's covariance minus the identity, both passes in Spark."""
    k = min(most, len(model.eigenvalues))
    if not k:
        return 0.0
    project = (model.components[:, :k] / np.sqrt(model.eigenvalues[:k])).copy()
    centre = model.mean

    def means(batches):
        total = np.zeros(k)
        for batch in batches:
            total += ((matrix(batch.column(0), len(centre)) - centre) @ project).sum(axis=0)
        yield pa.RecordBatch.from_pydict({"i": pa.array([0], pa.int32()), "row": pa.array([total.tolist()], pa.list_(pa.float64()))})

    mean = np.array(summed(distinct.select("_x").mapInArrow(means, "i int, row array<double>"))[0]) / model.n

    def products(batches):
        total = np.zeros((k, k))
        for batch in batches:
            z = (matrix(batch.column(0), len(centre)) - centre) @ project - mean
            total += z.T @ z
        yield pa.RecordBatch.from_pydict({"i": pa.array(range(k), pa.int32()), "row": pa.array(total.tolist(), pa.list_(pa.float64()))})

    rows = summed(distinct.select("_x").mapInArrow(products, "i int, row array<double>"))
    return float(np.abs(np.array([rows[i] for i in range(k)]) / model.n - np.eye(k)).max())


def whiten(
    rows: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", components: int = 4, scale: int = 256, dim: int | None = None
) -> DataFrame:
    """A row for each vector and component (1 to ``components``): id, component, n, deviation, whitened, explained,
    identity_error.

    Entries are quantised to x = floor(scale * c). The fit list holds each distinct x once: n of them, with sums S.
    ``deviation`` is the exact sum of (n * x - S)^2, null if it does not fit a long; ``whitened`` is x - S/n on the
    component over the root of its eigenvalue; ``explained`` the eigenvalue's share of the trace; ``identity_error`` the
    largest entry by which the whitened fit list's covariance departs from the identity.

    Vectors that are null or empty, hold null or non-finite entries, or differ in length from the most frequent length
    (or from ``dim``) have no rows. Repeated rows each have theirs, null ids stay null. Where all vectors are equal there
    is no component, and where the covariance's rank is smaller than ``components`` there are as many as its rank. A
    missing column counts as nulls, other columns of ``rows`` do not matter. An empty table gives no rows.
    """
    rows = ensure_columns(rows, **{id_col: "long", vector_col: "array<double>"})
    rows = rows.select(F.col(id_col).alias("_id"), F.col(vector_col).alias("_v"))
    known = stored(without(quantised(rows, "_v", scale, dim), "_v"), "whitening-rows")
    distinct = stored(known.select("_x").distinct(), "whitening-vectors")
    model = fit(distinct)
    kind = known.schema["_id"].dataType.simpleString()
    schema = f"{id_col} {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if model is None:
        return known.sparkSession.createDataFrame([], schema)
    error = identity_error(distinct, model, components)
    k = min(components, len(model.eigenvalues))
    project = (model.components[:, :k] / np.sqrt(model.eigenvalues[:k])).copy()
    n, sums, centre, shares = model.n, model.sums, model.mean, (model.eigenvalues[:k] / model.trace).tolist()
    top = max(map(abs, sums))

    def run(batches):
        s = np.array(sums, object)
        for batch in batches:
            if not batch.num_rows or not k:
                continue
            x, m = matrix(batch.column(1), len(s)), batch.num_rows
            far = n * max(abs(int(x.max())), abs(int(x.min()))) + top
            if len(s) * far**2 <= LIMIT:
                away = x * n - s.astype(np.int64)
                dev = np.einsum("kd,kd->k", away, away).tolist()
            else:  # in Python's own integers, of any length
                dev = [v if v <= LIMIT else None for v in ((x.astype(object) * n - s) ** 2).sum(axis=1).tolist()]
            z = (x - centre) @ project
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(np.repeat(np.arange(m), k))),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n, np.int64)),
                    pa.array([v for v in dev for _ in range(k)], pa.int64()), pa.array(z.reshape(-1)),
                    pa.array(np.tile(np.array(shares), m)), pa.array(np.full(m * k, error)),
                ],
                [c.split()[0] for c in ("id", "component", "n", "deviation", "whitened", "explained", "identity_error")],
            )

    out_schema = schema.replace(f"{id_col} {kind}", f"id {kind}", 1)
    return known.select("_id", "_x").mapInArrow(run, out_schema).withColumnRenamed("id", id_col)
