"""Embedding whitening by a bidiagonal qd solver.

Vectors become integers (floor of 256 times an entry). The *fit list* holds
every distinct vector once; its covariance V = C'C / n is never formed:

1. every task reduces its centred rows C block by block to one triangle R
   (QR of the former triangle over the next block); the triangles of
   `FAN_IN` tasks at a time are stacked and reduced again until one is left,
   which then is a triangle of all centred rows (one d x d matrix a task moves);
2. R is brought to bidiagonal form by Householder reflections;
3. dqds with a shift that cannot pass the smallest value (the reciprocal of the
   sum of the reciprocals of the last transform) gives all singular values to
   high relative accuracy;
4. twisted factorisations of the tridiagonal B'B give the vectors of the first
   values, close ones kept orthogonal, and the reflections carry them back.

Only d x d numbers reach the driver, whatever the number of rows.

Defined results: null vectors and vectors with null or non-finite entries take
no part; of several lengths the commonest (of equally common ones the longest)
is fitted and the rows of other lengths take no part either; repeated rows each
get their rows, and count once in the fit; a null vec_id stays null; other
columns are ignored. Directions without variance (fewer distinct vectors or
dimensions than components) have no row, so a table of one distinct vector, or
an empty one, gives an empty result. A deviation beyond a long is null; entries
beyond a long after scaling are held at its ends, as Spark's FLOOR does.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from funnelkit.llm.common import saved

SCALE = 256.0
COMPONENTS = 4
BLOCK_ROWS = 2048
FAN_IN = 32
EPS = float(np.finfo(float).eps)

OUTPUT = ("vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double,"
          " identity_error double")


# ------------------------------------------------------------- the qd solver

def bidiagonal(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray | None]]:
    """Householder: (diagonal, superdiagonal, right reflectors) of a square matrix; r = U B V'."""
    a = np.array(r, float)
    d = a.shape[0]
    right: list[np.ndarray | None] = []
    for k in range(d):
        u = _reflector(a[k:, k])
        if u is not None:
            a[k:, k:] -= 2.0 * np.outer(u, u @ a[k:, k:])
        u = _reflector(a[k, k + 1:]) if k < d - 2 else None
        if u is not None:
            a[k:, k + 1:] -= 2.0 * np.outer(a[k:, k + 1:] @ u, u)
        right.append(u)
    return np.diag(a).copy(), np.diag(a, 1).copy(), right


def _reflector(x: np.ndarray) -> np.ndarray | None:
    """Unit u such that x - 2 u (u'x) has only its first entry; None if that already holds."""
    if len(x) < 2 or not np.any(x[1:]):
        return None
    u = x.copy()
    u[0] += np.copysign(np.linalg.norm(x), x[0])
    return u / np.linalg.norm(u)


def _transform(q: list[float], e: list[float], shift: float) -> tuple[list[float], list[float], list[float]]:
    """One differential qd step with a shift: new q, new e and the d values on the way."""
    d = q[0] - shift
    qs, es, ds = [], [], [d]
    for i in range(len(e)):
        s = d + e[i]
        if s == 0.0:
            qs.append(0.0), es.append(0.0)
            d = q[i + 1] - shift
        else:
            t = q[i + 1] / s
            qs.append(s), es.append(e[i] * t)
            d = d * t - shift
        ds.append(d)
    qs.append(d)
    return qs, es, ds


def dqds(diagonal: np.ndarray, superdiagonal: np.ndarray) -> np.ndarray:
    """Squared singular values of an upper bidiagonal matrix, largest first.

    A step without shift gives d values whose reciprocals sum to the trace of
    the inverse; the reciprocal of that sum never exceeds the smallest value,
    so the next step shifts by it and stays positive. Negligible couplings
    split the matrix; a shift that rounding makes too large is not taken.
    """
    done: list[float] = []
    small = (10.0 * EPS) ** 2
    todo = [([float(x) ** 2 for x in diagonal], [float(x) ** 2 for x in superdiagonal], 0.0, 0.0)]
    while todo:
        q, e, sigma, low = todo.pop()
        if not q:
            continue
        while len(q) > 1:
            cut = next((i for i in range(len(e) - 1, -1, -1) if e[i] <= small * (sigma + min(q[i], q[i + 1]))), None)
            if cut is not None:
                todo.append((q[:cut + 1], e[:cut], sigma, low))
                q, e = q[cut + 1:], e[cut + 1:]
                continue
            if q[0] < q[-1]:  # graded the right way round, small values leave at the end
                q, e = q[::-1], e[::-1]
            q, e, ds = _transform(q, e, 0.0)
            if min(ds) <= 0.0:
                continue
            shift = (1.0 - 4.0 * EPS * len(q)) / sum(1.0 / d for d in ds)
            shifted = _transform(q, e, shift)
            if min(shifted[2]) < 0.0:
                continue
            q, e = shifted[0], shifted[1]
            total = sigma + shift  # compensated: what is rounded off is kept apart
            low += (sigma - total) + shift
            sigma = total
        done.append(sigma + (low + q[0]))
    return np.sort(np.maximum(np.array(done), 0.0))[::-1]


def twisted_vectors(diagonal: np.ndarray, superdiagonal: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Unit eigenvectors of B'B for the given eigenvalues (falling), as columns.

    Factorises T - value from the top and from the bottom; where both meet with
    the smallest residual the vector is 1 and grows outwards. Of values closer
    than 1e-5 (relative) the vectors are made orthogonal, the meeting point
    being the best one that leaves enough of the vector.
    """
    d = len(diagonal)
    main = diagonal ** 2
    main[1:] += superdiagonal ** 2
    off = diagonal[:-1] * superdiagonal
    tiny = EPS * max(float(np.max(np.abs(main))), 1e-300)
    out = np.zeros((d, len(values)))
    for j, value in enumerate(values):
        down, up = main - value, main - value
        for i in range(d - 1):
            down[i] = down[i] if abs(down[i]) > tiny * EPS else tiny * EPS
            down[i + 1] -= off[i] ** 2 / down[i]
        for i in range(d - 2, -1, -1):
            up[i + 1] = up[i + 1] if abs(up[i + 1]) > tiny * EPS else tiny * EPS
            up[i] -= off[i] ** 2 / up[i + 1]
        meet = np.abs(down + up - (main - value))
        near = [i for i in range(j) if abs(values[i] - value) <= 1e-5 * values[0]]
        best, kept = None, -1.0
        for k in np.argsort(meet, kind="stable"):
            z = np.zeros(d)
            z[k] = 1.0
            for i in range(k - 1, -1, -1):
                z[i] = -off[i] / down[i] * z[i + 1]
            for i in range(k, d - 1):
                z[i + 1] = -off[i] / up[i + 1] * z[i]
            z /= np.linalg.norm(z)
            for _ in range(2):
                for i in near:
                    z -= out[:, i] * (out[:, i] @ z)
            left = float(np.linalg.norm(z))
            if left > kept:
                best, kept = z / max(left, 1e-300), left
            if left >= 0.5 or not near:
                break
        out[:, j] = best
    return out


def principal(r: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray, float]:
    """(squared singular values, right singular vectors as columns) of the first `count` directions with variance, sum of all squares."""
    top = float(np.max(np.abs(r))) if r.size else 0.0
    if top == 0.0 or not np.isfinite(top):
        return np.zeros(0), np.zeros((r.shape[0], 0)), 0.0
    diagonal, superdiagonal, right = bidiagonal(r / top)
    values = dqds(diagonal, superdiagonal)
    rank = int(np.sum(values > (values[0] * (len(values) * EPS) ** 2)))
    chosen = values[:min(count, rank)]
    z = twisted_vectors(diagonal, superdiagonal, chosen)
    for k in range(len(right) - 1, -1, -1):
        if (u := right[k]) is not None:
            z[k + 1:] -= 2.0 * np.outer(u, u @ z[k + 1:])
    return chosen * top ** 2, z / np.linalg.norm(z, axis=0), float(np.sum(values)) * top ** 2


# ------------------------------------------------------------- Spark side

@dataclass(frozen=True)
class Whitening:
    """What every task needs: bounded by the dimension alone."""

    n: int
    sums: tuple[int, ...]
    directions: np.ndarray  # d x k, already divided by sqrt(eigenvalue)
    explained: tuple[float, ...]
    identity_error: float


def integer_vectors(vectors: DataFrame, *others: str) -> DataFrame:
    """(vec_id, others, x): the usable rows with floor(256 * entry) as longs."""
    entry = F.col("embedding")
    usable = F.forall(entry, lambda c: F.abs(c.cast("double")) < F.lit(float("inf")))  # NaN sorts above infinity
    return vectors.where(usable & (F.size(entry) > 0)).select(
        F.col("vec_id").cast("bigint").alias("vec_id"), *others,
        F.transform(entry, lambda c: F.floor(F.lit(SCALE) * c.cast("double"))).alias("x"))


def _matrix(batch: pa.RecordBatch, d: int) -> np.ndarray:
    return batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _sum_partials(d: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, [0] * d
        for batch in batches:
            x = _matrix(batch, d)
            if not len(x):
                continue
            n += len(x)
            exact = x if int(np.max(np.abs(x.astype(float)))) < (1 << 62) // len(x) else x.astype(object)
            sums = [a + int(b) for a, b in zip(sums, exact.sum(axis=0))]
        if n:
            wide = pa.decimal128(38, 0)
            yield pa.record_batch({"dim": pa.array(range(d), pa.int32()), "n": pa.array([n] * d, pa.int64()),
                                   "s": pa.array([pa.scalar(s, wide).as_py() for s in sums], wide)})
    return run


def _centred(x: np.ndarray, n: int, sums: tuple[int, ...]) -> np.ndarray:
    """x - S/n: the whole part is taken off exactly, then the fraction."""
    whole = np.array([float(s // n) for s in sums])
    rest = np.array([(s % n) / n for s in sums])
    return (x.astype(float) - whole) - rest


def _triangles(n: int, sums: tuple[int, ...]):
    d = len(sums)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        r = np.zeros((0, d))
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                rows = _centred(_matrix(batch.slice(at, BLOCK_ROWS), d), n, sums)
                r = np.linalg.qr(np.vstack([r, rows]), mode="r")
        if len(r):
            yield pa.record_batch({"part": pa.array([TaskContext.get().partitionId()], pa.int64()),
                                   "r": pa.array([r.astype("<f8").tobytes()], pa.binary())})
    return run


def _merge_triangles(d: int):
    def run(rows):
        import pandas as pd

        parts = [np.frombuffer(b, "<f8").reshape(-1, d) for _, b in sorted(zip(rows["part"], rows["r"]))]
        r = np.linalg.qr(np.vstack(parts), mode="r")
        return pd.DataFrame({"part": [int(rows["part"].iloc[0]) // FAN_IN], "r": [r.astype("<f8").tobytes()]})
    return run


def triangle(fit: DataFrame, n: int, sums: tuple[int, ...]) -> np.ndarray:
    """The d x d triangle of all centred rows, reduced `FAN_IN` to one until one is left."""
    d = len(sums)
    level = saved(fit.mapInArrow(_triangles(n, sums), "part bigint, r binary"), "whitening-triangles")
    while level.count() > 1:
        merged = level.groupBy((F.floor(F.col("part") / FAN_IN)).alias("at")).applyInPandas(
            _merge_triangles(d), "part bigint, r binary")
        level = saved(merged, "whitening-triangles")
    r = np.frombuffer(level.first()["r"], "<f8").reshape(-1, d)
    return np.vstack([r, np.zeros((d - len(r), d))])


def _moments(n: int, sums: tuple[int, ...], directions: np.ndarray):
    d, k = directions.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, k))
        for batch in batches:
            y = _centred(_matrix(batch, d), n, sums) @ directions
            total += y.T @ y
        yield pa.record_batch({"cell": pa.array(range(k * k), pa.int32()), "s": pa.array(total.ravel(), pa.float64())})
    return run


def fit_whitening(x: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """Fit on the distinct vectors of `x` (see `integer_vectors`); None if no vector is left."""
    fit = saved(x.select("x").distinct(), "whitening-fit")
    length = fit.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if length is None:
        return None
    d = length["d"]
    fit = fit.where(F.size("x") == d)
    totals = (fit.mapInArrow(_sum_partials(d), "dim int, n bigint, s decimal(38,0)")
              .groupBy("dim").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).orderBy("dim").collect())
    n, sums = int(totals[0]["n"]), tuple(int(t["s"]) for t in totals)
    squares, vectors, trace = principal(triangle(fit, n, sums), components)
    directions = vectors / np.sqrt(squares / n)
    error = 0.0
    if k := len(squares):
        cells = (fit.mapInArrow(_moments(n, sums, directions), "cell int, s double")
                 .groupBy("cell").agg(F.sum("s").alias("s")).orderBy("cell").collect())
        covariance = np.array([c["s"] for c in cells]).reshape(k, k) / n
        error = float(np.max(np.abs(covariance - np.eye(k))))
    return Whitening(n, sums, directions, tuple(float(s / trace) for s in squares), error)


def deviations(x: np.ndarray, n: int, sums: tuple[int, ...]) -> list[int | None]:
    """Per row the sum of (n x - S)^2, exact; None if it is beyond a long."""
    d = len(sums)
    most = n * int(np.max(np.abs(x.astype(float)), initial=0.0)) + max(abs(s) for s in sums)
    if most * most * d < 1 << 62:
        return ((n * x - np.array(sums, np.int64)) ** 2).sum(axis=1).tolist()
    found = ((n * x.astype(object) - np.array(sums, object)) ** 2).sum(axis=1)
    return [int(v) if v < 1 << 63 else None for v in found]


def _apply(model: Whitening):
    d, k = model.directions.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch, d)
            rows = len(x)
            if not rows:
                continue
            y = _centred(x, model.n, model.sums) @ model.directions
            each = np.repeat(np.arange(rows), k)
            spread = np.array(deviations(x, model.n, model.sums), object)[each]
            yield pa.record_batch({
                "vec_id": batch.column("vec_id").take(pa.array(each)),
                "component": pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)),
                "n": pa.array(np.full(rows * k, model.n, np.int64)),
                "deviation": pa.array(spread.tolist(), pa.int64()),
                "whitened": pa.array(y.ravel()),
                "explained": pa.array(np.tile(np.array(model.explained), rows)),
                "identity_error": pa.array(np.full(rows * k, model.identity_error))})
    return run


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """One row a usable vector and component; see the module for every case."""
    x = integer_vectors(vectors)
    model = fit_whitening(x, components)
    if model is None or not model.explained:
        return vectors.sparkSession.createDataFrame([], OUTPUT)
    return x.where(F.size("x") == len(model.sums)).mapInArrow(_apply(model), OUTPUT)
