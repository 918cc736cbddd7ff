"""Whitening of embeddings by principal components of an exact integer grid.

Entries become integers x = floor(64 c) + 1 000 000, so that counts, sums and
deviations are exact and equal vectors are equal rows. The components are fitted
on the distinct vectors: one pass gives n and the sums per dimension, a second
the covariance of the centred vectors, one partial matrix per task. The d x d
matrix (its size depends on the dimension alone) is reduced to tridiagonal form by
Householder reflections, its leading eigenvalues are found by bisection with Sturm
counts, their vectors by inverse iteration, reorthogonalised inside clusters of
close eigenvalues. The projection, d x 16 numbers, travels with the tasks.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from remitlens.llm.store import pinned, prepare

SCALE = 64
SHIFT = 1_000_000
_EPS = np.finfo(float).eps
#: An eigenvalue below this share of the largest, times the dimension, has no four certain digits left.
_CERTAIN = 1e4 * _EPS


# --- eigenvectors of a symmetric matrix ---------------------------------------------------------


def tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(diagonal, off-diagonal, reflections): T = H V H with H the product of the reflections I - 2 w w'."""
    a = np.array(matrix, float)
    n = len(a)
    reflections: list[np.ndarray] = []
    for k in range(n - 2):
        column = a[k + 1 :, k]
        scale = np.abs(column[1:]).max()
        w = np.zeros(n - k - 1)
        if scale > 0:
            top = max(scale, abs(column[0]))
            w = column / top
            w[0] += np.copysign(np.linalg.norm(w), w[0])
            w /= np.linalg.norm(w)
            rest = a[k + 1 :, k + 1 :]
            p = rest @ w
            q = 2 * (p - (w @ p) * w)
            rest -= np.outer(w, q) + np.outer(q, w)
            column -= 2 * (w @ column) * w
            a[k, k + 1 :] = column
        reflections.append(w)
    return np.diag(a).copy(), np.diag(a, -1).copy(), reflections


def reflect_back(vectors: np.ndarray, reflections: list[np.ndarray]) -> np.ndarray:
    """Eigenvectors (columns) of T as those of the matrix that T was made from."""
    out = vectors.copy()
    for k in range(len(reflections) - 1, -1, -1):
        w = reflections[k]
        out[k + 1 :] -= 2 * np.outer(w, w @ out[k + 1 :])
    return out


def sturm_counts(diagonal: np.ndarray, off: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Number of eigenvalues of T below each value of ``at``: negative terms of the Sturm sequence."""
    tiny = np.finfo(float).tiny * 1e16
    floor = max(tiny, _EPS * float(np.abs(off).max(initial=0)) ** 2 * _EPS)
    q = diagonal[0] - at
    count = (q < 0).astype(np.int64)
    for d, b in zip(diagonal[1:], off):
        q = np.where(np.abs(q) < floor, -floor, q)
        q = d - at - b * b / q
        count += q < 0
    return count


def leading_eigenvalues(diagonal: np.ndarray, off: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` largest eigenvalues of T, falling, each bisected until no double lies between its bounds."""
    n = len(diagonal)
    reach = np.concatenate([[0], np.abs(off)]) + np.concatenate([np.abs(off), [0]])
    slack = 2 * _EPS * float((np.abs(diagonal) + reach).max()) + np.finfo(float).tiny
    low = np.full(k, float((diagonal - reach).min()) - slack)
    high = np.full(k, float((diagonal + reach).max()) + slack)
    wanted = n - np.arange(k)  # the j-th largest is the first value with so many eigenvalues not above it
    while True:
        middle = low + (high - low) / 2
        open_ = (middle > low) & (middle < high)
        if not open_.any():
            return np.where(np.isfinite(high), high, low)
        below = sturm_counts(diagonal, off, middle) >= wanted
        high, low = np.where(open_ & below, middle, high), np.where(open_ & ~below, middle, low)


def _solve(diagonal: np.ndarray, off: np.ndarray, shift: float, y: np.ndarray, least: float) -> np.ndarray:
    """(T - shift I) x = y by elimination with row exchanges; pivots of at least ``least``."""
    n = len(diagonal)
    d, upper, second, y = diagonal - shift, np.append(off, 0.0), np.zeros(n), y.copy()
    for i in range(n - 1):
        b = off[i]
        if abs(b) > abs(d[i]):  # exchange rows i and i + 1
            factor = d[i] / b
            d[i], d[i + 1], upper[i], second[i] = b, upper[i] - factor * d[i + 1], d[i + 1], upper[i + 1]
            upper[i + 1] = -factor * second[i]
            y[i], y[i + 1] = y[i + 1], y[i] - factor * y[i + 1]
        else:
            d[i] = d[i] if abs(d[i]) > least else np.copysign(least, d[i])
            factor = b / d[i]
            d[i + 1] -= factor * upper[i]
            y[i + 1] -= factor * y[i]
    d[-1] = d[-1] if abs(d[-1]) > least else np.copysign(least, d[-1])
    x = np.zeros(n)
    for i in range(n - 1, -1, -1):
        x[i] = (y[i] - (upper[i] * x[i + 1] if i + 1 < n else 0) - (second[i] * x[i + 2] if i + 2 < n else 0)) / d[i]
    return x


def inverse_iteration(diagonal: np.ndarray, off: np.ndarray, values: np.ndarray, steps: int = 5) -> np.ndarray:
    """Unit eigenvectors (columns) of T for falling ``values``; those of one cluster are kept orthogonal."""
    n = len(diagonal)
    norm = float((np.abs(diagonal) + np.concatenate([[0], np.abs(off)]) + np.concatenate([np.abs(off), [0]])).max())
    least = max(_EPS * norm, np.finfo(float).tiny)
    random = np.random.default_rng(11)
    out = np.zeros((n, len(values)))
    first = 0
    shift = np.inf
    for j, value in enumerate(values):
        if j and values[j - 1] - value > 1e-3 * norm:
            first = j  # a new cluster
        shift = min(value, shift - 10 * least) if j > first else value
        x = random.standard_normal(n)
        for _ in range(steps):
            x /= np.abs(x).max()
            x = _solve(diagonal, off, shift, x, least)
            x /= np.linalg.norm(x)
            for _ in range(2):
                x -= out[:, first:j] @ (out[:, first:j].T @ x)
            x /= np.linalg.norm(x)
        out[:, j] = x
    return out


def leading_eigenvectors(matrix: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(values, unit vectors as columns) of the ``k`` largest eigenvalues of a symmetric matrix, falling."""
    k = min(k, len(matrix))
    scale = float(np.abs(matrix).max(initial=0))
    if k == 0 or scale == 0:
        return np.zeros(k), np.eye(len(matrix), k)
    diagonal, off, reflections = tridiagonal(matrix / scale)
    values = leading_eigenvalues(diagonal, off, k)
    vectors = reflect_back(inverse_iteration(diagonal, off, values), reflections)
    return values * scale, vectors


# --- distributed fit ----------------------------------------------------------------------------


@dataclass
class Whitening:
    """Fitted components: ``sums`` per dimension over ``n`` distinct vectors, ``values`` and ``vectors``."""

    n: int
    sums: list[int]
    trace: float
    values: np.ndarray
    vectors: np.ndarray
    identity_error: float = 0.0

    @property
    def dimension(self) -> int:
        return len(self.sums)


def _grid(vector: Column) -> Column:
    return F.transform(vector, lambda c: F.floor(c.cast("double") * SCALE) + F.lit(SHIFT))


def _usable(vector: Column) -> Column:
    """Vectors whose entries are all there, finite and small enough for a long x."""
    bad = F.exists(vector, lambda c: c.isNull() | F.isnan(c) | (F.abs(c.cast("double")) >= F.lit(2.0**56)))
    return F.coalesce(~bad & (F.size(vector) > 0), F.lit(False))


def _matrix(column: pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0), np.int64)


class _Centre:
    """n * x - S without overflow: x relative to floor(S / n), the remainder apart."""

    def __init__(self, n: int, sums: list[int]):
        self.n = n
        self.whole = np.array([s // n for s in sums], np.int64)
        self.rest = np.array([s % n for s in sums], np.int64)

    def _near(self, x: np.ndarray) -> np.ndarray:
        return x - self.whole

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S / n in double, rounded once."""
        z = self._near(x)
        if np.abs(z).max(initial=0) < (1 << 62) // self.n:
            return (z * self.n - self.rest) / self.n
        return np.array([[(a * self.n - b) / self.n for a, b in zip(row, self.rest.tolist())] for row in z.tolist()])

    def deviations(self, x: np.ndarray) -> list[int]:
        """Sum over dimensions of (n x - S)^2 as exact integers."""
        z, n, rest = self._near(x), self.n, [int(r) for r in self.rest]
        most = int(np.abs(z).max(initial=0))
        if most**2 * z.shape[1] < 1 << 62 and most * n * z.shape[1] < 1 << 62:
            squares, mixed = (z * z).sum(1).tolist(), (z * self.rest).sum(1).tolist()
            constant = sum(r * r for r in rest)
            return [n * n * a - 2 * n * b + constant for a, b in zip(squares, mixed)]
        return [sum((n * a - b) ** 2 for a, b in zip(row, rest)) for row in z.tolist()]


def _summed(fit: DataFrame, centre: _Centre, projection: np.ndarray | None = None) -> np.ndarray:
    """Sum of the outer products of the centred (and projected) vectors, symmetric; one partial matrix per task.

    A last row and column hold the sums of the vectors themselves.
    """
    size = 1 + (len(centre.rest) if projection is None else projection.shape[1])

    def run(batches):
        total = np.zeros((size, size))
        for batch in batches:
            x = _matrix(batch.column(0))
            for at in range(0, len(x), 4096):
                y = centre.centred(x[at : at + 4096])
                y = y if projection is None else y @ projection
                y = np.hstack([y, np.ones((len(y), 1))])
                total += y.T @ y
        i, j = np.triu_indices(size)
        yield pa.RecordBatch.from_arrays(
            [pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total[i, j])], names=["i", "j", "v"]
        )

    out = np.zeros((size, size))
    # (size + 1) * size / 2 rows, whatever the number of vectors
    for r in fit.mapInArrow(run, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
        out[r.i, r.j] = out[r.j, r.i] = r.v
    return out


def _covariance(fit: DataFrame, centre: _Centre, projection: np.ndarray | None = None) -> np.ndarray:
    """Covariance over the fit list, divisor n. The mean that is left after centring (rounding) is taken out too."""
    total = _summed(fit, centre, projection)
    mean = total[-1, :-1] / centre.n
    return total[:-1, :-1] / centre.n - np.outer(mean, mean)


def fit_whitening(vectors: DataFrame, column: str = "embedding", components: int = 16) -> Whitening:
    """Components of the distinct grid vectors of ``vectors``; see ``whiten`` for the cases."""
    prepare(vectors.sparkSession)
    grid = vectors.where(_usable(F.col(column))).select(_grid(F.col(column)).alias("x"))
    distinct = pinned(grid.groupBy("x").count().select("x"), "whitening-fit")
    sizes = distinct.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n"))
    best = sizes.orderBy(F.desc("n"), F.desc("d")).first()
    if best is None:
        return Whitening(0, [], 0.0, np.zeros(0), np.zeros((0, 0)))
    n, d = best.n, best.d
    fit = distinct.where(F.size("x") == d)
    entries = fit.select(F.posexplode("x").alias("i", "x")).groupBy("i").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("s"))
    sums = [0] * d
    for r in entries.collect():  # one row per dimension
        sums[r.i] = int(r.s)
    centre = _Centre(n, sums)
    v = _covariance(fit, centre)
    values, axes = leading_eigenvectors(v, components)
    certain = int((values > d * _CERTAIN * max(values.max(initial=0), 0)).sum())
    values, axes = values[:certain], axes[:, :certain]
    model = Whitening(n, sums, float(np.trace(v)), values, axes)
    if certain:
        own = _covariance(fit, centre, axes / np.sqrt(values))
        model.identity_error = float(np.abs(own - np.eye(certain)).max())
    return model


def whiten(vectors: DataFrame, model: Whitening, column: str = "embedding") -> DataFrame:
    """``vectors`` with ``deviation`` (decimal digits), ``deviation_long`` and ``whitened`` (array of doubles).

    Defined cases: a vector that is null or empty, that holds a null, NaN or
    infinite entry or one beyond 2^56 in magnitude (it has no long x), and one whose
    length is not the most common one of the fit list (ties: the longer) are left
    out. Repeated rows each stay. ``deviation_long`` is null where the exact value
    exceeds a long. Directions whose variance is zero, or too small beside the
    largest to be told from rounding, can't be whitened and give no component, so
    equal vectors alone, one vector or an empty table give none. Columns of
    ``vectors`` with the names of the new ones are replaced; all others pass through.
    """
    prepare(vectors.sparkSession)
    new = ("deviation", "deviation_long", "whitened")
    base = vectors.drop(*new)
    kept = base.where(_usable(F.col(column)) & (F.size(column) == model.dimension)).withColumn("whitened", _grid(F.col(column)))
    centre = _Centre(model.n, model.sums) if model.n else None
    projection = model.vectors / np.sqrt(model.values) if model.n else None

    def run(batches):
        for batch in batches:
            x = _matrix(batch.column(batch.num_columns - 1))
            if not len(x):
                continue
            exact = centre.deviations(x)
            y = centre.centred(x) @ projection
            offsets = pa.array(np.arange(0, y.size + 1, y.shape[1] or 1, dtype=np.int32)[: len(y) + 1] if y.size else np.zeros(len(y) + 1, np.int32))
            lists = pa.ListArray.from_arrays(offsets, pa.array(y.ravel()))
            longs = pa.array([e if e < 1 << 63 else None for e in exact], pa.int64())
            columns = [*batch.columns[:-1], pa.array([str(e) for e in exact], pa.string()), longs, lists]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[:-1], *new])

    if centre is None:
        none = kept.where("false")
        return none.select(*base.columns, F.lit("").alias("deviation"), F.lit(0).cast("long").alias("deviation_long"), F.array().cast("array<double>").alias("whitened"))
    ddl = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in base.schema.fields)
    return kept.mapInArrow(run, f"{ddl}deviation string, deviation_long long, whitened array<double>")


def components(model: Whitening, whitened: DataFrame, key: str = "vec_id") -> DataFrame:
    """One row per vector and component, with the measures of the fit."""
    shares = F.array(*[F.lit(float(e / model.trace)) for e in model.values]).cast("array<double>")
    rows = whitened.select(key, "deviation", "deviation_long", F.posexplode("whitened").alias("place", "whitened"))
    return rows.select(
        key, (F.col("place") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), F.col("deviation_long").alias("deviation"),
        "whitened", shares[F.col("place")].alias("explained"), F.lit(model.identity_error).alias("identity_error"),
        F.col("deviation").alias("deviation_digits"),
    )
