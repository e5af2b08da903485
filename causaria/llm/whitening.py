"""Embedding whitening: an exact centred scatter from all tasks, cyclic Jacobi on the driver, the whitening matrix broadcast.

Entries are made whole numbers first (floor(scale * c) + offset), so that
counts, sums and the scatter are exact and don't depend on how rows are dealt
out. The scatter is taken about the rounded mean; what rounding left is put
right on the driver in whole numbers, and each covariance is rounded once.

Rows whose vector is null, empty, or holds null or non-finite entries are
dropped, as are those with an entry whose whole number is 2^62 or more, and
those of another length than most vectors have (the shorter at a tie). Equal
vectors and repeated ids count and are returned as often as they occur. A
component without variance has no whitened value (null). No vectors give no
rows. The driver holds matrices of dims x dims, whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import only

SCALE, OFFSET, COMPONENTS = 1024, 100_000, 8

#: Whole numbers up to here; differences of two fit a long.
LARGEST = 2**62

#: An off-diagonal entry this small against its two diagonal ones counts as vanished.
VANISHED = 2.0**-52

MAX_SWEEPS = 100

_LIMB = 2**60


@dataclass(frozen=True)
class Fit:
    """What whitening needs of the fit list: count, sums, the rounded mean, eigenvalues falling, eigenvectors as rows, the trace."""

    n: int
    sums: list[int]
    centre: np.ndarray
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    scale: int
    offset: int

    @property
    def dims(self) -> int:
        return len(self.sums)

    def rank(self) -> int:
        """Components whose variance is told apart from rounding."""
        return int((self.values > VANISHED * self.dims * self.values[0]).sum()) if self.n and self.values[0] > 0 else 0


def usable(column: Column, scale: int = SCALE, offset: int = OFFSET) -> Column:
    """Whether a vector has entries, all of them finite and small enough."""
    fits = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double") * F.lit(float(scale)) + F.lit(float(offset))) < float(LARGEST))
    return column.isNotNull() & (F.size(column) > 0) & F.forall(column, fits)


def whole(vectors: np.ndarray, scale: int, offset: int) -> np.ndarray:
    return np.floor(vectors * scale).astype(np.int64) + offset


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, dims)


def _exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b for whole numbers, exact whatever their size; as Python's own numbers."""
    bound = int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) * a.shape[-1]
    if bound < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64)).astype(np.int64).astype(object)
    if bound < 2**63:
        return (a @ b).astype(object)
    return a.astype(object) @ b.astype(object)


def _limbs(i: list[int], j: list[int], totals: list[int]) -> pa.RecordBatch:
    """Rows of (i, j, high, low), the total being high * 2^60 + low, in decimals."""
    parts = [divmod(int(t), _LIMB) for t in totals]
    kind = pa.decimal128(38, 0)
    return pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array([Decimal(h) for h, _ in parts], kind), pa.array([Decimal(x) for _, x in parts], kind)], ["i", "j", "high", "low"])


def _totals(df: DataFrame, run) -> dict[tuple[int, int], int]:
    """Exact totals of what tasks found for each (i, j): at most dims x dims of them."""
    found = df.mapInArrow(run, "i int, j int, high decimal(38,0), low decimal(38,0)").groupBy("i", "j").agg(F.sum("high").alias("high"), F.sum("low").alias("low"))
    return {(r.i, r.j): int(r.high) * _LIMB + int(r.low) for r in found.collect()}


def fit(df: DataFrame, column: str = "embedding", scale: int = SCALE, offset: int = OFFSET) -> Fit:
    """The fit over all usable vectors of df: two passes over them, one for their sums, one for the scatter about the mean."""
    vectors = only(df, column).where(usable(F.col(column), scale, offset))
    common = vectors.groupBy(F.size(column).alias("dims")).count().orderBy(F.desc("count"), "dims").limit(1).first()
    if common is None:
        return Fit(0, [], np.zeros(0, np.int64), np.zeros(0), np.zeros((0, 0)), 0.0, scale, offset)
    n, dims = common["count"], common["dims"]
    vectors = vectors.where(F.size(column) == dims)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(dims, object)
        for b in batches:
            x = whole(_matrix(b.column(0), dims), scale, offset)
            total += _exact(np.ones((1, len(x)), np.int64), x)[0]
        yield _limbs(list(range(dims)), [0] * dims, list(total))

    found = _totals(vectors, sums)
    s = [found[i, 0] for i in range(dims)]
    mean = [(2 * t + n) // (2 * n) for t in s]
    centre = np.array(mean, np.int64)
    i, j = np.triu_indices(dims)

    def scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dims, dims), object)
        for b in batches:
            d = whole(_matrix(b.column(0), dims), scale, offset) - centre
            total += _exact(d.T, d)
        yield _limbs(i.tolist(), j.tolist(), list(total[i, j]))

    found = _totals(vectors, scatter)
    left = [t - n * c for t, c in zip(s, mean, strict=True)]  # by which the mean was rounded, times n
    v = np.empty((dims, dims))
    for (a, b), t in found.items():
        v[a, b] = v[b, a] = (n * t - left[a] * left[b]) / (n * n)  # of whole numbers: rounded once
    values, vectors_ = jacobi(v)
    return Fit(n, s, centre, values, vectors_, float(np.trace(v)), scale, offset)


def jacobi(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors as rows, of a symmetric matrix: cyclic sweeps of rotations.

    An entry counts as vanished against its own two diagonal entries, which is
    what keeps small eigenvalues accurate. An eigenvector's largest entry is
    positive.
    """
    a, n = np.array(matrix, float), len(matrix)
    v = np.eye(n)  # rows are vectors
    floor = np.finfo(float).tiny
    for _ in range(MAX_SWEEPS):
        turned = False
        for p in range(n - 1):
            for q in range(p + 1, n):
                off = a[p, q]
                if abs(off) <= max(floor, VANISHED * np.sqrt(abs(a[p, p] * a[q, q]))):
                    continue
                turned = True
                theta = (a[q, q] - a[p, p]) / (2 * off)
                t = (1.0 if theta >= 0 else -1.0) / (abs(theta) + np.hypot(theta, 1.0))
                c = 1 / np.hypot(t, 1.0)
                s = t * c
                app, aqq = a[p, p] - t * off, a[q, q] + t * off
                x, y = c * a[p] - s * a[q], s * a[p] + c * a[q]
                a[p], a[q] = x, y
                a[:, p], a[:, q] = x, y
                a[p, p], a[q, q], a[p, q], a[q, p] = app, aqq, 0.0, 0.0
                v[p], v[q] = c * v[p] - s * v[q], s * v[p] + c * v[q]
        if not turned:
            break
    off = a - np.diag(np.diag(a))
    if n and np.abs(off).max() > 1e-10 * max(np.abs(np.diag(a)).max(), floor):
        raise ArithmeticError(f"{MAX_SWEEPS} sweeps left entries beside the diagonal")
    order = np.argsort(-np.diag(a), kind="stable")
    v = v[order]
    if n:
        v = v * np.where(np.take_along_axis(v, np.abs(v).argmax(1)[:, None], 1) < 0, -1.0, 1.0)
    return np.diag(a)[order], v


def whiten(df: DataFrame, model: Fit, components: int = COMPONENTS, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(key, deviation, whitened) of every usable vector: n^2 times its squared distance from the mean, exact (null beyond 38 digits), and its first whitened components, a double each."""
    d = only(df, key, column)
    k, dims, n = min(components, model.dims), model.dims, model.n
    schema = f"`{key}` {d.schema[key].dataType.simpleString()}, deviation decimal(38,0), whitened array<double>"
    rank = min(k, model.rank())
    left = [t - n * int(c) for t, c in zip(model.sums, model.centre, strict=True)]
    # Half of the mean's rounding error and the scaled vectors: what a task needs, dims x 8 doubles.
    held = df.sparkSession.sparkContext.broadcast((model.centre, left, np.array([x / n for x in left]), model.vectors[:rank] / np.sqrt(model.values[:rank])[:, None]))
    scale, offset = model.scale, model.offset

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre, rest, shift, w = held.value
        for b in batches:
            x = whole(_matrix(b.column(1), dims), scale, offset) - centre
            far = max(int(np.abs(x).max(initial=0)) * n + max(map(abs, rest)), 1)
            e = x * n - np.array(rest) if far * far * dims < 2**63 else x.astype(object) * n - np.array(rest, object)
            deviation = [v if v < 10**38 else None for v in map(int, (e * e).sum(axis=1))]
            out = np.full((len(x), k), np.nan)
            out[:, :rank] = (x - shift) @ w.T
            flat = pa.array(out.ravel(), pa.float64(), mask=np.isnan(out.ravel()))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * k), flat)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([None if v is None else Decimal(v) for v in deviation], pa.decimal128(38, 0)), lists], [key, "deviation", "whitened"])

    if not n:
        return df.sparkSession.createDataFrame([], schema)
    return d.where(usable(F.col(column), scale, offset) & (F.size(column) == dims)).mapInArrow(run, schema)


def identity_error(whitened: DataFrame, components: int) -> float | None:
    """The largest entry by which the covariance of whitened components differs from the identity; null if none has variance."""
    w = F.col("whitened")
    pairs = [(i, j) for i in range(components) for j in range(i, components)]
    if not pairs:
        return None
    found = whitened.agg(*[F.covar_pop(w[i], w[j]).alias(f"c{i}_{j}") for i, j in pairs]).first()
    off = [abs(found[f"c{i}_{j}"] - (i == j)) for i, j in pairs if found[f"c{i}_{j}"] is not None]
    return max(off, default=None)


def components(df: DataFrame, count: int = COMPONENTS, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """A row for each usable vector and component: its whitened value beside n, the deviation, the component's share of the variance and the identity error.

    deviation is null where it is beyond a long.
    """
    model = fit(df, column)
    rows = whiten(df, model, count, key, column)
    k = min(count, model.dims)
    error = identity_error(rows, min(k, model.rank()))
    shares = F.array(*[F.lit(float(v) / model.trace if model.trace > 0 else None).cast("double") for v in model.values[:k]]) if k else F.array().cast("array<double>")
    out = rows.select(key, F.col("deviation").try_cast("long").alias("deviation"), F.posexplode("whitened").alias("at", "whitened"))
    return out.select(key, (F.col("at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", F.element_at(shares, F.col("at") + 1).alias("explained"), F.lit(error).cast("double").alias("identity_error"))
