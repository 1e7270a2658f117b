"""Whitening of embeddings with eigenvectors that are refined in higher precision.

The covariance is summed on Spark from whole numbers: entries are taken as x = floor(64 c) + 1000000,
centred on the whole number nearest their mean, and multiplied; the rest of the mean (half a unit at
most) is taken off exactly afterwards. So the covariance carries no rounding of its own.

Its eigenvectors start as those of the float32 matrix and are corrected by Ogita and Aishima's
iteration, matrix products in extended precision, until the correction vanishes. Eigenvalues that the
iteration can't tell apart yet form a cluster: the matrix, restricted to the cluster's space and
shifted by its mean eigenvalue, is solved by itself, which turns the cluster's vectors into their own
eigenvectors for the next round. Vectors of equal eigenvalues are any orthonormal basis.

Every pass reads the rows once and carries one matrix of the dimension's size a task.

Defined results: rows whose vector is null or empty, or holds null, NaN or an infinity, are dropped; the
dimension is the most frequent length of the others (of equally frequent ones the largest), rows of
another length aren't vectors of that space and are dropped; null and repeated vec_ids are rows like
any other; a component without variance (below 1e-13 of the largest) can't be scaled and is left
out, so a table of equal vectors, of one row or of none gives no rows. A floor beyond 2^60 is held
there. A deviation that doesn't fit a long (n beyond 10^7 or so) is null.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from almanac.llm.sums import SCHEMA, pieces, summed
from almanac.llm.util import bounded_batches

SCALE, SHIFT = 64, 1_000_000
TOP = 32
#: Entries are held within +-2^60; rows with a centred entry over WIDE are multiplied as doubles.
HELD, WIDE = 1 << 60, 1 << 12
#: A bound only: four or five rounds settle float32 starts, clusters a few more.
ROUNDS = 30
LIMB = 1 << 31

OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


# --- eigenvectors -----------------------------------------------------------------------------


def correction(a: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, float, float]:
    """One step: (corrected x, eigenvalues, the gap below which eigenvalues are one cluster, the size
    of the correction), in falling order of the eigenvalues."""
    rest = np.eye(len(a), dtype=a.dtype) - x.T @ x
    inner = x.T @ a @ x
    rest, inner = (rest + rest.T) / 2, (inner + inner.T) / 2  # else rounding, over a small gap, turns vectors apart
    values = np.diag(inner) / (1 - np.diag(rest))
    order = np.argsort(-values, kind="stable")
    x, rest, inner, values = x[:, order], rest[np.ix_(order, order)], inner[np.ix_(order, order)], values[order]
    norm = lambda m: float(np.linalg.norm(m.astype(np.float64), 2))
    least = 2 * (norm(inner - np.diag(values)) + norm(a) * norm(rest))
    gap = values[None, :] - values[:, None]
    near = np.abs(gap) <= least
    e = np.where(near, rest / 2, (inner + values[None, :] * rest) / np.where(near, 1, gap))
    return x + x @ e, values, least, float(np.abs(e).max())


def inside(a: np.ndarray, x: np.ndarray, values: np.ndarray, least: float) -> np.ndarray:
    """``x`` with the vectors of each cluster replaced by eigenvectors of the cluster's own problem."""
    x = x.copy()
    cuts = [0, *(np.flatnonzero(-np.diff(values) > least) + 1).tolist(), len(values)]
    for first, last in zip(cuts[:-1], cuts[1:], strict=True):
        if last - first > 1:
            own = x[:, first:last]
            t = own.T @ a @ own
            t = (t + t.T) / 2
            t -= np.trace(t) / len(t) * np.eye(len(t), dtype=t.dtype)
            if size := np.abs(t).max():
                x[:, first:last] = own @ np.linalg.eigh((t / size).astype(np.float64))[1][:, ::-1]
    return x


def eigenvectors(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues falling, unit eigenvectors as columns) of a symmetric extended-precision matrix,
    to extended precision but for the conditioning of the vectors."""
    size = np.abs(a).max()
    if not len(a) or not size:
        return np.zeros(len(a), a.dtype), np.eye(len(a), dtype=a.dtype)
    a = (a + a.T) / (2 * size)
    x = np.linalg.eigh(a.astype(np.float32))[1].astype(a.dtype)
    best, stalled = np.inf, 0
    for _ in range(ROUNDS):
        x, values, least, moved = correction(a, x)
        stalled = 0 if moved < best / 2 else stalled + 1
        best = min(best, moved)
        if stalled == 3 or moved < 4 * np.finfo(a.dtype).eps:
            break
        x = inside(a, x, values, least)
    values = np.diag(x.T @ a @ x) / np.diag(x.T @ x)
    order = np.argsort(-values, kind="stable")
    return values[order] * size, (x / np.sqrt(np.sum(x * x, axis=0)))[:, order]


# --- passes over the rows ---------------------------------------------------------------------


def usable(table: DataFrame, vector: str) -> DataFrame:
    """(vec_id, vector) of the rows whose vector has finite entries only."""
    finite = F.forall("vector", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("vector")).where(F.col("vector").isNotNull() & finite)


def whole(column: pa.Array, dims: int) -> np.ndarray:
    """Vectors as rows of x, int64."""
    c = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
    with np.errstate(over="ignore"):
        return np.clip(np.floor(SCALE * c), -HELD, HELD).astype(np.int64) + SHIFT


@dataclass
class Means:
    """n, the whole number nearest each mean, and by what n x - S differs from n (x - nearest)."""

    n: int
    nearest: np.ndarray
    rest: list[int]

    @property
    def offset(self) -> np.ndarray:
        """S/n - nearest."""
        return np.array([np.longdouble(r) / np.longdouble(self.n) for r in self.rest], np.longdouble)


def means(rows: DataFrame, dims: int) -> Means:
    """Sums in two limbs of 31 bits, so that no sum of longs overflows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, high, low = 0, np.zeros(dims, np.int64), np.zeros(dims, np.int64)
        for batch in batches:
            x = whole(batch.column(0), dims)
            n, high, low = n + len(x), high + (x // LIMB).sum(axis=0), low + (x % LIMB).sum(axis=0)
        yield pieces(np.concatenate([[n], high, low]))

    found = summed(rows.select("vector").mapInArrow(run, SCHEMA), (2 * dims + 1,), np.int64).tolist()
    n = found[0]
    sums = [h * LIMB + lo for h, lo in zip(found[1 : dims + 1], found[dims + 1 :], strict=True)]
    nearest = [(2 * s + n) // (2 * n) for s in sums]
    return Means(n, np.array(nearest, np.int64), [s - n * m for s, m in zip(sums, nearest, strict=True)])


def products(d: np.ndarray) -> np.ndarray:
    """d.T @ d of small whole numbers, exactly: blocks whose sums stay below 2^53."""
    step = max(1, (1 << 53) // WIDE**2)
    out = np.zeros((d.shape[1], d.shape[1]), np.int64)
    for k in range(0, len(d), step):
        part = d[k : k + step].astype(np.float64)
        out += (part.T @ part).astype(np.int64)
    return out


def covariance(rows: DataFrame, dims: int, mean: Means) -> np.ndarray:
    """Extended precision. Rows with an entry far off (over WIDE) are multiplied as doubles, the others
    as whole numbers whose sums travel in two limbs of 26 bits, each exact in a double."""
    nearest, offset = mean.nearest, mean.offset
    near_offset = offset.astype(np.float64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        exact, far = np.zeros((dims, dims), np.int64), np.zeros((dims, dims))
        sums, n = np.zeros(dims, np.int64), 0
        for batch in batches:
            d = whole(batch.column(0), dims) - nearest
            off = (np.abs(d) > WIDE).any(axis=1)
            own = d[~off]
            exact, sums, n = exact + products(own), sums + own.sum(axis=0), n + len(own)
            if off.any():
                wide = d[off] - near_offset
                far += wide.T @ wide
        yield pieces(np.concatenate([(exact >> 26).ravel(), (exact & ((1 << 26) - 1)).ravel(), far.ravel(), sums, [n]]).astype(np.float64))

    k = dims * dims
    found = summed(rows.select("vector").mapInArrow(run, SCHEMA), (3 * k + dims + 1,), np.float64).astype(np.longdouble)
    high, low, far, sums, n = found[:k], found[k : 2 * k], found[2 * k : 3 * k], found[3 * k : -1], found[-1]
    cross = np.outer(sums, offset)
    total = (high * (1 << 26) + low + far).reshape(dims, dims) - cross - cross.T + n * np.outer(offset, offset)
    return total / mean.n


@dataclass
class Whitener:
    """Takes rows of x to whitened components."""

    mean: Means
    matrix: np.ndarray
    explained: np.ndarray

    @property
    def k(self) -> int:
        return self.matrix.shape[1]

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean.nearest) - self.mean.offset.astype(np.float64)) @ self.matrix

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sums of (n x - S)^2, exact."""
        d, n, rest = x - self.mean.nearest, self.mean.n, self.mean.rest
        if len(d) and n * (int(np.abs(d).max()) + 1) < 1 << 31 and d.shape[1] * (n * (int(np.abs(d).max()) + 1)) ** 2 < 1 << 63:
            own = n * d - np.array(rest, np.int64)
            return (own * own).sum(axis=1).tolist()
        found = [sum((n * c - r) ** 2 for c, r in zip(row, rest, strict=True)) for row in d.tolist()]
        return [v if v < 1 << 63 else None for v in found]


def fit(rows: DataFrame, dims: int, top: int = TOP) -> Whitener | None:
    """None if no component has variance."""
    mean = means(rows, dims)
    if not mean.n:
        return None
    v = covariance(rows, dims, mean)
    values, vectors = eigenvectors(v)
    k = int(np.sum(values[:top] > 1e-13 * values[0])) if values[0] > 0 else 0
    if not k:
        return None
    return Whitener(mean, (vectors[:, :k] / np.sqrt(values[:k])).astype(np.float64), (values[:k] / np.trace(v)).astype(np.float64))


def identity_error(rows: DataFrame, dims: int, white: Whitener) -> float:
    """The largest absolute entry of the whitened rows' covariance minus the identity."""
    k = white.k

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k + 1, k))
        for batch in batches:
            w = white.whitened(whole(batch.column(0), dims))
            total[:k] += w.T @ w
            total[k] += w.sum(axis=0)
        yield pieces(total)

    total = summed(rows.select("vector").mapInArrow(run, SCHEMA), (k + 1, k), np.float64) / white.mean.n
    return float(np.abs(total[:k] - np.outer(total[k], total[k]) - np.eye(k)).max())


def whiten(table: DataFrame, vector: str = "embedding", top: int = TOP) -> DataFrame:
    """One row per usable row and component: OUT."""
    spark = table.sparkSession
    bounded_batches(spark)
    rows = usable(table, vector)
    lengths = rows.groupBy(F.size("vector").alias("dims")).count().where("dims > 0")
    most = lengths.orderBy(F.desc("count"), F.desc("dims")).limit(1).collect()
    if not most:
        return spark.createDataFrame([], OUT)
    dims = most[0]["dims"]
    rows = rows.where(F.size("vector") == dims)
    white = fit(rows, dims, top)
    if white is None:
        return spark.createDataFrame([], OUT)
    k, n, error = white.k, white.mean.n, identity_error(rows, dims, white)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = whole(batch.column(1), dims)
            at = np.repeat(np.arange(len(x)), k)
            out = [
                batch.column(0).take(pa.array(at)),
                pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                pa.array(np.full(len(at), n, np.int64)),
                pa.array(white.deviations(x), pa.int64()).take(pa.array(at)),
                pa.array(white.whitened(x).ravel()),
                pa.array(np.tile(white.explained, len(x))),
                pa.array(np.full(len(at), error)),
            ]
            yield pa.RecordBatch.from_arrays(out, names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(run, OUT)
