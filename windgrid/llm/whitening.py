"""PCA whitening of embeddings by a cyclic Jacobi eigensolver.

Entries become whole numbers first: x = floor(1024 * c) + 100000. Three passes over
the vector column, none of which moves a vector:

1. the number of vectors and exact sums a dimension;
2. the scatter of vectors centred at the whole number next to their mean: each task
   adds d x d products of small whole numbers, exact as long as they stay under 2^53,
   and a tree of groups adds the tasks' matrices. The rest of the centring, at most
   half a unit, is a matrix of rank one;
3. the covariance of the whitened vectors, which gives the error against the identity.

The driver holds the d x d covariance (32 MB for 2,048 dimensions) and rotates it by
cyclic Jacobi until each off-diagonal entry is negligible beside its own two diagonal
entries, which gives small eigenvalues their relative accuracy. The sorted, scaled
eigenvectors go to the tasks, as d x components numbers.

Left out: vectors that are null, or hold null or non-finite entries, or an entry
beyond 2^52 / 1024, whose whole number is not exact. Shorter vectors are filled up
with zeros. Directions without variance (under 1e-13 of the largest) have null
whitened values and stay out of the error; explained is null where nothing varies.
deviation is null where it exceeds a long. Ids are returned as they are, null, repeated
or of any type; repeated rows count as often as they stand; ties between equal
eigenvalues keep the order of the dimensions. An empty table gives an empty result.
Only the two columns named are read, so others can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship

SCALE, SHIFT = 1024, 100_000
#: Vectors that a task handles at a time.
ROWS = 8192
#: Groups of tasks whose matrices are added up before they meet.
FAN = 256
#: Below this share of the largest eigenvalue a direction has no variance.
NOTHING = 1e-13
LONG = 2**63 - 1


def whole_vectors(col: pa.Array, dim: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Places of the vectors that take part, and their whole numbers (filled up to dim; None: up to the longest)."""
    there = np.flatnonzero(col.is_valid().to_numpy(zero_copy_only=False))
    sizes = pc.list_value_length(col).drop_null().to_numpy().astype(np.int64)
    flat = col.flatten()
    values = pc.cast(flat, pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False)
    with np.errstate(over="ignore", invalid="ignore"):
        good = np.abs(values * SCALE) < 2.0**52
    row = np.repeat(np.arange(len(there)), sizes)
    ok = np.bincount(row[~good], minlength=len(there)) == 0
    dim = int(sizes[ok].max(initial=0)) if dim is None else dim
    used = ok[row]
    out = np.full((len(there), dim), SHIFT, dtype=np.int64)
    at = np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[row[used], at[used]] = np.floor(values[used] * SCALE).astype(np.int64) + SHIFT
    return there[ok], out[ok]


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield batch.slice(at, ROWS)


def _sums(vectors: DataFrame) -> tuple[int, list[int]]:
    """The number of vectors, and their exact sum in each dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, high, low = 0, np.zeros(0, np.int64), np.zeros(0, np.int64)
        for b in _parts(batches):
            _, x = whole_vectors(b.column(0))
            if (more := x.shape[1] - len(high)) > 0:  # the vectors before were shorter
                high, low = (np.append(a, [f(n * SHIFT)] * more) for a, f in ((high, lambda v: v >> 20), (low, lambda v: v & 0xFFFFF)))
            total = np.full((2, len(high)), 0, np.int64)
            total[0, : x.shape[1]], total[1, : x.shape[1]] = (x >> 20).sum(0), (x & 0xFFFFF).sum(0)
            rest = len(x) * SHIFT
            total[0, x.shape[1] :], total[1, x.shape[1] :] = rest >> 20, rest & 0xFFFFF
            n, high, low = n + len(x), high + total[0], low + total[1]
        if n:
            at = np.arange(-1, len(high), dtype=np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(np.append(0, high)), pa.array(np.append(n, low)), pa.array(np.full(len(at), n))], names=["at", "high", "low", "n"])

    parts = vectors.mapInArrow(run, "at int, high long, low long, n long")
    wide = [F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("high", "low", "n")]
    found = {r["at"]: r for r in parts.groupBy("at").agg(*wide).collect()}  # a row for each dimension
    if not found:
        return 0, []
    n = int(found[-1]["low"])
    # a task that met only shorter vectors knows nothing of the dimensions beyond: they are zeros there
    return n, [(int(found[d]["high"]) << 20) + int(found[d]["low"]) + (n - int(found[d]["n"])) * SHIFT for d in range(len(found) - 1)]


def _added(vectors: DataFrame, run, rows: int) -> np.ndarray:
    """The sum of the matrices (of so many rows) that run yields, one a task, by a tree of groups; on the driver."""
    made = vectors.mapInArrow(lambda batches: _as_rows(run(batches)), "task long, at int, row array<double>")

    def add(batch: pa.Table) -> pa.Table:
        total = _matrix(batch["row"].combine_chunks()).sum(0)
        return pa.table({"task": batch["task"][:1], "at": batch["at"][:1], "row": pa.array([total], pa.list_(pa.float64()))})

    for groups in (FAN, 1):
        made = made.withColumn("task", F.pmod(F.col("task"), F.lit(groups))).groupBy("task", "at").applyInArrow(add, "task long, at int, row array<double>")
    found = made.drop("task").toArrow()
    out = np.zeros((rows, rows))
    if found.num_rows:
        out[found["at"].to_numpy()] = _matrix(found["row"].combine_chunks())
    return out


def _matrix(rows: pa.Array) -> np.ndarray:
    return rows.flatten().to_numpy().reshape(len(rows), -1)


def _as_rows(matrices: Iterator[np.ndarray]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    for m in matrices:
        task = np.full(len(m), TaskContext.get().partitionId())
        rows = pa.array(list(m), pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([pa.array(task), pa.array(np.arange(len(m), dtype=np.int32)), rows], names=["task", "at", "row"])


def jacobi(a: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (falling) and unit eigenvectors (columns) of a symmetric matrix by cyclic Jacobi rotations.

    An entry is rotated away unless it is negligible beside the geometric mean of its
    two diagonal entries; the end is a sweep without rotations.
    """
    a = np.array(a, dtype=np.float64)
    d = len(a)
    vectors = np.eye(d)
    tiny = np.finfo(float).tiny
    for _ in range(sweeps):
        turned = False
        for p in range(d - 1):
            for q in range(p + 1, d):
                off, low, high = a[p, q], a[p, p], a[q, q]
                if abs(off) <= 1e-16 * np.sqrt(abs(low * high)) + tiny:
                    continue
                turned = True
                theta = (high - low) / (2 * off)
                t = (1.0 if theta >= 0 else -1.0) / (abs(theta) + np.hypot(theta, 1.0))
                c = 1 / np.sqrt(1 + t * t)
                s = t * c
                rows = a[p].copy()
                a[p], a[q] = c * rows - s * a[q], s * rows + c * a[q]
                a[:, p], a[:, q] = a[p], a[q]
                a[p, p], a[q, q], a[p, q], a[q, p] = low - t * off, high + t * off, 0.0, 0.0
                column = vectors[:, p].copy()
                vectors[:, p], vectors[:, q] = c * column - s * vectors[:, q], s * column + c * vectors[:, q]
        if not turned:
            break
    values = np.diag(a)
    order = np.argsort(-values, kind="stable")
    return values[order], vectors[:, order]


def exact_deviations(near: np.ndarray, n: int, rest: list[int]) -> pa.Array:
    """Sums over dimensions of (n * near - rest)^2, exact; null where a long can't hold it. near: x less the whole number next to its mean."""
    about = ((n * near.astype(np.float64) - np.array(rest, dtype=np.float64)) ** 2).sum(1)
    if about.max(initial=0) < 2.0**62:
        return pa.array(((n * near - np.array(rest, dtype=np.int64)) ** 2).sum(1))
    out = []
    for row, guess in zip(near, about.tolist(), strict=True):
        exact = sum((n * v - r) ** 2 for v, r in zip(row.tolist(), rest, strict=True)) if guess < 2.0**63.5 else LONG + 1
        out.append(exact if exact <= LONG else None)
    return pa.array(out, pa.int64())


class Whitening:
    """The fitted transform. n, mean (exact sums), covariance, values and vectors of all components, error against the identity."""

    def __init__(self, df: DataFrame, vector_col: str, components: int = 8) -> None:
        ship(df.sparkSession)
        vectors = df.select(vector_col)
        self.n, self.sums = _sums(vectors)
        self.dim = dim = len(self.sums)
        self.components = min(components, dim)
        self.error = None
        if not self.components:
            return
        n = self.n
        self.middle = middle = [(2 * s + n) // (2 * n) for s in self.sums]
        self.rest = [s - n * m for s, m in zip(self.sums, middle, strict=True)]  # n * (mean - middle)
        centre = np.array(middle, dtype=np.int64)

        def scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
            total = np.zeros((dim, dim))
            for b in _parts(batches):
                x = (whole_vectors(b.column(0), dim)[1] - centre).astype(np.float64)
                total += x.T @ x
            yield total

        off = np.array([r / n for r in self.rest])
        self.covariance = _added(vectors, scatter, dim) / n - np.outer(off, off)
        self.values, self.vectors = jacobi(self.covariance)
        k = self.components
        varies = self.values[:k] > NOTHING * max(self.values[0], 0.0)
        self.matrix = self.vectors[:, :k] / np.sqrt(np.where(varies, self.values[:k], np.inf))
        self.varies, self.off = varies, off
        trace = float(np.trace(self.covariance))
        self.explained = [float(v / trace) if trace > 0 else None for v in self.values[:k]]
        self._measure(vectors, centre)

    def _measure(self, vectors: DataFrame, centre: np.ndarray) -> None:
        dim, matrix, off, k = self.dim, self.matrix, self.off, self.components

        def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
            total = np.zeros((k + 1, k + 1))
            for b in _parts(batches):
                x = (whole_vectors(b.column(0), dim)[1] - centre) - off
                y = np.hstack([x @ matrix, np.ones((len(x), 1))])
                total += y.T @ y
            yield total

        m = _added(vectors, moments, k + 1) / self.n
        error = m[:k, :k] - np.outer(m[:k, k], m[:k, k]) - np.eye(k)
        there = np.flatnonzero(self.varies)
        self.error = float(np.abs(error[np.ix_(there, there)]).max(initial=0.0))

    def transform(self, df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
        """id_col, component (from 1), n, deviation, whitened, explained, identity_error: a row for each vector that takes part and each component."""
        n, dim, k, error, explained = self.n, self.dim, self.components, self.error, self.explained if self.components else []
        kind = df.schema[id_col].dataType.simpleString()
        schema = f"`{id_col}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
        if not k:
            return df.sparkSession.createDataFrame([], schema)
        centre, off, rest, matrix, gone = np.array(self.middle, dtype=np.int64), self.off, self.rest, self.matrix, ~self.varies

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in _parts(batches):
                kept, x = whole_vectors(b.column(1), dim)
                near = x - centre
                white = (near - off) @ matrix
                each = pa.array(np.repeat(np.arange(len(kept)), k))
                ids = b.column(0).take(pa.array(kept)).take(each)
                component = np.tile(np.arange(1, k + 1, dtype=np.int32), len(kept))
                values = pa.array(white.ravel(), mask=np.tile(gone, len(kept)))
                share = pa.array(explained, pa.float64()).take(pa.array(component - 1))
                size = len(component)
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(component), pa.array(np.full(size, n)), exact_deviations(near, n, rest).take(each), values, share, pa.array(np.full(size, error))],
                    names=[id_col, "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

        return df.select(id_col, vector_col).mapInArrow(run, schema)


def whiten(df: DataFrame, id_col: str, vector_col: str, components: int = 8) -> DataFrame:
    """Fits on all vectors of df and transforms them."""
    return Whitening(df, vector_col, components).transform(df, id_col, vector_col)


def query(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return whiten(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
