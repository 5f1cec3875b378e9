"""Whitening of embeddings by principal components found through spectrum slicing.

The covariance of the distinct vectors is summed up by Spark, centred first. Its leading
eigenpairs are then found one by one: the inertia of the LDL' factors of the covariance less a
shift counts the eigenvalues above the shift, and halving isolates the k-th one; Rayleigh
quotient iteration converges cubically inside its interval; counts just above and below the
result certify that it is the k-th. The matrix has the size of a vector, whatever the number of
rows, so this part is done once on the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retort.llm.text import saved

COMPONENTS = 16
SCALE = 64.0
SHIFT = 1_000_000
#: Vectors worked on at once in a task.
BLOCK_ROWS = 4096

_EPS = np.finfo(float).eps
_GROWTH = (1 + np.sqrt(17.0)) / 8  # Bunch-Kaufman bound on the growth of entries


def whole_entries(vector: Column) -> Column:
    """Entries as the whole numbers floor(64 * c) + 1000000; null if any is null or not finite."""
    fine = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) != float("inf")))
    return F.when(fine, F.transform(vector, lambda c: F.floor(c.cast("double") * F.lit(SCALE)) + F.lit(SHIFT).cast("long")))


def inertia(matrix: np.ndarray, shift: float) -> int:
    """Number of eigenvalues of a symmetric matrix above ``shift``.

    Signs of the pivots of P(A - shift I)P' = LDL' with pivots of order 1 and 2 (Sylvester's law).
    """
    a = matrix - shift * np.eye(len(matrix))
    above, tiny = 0, _EPS * max(float(np.abs(a).max(initial=0)), np.finfo(float).tiny)
    while len(a):
        p = 0
        column = np.abs(a[1:, 0])
        if len(column) and column.max() > 0 and abs(a[0, 0]) < _GROWTH * column.max():
            r = int(column.argmax()) + 1
            others = np.abs(a[r]).copy()
            others[r] = 0
            if abs(a[0, 0]) * others.max() >= _GROWTH * column.max() ** 2:
                p = 0
            elif abs(a[r, r]) >= _GROWTH * others.max():
                p = r
            else:  # a pivot of order 2 has one eigenvalue of each sign
                order = [0, r, *(i for i in range(1, len(a)) if i != r)]
                a = a[np.ix_(order, order)]
                pair, rest = a[:2, :2], a[2:, :2]
                a = a[2:, 2:] - rest @ np.linalg.solve(pair, rest.T)
                above += 1
                continue
        if p:
            order = [p, *(i for i in range(len(a)) if i != p)]
            a = a[np.ix_(order, order)]
        pivot = a[0, 0]
        above += bool(pivot > 0)
        if abs(pivot) > tiny:
            a = a[1:, 1:] - np.outer(a[1:, 0], a[0, 1:]) / pivot
        else:  # the column is zero to rounding as well
            a = a[1:, 1:]
    return above


def _apart(v: np.ndarray, found: list[np.ndarray]) -> np.ndarray:
    for _ in range(2):
        for u in found:
            v = v - (u @ v) * u
    return v / max(float(np.linalg.norm(v)), np.finfo(float).tiny)


def _solve(matrix: np.ndarray, shift: float, v: np.ndarray, scale: float) -> np.ndarray:
    for nudge in (0.0, 1.0, 16.0):  # an exact eigenvalue as shift leaves nothing to divide by
        try:
            y = np.linalg.solve(matrix - (shift + nudge * _EPS * scale) * np.eye(len(v)), v)
        except np.linalg.LinAlgError:
            continue
        if np.isfinite(y).all():
            return y
    return v


class Spectrum:
    """The eigenvalues of a symmetric matrix as inertia counts show them; every count is kept."""

    def __init__(self, matrix: np.ndarray):
        self.matrix, size = matrix, len(matrix)
        #: No eigenvalue is larger.
        self.reach = float(np.abs(matrix).sum(1).max(initial=0))
        #: Eigenvalues nearer to each other, or to 0, can't be told apart.
        self.near = 8 * size * _EPS * self.reach
        self.counts: dict[float, int] = {}

    def above(self, shift: float) -> int:
        if shift not in self.counts:
            self.counts[shift] = inertia(self.matrix, shift)
        return self.counts[shift]

    def bracket(self, k: int) -> tuple[float, float]:
        """The narrowest interval known to hold the k-th largest eigenvalue."""
        low = max(s for s, n in self.counts.items() if n >= k)
        return low, min(s for s, n in self.counts.items() if n < k and s >= low)

    def isolate(self, k: int) -> tuple[float, float]:
        """An interval with the k-th eigenvalue and no other, or one too narrow to part them."""
        low, high = self.bracket(k)
        while high - low > self.near and (self.above(low) != k or self.above(high) != k - 1):
            self.above((low + high) / 2)
            low, high = self.bracket(k)
        return low, high

    def certified(self, value: float, k: int) -> bool:
        return self.above(value - self.near) >= k > self.above(value + self.near)


def leading_eigenpairs(matrix: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``count`` largest positive eigenvalues, falling, and unit eigenvectors as rows.

    Fewer are returned if fewer are positive beyond rounding. Equal eigenvalues, which no shift
    can part, get orthogonal vectors of their common space.
    """
    spectrum, values, vectors = Spectrum(matrix), [], []
    if spectrum.reach:
        spectrum.above(spectrum.reach + spectrum.near)
    for k in range(1, min(count, spectrum.above(spectrum.near) if spectrum.reach else 0) + 1):
        low, high = spectrum.isolate(k)
        while True:
            pair = _refined(matrix, low, high, vectors, spectrum.reach)
            if pair and spectrum.certified(pair[0], k):
                break
            if high - low <= spectrum.near:
                raise ArithmeticError(f"eigenpair {k} of {len(matrix)} not found")
            spectrum.above((low + high) / 2)  # a tighter interval, then once more
            low, high = spectrum.bracket(k)
        values.append(pair[0])
        vectors.append(pair[1])
    order = np.argsort(-np.array(values), kind="stable") if values else np.zeros(0, int)
    return np.array(values)[order], np.array(vectors).reshape(len(values), len(matrix))[order]


def _apart(v: np.ndarray, found: list[np.ndarray]) -> np.ndarray:
    for _ in range(2):
        for u in found:
            v = v - (u @ v) * u
    return v / max(float(np.linalg.norm(v)), np.finfo(float).tiny)


def _solve(matrix: np.ndarray, shift: float, v: np.ndarray, scale: float) -> np.ndarray:
    for nudge in (0.0, 1.0, 16.0):  # an exact eigenvalue as shift leaves nothing to divide by
        try:
            y = np.linalg.solve(matrix - (shift + nudge * _EPS * scale) * np.eye(len(v)), v)
        except np.linalg.LinAlgError:
            continue
        if np.isfinite(y).all():
            return y
    return v


def _refined(matrix: np.ndarray, low: float, high: float, found: list[np.ndarray], scale: float):
    """The eigenpair in an interval by Rayleigh quotient iteration; None if the iteration leaves it."""
    value, v = (low + high) / 2, _apart(np.random.default_rng(len(found)).standard_normal(len(matrix)), found)
    for _ in range(3):  # inverse iteration brings the start near the interval's vector
        v = _apart(_solve(matrix, value, v, scale), found)
    for _ in range(30):
        value = float(v @ matrix @ v)
        rest = float(np.linalg.norm(matrix @ v - value * v))
        if rest <= 4 * len(matrix) * _EPS * scale:
            return (value, v) if low - rest <= value <= high + rest else None
        if not low <= value <= high:
            return None
        v = _apart(_solve(matrix, value, v, scale), found)
    return None


def _blocks(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Runs of rows with their vectors as a matrix of whole numbers."""
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK_ROWS):
            part = batch.slice(at, BLOCK_ROWS)
            x = pc.list_flatten(part.column(column)).to_numpy(zero_copy_only=False)
            yield part, x.reshape(part.num_rows, -1)


def _matrix(parts: DataFrame, size: int) -> np.ndarray:
    """Sum over rows (i, row of numbers) of the tasks, added up by Spark: one number per cell is left."""
    cells = parts.select("i", F.posexplode("cells").alias("j", "v")).groupBy("i", "j").agg(F.sum("v").alias("v"))
    total = np.zeros((size, size))
    for i, j, v in cells.collect():
        total[i, j] = v
    return total


def _products(batches: Iterator[pa.RecordBatch], mean: np.ndarray, basis: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows of the sum of d d' over the vectors, where d is the centred vector in ``basis``."""
    total = np.zeros((len(basis), len(basis)))
    for _, x in _blocks(batches, "x"):
        d = (x - mean) @ basis.T
        total += d.T @ d
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.arange(len(basis), dtype=np.int32)), pa.array(list(total), pa.list_(pa.float64()))], ["i", "cells"]
    )


def _sums(fit: DataFrame, size: int) -> tuple[int, list[int]]:
    """Number of vectors and exact sum per dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, high, low = 0, np.zeros(size, np.int64), np.zeros(size, np.int64)
        for _, x in _blocks(batches, "x"):  # halves, so that no sum overflows
            n, high, low = n + len(x), high + (x >> 32).sum(0), low + (x & 0xFFFFFFFF).sum(0)
        place = pa.array(np.arange(size, dtype=np.int32))
        yield pa.RecordBatch.from_arrays([place, pa.array(np.full(size, n)), pa.array(high), pa.array(low)], ["i", "n", "high", "low"])

    parts = fit.mapInArrow(run, "i int, n long, high long, low long").groupBy("i")
    rows = parts.agg(*[F.sum(c).alias(c) for c in ("n", "high", "low")]).orderBy("i").collect()  # one per dimension
    return rows[0]["n"], [(r["high"] << 32) + r["low"] for r in rows]


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sum over dimensions of (n * x - S)^2 of each row, exact; None if it is no 64-bit number."""
    largest = int(np.abs(x).max(initial=0))
    wide = max((abs(n * s) for s in (largest, *sums)), default=0) * 2 + max(map(abs, sums), default=0)
    if wide < 1 << 62:
        d = n * x - np.array(sums, np.int64)
        if int(np.abs(d).max(initial=0)) ** 2 * x.shape[1] < 1 << 63:
            return (d * d).sum(1).tolist()
    exact = [sum((n * int(c) - s) ** 2 for c, s in zip(row, sums, strict=True)) for row in x]
    return [v if v < 1 << 63 else None for v in exact]


def whitened(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """One row per remaining input row and component: vec_id, component, n, deviation, whitened,
    explained, identity_error.

    Rows whose vector is null, empty, or holds null or non-finite entries take no part; nor do
    those of another length than most have (of equally common ones the longest counts). The fit
    is over the distinct vectors, so copies weigh once, but all rows are returned. Components
    without variance beyond rounding are left out; if there is none (no rows, or all alike), the
    result is empty. Entries beyond 2**60 count as 2**60; ``deviation`` is null where it is no
    64-bit number. Other columns are not read; identifiers may be null and repeat.
    """
    schema = (
        "vec_id {}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    ).format(vectors.schema[id_col].dataType.simpleString())
    spark = vectors.sparkSession
    limit = F.lit(float(1 << 60) / SCALE)
    held = F.transform(F.col(vector_col), lambda c: F.greatest(F.least(c.cast("double"), limit), -limit))
    fine = F.forall(F.col(vector_col), lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) != float("inf")))
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.when(fine & (F.size(vector_col) > 0), whole_entries(held)).alias("x"))
    rows = saved(rows.filter(F.col("x").isNotNull()), "whitening-rows")
    common = rows.groupBy(F.size("x").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    if common is None:
        return spark.createDataFrame([], schema)
    size = common["size"]
    rows = rows.filter(F.size("x") == size)
    fit = saved(rows.select("x").distinct(), "whitening-fit")
    n, sums = _sums(fit, size)
    mean = np.array([s / n for s in sums])

    identity = np.eye(size)
    cells = "i int, cells array<double>"
    covariance = _matrix(fit.mapInArrow(lambda batches: _products(batches, mean, identity), cells), size) / n
    covariance = (covariance + covariance.T) / 2
    values, basis = leading_eigenpairs(covariance, components)
    if not len(values):
        return spark.createDataFrame([], schema)
    basis = basis / np.sqrt(values)[:, None]
    explained = values / covariance.trace()
    again = _matrix(fit.mapInArrow(lambda batches: _products(batches, mean, basis), cells), len(basis)) / n
    error = float(np.abs(again - np.eye(len(basis))).max())

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x in _blocks(batches, "x"):
            white = (x - mean) @ basis.T
            many, k = len(x), len(basis)
            each = np.repeat(np.arange(many), k)
            deviation = pa.array(deviations(x, n, sums), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("vec_id").take(pa.array(each)),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), many)),
                    pa.array(np.full(many * k, n, np.int64)),
                    deviation.take(pa.array(each)),
                    pa.array(white.ravel()),
                    pa.array(np.tile(explained, many)),
                    pa.array(np.full(many * k, error)),
                ],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return rows.mapInArrow(project, schema)
