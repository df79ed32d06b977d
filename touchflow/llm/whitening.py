"""Whitening of vectors by a covariance from variances alone (polarisation).

A component c becomes the integer x = floor(64 c) + 1000000.  The covariance is that of the distinct
x-vectors.  For two dimensions i and j it is (Var(i + j) - Var(i) - Var(j)) / 2, so one aggregate of
squares, for every dimension and every sum of two, gives the whole matrix.  All of it is exact: values
are centred before they are squared, at the whole part of their mean, and the sums of what is left,
r, correct the rest: the n-fold deviation of a value is n d - r, and the sum of its squares is
n (n sum(d d) - r r).  Only the last division rounds, and ``eigh`` works on the result.

Vectors are shuffled once, for the distinct ones, which are stored in the shared folder and read for
the sums, the squares and the check; partial sums are one row per task, dimension and pair.  The driver
gets one sum per pair of dimensions and gives the tasks one matrix.

Edge cases: null vectors and those with null or non-finite entries are left out; null ids and repeated
rows are returned as they are; vectors of each length are whitened by those of their own length, and
empty ones have no components; a component without variance (fewer distinct vectors than dimensions,
constant or dependent dimensions) cannot be whitened and has no rows; an entry of 2**50 or more is an
error; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchflow.session import stored

# Scale and offset of the integers.
SCALE, OFFSET = 64, 1_000_000
COMPONENTS = 16
#: Vectors that are worked on at once.
_ROWS = 4096
#: Below this size, squares of sums of two add up in 64 bits over ``_ROWS`` rows.
_SMALL = 1 << 24
#: A variance this much smaller than the largest is rounding.
_NOTHING = 1e-12
WIDE = "decimal(38,0)"


@dataclass
class Whitening:
    """Of the vectors of one length: whole means, sums of what is left, count and components."""

    mean: np.ndarray
    rest: list[int]
    n: int
    vectors: np.ndarray  # (dimension, component)
    values: np.ndarray
    trace: float
    error: float = 0.0

    def project(self, x: np.ndarray) -> np.ndarray:
        centred = (x - self.mean).astype(np.float64) - np.array([r / self.n for r in self.rest])
        return centred @ self.vectors / np.sqrt(self.values)


def integers(table: DataFrame) -> DataFrame:
    """(vec_id, x) of the usable rows."""
    c = F.transform("embedding", lambda v: v.cast("double"))
    usable = F.col("c").isNotNull() & ~F.exists(
        "c", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    whole = F.transform("c", lambda v: F.when(
        F.abs(v) < 2.0 ** 50, F.floor(v * SCALE).cast("long") + OFFSET).otherwise(
        F.raise_error(F.lit("an entry of 2**50 or more")).cast("long")))
    return table.select(F.col("vec_id").cast("long").alias("vec_id"), c.alias("c")) \
        .where(usable & (F.size("c") > 0)).select("vec_id", whole.alias("x"))


def _blocks(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(dimensions, places in the batch, their vectors) of at most ``_ROWS`` vectors."""
    column = batch["x"]
    sizes = np.asarray(column.value_lengths())
    for dim in np.unique(sizes):
        places = np.flatnonzero(sizes == dim)
        for at in range(0, len(places), _ROWS):
            part = places[at:at + _ROWS]
            values = column.take(pa.array(part)).flatten().to_numpy(zero_copy_only=False)
            yield int(dim), part, values.reshape(len(part), -1)


def _sums(mean: dict[int, np.ndarray] | None):
    """Per task: sums of each dimension (i, i) without ``mean``; with it those of the squares of
    each centred dimension and of each sum of two (i, j), and of the centred values (i, null)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[tuple[int, int, int | None], int] = {}

        def add(dim: int, i: int, js, values) -> None:
            for j, value in zip(js, values):
                totals[dim, i, j] = totals.get((dim, i, j), 0) + int(value)

        count: dict[int, int] = {}
        for batch in batches:
            for dim, part, x in _blocks(batch):
                count[dim] = count.get(dim, 0) + len(part)
                if mean is None:
                    # Below 2**57 each and 4096 rows: the halves add up in 64 bits.
                    high, low = (x >> 32).sum(axis=0), (x & 0xFFFFFFFF).sum(axis=0)
                    for i in range(dim):
                        add(dim, i, [i], [(int(high[i]) << 32) + int(low[i])])
                    continue
                d = x - mean[dim]
                if np.abs(d).max() >= _SMALL:
                    d = d.astype(object)
                for i in range(dim):
                    both = d[:, i:] + d[:, i:i + 1]
                    both[:, 0] = d[:, i]
                    add(dim, i, [None, *range(i, dim)], [d[:, i].sum(), *(both * both).sum(axis=0)])
        keys = list(totals)
        rows = [(*k, count[k[0]], str(totals[k])) for k in keys]
        for at in range(0, len(rows), 10_000):
            columns = list(zip(*rows[at:at + 10_000]))
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(c, pa.int32()) for c in columns[:3]), pa.array(columns[3], pa.int64()),
                 pa.array(columns[4], pa.string())], ["dim", "i", "j", "n", "total"])

    return run


def _summed(distinct: DataFrame, mean: dict[int, np.ndarray] | None) -> list:
    """One row per dimension or pair of dimensions."""
    return distinct.mapInArrow(_sums(mean), "dim int, i int, j int, n long, total string") \
        .groupBy("dim", "i", "j").agg(F.sum("n").alias("n"),
                                      F.sum(F.col("total").cast(WIDE)).alias("total")).collect()


def covariance(n: int, rest: list[int], squares: dict[tuple[int, int], int]) -> np.ndarray:
    """The matrix from the sums of centred values and of their squares, alone and in sums of two."""
    dim = len(rest)

    def spread(i: int, j: int) -> int:  # n * n times the variance of i, or of the sum of i and j
        r = rest[i] if i == j else rest[i] + rest[j]
        return n * squares[i, j] - r * r

    own = [spread(i, i) for i in range(dim)]
    matrix = np.empty((dim, dim))
    for i in range(dim):
        matrix[i, i] = own[i] / (n * n)
        for j in range(i + 1, dim):
            matrix[i, j] = matrix[j, i] = (spread(i, j) - own[i] - own[j]) / (2 * n * n)
    return matrix


def _check(models: dict[int, Whitening]):
    """Sums of the whitened values and of their products."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for dim, part, x in _blocks(batch):
                if dim in models:
                    w = np.hstack([models[dim].project(x), np.ones((len(part), 1))])
                    totals[dim] = totals.get(dim, 0) + w.T @ w
        for dim, total in totals.items():
            i, j = np.indices(total.shape)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(i.size, dim), pa.int32()), pa.array(i.ravel(), pa.int32()),
                 pa.array(j.ravel(), pa.int32()), pa.array(total.ravel())],
                ["dim", "i", "j", "total"])

    return run


def fit(distinct: DataFrame, components: int = COMPONENTS) -> dict[int, Whitening]:
    """A whitening per length, from its distinct vectors."""
    mean: dict[int, dict[int, int]] = {}
    for row in _summed(distinct, None):
        mean.setdefault(row["dim"], {})[row["i"]] = int(row["total"]) // row["n"]
    centre = {dim: np.array([m[i] for i in range(dim)], np.int64) for dim, m in mean.items()}
    rest: dict[int, dict[int, int]] = {}
    squares: dict[int, dict[tuple[int, int], int]] = {}
    counts = {}
    for row in _summed(distinct, centre):
        counts[row["dim"]] = row["n"]
        if row["j"] is None:
            rest.setdefault(row["dim"], {})[row["i"]] = int(row["total"])
        else:
            squares.setdefault(row["dim"], {})[row["i"], row["j"]] = int(row["total"])
    models = {}
    for dim, n in counts.items():
        left = [rest[dim][i] for i in range(dim)]
        matrix = covariance(n, left, squares[dim])
        values, vectors = np.linalg.eigh(matrix)
        values, vectors = values[::-1], vectors[:, ::-1]
        used = min(components, int((values > max(values[0], 0) * _NOTHING).sum()))
        if used:
            models[dim] = Whitening(centre[dim], left, n, vectors[:, :used], values[:used],
                                    float(np.trace(matrix)))
    sums = distinct.mapInArrow(_check(models), "dim int, i int, j int, total double") \
        .groupBy("dim", "i", "j").agg(F.sum("total").alias("total")).collect()
    for dim, model in models.items():
        k = len(model.values)
        total = np.zeros((k + 1, k + 1))
        for row in sums:
            if row["dim"] == dim:
                total[row["i"], row["j"]] = row["total"]
        average = total[:k, k] / model.n
        model.error = float(np.abs(
            total[:k, :k] / model.n - np.outer(average, average) - np.eye(k)).max())
    return models


def _whitened(models: dict[int, Whitening]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, part, x in _blocks(batch):
                model = models.get(dim)
                if model is None:
                    continue
                k, d = len(model.values), x - model.mean
                largest = model.n * int(np.abs(d).max()) + max(map(abs, model.rest))
                if dim * largest * largest < 2 ** 63:
                    far = d * model.n - np.array(model.rest)
                else:
                    far = d.astype(object) * model.n - np.array(model.rest, object)
                deviation = (far * far).sum(axis=1)
                rows = np.repeat(np.arange(len(part)), k)
                yield pa.RecordBatch.from_arrays(
                    [batch["vec_id"].take(pa.array(part[rows])),
                     pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(part))),
                     pa.array(np.full(len(rows), model.n, np.int64)),
                     pa.array([str(v) for v in deviation.tolist()], pa.string())
                     .take(pa.array(rows)),
                     pa.array(model.project(x).ravel()),
                     pa.array(np.tile(model.values / model.trace, len(part))),
                     pa.array(np.full(len(rows), model.error))],
                    ["vec_id", "component", "n", "deviation", "whitened", "explained",
                     "identity_error"])

    return run


def whiten(table: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """A row per usable vector and component, numbered from 1 by falling variance.

    ``n`` counts the distinct vectors, ``deviation`` is the exact sum over dimensions of
    (n x - S)**2, ``whitened`` the centred vector on the component in units of its standard
    deviation, ``explained`` the component's share of the variance, and ``identity_error`` the
    largest entry by which the covariance of ``whitened``, as measured, is off the identity.
    """
    rows = integers(table)
    models = fit(stored(rows.select("x").distinct(), "whitening-distinct"), components)
    return rows.mapInArrow(
        _whitened(models), "vec_id bigint, component int, n bigint, deviation string, "
        "whitened double, explained double, identity_error double").withColumn(
        "deviation", F.col("deviation").cast(WIDE))
