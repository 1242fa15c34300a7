"""Whitening of embeddings from polarised covariances.

Entries are scaled to whole numbers, so all sums are exact. A first pass counts the vectors and sums each dimension. A second one centres entries at the whole part of the mean and adds up the squares of each
dimension and of the sum of each two dimensions; the rest of the mean, a fraction, is taken out of the totals as whole numbers. The variance of a sum of two is the sum of their variances and twice
their covariance, so differences of variances give all covariances. What tasks send has as many numbers as pairs of dimensions, however many rows there are. The covariance's eigenvectors come from `eigh` on the driver, and
a third pass projects the vectors; a pass over the projections measures how far their covariance is from the identity.

Squares are added up in 64-bit numbers as long as they fit, otherwise without bound, so totals never lose a digit.

Defined cases: vectors that are null or hold null or non-finite entries are dropped, and so are empty ones and those whose length is not the most frequent one (of several the greatest); entries of over 2 ** 60 / `SCALE`
count as that; a null id is kept; repeated rows count each; components with an eigenvalue that is zero but for rounding have no rows; a deviation that no long holds is null; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fixlake.llm.common import bounded

SCALE = 64
SHIFT = 1_000_000
COMPONENTS = 32
#: Rows of vectors that are worked on at once.
STEP = 1024
#: Scaled entries are held within this.
MOST = 1 << 60


def _matrix(column: pa.Array, size: int | None) -> tuple[np.ndarray, np.ndarray]:
    """(rows that are kept, their vectors) of a batch; size None: kept are all that are whole, and the vectors' lengths come instead."""
    lengths = np.asarray(column.value_lengths().fill_null(0), dtype=np.int64)
    values = column.flatten()
    bad = np.asarray(values.is_null()) | ~np.isfinite(values.fill_null(0).to_numpy(zero_copy_only=False).astype(np.float64))
    ends = np.cumsum(lengths)
    held = np.concatenate(([0], np.cumsum(bad)))
    good = (held[ends] == held[ends - lengths]) & (lengths > 0)
    if size is None:
        return np.flatnonzero(good), lengths
    rows = np.flatnonzero(good & (lengths == size))
    at = (ends - lengths)[rows][:, None] + np.arange(size)
    return rows, values.fill_null(0).to_numpy(zero_copy_only=False).astype(np.float64)[at] if len(rows) else np.zeros((0, size))


def _scaled(vectors: np.ndarray) -> np.ndarray:
    return np.clip(np.floor(SCALE * vectors), -MOST, MOST).astype(np.int64) + SHIFT


def _exact(x: np.ndarray) -> list[int]:
    """Sums of the columns of whole numbers."""
    if len(x) and int(np.abs(x).max()) > (1 << 62) // len(x):
        x = x.astype(object)
    return [int(v) for v in x.sum(axis=0)]


def _squares(y: np.ndarray, i: int) -> list[int]:
    """Sums of the squares of column i and of its sums with each later one."""
    u = y[:, i:].copy()
    u[:, 1:] += y[:, i : i + 1]
    if len(u) and int(np.abs(u).max()) ** 2 * len(u) >= 1 << 62:
        u = u.astype(object)
    return [int(v) for v in (u * u).sum(axis=0)]


def _decimals(values: list[int]) -> pa.Array:
    return pa.array([Decimal(v) for v in values], pa.decimal128(38, 0))


def _vectors(df: DataFrame, vector: str, size: int) -> tuple:
    """A function that gives the scaled vectors of batches in steps."""

    def steps(batches: Iterator[pa.RecordBatch], column: int = 0) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
        for batch in bounded(batches):
            rows, vectors = _matrix(batch.column(column), size)
            for at in range(0, len(rows), STEP):
                yield batch, rows[at : at + STEP], _scaled(vectors[at : at + STEP])

    return df.select(vector), steps


def _size(df: DataFrame, vector: str) -> int:
    """The vectors' most frequent length; 0 if there are none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches):
            rows, lengths = _matrix(batch.column(0), None)
            sizes, counts = np.unique(lengths[rows], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(sizes), pa.array(counts)], names=["size", "c"])

    found = df.select(vector).mapInArrow(run, "size long, c long").groupBy("size").agg(F.sum("c").alias("c")).orderBy(F.desc("c"), F.desc("size")).first()
    return found["size"] if found else 0


def _sums(df: DataFrame, vector: str, size: int) -> tuple[int, list[int]]:
    """(vectors, sum of each dimension)."""
    source, steps = _vectors(df, vector, size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals, n = [0] * size, 0
        for _, rows, x in steps(batches):
            totals, n = [a + b for a, b in zip(totals, _exact(x), strict=True)], n + len(rows)
        yield pa.RecordBatch.from_arrays([pa.array(range(-1, size), pa.int32()), _decimals([n, *totals])], names=["i", "s"])

    found = {r["i"]: int(r["s"]) for r in source.mapInArrow(run, "i int, s decimal(38,0)").groupBy("i").agg(F.sum("s").cast("decimal(38,0)").alias("s")).collect()}
    return found.get(-1, 0), [found.get(i, 0) for i in range(size)]


def _square_sums(df: DataFrame, vector: str, size: int, centre: list[int]) -> dict[tuple[int, int], int]:
    """The sum of squares, about the centre, of each dimension (i, i) and of the sum of each two (i, j)."""
    source, steps = _vectors(df, vector, size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = [[0] * (size - i) for i in range(size)]
        for _, _, x in steps(batches):
            y = x - np.array(centre, dtype=np.int64)
            for i in range(size):
                totals[i] = [a + b for a, b in zip(totals[i], _squares(y, i), strict=True)]
        for i in range(size):
            yield pa.RecordBatch.from_arrays([pa.array([i] * (size - i), pa.int32()), pa.array(range(i, size), pa.int32()), _decimals(totals[i])], names=["i", "j", "s"])

    found = source.mapInArrow(run, "i int, j int, s decimal(38,0)").groupBy("i", "j").agg(F.sum("s").cast("decimal(38,0)").alias("s"))
    return {(r["i"], r["j"]): int(r["s"]) for r in found.collect()}


@dataclass
class Whitener:
    """What is fitted: n vectors, whole part and rest of each dimension's sum, covariance, and components (rows) with their eigenvalues, greatest first."""

    n: int
    sums: list[int]
    covariance: np.ndarray
    components: np.ndarray
    values: np.ndarray
    trace: float

    def centred(self, x: np.ndarray) -> np.ndarray:
        whole = np.array([s // self.n for s in self.sums], dtype=np.int64)
        return (x - whole) - np.array([s % self.n / self.n for s in self.sums])

    def project(self, x: np.ndarray) -> np.ndarray:
        return (self.centred(x) @ self.components.T) / np.sqrt(self.values)

    def deviations(self, x: np.ndarray) -> list[int]:
        """The sum over dimensions of (n * x - sum) ** 2, exactly."""
        whole, rest = [s // self.n for s in self.sums], [s % self.n for s in self.sums]
        y = x - np.array(whole, dtype=np.int64)
        most = (int(np.abs(y).max(initial=0)) + 1) * self.n
        if most * most * len(whole) < 1 << 62:
            z = self.n * y - np.array(rest, dtype=np.int64)
        else:
            z = self.n * y.astype(object) - np.array(rest, dtype=object)
        return [int(v) for v in (z * z).sum(axis=1)]


def fit(df: DataFrame, vector: str = "embedding", components: int = COMPONENTS) -> Whitener | None:
    """The whitener of all vectors, or None if there are none."""
    size = _size(df, vector)
    n, sums = _sums(df, vector, size) if size else (0, [])
    if not n:
        return None
    squares = _square_sums(df, vector, size, [s // n for s in sums])
    rest = [s % n for s in sums]
    # n * n times the variances of dimensions and of their sums: the whole mean is taken off already, the rest's square goes now
    variance = lambda i, j: n * squares[i, j] - (rest[i] if i == j else rest[i] + rest[j]) ** 2
    own = [variance(i, i) for i in range(size)]
    covariance = np.empty((size, size))
    for i in range(size):
        for j in range(i, size):
            covariance[i, j] = covariance[j, i] = (2 * own[i] if i == j else variance(i, j) - own[i] - own[j]) / (2 * n * n)
    values, vectors = np.linalg.eigh(covariance)
    order = np.argsort(-values, kind="stable")[:components]
    order = order[values[order] > size * np.finfo(np.float64).eps * max(values.max(), 0)]
    rows = vectors.T[order]
    rows *= np.sign(rows[np.arange(len(rows)), np.abs(rows).argmax(axis=1)])[:, None]
    return Whitener(n, sums, covariance, rows, values[order], sum(own) / (n * n))


def identity_error(df: DataFrame, model: Whitener, vector: str = "embedding") -> float:
    """The largest entry, without sign, of the whitened vectors' covariance minus the identity, from the vectors as they are projected."""
    source, steps = _vectors(df, vector, len(model.sums))
    many = len(model.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, square = np.zeros(many), np.zeros((many, many))
        for _, _, x in steps(batches):
            w = model.project(x)
            total += w.sum(axis=0)
            square += w.T @ w
        i, j = np.indices((many + 1, many)).reshape(2, -1)
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(np.vstack((total, square)).reshape(-1))], names=["i", "j", "s"])

    found = np.zeros((many + 1, many))
    for r in source.mapInArrow(run, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect():
        found[r["i"], r["j"]] = r["s"] / model.n
    return float(np.abs(found[1:] - np.outer(found[0], found[0]) - np.eye(many)).max(initial=0.0))


def whitened(df: DataFrame, model: Whitener, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(key, component, n, deviation, whitened, explained, identity_error) of each vector and component."""
    error = identity_error(df, model, vector)
    _, steps = _vectors(df, vector, len(model.sums))
    many = len(model.values)
    explained = model.values / model.trace
    kind = df.schema[key].dataType.simpleString()
    fields = ["component", "n", "deviation", "whitened", "explained", "identity_error"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, rows, x in steps(batches, 1):
            deviation = pa.array([v if v < 1 << 63 else None for v in model.deviations(x)], pa.int64())
            each = np.repeat(np.arange(len(rows)), many)
            columns = [
                pa.array(np.tile(np.arange(1, many + 1, dtype=np.int32), len(rows))), pa.array(np.full(len(each), model.n)), deviation.take(pa.array(each)),
                pa.array(model.project(x).reshape(-1)), pa.array(np.tile(explained, len(rows))), pa.array(np.full(len(each), error)),
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows[each])), *columns], names=[batch.schema.names[0], *fields])

    schema = f"`{key}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    return df.select(key, vector).mapInArrow(run, schema)


def whiten(df: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """Fit and project: the whitened components of all vectors of df."""
    model = fit(df, vector, components)
    if model is None:
        model = Whitener(1, [0], np.zeros((1, 1)), np.zeros((0, 1)), np.zeros(0), 1.0)
    return whitened(df, model, key, vector)
