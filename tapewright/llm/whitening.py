"""Whitening of embeddings by mixed-precision eigenvectors of their covariance.

Vectors are taken as integers ``floor(256 c)``. Spark computes what depends on the rows: the distinct vectors, their
exact sums, their centred covariance, the projections. The eigenvectors of the d x d covariance come from a float32
decomposition; Ogita-Aishima iterations, which are matrix products alone, then correct all of them at once in extended
precision. Where eigenvalues lie too close for that, the vectors of a cluster are first turned among themselves by a
small decomposition of the covariance that they span, shifted by its mean, so that its gaps count in full.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapewright.session import settle

COMPONENTS = 4
STEPS = 12
#: Integers beyond this are taken as this, so that sums of a batch stay exact.
LARGEST = 1 << 46
#: A component of less than this share of the variance cannot be divided by.
LEAST_SHARE = 1e-13
SCHEMA = ("vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")


def extended(a: np.ndarray) -> np.ndarray:
    return np.asarray(a, dtype=np.longdouble)


def clusters(values: np.ndarray, gap: float) -> list[np.ndarray]:
    """Runs of two or more sorted values whose neighbours differ by ``gap`` at most, as index arrays."""
    order = np.argsort(values)
    cut = np.flatnonzero(np.diff(values[order]) > gap) + 1
    return [run for run in np.split(order, cut) if len(run) > 1]


def corrected(a: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, float, float]:
    """One Ogita-Aishima step: better vectors, their values, the size of the correction, the gap that it could resolve."""
    r = np.eye(len(a), dtype=np.longdouble) - x.T @ x
    s = x.T @ (a @ x)
    value = np.diag(s) / (1 - np.diag(r))
    off = s - np.diag(value)
    size = float(np.abs(a).sum(axis=1).max())
    gap = 2 * (float(np.sqrt((off * off).sum())) + size * float(np.sqrt((r * r).sum())))
    apart = value[None, :] - value[:, None]
    near = np.abs(apart) <= gap
    e = np.where(near, r / 2, (s + value[None, :] * r) / np.where(near, 1, apart))
    return x + x @ e, value, float(np.abs(e).max()), gap


def turned(a: np.ndarray, x: np.ndarray, value: np.ndarray, gap: float) -> np.ndarray:
    """Vectors of every cluster replaced by what diagonalises the covariance inside it: a sub-solve of its size.

    The cluster is shifted by its mean and scaled to one, so that a float32 decomposition sees its gaps.
    """
    x = x.copy()
    for own in clusters(value, gap):
        part = x[:, own]
        part = part @ (1.5 * np.eye(len(own), dtype=np.longdouble) - (part.T @ part) / 2)
        inner = part.T @ (a @ part) - value[own].mean() * (part.T @ part)
        inner = (inner + inner.T) / 2
        scale = np.abs(inner).max()
        if scale > 0:
            _, w = np.linalg.eigh((inner / scale).astype(np.float32))
            w = extended(w)
            w = w @ (1.5 * np.eye(len(own), dtype=np.longdouble) - (w.T @ w) / 2)
            part = part @ w
        x[:, own] = part
    return x


def eigenvectors(covariance: np.ndarray, steps: int = STEPS) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns; largest entry positive) of a symmetric matrix."""
    a = extended(covariance)
    a = (a + a.T) / 2
    size = np.abs(a).max() if a.size else 0
    if not size:
        return np.zeros(len(a)), np.eye(len(a))
    a = a / size
    _, first = np.linalg.eigh(a.astype(np.float32))
    x, best = extended(first), np.inf
    for _ in range(steps):
        better, value, change, gap = corrected(a, x)
        if change < 4 * np.finfo(np.longdouble).eps or (best < 1e-12 and change >= best):
            break
        best = min(best, change)
        x = turned(a, better, value, gap)
    x = x @ (1.5 * np.eye(len(a), dtype=np.longdouble) - (x.T @ x) / 2)
    value = np.diag(x.T @ (a @ x)) / np.diag(x.T @ x)
    x = x / np.sqrt((x * x).sum(axis=0))
    order = np.argsort(-value, kind="stable")
    value, x = value[order] * size, x[:, order]
    x = x * np.where(x[np.abs(x).argmax(axis=0), np.arange(len(a))] < 0, -1, 1)
    return value.astype(np.float64), x.astype(np.float64)


@dataclass
class Whitener:
    """What whitens vectors of one length: ``basis`` has a column per component."""

    n: int
    sums: list[int]
    basis: np.ndarray
    values: np.ndarray
    explained: np.ndarray

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])

    def whiten(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) @ self.basis) / np.sqrt(self.values)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum of (n x - S)^2, exact; null beyond 64 bits."""
        sums = np.array(self.sums, dtype=object)
        if len(x) and self.n * int(np.abs(x).max()) + max(abs(s) for s in self.sums) < int((2**62 / x.shape[1]) ** 0.5):
            d = self.n * x - sums.astype(np.int64)
            return (d * d).sum(axis=1).tolist()
        exact = [sum((self.n * int(c) - s) ** 2 for c, s in zip(row, self.sums, strict=True)) for row in x]
        return [v if v < 2**63 else None for v in exact]


def finite(vector: Column) -> Column:
    """Not null, no null, NaN or infinite component."""
    fine = F.forall(vector, lambda v: F.coalesce((v > float("-inf")) & (v < float("inf")) & ~F.isnan(v), F.lit(False)))
    return F.coalesce(vector.isNotNull() & fine, F.lit(False))


def whole(vector: Column) -> Column:
    """``floor(256 c)`` of every component, cut at ``LARGEST``."""
    edge = F.lit(float(LARGEST))
    return F.transform(vector, lambda c: F.greatest(-edge, F.least(edge, F.floor(c.cast("double") * 256).cast("double"))).cast("long"))


def rows_of(column: pa.Array, width: int) -> np.ndarray:
    """A list column whose rows all have ``width`` values as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def sums_of(points: DataFrame, width: int) -> tuple[int, list[int]]:
    """How many rows, and the exact sum of every component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, [0] * width
        for batch in batches:
            x = rows_of(batch.column(0), width)
            for i in range(0, len(x), 1 << 16):
                total = [t + int(s) for t, s in zip(total, x[i:i + (1 << 16)].sum(axis=0), strict=True)]
            n += len(x)
        if n:
            yield pa.RecordBatch.from_pydict({"at": pa.array(range(-1, width), pa.int32()), "total": pa.array([n, *total]).cast(pa.decimal128(38, 0))})

    found = points.mapInArrow(run, "at int, total decimal(38,0)").groupBy("at").agg(F.sum("total").cast("decimal(38,0)").alias("total")).collect()
    by = {r["at"]: int(r["total"]) for r in found}
    return by.get(-1, 0), [by.get(i, 0) for i in range(width)]


def products_of(points: DataFrame, width: int, out: int, image) -> np.ndarray:
    """Sum of the outer products of ``image`` of every row with itself: one ``out`` x ``out`` matrix per task, added up by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros((out, out)), False
        for batch in batches:
            x = rows_of(batch.column(0), width)
            for i in range(0, len(x), 4096):
                y = image(x[i:i + 4096])
                total += y.T @ y
                seen = True
        if seen:
            at = np.triu_indices(out)
            yield pa.RecordBatch.from_pydict({
                "i": pa.array(at[0], pa.int32()), "j": pa.array(at[1], pa.int32()), "v": pa.array(total[at])})

    found = points.mapInArrow(run, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
    matrix = np.zeros((out, out))
    for r in found:
        matrix[r["i"], r["j"]] = matrix[r["j"], r["i"]] = r["v"]
    return matrix


def fit(points: DataFrame, width: int, components: int = COMPONENTS) -> tuple[Whitener, float]:
    """The whitener of the distinct vectors ``points (x)`` of one length, and how far their whitened covariance is from identity."""
    n, sums = sums_of(points, width)
    mean = np.array([s / n for s in sums])
    covariance = products_of(points, width, width, lambda x: x - mean) / n
    values, vectors = eigenvectors(covariance)
    trace = float(np.trace(covariance))
    kept = int((values[:components] > LEAST_SHARE * trace).sum()) if trace > 0 else 0
    fitted = Whitener(n, sums, vectors[:, :kept], values[:kept], values[:kept] / (trace or 1.0))
    if not kept:
        return fitted, 0.0
    own = products_of(points, width, kept, fitted.whiten) / n
    return fitted, float(np.abs(own - np.eye(kept)).max())


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """``(vec_id, component, n, deviation, whitened, explained, identity_error)`` of every vector and component.

    ``vectors``: vec_id and embedding. Rows whose vector is null or holds null or non-finite components are dropped; a null
    vec_id and repeated rows stay. Vectors of each length are whitened on their own. The fit takes every
    distinct integer vector once. Components number ``components`` at most; those without variance are left out, so a table
    with one distinct vector, like an empty one, gives no rows. ``deviation`` is null beyond 64 bits; integers are cut at
    2^46. Other columns are not read.
    """
    rows = vectors.where(finite(F.col("embedding"))).select(F.col("vec_id").cast("long").alias("vec_id"), whole(F.col("embedding")).alias("x"))
    points = settle(rows.select("x").distinct().select("x", F.size("x").alias("d")), "points")
    widths = [r["d"] for r in points.groupBy("d").count().orderBy("d").collect() if r["d"] and r["count"] > 1]
    parts = [of_width(rows.where(F.size("x") == d), points.where(F.col("d") == d).select("x"), d, components) for d in widths]
    if not parts:
        return vectors.sparkSession.createDataFrame([], SCHEMA)
    return reduce(DataFrame.unionByName, parts)


def of_width(rows: DataFrame, points: DataFrame, width: int, components: int) -> DataFrame:
    fitted, error = fit(points, width, components)
    kept = len(fitted.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = rows_of(batch.column(1), width)
            m = len(x)
            which = np.repeat(np.arange(m), kept)
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(pa.array(which)), pa.array(np.tile(np.arange(1, kept + 1, dtype=np.int32), m)),
                pa.array(np.full(m * kept, fitted.n)), pa.array(fitted.deviations(x), pa.int64()).take(pa.array(which)),
                pa.array(fitted.whiten(x).ravel()), pa.array(np.tile(fitted.explained, m)), pa.array(np.full(m * kept, error))],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(run, SCHEMA)
