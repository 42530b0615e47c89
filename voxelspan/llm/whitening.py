"""Whitening of embeddings with covariances by polarisation, exact in whole numbers.

1. ``entries``: each entry c becomes the whole number floor(64 c) + 1,000,000.
2. ``fit``: the distinct vectors give their number n and the sums S of each dimension; d is an entry less the whole number
   nearest its dimension's mean. Each task squares and sums d_i + d_j for every pair of dimensions (for i = j, d_i itself),
   in whole numbers; Spark adds the tasks' sums up. The rest of the centring, below one half, is subtracted exactly from the
   sums: the variance of x_i + x_j times n n is n Q_ij - (A_i + A_j)^2, with A the sums of d.
3. Half the difference of that variance and those of x_i and x_j is their covariance. ``eigh`` of the matrix gives
   the components. The driver holds numbers of dimensions and pairs of dimensions, never of rows.
4. ``whiten`` projects all rows.

Defined results: a row takes no part if its vector is null or holds a null or an entry that is not finite, or if its length is
not the most common one of the others (of equally common ones the longest); entries beyond 2^40 / 64 count as that bound; a
deviation beyond a long is null; repeated rows come out each for itself, and so do rows whose id is null; where a
component has no variance its ``whitened`` is null; without any variance ``explained`` is null too; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from .shared import stored

SCALE, SHIFT, BOUND = 64, 1_000_000, 2.0**40
COMPONENTS = 16
#: Rows that a task squares at a time.
BLOCK = 4096


@dataclass
class Model:
    """Of the fit list: number of vectors, sums and covariance of the dimensions; eigenvalues, falling, and components as columns."""

    n: int
    sums: list[int]
    covariance: np.ndarray
    values: np.ndarray
    vectors: np.ndarray

    def scaled(self, k: int) -> np.ndarray:
        """The first k components over the roots of their eigenvalues; NaN where there is no variance."""
        least = self.values[0] * len(self.sums) * 2.0**-52
        root = np.sqrt(np.where(self.values[:k] > least, self.values[:k], np.nan))
        return self.vectors[:, :k] / root


def entries(df: DataFrame, vector: str, *keep: str) -> DataFrame:
    """(*keep, x) of the rows that take part."""
    odd = lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf"))
    rows = df.select(*keep, F.col(vector).cast("array<double>").alias("_v")).where(F.col("_v").isNotNull() & ~F.exists("_v", odd))
    usual = rows.groupBy(F.size("_v").alias("k")).count().orderBy(F.desc("count"), F.desc("k")).first()
    if usual is None:
        return rows.select(*keep, F.expr("cast(null as array<bigint>)").alias("x")).where(F.lit(False))
    whole = lambda e: F.floor(F.greatest(F.least(e * SCALE, F.lit(BOUND)), F.lit(-BOUND))).cast("long") + SHIFT
    return rows.where(F.size("_v") == usual["k"]).select(*keep, F.transform("_v", whole).alias("x"))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), -1)


def _added(parts: DataFrame, *key: str) -> dict:
    """Sums of ``v`` by key, as whole numbers. As many rows as there are keys."""
    return {tuple(r[k] for k in key): int(r["v"]) for r in parts.groupBy(*key).agg(F.sum("v").cast("decimal(38,0)").alias("v")).collect()}


def totals(points: DataFrame) -> tuple[int, list[int]]:
    """Number of rows and the sum of each dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, None
        for batch in batches:
            x = _matrix(batch.column(0))
            n += len(x)
            part = x.sum(0).astype(object)
            sums = part if sums is None else sums + part
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([-1, *range(len(sums))], pa.int32()), pa.array([n, *sums.tolist()], pa.decimal128(38, 0))], ["i", "v"])

    held = _added(points.select("x").mapInArrow(run, "i int, v decimal(38,0)"), "i")
    return held.pop((-1,), 0), [held[(i,)] for i in range(len(held))]


def squares(points: DataFrame, centre: list[int]) -> dict[tuple[int, int], int]:
    """Sum of (d_i + d_j)^2 for i < j, and of d_i^2 for i = j, over all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = len(centre)
        total = np.zeros((size, size), object)
        some = False
        for batch in batches:
            x = _matrix(batch.column(0))
            for at in range(0, len(x), BLOCK):
                some = True
                d = np.ascontiguousarray((x[at : at + BLOCK] - np.asarray(centre)).T)
                if int(np.abs(d).max(initial=0)) >= 2**24:  # the block's sums could leave 64 bits
                    d = d.astype(object)
                part = np.zeros((size, size), d.dtype)
                for i in range(size):
                    t = d[i] + d[i:]
                    t[0] = d[i]
                    part[i, i:] = (t * t).sum(1) if d.dtype == object else np.einsum("ij,ij->i", t, t)
                total = total + part.astype(object)
        if some:
            i, j = np.triu_indices(size)
            yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total[i, j].tolist(), pa.decimal128(38, 0))], ["i", "j", "v"])

    return _added(points.select("x").mapInArrow(run, "i int, j int, v decimal(38,0)"), "i", "j")


def fit(points: DataFrame) -> Model | None:
    """Model of the rows of ``points(x)``, of which a distinct one counts once; None without rows or dimensions."""
    n, sums = totals(points)
    if not sums:
        return None
    size = len(sums)
    centre = [(2 * s + n) // (2 * n) for s in sums]
    rest = [s - n * c for s, c in zip(sums, centre, strict=True)]
    q = squares(points, centre)
    spread = [n * q[(i, i)] - rest[i] ** 2 for i in range(size)]  # variance times n n
    v = np.zeros((size, size))
    for (i, j), x in q.items():
        both = spread[i] if i == j else n * x - (rest[i] + rest[j]) ** 2
        v[i, j] = v[j, i] = both / n**2 if i == j else (both - spread[i] - spread[j]) / (2 * n**2)
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1], vectors[:, ::-1]
    vectors = vectors * np.where(vectors[np.abs(vectors).argmax(0), np.arange(size)] < 0, -1.0, 1.0)  # of each component the largest entry is positive
    return Model(n, sums, v, np.maximum(values, 0.0), vectors)


def _centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n x - S in whole numbers."""
    large = n * (int(np.abs(x).max(initial=0)) + 1) >= 2**61
    return (x.astype(object) if large else x) * n - np.asarray(sums, object if large else np.int64)


def whiten(rows: DataFrame, model: Model, k: int = COMPONENTS) -> DataFrame:
    """Rows of ``rows(.., x)`` with ``deviation``, the sum of squares of n x - S, and ``whitened``, an array of the first k components."""
    n, sums, scaled = model.n, model.sums, model.scaled(k)
    keep = [f for f in rows.schema if f.name != "x"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u = _centred(_matrix(batch.column("x")), n, sums)
            if u.dtype != object and int(np.abs(u).max(initial=0)) ** 2 * max(1, u.shape[1]) < 2**63:
                deviation = np.einsum("ij,ij->i", u, u).tolist()
            else:
                wide = u.astype(object)
                deviation = [int(s) if s < 2**63 else None for s in (wide * wide).sum(1)]
            z = (u / n).astype(float) @ scaled
            flat = pa.array(z.reshape(-1), mask=np.isnan(z.reshape(-1)))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(z) + 1, dtype=np.int32) * z.shape[1]), flat)
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in keep), pa.array(deviation, pa.int64()), lists], [*(f.name for f in keep), "deviation", "whitened"])

    return rows.mapInArrow(run, StructType([*keep, StructField("deviation", LongType()), StructField("whitened", ArrayType(DoubleType()))]))


def identity_error(points: DataFrame, model: Model, k: int = COMPONENTS) -> float | None:
    """Largest absolute entry of the whitened fit list's covariance minus the identity; None if no component has variance."""
    n, sums, scaled = model.n, model.sums, model.scaled(k)
    scaled = scaled[:, ~np.isnan(scaled).any(0)]
    size = scaled.shape[1]
    if not size:
        return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram, mean = np.zeros((size, size)), np.zeros(size)
        for batch in batches:
            z = (_centred(_matrix(batch.column(0)), n, sums) / n).astype(float) @ scaled
            gram, mean = gram + z.T @ z, mean + z.sum(0)
        i, j = np.indices((size + 1, size)).reshape(2, -1)
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(np.vstack([gram, mean]).reshape(-1))], ["i", "j", "v"])

    held = np.zeros((size + 1, size))
    for r in points.select("x").mapInArrow(run, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
        held[r["i"], r["j"]] = r["v"]
    mean = held[-1] / n
    return float(np.abs(held[:-1] / n - np.outer(mean, mean) - np.eye(size)).max())


def distinct_points(rows: DataFrame) -> DataFrame:
    """The fit list: each x once, stored."""
    return stored(rows.select("x").distinct(), "points")


def whitened_components(df: DataFrame, name: str, vector: str, k: int = COMPONENTS) -> DataFrame:
    """(name, component, n, deviation, whitened, explained, identity_error) of each row that takes part and component up to k."""
    rows = entries(df, vector, name)
    points = distinct_points(rows)
    model = fit(points)
    out = ["component int", "n long", "deviation long", "whitened double", "explained double", "identity_error double"]
    if model is None:
        return rows.select(name, *(F.lit(None).cast(c.split()[1]).alias(c.split()[0]) for c in out)).where(F.lit(False))
    trace, error = float(np.trace(model.covariance)), identity_error(points, model, k)
    shares = [float(e) / trace if trace > 0 else None for e in model.values[:k]]
    long = whiten(rows, model, k).select(name, "deviation", F.posexplode("whitened").alias("_k", "whitened"))
    share = F.get(F.array(*(F.lit(s).cast("double") for s in shares)), F.col("_k"))
    return long.select(
        name, (F.col("_k") + 1).cast("int").alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
        share.alias("explained"), F.lit(error).cast("double").alias("identity_error"),
    )
