"""Embedding whitening: principal components of integer vectors, each scaled to unit variance.

1. Every partition takes its rows batch by batch: the count, the sums (integers, so the local mean is exact) and the
   scatter centred on the local mean. Two such states are merged by Chan's pairwise formula, within a partition and then
   between partitions in a treeReduce; the driver gets one state of dimensions^2 numbers and finds the eigenvectors.
2. A second pass gathers, in the same way, the covariance of the whitened values and compares it with the identity.
3. The rows are written with the verified model. Nothing but the model is broadcast, and no row is shuffled.

Sums stay exact at any size (Python integers); a deviation that doesn't fit 64 bits is null.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.shared import table

SCALE, OFFSET = 64, 1_000_000
COMPONENTS = 32
#: Eigenvalues up to this share of the largest count as zero: their components have no whitened value.
ZERO = 1e-12
#: Integers beyond it are clipped, so that 64 bits hold them.
_MOST = 1 << 61
_TOGETHER = 4096
SCHEMA = "component int, n long, deviation long, whitened double, explained double, identity_error double"


class State(NamedTuple):
    """Count, sums (Python integers, so of any size) and centred scatter of integer vectors."""

    n: int
    sums: np.ndarray
    scatter: np.ndarray


def of(x: np.ndarray) -> State:
    """The state of a batch of rows of int64."""
    n, sums = len(x), x.sum(0, dtype=object) if len(x) and np.abs(x).max() > _MOST // len(x) else x.sum(0)
    z = centred(x, n, sums)
    return State(n, np.array([int(s) for s in sums], object), z.T @ z)


def centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """x - sums / n, from exact numerators where 64 bits hold them."""
    return scaled(x, n, sums).astype(np.float64) / n


def scaled(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """n * x - sums, exact: of int64, or of Python integers beyond 64 bits."""
    most = max((abs(int(s)) for s in sums), default=0) + n * int(np.abs(x).max(initial=0))
    if most < 1 << 62:
        return n * x - np.array(sums, np.int64)
    return n * x.astype(object) - np.array(sums, object)


def merged(a: State | None, b: State | None) -> State | None:
    """Chan's formula: the scatter of two parts is the sum of theirs and that of their means."""
    if a is None or b is None:
        return b if a is None else a
    n = a.n + b.n
    gap = np.array([(int(t) * a.n - int(s) * b.n) / (a.n * b.n) for s, t in zip(a.sums, b.sums, strict=True)])
    return State(n, a.sums + b.sums, a.scatter + b.scatter + np.outer(gap, gap) * (a.n * b.n / n))


def usable(vectors: DataFrame, column: str) -> DataFrame:
    """The rows whose vector is an array without null or non-finite entries, as doubles in `__v`."""
    v = F.col(column).cast("array<double>")
    return vectors.withColumn("__v", v).filter(F.col("__v").isNotNull() & ~F.exists("__v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))))


def integers(column: pa.Array, dims: int, scale: int, offset: int) -> np.ndarray:
    """Rows of floor(scale * c) + offset."""
    x = np.floor(column.flatten().to_numpy(zero_copy_only=False) * scale).reshape(-1, dims)
    return np.clip(x, -float(_MOST), float(_MOST)).astype(np.int64) + offset


def whiten(vectors: DataFrame, components: int = COMPONENTS, scale: int = SCALE, offset: int = OFFSET, column: str = "embedding", key: str = "vec_id") -> DataFrame:
    """One row for each usable vector and component: key and SCHEMA.

    A vector that is null or holds null or non-finite entries gives no rows. Where lengths differ, the most frequent one
    counts (of equally frequent ones the longest), and vectors of others give no rows; nor do vectors without entries, or
    an empty table. Repeated rows and null keys are rows like others. `components` beyond the dimensions aren't there.
    Components whose eigenvalue is zero to rounding (a single row, equal rows, fewer rows than dimensions) have a null
    `whitened`; identity_error covers the others (0 if there is none), and explained is 0 where the trace is. Equal
    eigenvalues have some orthonormal basis, one for all rows. An entry beyond 2^61 / scale is clipped; a deviation beyond 64 bits
    is null. Memory of a task: a batch and one state, whatever the rows. Other columns, of whatever name, aren't kept.
    """
    spark, kind = vectors.sparkSession, vectors.schema[key].dataType.simpleString()
    good = usable(vectors.select(F.col(key).alias(key), F.col(column).alias(column)), column)
    common = good.groupBy(F.size("__v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    schema = f"`{key}` {kind}, {SCHEMA}"
    if common is None or not common["d"]:
        return spark.createDataFrame([], schema)
    dims = common["d"]
    good = good.filter(F.size("__v") == dims).select(key, "__v")
    found = _reduced(good.select("__v"), lambda column: of(integers(column, dims, scale, offset)))
    values, axes = np.linalg.eigh(found.scatter / found.n)
    values, axes = values[::-1][:components], axes[:, ::-1][:, :components]
    trace = float(np.trace(found.scatter)) / found.n
    real = values > ZERO * max(values[0], 0.0)
    turn = np.where(real, axes / np.sqrt(np.where(real, values, 1.0)), 0.0)

    def parts(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        d = scaled(x, found.n, found.sums)
        return d, d.astype(np.float64) / found.n @ turn

    def seen(column: pa.Array) -> tuple[int, np.ndarray, np.ndarray]:
        w = parts(integers(column, dims, scale, offset))[1]
        return len(w), w.mean(0), (w - w.mean(0)).T @ (w - w.mean(0))

    n, _, scatter = _reduced(good.select("__v"), seen, _pooled)
    wrong = scatter / n - np.eye(len(values))
    error = float(np.abs(wrong[np.ix_(real, real)]).max(initial=0.0))
    explained = np.maximum(values, 0) / trace if trace > 0 else np.zeros(len(values))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(values)
        for batch in _runs(batches):
            d, w = parts(integers(batch.column("__v"), dims, scale, offset))
            far = int(np.abs(d).max(initial=0)) ** 2 * dims >= 1 << 62
            squares = (d.astype(object) ** 2).sum(1) if far else (d * d).sum(1)
            squares = pa.array([None if s >= 1 << 63 else int(s) for s in squares] if far else squares, pa.int64())
            m, at = len(d), np.repeat(np.arange(len(d)), k)
            yield pa.RecordBatch.from_pydict({
                key: batch.column(key).take(pa.array(at)), "component": pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), "n": pa.array(np.full(m * k, found.n)),
                "deviation": squares.take(pa.array(at)), "whitened": pa.array(w.ravel(), mask=np.tile(~real, m)), "explained": pa.array(np.tile(explained, m)), "identity_error": pa.array(np.full(m * k, error)),
            })

    return good.mapInArrow(rows, schema)


def _pooled(a, b):
    """Chan's formula for means of doubles."""
    if a is None or b is None:
        return b if a is None else a
    n, gap = a[0] + b[0], b[1] - a[1]
    return n, a[1] + gap * (b[0] / n), a[2] + b[2] + np.outer(gap, gap) * (a[0] * b[0] / n)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, _TOGETHER):
            yield batch.slice(at, _TOGETHER)


def _reduced(rows: DataFrame, state, merge=merged):
    """One state of all rows: a state for each partition, merged pairwise in a tree."""
    import pickle

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in _runs(batches):
            held = merge(held, state(batch.column("__v")))
        if held is not None:
            yield pa.RecordBatch.from_pydict({"state": pa.array([pickle.dumps(held)], pa.binary())})

    return rows.mapInArrow(partial, "state binary").rdd.map(lambda r: pickle.loads(bytes(r["state"]))).treeReduce(merge)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))
