"""Embedding whitening along the leading components, by Chebyshev-filtered subspace iteration.

Vectors are put on a grid of whole numbers; the different ones are the fit list. Their
covariance V is never formed: a pass over the list multiplies it with a block Q of columns,
each task returning the sum of X'(XQ) over its centred rows X, as wide as Q and as long as a
vector, whatever the number of rows.

A Rayleigh-Ritz step (QR of the block, then the eigenvectors of Q'VQ) gives estimates and their
residuals. Until the residuals of the wanted components are below TOLERANCE of the largest
eigenvalue, the block goes through a Chebyshev polynomial of V, computed by its three-term
recurrence, one pass a degree. It stays within one on the unwanted part of the spectrum, from 0
to the least estimate in the block, and grows fast beyond. The degree follows from how far the
wanted estimates lie outside. A residual bounds the distance to the next eigenvalue, so the
components that are returned are certified; a block that does not get there in ROUNDS raises.

Defined results for odd input: rows whose vector is null, empty, or holds null or non-finite
entries are left out, and so are vectors whose length is not the most frequent one (of equally
frequent ones the longest stays); equal vectors, under whatever ids, count once in the fit and
get equal results; with fewer dimensions than components, or with components along which all
vectors agree, there are as many as have a variance; a table that holds none gives an empty
result; vectors of any length fit, as a task holds some thousand rows at a time; further
columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import acosh, ceil, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable

COMPONENTS = 4
#: Columns of the block: the more, the further off is the spectrum that has to be damped.
WIDTH = 40
#: Vectors of a task, at least: a pass is short, so that many small tasks would cost more than they do.
TOGETHER = 4096
#: Steps of the grid in a unit.
GRID = 256
TOLERANCE, ROUNDS, MOST_DEGREE, SEED = 1e-12, 40, 64, 11


def on_grid(vectors: DataFrame, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """(vec_id, x): the rows with all entries finite, as whole numbers, of the length that most of them have."""
    c = F.col(vector)
    number = lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))
    rows = vectors.select(F.col(key).alias("vec_id"), F.transform(c, lambda e: e.cast("double")).alias("v")).where((F.size("v") > 0) & F.forall("v", number))
    most = rows.groupBy(F.size("v").alias("len")).count().orderBy(F.desc("count"), F.desc("len")).first()
    return rows.where(F.size("v") == (most["len"] if most else 0)).select("vec_id", F.transform("v", lambda e: F.floor(GRID * e)).alias("x"))


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """The batch's vectors, a row each."""
    return column.values.to_numpy(zero_copy_only=False)[column.offsets[0].as_py() : column.offsets[-1].as_py()].reshape(len(column), -1)


def summed(fit: DataFrame, part) -> np.ndarray:
    """The sum of part(X) over all batches X of the fit list, as a flat array of doubles."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            if b.num_rows:
                found = np.asarray(part(matrix(b.column(0)).astype(np.float64)), np.float64).ravel()
                total = found if total is None else total + found
        if total is not None:
            yield pa.record_batch([pa.array(range(len(total)), pa.int32()), pa.array(total)], ["at", "value"])

    rows = fit.mapInArrow(each, "at int, value double").groupBy("at").agg(F.sum("value").alias("value")).collect()
    return np.array([r["value"] for r in sorted(rows)])


def orthonormal(block: np.ndarray) -> np.ndarray:
    return np.linalg.qr(block)[0]


def ritz(q: np.ndarray, vq: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Estimates of eigenvalues (falling), their vectors, and the vectors times V less the estimates."""
    small = q.T @ vq
    values, turn = np.linalg.eigh((small + small.T) / 2)
    values, turn = values[::-1], turn[:, ::-1]
    vectors = q @ turn
    return values, vectors, vq @ turn - vectors * values


def degree(values: np.ndarray, wanted: int, residual: float) -> int:
    """Passes that bring the residual below the tolerance, by the growth of the polynomial at the last wanted estimate."""
    outside = 2 * values[wanted - 1] / max(values[-1], 1e-300) - 1
    growth = acosh(max(outside, 1 + 1e-9))
    return min(MOST_DEGREE, max(2, ceil(log(max(residual / (TOLERANCE * values[0]), 10) * 4) / growth)))


def components(fit: DataFrame, n: int, mean: np.ndarray, count: int = COMPONENTS, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """The leading eigenvalues of the fit list's covariance, falling, and its unit eigenvectors as columns; the largest entry of each is positive."""
    dims = len(mean)
    width, wanted = min(width, dims), min(count, dims)

    def times(q: np.ndarray) -> np.ndarray:
        def part(x):
            x = x - mean
            return x.T @ (x @ q)

        return summed(fit, part).reshape(dims, -1) / n

    q = orthonormal(np.random.default_rng(SEED).standard_normal((dims, width)))
    for _ in range(ROUNDS):
        values, vectors, rest = ritz(q, times(q))
        residual = np.linalg.norm(rest[:, :wanted], axis=0).max()
        if values[0] <= 0 or residual <= TOLERANCE * values[0]:
            break
        half = max(values[-1], values[0] * 1e-6) / 2  # the unwanted part is [0, 2 * half]
        before, now = vectors, (rest + vectors * values) / half - vectors
        for _ in range(degree(values, wanted, residual) - 1):
            before, now = now, 2 * (times(now) / half - now) - before
        q = orthonormal(now)
    else:
        raise ArithmeticError(f"residual {residual:.3g} after {ROUNDS} rounds")
    kept = [k for k in range(wanted) if values[k] > values[0] * dims * 1e-13 and values[0] > 0]
    vectors = vectors[:, kept]
    return values[kept], vectors * np.sign(vectors[np.abs(vectors).argmax(axis=0), range(len(kept))])


def whitened(vectors: DataFrame, count: int = COMPONENTS, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of every row that takes part and every component."""
    rows = on_grid(vectors, vector, key)
    fit = durable(rows.select("x").distinct())
    n = fit.count()
    fit = fit.coalesce(max(1, n // TOGETHER))
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if not n:
        return fit.sparkSession.createDataFrame([], schema)
    sums = np.array([r["s"] for r in fit.select(F.posexplode("x")).groupBy("pos").agg(F.sum("col").alias("s")).orderBy("pos").collect()], np.int64)
    mean = sums / n
    values, axes = components(fit, n, mean, count)
    if not len(values):
        return fit.sparkSession.createDataFrame([], schema)
    scale = axes / np.sqrt(values)
    trace = summed(fit, lambda x: np.square(x - mean).sum())[0] / n
    middle = summed(fit, lambda x: ((x - mean) @ scale).sum(axis=0)) / n

    def spread(x):
        w = (x - mean) @ scale - middle
        return w.T @ w

    error = float(np.abs(summed(fit, spread).reshape(len(values), -1) / n - np.eye(len(values))).max())
    explained = values / trace

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = matrix(b.column(1)).astype(np.int64)
            away = np.square(n * x - sums).sum(axis=1) if len(x) else np.zeros(0, np.int64)  # whole numbers: exact wherever the result is a long
            k, times = len(values), np.repeat(np.arange(len(x)), len(values))
            white = ((x.reshape(len(x), len(sums)) - mean) @ scale).ravel()
            yield pa.record_batch([
                b.column(0).take(pa.array(times)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.full(len(times), n)), pa.array(away[times]), pa.array(white), pa.array(np.tile(explained, len(x))), pa.array(np.full(len(times), error)),
            ], ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), "x").mapInArrow(each, schema)
