"""Associative-memory assignment: hard, soft, and contraction to the fixed points of a soft mixture."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import InvalidParameter
from ..functions.distance import SQUARED_EUCLIDEAN
from .pairs import matrix, nearest_centroid

SETTLED = 1e-10


def assign(p: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(id, label): the nearest centroid by squared distance, the first of equals."""
    return nearest_centroid(p, centroids, SQUARED_EUCLIDEAN).select("id", "label")


def soft_weights(squared: Column, beta: float) -> Column:
    """Shares exp(-beta / 2 d) of an array of squared distances, shifted so that none overflows."""
    logs = F.transform(squared, lambda d: d * F.lit(-beta / 2))
    shifted = F.transform(logs, lambda w: F.exp(w - F.array_max(logs)))
    return F.transform(shifted, lambda w: w / F.aggregate(shifted, F.lit(0.0), lambda s, v: s + v))


def soft_assign(p: DataFrame, centroids: np.ndarray, beta: float) -> DataFrame:
    """(id, cluster, weight): every cluster's share of every point."""
    c = np.asarray(centroids, np.float64)

    def shares(batches):
        import pyarrow as pa

        for batch in batches:
            x = matrix(batch.column(1))
            if not len(x):
                continue
            w = weights(x, c, beta)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column(0).to_numpy(), len(c))), pa.array(np.tile(np.arange(len(c)), len(x))), pa.array(w.ravel())], ["id", "cluster", "weight"])

    return p.select("id", "features").mapInArrow(shares, "id long, cluster long, weight double")


def weights(x: np.ndarray, c: np.ndarray, beta: float) -> np.ndarray:
    logs = -beta / 2 * SQUARED_EUCLIDEAN.block(x, c)
    e = np.exp(logs - logs.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def contracted(x: np.ndarray, c: np.ndarray, beta: float, steps: int, rate: float) -> np.ndarray:
    """Gradient steps v - rate (v - sum of weighted centroids), each point until it moves less than SETTLED."""
    x, moving = x.copy(), np.ones(len(x), bool)
    for _ in range(steps):
        if not moving.any():
            break
        step = rate * (x[moving] - weights(x[moving], c, beta) @ c)
        x[moving] -= step
        moving[np.flatnonzero(moving)[np.linalg.norm(step, axis=1) < SETTLED]] = False
    return x


def contract(p: DataFrame, centroids: np.ndarray, beta: float, steps: int, rate: float) -> DataFrame:
    """(id, features) after contraction."""
    if steps < 0:
        raise InvalidParameter("steps", "can't be negative")
    c = np.asarray(centroids, np.float64)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            x = matrix(batch.column(1))
            if len(x):
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(contracted(x, c, beta, steps, rate)), pa.list_(pa.float64()))], ["id", "features"])

    return p.select("id", "features").mapInArrow(run, "id long, features array<double>")


def loss(p: DataFrame, centroids: np.ndarray, beta: float, steps: int, rate: float) -> DataFrame:
    """(loss): summed squared distance of points from where they contract to."""
    after = contract(p, centroids, beta, steps, rate).withColumnRenamed("features", "y")
    return p.join(after, "id").agg(F.coalesce(F.sum(SQUARED_EUCLIDEAN.column(F.col("features"), F.col("y"))), F.lit(0.0)).alias("loss"))
