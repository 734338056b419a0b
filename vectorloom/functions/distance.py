"""Distances, each as a column expression and as a numpy kernel over blocks of rows.

A metric of one's own needs ``column``; with ``block`` it also runs in the block kernels, and without
it these apply ``column`` to joined rows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vectors as V


@dataclass(frozen=True)
class Metric:
    name: str
    column: Callable[[Column, Column], Column]
    block: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None
    normalize_centroids: bool = False
    #: |x_i - y_i| <= bound(distance) for every coordinate, where such a bound exists: what grids and projections rely on.
    bound: Callable[[float], float] | None = None
    nonnegative: bool = True
    #: How distances come to keep the triangle inequality: "plain" as they are, "root" by their square root, "angle" as the angle whose
    #: cosine is one less them; None where they don't. What cells of pivots rely on.
    triangle: str | None = None
    #: The power of a distance that is the squared Euclidean one, so that products of rows tell what can be near; None for other metrics.
    power: int | None = None
    #: (row, column, distance) of the rows of two blocks at most a limit apart, where that takes less than all distances; None if it doesn't.
    near: Callable[[np.ndarray, np.ndarray, float], tuple[np.ndarray, np.ndarray, np.ndarray]] | None = None


def by_products(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float] | None:
    """Squared Euclidean distances by one product of matrices, about the mean of y, and by how much they may be off; None if that isn't bounded.

    A tenth or less of what differences cost. Products cancel where rows are near each other for their length, so these numbers only
    tell what may be near; what is kept is worked out by differences (``of_rows``).
    """
    if not len(x) or not len(y):
        return np.empty((len(x), len(y))), 0.0
    with np.errstate(all="ignore"):
        middle = y.mean(0)
        x, y = x - middle, y - middle
        xx, yy = np.einsum("ij,ij->i", x, x), np.einsum("ij,ij->i", y, y)
        off = float(4 * (x.shape[1] + 8) * np.finfo(np.float64).eps * (xx.max() + yy.max()))
        if not np.isfinite(off):
            return None
        d = x @ y.T
        d *= -2
        d += xx[:, None]
        d += yy
    return d, off


def of_rows(metric: Metric, x: np.ndarray, y: np.ndarray, row: np.ndarray, column: np.ndarray) -> np.ndarray:
    """Distances of the pairs (row, column) by differences, for a metric with a ``power``: the same bits as its ``block`` gives."""
    out = np.empty(len(row))
    step = max(1, 1_000_000 // max(1, x.shape[1]))
    for a in range(0, len(row), step):
        out[a : a + step] = ((x[row[a : a + step]] - y[column[a : a + step]]) ** 2).sum(1)
    return np.sqrt(out) if metric.power == 2 else out


def within(metric: Metric, x: np.ndarray, y: np.ndarray, limit: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, distance) of pairs at most limit apart."""
    if metric.near is not None and len(x) and len(y):
        return metric.near(x, y, limit)
    near = by_products(x, y) if metric.power else None
    if near is None:
        d = metric.block(x, y) if len(x) and len(y) else np.empty((len(x), len(y)))
        row, column = np.nonzero(d <= limit)
        return row, column, d[row, column]
    if limit < 0:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    row, column = np.nonzero(near[0] <= limit**metric.power * (1 + 1e-12) + near[1])
    d = of_rows(metric, x, y, row, column)
    return row[d <= limit], column[d <= limit], d[d <= limit]


def below(metric: Metric, x: np.ndarray, y: np.ndarray, limit: float) -> np.ndarray:
    """Whether rows are less than limit apart, for all pairs; distances are worked out by differences only where products leave that open."""
    near = by_products(x, y) if metric.power and limit > 0 else None
    if near is None:
        return metric.block(x, y) < limit if len(x) and len(y) else np.zeros((len(x), len(y)), bool)
    d, off = near
    d -= limit**metric.power
    off += limit**metric.power * 1e-12
    out = d < -off
    row, column = np.divmod(np.flatnonzero(np.abs(d, out=d) <= off), max(1, len(y)))
    out[row, column] = of_rows(metric, x, y, row, column) < limit
    return out


def for_sums(metric: Metric, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """All distances, within 1e-10 of their size: by differences where products would be off by more."""
    near = by_products(x, y) if metric.power else None
    if near is None:
        return metric.block(x, y)
    d, off = near
    row, column = np.nonzero(d <= off * 1e10)
    if len(row) * 8 > d.size:
        return metric.block(x, y)
    d[row, column] = 1.0
    if metric.power == 2:
        np.sqrt(d, out=d)
    d[row, column] = of_rows(metric, x, y, row, column)
    return d


def _squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """By differences, not by products, which cancel far from the origin; in slices of bounded memory."""
    out = np.empty((len(x), len(y)))
    step = max(1, 4_000_000 // max(1, y.size))
    for a in range(0, len(x), step):
        out[a : a + step] = ((x[a : a + step, None, :] - y[None, :, :]) ** 2).sum(2)
    return out


def _cosine(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    norms = np.outer((x**2).sum(1), (y**2).sum(1))
    return np.where(norms < V.COSINE_FLOOR, 0.0, 1 - (x @ y.T) / np.sqrt(np.maximum(norms, V.COSINE_FLOOR)))


def _cosine_column(x: Column, y: Column) -> Column:
    norms = V.squared_norm(x) * V.squared_norm(y)
    return F.when(norms < V.COSINE_FLOOR, F.lit(0.0)).otherwise(1 - V.dot(x, y) / F.sqrt(norms))


def _squared_column(x: Column, y: Column) -> Column:
    return V.total(F.zip_with(x, y, lambda a, b: (a - b) * (a - b)))


SQUARED_EUCLIDEAN = Metric("sqeuclidean", _squared_column, _squared, bound=lambda d: d**0.5, triangle="root", power=1)
EUCLIDEAN = Metric("euclidean", lambda x, y: F.sqrt(_squared_column(x, y)), lambda x, y: np.sqrt(_squared(x, y)), bound=lambda d: d, triangle="plain", power=2)
COSINE = Metric("cosine", _cosine_column, _cosine, normalize_centroids=True, triangle="angle")
INNER_PRODUCT = Metric("inner", lambda x, y: -V.dot(x, y), lambda x, y: -(x @ y.T), nonnegative=False)


def composite(a: Metric, b: Metric, weight_a: float, weight_b: float) -> Metric:
    """A weighted sum of two metrics; the weights are taken as they are."""
    block = (lambda x, y: weight_a * a.block(x, y) + weight_b * b.block(x, y)) if a.block and b.block else None
    return Metric(f"composite({a.name},{b.name})", lambda x, y: weight_a * a.column(x, y) + weight_b * b.column(x, y), block, nonnegative=a.nonnegative and b.nonnegative and min(weight_a, weight_b) >= 0)
