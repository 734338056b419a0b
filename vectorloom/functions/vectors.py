"""Vector expressions on ARRAY<DOUBLE> columns; all are built-in functions that Catalyst plans."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

NOISE = -1
#: Below this product of squared norms cosine distance is 0; norms below this stay as they are; least variance.
COSINE_FLOOR, NORM_FLOOR, VARIANCE_FLOOR = 1e-9, 1.1920929e-7, 2.220446049250313e-16
#: Fixed value: the score of clusters without any spread.
LARGEST = 3.4028234663852886e38


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x)


def dot(x: Column, y: Column) -> Column:
    return total(F.zip_with(x, y, lambda a, b: a * b))


def squared_norm(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda s, a: s + a * a)


def normalized(x: Column) -> Column:
    """Unit length, unless the norm is next to nothing."""
    norm = F.sqrt(squared_norm(x))
    return F.when(norm > NORM_FLOOR, F.transform(x, lambda a: a / norm)).otherwise(x)


def finite(x: Column) -> Column:
    """Whether every value is there and finite."""
    return ~F.exists(x, lambda a: a.isNull() | F.isnan(a) | (F.abs(a) == float("inf")))


def grid_cell(x: Column, width: float) -> Column:
    return F.transform(x, lambda a: F.floor(a / F.lit(width)))


def projection_matrix(d: int, m: int, seed: int) -> np.ndarray:
    """m unit rows of length d, uniform in [-1, 1) before they are scaled."""
    rows = np.random.default_rng(seed).uniform(-1, 1, (m, d))
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def project(x: Column, matrix: np.ndarray) -> Column:
    """The product of a fixed matrix and a vector."""
    return F.array(*[dot(x, F.array(*[F.lit(float(a)) for a in row])) for row in matrix])


def flat_row(flat: Column, i: Column, d: int) -> Column:
    """Row i of a row-major array."""
    return F.slice(flat, i * d + 1, F.lit(d))


def is_noise(label: Column) -> Column:
    return label == NOISE


def inverse(distance: Column) -> Column:
    """Density of a distance: its inverse, infinite at 0."""
    return F.when(distance > 0, 1 / distance).otherwise(F.lit(float("inf")))


def rounded(x: Column, digits: int) -> Column:
    """x rounded by scaling, halves away from zero, as C and SQL engines round binary numbers; F.round goes by x's decimal digits instead."""
    scale = F.lit(10.0**digits)
    out = F.round(x * scale, 0) / scale
    return F.when(F.abs(x) * scale < float("inf"), out).otherwise(x)


def mutual_reachability(distance: Column, core_a: Column, core_b: Column) -> Column:
    return F.greatest(distance, core_a, core_b)


def pairs_of(n: Column) -> Column:
    return n * (n - 1) / 2


def decay(weight: Column, rate: float, dt: Column) -> Column:
    """Weight after dt steps of base-2 decay."""
    return weight * F.pow(F.lit(2.0), -rate * dt)


def outlier_floor(rate: float, period: int, age: Column) -> Column:
    """The weight that an outlier micro-cluster of some age needs to stay."""
    return F.expm1(-(age + period) * rate * math.log(2)) / math.expm1(-period * rate * math.log(2))


def pruning_period(beta: float, mu: float, rate: float) -> int:
    return math.ceil(math.log2(beta * mu / (beta * mu - 1)) / rate)


def pruning_periods(beta: Column, mu: Column, rate: Column) -> Column:
    """``pruning_period`` of columns."""
    return F.ceil(F.log2(beta * mu / (beta * mu - 1)) / rate)
