"""DBSCAN over cells against range pairs, and a crowded cell."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from vectorloom import errors
from vectorloom.functions.distance import COSINE, EUCLIDEAN, SQUARED_EUCLIDEAN
from vectorloom.operators import dbscan
from vectorloom.operators.dbscan import DBSCAN


def frame(spark, x):
    return spark.createDataFrame([(k, [float(v) for v in row]) for k, row in enumerate(x)], "id long, features array<double>")


def labels(df):
    return {r["id"]: r["label"] for r in df.collect()}


@pytest.mark.parametrize(("d", "metric", "epsilon", "border", "block"), [(2, EUCLIDEAN, 0.5, "textbook", 4096), (1, EUCLIDEAN, 0.25, "scan_order", 2), (3, SQUARED_EUCLIDEAN, 0.5, "textbook", 3)])
def test_cells_give_what_pairs_give(spark, monkeypatch, d, metric, epsilon, border, block):
    monkeypatch.setattr(dbscan, "BLOCK", block)
    r = np.random.default_rng(d)
    x = np.concatenate([r.uniform(0, 4 if d > 1 else 40, (120, d)), np.round(r.normal(2, 0.3, (60, d)), 1), np.full((9, d), 1.5), -r.uniform(0, 3, (30, d))])
    p = frame(spark, x)
    slow = DBSCAN(epsilon, 5, metric, border, plan="block")
    fast = DBSCAN(epsilon, 5, metric, border, plan="cells")
    want = labels(slow.fit_predict(p))
    assert labels(fast.fit_predict(p)) == want and len(set(want.values())) > 2


def test_a_crowded_cell(spark):
    """100,000 rows in one cell, and as many in the next one that isn't near enough."""
    spot = lambda n, at: spark.range(n).select((F.col("id") + int(at * 1e6)).alias("id"), F.array(F.lit(float(at)) + F.col("id") * 1e-8, F.lit(0.0)).alias("features"))
    began = time.monotonic()
    found = DBSCAN(0.5, 5).fit_predict(spot(100_000, 0).unionAll(spot(1000, 3)).unionAll(spot(3, 9))).groupBy("label").count().collect()
    assert {r["label"]: r["count"] for r in found} == {0: 100_000, 1: 1000, -1: 3}
    assert time.monotonic() - began < 100


def test_refused(spark):
    with pytest.raises(errors.InvalidParameter):
        DBSCAN(0.5, 5, COSINE, plan="cells").fit_predict(frame(spark, [[1.0, 2.0]]))
