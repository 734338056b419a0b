"""Joins over metric-space cells against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vectorloom import errors
from vectorloom.functions import vectors as V
from vectorloom.functions.distance import COSINE, EUCLIDEAN, INNER_PRODUCT, SQUARED_EUCLIDEAN, Metric
from vectorloom.operators import pairs, pivots

MANHATTAN = Metric("manhattan", lambda x, y: V.total(F.zip_with(x, y, lambda a, b: F.abs(a - b))), triangle="plain")


def block_of(metric):
    return metric.block or (lambda x, y: np.abs(x[:, None, :] - y[None, :, :]).sum(2))


def frame(spark, x):
    return spark.createDataFrame([(k, [float(v) for v in row]) for k, row in enumerate(x)], "id long, features array<double>")


def clustered(n=600, d=6, seed=3):
    r = np.random.default_rng(seed)
    x = r.normal(0, 6, (20, d))[r.integers(0, 20, n)] + r.normal(0, 0.3, (n, d))
    x[5:25] = x[4]  # ties
    x[30:33] = 0.0  # no direction
    return x


@pytest.mark.parametrize(("metric", "epsilon"), [(EUCLIDEAN, 1.2), (SQUARED_EUCLIDEAN, 1.4), (COSINE, 0.01), (MANHATTAN, 2.0)])
@pytest.mark.parametrize("block", [4096, 7])
def test_range_join(spark, monkeypatch, metric, epsilon, block):
    monkeypatch.setattr(pivots, "BLOCK", block)
    x = clustered(300 if metric is MANHATTAN or block == 7 else 600)
    d = block_of(metric)(x, x)
    want = {(i, j) for i, j in zip(*np.nonzero(d <= epsilon)) if i < j}
    found = pairs.range_join(frame(spark, x), epsilon, metric, plan="pivot").collect()
    assert len(found) == len({(r["i"], r["j"]) for r in found})
    assert {(r["i"], r["j"]) for r in found} == want
    assert all(r["distance"] == pytest.approx(d[r["i"], r["j"]], abs=1e-9) for r in found)


@pytest.mark.parametrize("metric", [EUCLIDEAN, SQUARED_EUCLIDEAN, COSINE, MANHATTAN])
@pytest.mark.parametrize("include_self", [False, True])
def test_knn_join(spark, monkeypatch, metric, include_self):
    monkeypatch.setattr(pivots, "BLOCK", 40)
    x = clustered(250)
    x[30:33] = x[29] if metric is COSINE else 0.0
    d = np.round(block_of(metric)(x, x), 12)
    found = {}
    for r in pairs.knn_join(frame(spark, x), 4, metric, include_self, plan="pivot").collect():
        found.setdefault(r["i"], []).append((r["rank"], r["j"], r["distance"]))
    assert len(found) == len(x)
    for i, mine in found.items():
        order = [j for j in np.lexsort((np.arange(len(x)), d[i])) if include_self or j != i][:4]
        assert [m[0] for m in sorted(mine)] == [1, 2, 3, 4]
        assert [m[2] for m in sorted(mine)] == pytest.approx([d[i, j] for j in order], abs=1e-7 if metric is COSINE else 1e-9)


def test_cells_leave_most_pairs_unseen(spark):
    r = np.random.default_rng(1)
    x = r.normal(0, 10, (40, 8))[r.integers(0, 40, 4000)] + r.normal(0, 0.2, (4000, 8))
    p = frame(spark, x)
    found, looked = pivots.range_join(p, 0.8)
    assert looked <= 4000 * 4000 // 10
    d = np.sqrt(((x[:, None, :4] - x[None, :, :4]) ** 2).sum(2) + ((x[:, None, 4:] - x[None, :, 4:]) ** 2).sum(2))
    assert found.count() == ((d <= 0.8).sum() - 4000) // 2
    near, looked = pivots.knn_join(p, 3)
    assert looked <= 4000 * 4000 // 10 and near.count() == 12_000


def test_edges(spark):
    with pytest.raises(errors.InvalidParameter):
        pairs.range_join(frame(spark, [[1.0]]), 1.0, INNER_PRODUCT, plan="pivot")
    assert pairs.range_join(frame(spark, np.empty((0, 2))), 1.0, plan="pivot").count() == 0
    assert pairs.knn_join(frame(spark, [[1.0]]), 2, plan="pivot").count() == 0
    same = frame(spark, np.ones((30, 2)))
    assert pairs.range_join(same, 0.5, plan="pivot").count() == 435 and pairs.knn_join(same, 2, plan="pivot").count() == 60
