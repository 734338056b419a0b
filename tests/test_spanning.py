"""Spanning trees over cells of pivots against one task's, and how few pairs they look at."""

import numpy as np
import pytest

from vectorloom.functions.distance import EUCLIDEAN, SQUARED_EUCLIDEAN
from vectorloom.operators import hierarchy, spanning
from vectorloom.operators.pairs import core_distances


def frame(spark, x):
    return spark.createDataFrame([(k, [float(v) for v in row]) for k, row in enumerate(x)], "id long, features array<double>")


def edges(tree):
    return sorted((r["u"], r["v"], round(r["w"], 9)) for r in tree.collect())


@pytest.mark.parametrize(("metric", "root", "cored"), [(EUCLIDEAN, False, True), (SQUARED_EUCLIDEAN, True, False)])
def test_the_same_tree(spark, monkeypatch, metric, root, cored):
    r = np.random.default_rng(4)
    x = np.concatenate([np.round(r.normal(c, 0.4, (25, 3)), 1) for c in (1, 4, 9)] + [np.full((8, 3), 4.0)])  # many ties
    p = frame(spark, x)
    core = core_distances(p, 3, metric) if cored else None
    monkeypatch.setattr(spanning, "LISTED", 3)
    want = edges(hierarchy.spanning_tree(p, metric, core, root))
    monkeypatch.setattr(hierarchy, "DENSE", 0)
    monkeypatch.setattr(hierarchy, "PRUNE", 0)
    found = edges(hierarchy.spanning_tree(p, metric, core, root))
    assert found == want and len(found) == len(x) - 1


def test_rounds_look_at_few_pairs(spark):
    r = np.random.default_rng(9)
    x = r.normal(0, 10, (30, 4))[r.integers(0, 30, 1500)] + r.normal(0, 0.5, (1500, 4))
    table = frame(spark, x).selectExpr("id", "features", "0.0D as core")
    looked: list[int] = []
    tree = spanning.pruned_tree(table, EUCLIDEAN, looked=looked)
    assert tree.count() == 1499 and len(looked) >= 3
    assert looked[0] < 1500 * 1500 / 4 and all(n < 1500 * 1500 / 10 for n in looked[1:])


def test_few_points(spark):
    table = frame(spark, [[1.0], [3.0]]).selectExpr("id", "features", "0.0D as core")
    assert edges(spanning.pruned_tree(table, EUCLIDEAN)) == [(0, 1, 2.0)]
    assert spanning.pruned_tree(table.limit(1), EUCLIDEAN).count() == 0
