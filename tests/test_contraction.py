"""Folds of trees in levels against the fold of one task."""

import math

import numpy as np
import pytest

from vectorloom.operators import contraction, hierarchy


def tree_of(spark, seed, n, ties):
    """A random tree over scattered ids, some edges of no length and many of equal lengths."""
    r = np.random.default_rng(seed)
    ids = np.sort(r.choice(10 * n, n, replace=False)).tolist()
    order = r.permutation(n).tolist()
    edges = []
    for k in range(1, n):
        a, b = ids[order[k]], ids[order[int(r.integers(max(0, k - 12), k))]]
        w = float(r.integers(0, 9)) / 4 if ties else float(r.gamma(0.7)) + 1e-3
        edges.append((min(a, b), max(a, b), w))
    return ids, spark.createDataFrame(edges, "u long, v long, w double").repartition(3)


def rows(df):
    close = lambda v: round(v, 9) if isinstance(v, float) and math.isfinite(v) else v
    return sorted((tuple(close(v) for v in r) for r in df.collect()), key=str)


@pytest.mark.parametrize("ties", [False, True])
def test_levels_are_one_fold(spark, ties):
    ids, tree = tree_of(spark, 3, 150, ties)
    least = 4
    merged = [r for r in rows(hierarchy.dendrogram(tree)) if r[1] is not None]
    places, edges = hierarchy.ordered_edges(tree.toArrow())
    labels, scores = hierarchy.density_labels(len(ids), edges, least)
    flat = sorted([(i, int(a), round(float(b), 9)) for i, a, b in zip(places.tolist(), labels, scores, strict=True)], key=str)
    c = hierarchy.condense(len(ids), edges, least)
    own = hierarchy.excesses(c, hierarchy.points_inside(c))
    clusters = [(k, c.parent[k] if c.parent[k] >= 0 else None, c.born[k], s, own[k]) for k, s in enumerate(hierarchy.cluster_sizes(c))]
    points = spark.createDataFrame([(i,) for i in ids], "id long")
    for cuts in (1, 4):
        assert rows(contraction.merges(tree, cuts=cuts)[0]) == merged
        assert rows(contraction.density_labels(points, tree, least, cuts=cuts)) == flat
        found = {r[0]: r for r in contraction.all_clusters(*contraction.condensed_parts(tree, least, cuts=cuts)).collect()}
        assert sorted(found) == [k[0] for k in clusters]
        for want in clusters:
            got = found[want[0]]
            assert got[1] == want[1] and got[3] == want[3] and got[2] == want[2]
            assert got[4] == want[4] or math.isclose(got[4], want[4], rel_tol=1e-9, abs_tol=1e-9)


def test_levels_shrink_to_what_a_task_may_hold(spark):
    ids, tree = tree_of(spark, 8, 60, False)
    parts, _ = contraction.condensed_parts(tree, 3, largest=10)
    assert len(parts) > 2
    points = spark.createDataFrame([(i,) for i in ids], "id long")
    assert rows(contraction.density_labels(points, tree, 3, largest=10)) == rows(contraction.density_labels(points, tree, 3, cuts=1))


def test_trees_without_edges_and_too_small_ones(spark):
    points = spark.createDataFrame([(4,), (9,)], "id long")
    none = spark.createDataFrame([], "u long, v long, w double")
    assert rows(contraction.density_labels(points, none, 2)) == [(4, -1, 1.0), (9, -1, 1.0)]
    assert contraction.merges(none)[0].count() == 0
    one = spark.createDataFrame([(4, 9, 1.0)], "u long, v long, w double")
    assert rows(contraction.density_labels(points, one, 5)) == [(4, -1, 1.0), (9, -1, 1.0)]
