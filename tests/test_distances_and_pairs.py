import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vectorloom import errors
from vectorloom.functions import distance as D
from vectorloom.functions import vectors as V
from vectorloom.operators import graph, pairs
from vectorloom.sources import points as S

METRICS = [D.SQUARED_EUCLIDEAN, D.EUCLIDEAN, D.COSINE, D.INNER_PRODUCT, D.composite(D.EUCLIDEAN, D.COSINE, 0.3, 2.0)]


def table(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "id long, features array<double>")


@pytest.fixture(scope="module")
def cloud():
    x = np.random.default_rng(0).normal(size=(60, 3))
    x[7] = 0
    x[20] = x[19]
    return x


def test_columns_and_blocks_agree(spark, cloud):
    p = table(spark, cloud[:15])
    for m in METRICS:
        a = {(r["i"], r["j"]): r["distance"] for r in pairs.pairwise(p, m).collect()}
        b = {(r["i"], r["j"]): r["distance"] for r in pairs.pairwise(p, D.Metric(m.name, m.column)).collect()}
        assert a.keys() == b.keys() and len(a) == 105
        assert max(abs(a[k] - b[k]) for k in a) < 1e-9


def test_range_plans_agree(spark, cloud, monkeypatch):
    monkeypatch.setattr(pairs, "TILE", 16)
    p = table(spark, cloud)
    for m, eps in ((D.EUCLIDEAN, 0.9), (D.SQUARED_EUCLIDEAN, 0.5)):
        d = m.block(cloud, cloud)
        want = {(i, j) for i in range(60) for j in range(i + 1, 60) if d[i, j] <= eps}
        for plan in ("block", "grid", "projection"):
            got = [(r["i"], r["j"]) for r in pairs.range_join(p, eps, m, plan, 3).collect()]
            assert len(got) == len(set(got)) and set(got) == want, (m.name, plan)
    with pytest.raises(errors.InvalidParameter):
        pairs.range_join(p, 0.5, D.COSINE, "grid", 3)
    with pytest.raises(errors.InvalidParameter):
        pairs.range_join(p, 0.0)


def test_range_plan_chosen_by_spread(spark, monkeypatch):
    r = np.random.default_rng(3)
    wide, narrow = r.uniform(-100, 100, (300, 8)), r.normal(size=(300, 8))
    calls = []
    for name in ("pairwise", "_projection_join", "_grid_join"):
        whole = getattr(pairs, name)
        monkeypatch.setattr(pairs, name, lambda *a, name=name, whole=whole: calls.append(name) or whole(*a))
    for x, epsilon, plan in ((wide, 8.0, "_projection_join"), (narrow, 2.0, "pairwise"), (wide[:, :2], 3.0, "_grid_join")):
        p = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "id long, features array<double>")
        calls.clear()
        found = sorted((e["i"], e["j"]) for e in pairs.range_join(p, epsilon).collect())
        d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
        assert calls == [plan] and found == [(i, j) for i in range(300) for j in range(i + 1, 300) if d[i, j] <= epsilon]


def test_groups_of_points():
    assert pairs.groups_for(2000, 64, 8, 512) == 7 and pairs.groups_for(10, 4, 8, 512) == 1 and pairs.groups_for(1_000_000, 64, 8, 512) == 8
    assert pairs.groups_for(1_000_000, 64, 4000, 512) == 155


def test_nearest_others(spark, cloud, monkeypatch):
    monkeypatch.setattr(pairs, "TILE", 25)
    d = D.EUCLIDEAN.block(cloud, cloud)
    found = {}
    for r in pairs.knn_join(table(spark, cloud), 4).collect():
        found.setdefault(r["i"], {})[r["rank"]] = r["j"]
    for i in range(60):
        order = [j for j in np.lexsort((np.arange(60), d[i])) if j != i][:4]
        assert [found[i][k] for k in range(1, 5)] == order
    own = pairs.knn_join(table(spark, cloud), 1, include_self=True).where("i = j").count()
    assert own >= 59
    curve = [r["distance"] for r in pairs.k_distance(table(spark, cloud), 3).orderBy("position").collect()]
    want = np.sort([np.sort(np.delete(d[i], i))[2] for i in range(60)])
    assert np.allclose(curve, want) and pairs.k_distance(table(spark, cloud[:1]), 3).count() == 0


def test_ties_take_the_first_centroid(spark):
    p = table(spark, [[0.0, 0.0], [5.0, 0.0]])
    c = np.array([[1.0, 0.0], [-1.0, 0.0], [5.0, 1.0]])
    for m in (D.EUCLIDEAN, D.Metric("own", D.EUCLIDEAN.column)):
        assert [r["label"] for r in pairs.nearest_centroid(p, c, m).orderBy("id").collect()] == [0, 2]


@settings(max_examples=30, deadline=None)
@given(st.lists(st.lists(st.floats(-100, 100), min_size=2, max_size=2), min_size=1, max_size=8))
def test_kernels_are_symmetric_and_zero_on_themselves(x):
    x = np.array(x)
    for m in (D.SQUARED_EUCLIDEAN, D.EUCLIDEAN):
        d = m.block(x, x)
        assert np.allclose(d, d.T) and np.allclose(np.diag(d), 0)


def test_translation_keeps_distances_far_away():
    x = np.random.default_rng(1).normal(size=(5, 2))
    assert np.allclose(D.SQUARED_EUCLIDEAN.block(x + 1e6, x + 1e6), D.SQUARED_EUCLIDEAN.block(x, x), atol=1e-6)


def test_vector_functions(spark):
    row = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0], [1.0, None], 2.5)], "a array<double>, z array<double>, n array<double>, d double").select(
        V.normalized(F.col("a")).alias("u"), V.normalized(F.col("z")).alias("z"), V.finite(F.col("n")).alias("n"), V.finite(F.col("a")).alias("a"), V.grid_cell(F.col("a"), 2.0).alias("g"), V.inverse(F.lit(0.0)).alias("inf"), V.pairs_of(F.lit(4)).alias("c"), V.decay(F.lit(8.0), 0.5, F.lit(4)).alias("w")
    ).first()
    assert row["u"] == [0.6, 0.8] and row["z"] == [0.0, 0.0] and not row["n"] and row["a"] and row["g"] == [1, 2] and row["inf"] == float("inf") and row["c"] == 6 and row["w"] == 2.0
    assert V.pruning_period(0.75, 2.0, 0.25) == 7


def test_sources(spark):
    flat = spark.createDataFrame([([1.0, 2.0, 3.0, 4.0],)], "f array<double>")
    assert [(r["id"], r["features"]) for r in S.from_flat(flat, "f", 2).orderBy("id").collect()] == [(0, [1.0, 2.0]), (1, [3.0, 4.0])]
    with pytest.raises(Exception, match="multiple"):
        S.from_flat(flat, "f", 3).collect()
    p = S.from_rows(spark, [[1, 2], [3, 4]])
    assert S.validated(p) == S.Shape(2, 2)
    assert S.labels_array(S.from_labels(spark, [1, -5, None])).tolist() == [1, -1, -1]
    for rows, error in (([], errors.EmptyInput), ([(0, [1.0]), (1, [1.0, 2.0])], errors.DimensionMismatch), ([(0, [float("nan")])], errors.NonFinite), ([(0, None), (1, [1.0])], errors.ClusterError)):
        with pytest.raises(error):
            S.validated(spark.createDataFrame(rows, "id long, features array<double>"))
    assert S.not_finite(spark.createDataFrame([(3, [1.0, float("inf")])], "id long, features array<double>")).first()["position"] == 1


def test_idx_files(spark, tmp_path):
    import struct

    (tmp_path / "i").write_bytes(struct.pack(">iiii", 2051, 2, 1, 2) + bytes([0, 255, 51, 102]))
    (tmp_path / "l").write_bytes(struct.pack(">ii", 2049, 2) + bytes([7, 3]))
    rows = S.read_idx(spark, str(tmp_path / "i"), str(tmp_path / "l")).orderBy("id").collect()
    assert [r["label"] for r in rows] == [7, 3] and rows[0]["features"] == [0.0, 1.0] and rows[1]["features"] == [0.2, 0.4]


def test_components_both_ways(spark):
    r = np.random.default_rng(3)
    edges = [(int(a), int(b)) for a, b in r.integers(0, 80, (60, 2))] + [(200, 200)] + [(k, k + 1) for k in range(300, 330)]
    df = spark.createDataFrame(edges, "i long, j long")
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        return x if parent[x] == x else find(parent[x])

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    want = {x: find(x) for x in parent}
    for one_task in (0, 1000):
        assert {x["id"]: x["component"] for x in graph.connected_components(df, one_task=one_task).collect()} == want
    assert graph.connected_components(df.limit(0)).count() == 0 and graph.connected_components(df.limit(0), one_task=0).count() == 0


def test_relabel_and_rank(spark):
    labels = spark.createDataFrame([(0, 9), (1, 4), (2, 9), (3, -1)], "id long, label long")
    assert {r["id"]: r["label"] for r in graph.relabel(labels).collect()} == {0: 0, 1: 1, 2: 0, 3: 2}
