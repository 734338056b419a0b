import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from vectorloom import errors
from vectorloom.functions import distance as D
from vectorloom.operators import constrained, correlation, evaluation, graph, hierarchy, memory, optics
from vectorloom.operators.dbscan import DBSCAN, with_null_noise
from vectorloom.operators.kmeans import KMeans, centroids_of, seed_centroids


def table(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in np.atleast_1d(row)]) for i, row in enumerate(x)], "id long, features array<double>")


def labelled(spark, y):
    return spark.createDataFrame([(i, int(v)) for i, v in enumerate(y)], "id long, label long")


def array(df, column="label"):
    return np.array([r[column] for r in df.orderBy("id").collect()])


def same_partition(a, b):
    return len(set(zip(a.tolist(), b.tolist()))) == len(set(a.tolist())) == len(set(b.tolist()))


@pytest.fixture(scope="module")
def blobs():
    r = np.random.default_rng(5)
    return np.concatenate([r.normal(c, 0.1, (10, 2)) for c in ((0, 0), (10, 0), (0, 10))] + [np.array([[50.0, 50], [-40, 7], [5, 5]])])


def test_dbscan_blobs(spark, blobs):
    found = array(DBSCAN(1.0, 3).fit_predict(table(spark, blobs)))
    assert found.tolist() == [0] * 10 + [1] * 10 + [2] * 10 + [-1] * 3
    assert array(with_null_noise(DBSCAN(1.0, 3).fit_predict(table(spark, blobs)))).tolist()[-1] is None


def test_dbscan_borders(spark):
    p = table(spark, [2.0, 0.0, 0.5, 1.0, 0.9])
    assert array(DBSCAN(1.0, 4).fit_predict(p)).tolist() == [0] * 5
    assert array(DBSCAN(1.0, 4, border="scan_order").fit_predict(p)).tolist() == [-1, 0, 0, 0, 0]
    assert array(DBSCAN(1.0, 2).fit_predict(table(spark, [[0, 0], [1, 0], [0, 1]]))).tolist() == [0, 0, 0]
    assert array(DBSCAN(0.1, 2).fit_predict(table(spark, [[5, 5]] * 6))).tolist() == [0] * 6
    assert array(DBSCAN(0.1, 1).fit_predict(table(spark, [0.0, 9.0]))).tolist() == [0, 1]
    for bad in ((0, 3), (1.0, 0)):
        with pytest.raises(errors.InvalidParameter):
            DBSCAN(*bad)


def test_kmeans(spark, blobs):
    p = table(spark, blobs[:30])
    m = KMeans(3, seed=1).fit(p)
    assert same_partition(array(m.labels), np.repeat([0, 1, 2], 10))
    trace = m.inertia_trace
    assert all(a >= b - 1e-9 for a, b in zip(trace, trace[1:])) and m.wcss(p) == pytest.approx(trace[-1])
    assert array(m.predict(table(spark, blobs[:1]))).tolist() == [array(m.labels)[0]]
    with pytest.raises(errors.DimensionMismatch):
        m.predict(table(spark, [1.0]))
    with pytest.raises(errors.InvalidClusterCount):
        KMeans(31).fit(p)
    assert len({tuple(c) for c in seed_centroids(p, 3, seed=4)}) == 3 and (seed_centroids(p, 3, seed=4) == seed_centroids(p, 3, seed=4)).all()


def test_kmeans_empty_cluster_and_cosine(spark):
    p = table(spark, [[0, 0], [0.1, 0], [0, 0.1], [0.1, 0.1], [0.3, 0.3]])
    m = KMeans(2, initial=((0.05, 0.05), (999.0, 999.0))).fit(p)
    assert set(array(m.labels)) == {0, 1}
    own = KMeans(2, D.Metric("own", D.SQUARED_EUCLIDEAN.column), initial=((0.05, 0.05), (999.0, 999.0))).fit(p)
    assert (array(own.labels) == array(m.labels)).all()
    c = KMeans(2, D.COSINE, seed=3).fit(table(spark, [[1, 0], [-1, 0], [0, 1], [0, -1]]))
    assert np.isfinite(c.centroids).all()


def test_metrics_by_hand(spark):
    p = table(spark, [[0, 0], [1, 0], [0, 1], [10, 0], [11, 0], [10, 1]])
    y = labelled(spark, [0, 0, 0, 1, 1, 1])
    assert evaluation.silhouette(p, y).first()[0] == pytest.approx(0.88622, abs=1e-3)
    assert evaluation.silhouette(table(spark, [[0, 0], [10, 0]]), labelled(spark, [0, 1])).first()[0] == 0
    assert evaluation.silhouette(p, labelled(spark, [3] * 6)).first()[0] == 0
    mixed = labelled(spark, [0, 0, 0, 1, 1, 2])
    s = evaluation.silhouettes(p, mixed)
    assert s.count() == 5 and evaluation.silhouette_noise_aware(p, mixed).first()[0] == pytest.approx(s.agg(F.sum("silhouette")).first()[0] / 6)
    assert evaluation.silhouette_sampled(p, y, 6).first()[0] == pytest.approx(evaluation.silhouette(p, y).first()[0])
    assert evaluation.adjusted_rand_index(y, y).first()[0] == 1 and evaluation.normalized_mutual_information(y, labelled(spark, [0] * 6)).first()[0] == 0
    assert evaluation.purity(labelled(spark, [0, 0, 0, 0, 1, 1]), y).first()[0] == pytest.approx(5 / 6)
    assert evaluation.noise_ratio(labelled(spark, [-1, 0, 0, 0])).first()[0] == 0.25 and evaluation.noise_ratio(labelled(spark, [0]).limit(0)).first()[0] == 0


def test_evaluation_example(spark):
    lines = np.concatenate([np.column_stack([np.full(40, x), np.arange(40) * 0.1]) for x in (0.0, 10.0, 20.0)] + [np.array([[100.0, 100.0]])])
    p = table(spark, lines)
    labels = DBSCAN(3.0, 3).fit_predict(p)
    assert array(labels).tolist() == [0] * 40 + [1] * 40 + [2] * 40 + [-1]
    d = D.EUCLIDEAN.block(lines, lines)
    core = np.sort(d + np.diag([np.inf] * 121), axis=1)[:, 2]
    m = np.maximum(d, np.maximum.outer(core, core))
    y, s = array(labels), []
    for i in range(121):
        means = {c: m[i][(y == c) & (np.arange(121) != i)].mean() for c in range(3)}
        if y[i] >= 0:
            b = min(v for c, v in means.items() if c != y[i])
            s.append((b - means[y[i]]) / max(b, means[y[i]]))
        else:
            near = min(means, key=means.get)
            inner = m[np.ix_(y == near, y == near)][np.triu_indices(40, 1)].mean()
            s.append(1.0 if means[near] > inner else -1.0)
    assert evaluation.disco(p, labels, 3).first()[0] == pytest.approx(np.mean(s))


def test_scores_against_numpy(spark, blobs):
    p, y = table(spark, blobs), labelled(spark, [0] * 10 + [1] * 10 + [2] * 10 + [-1] * 3)
    c = np.array([r["centroid"] for r in centroids_of(p, y).orderBy("cluster").collect()])
    assert np.allclose(c, [blobs[k * 10 : k * 10 + 10].mean(0) for k in range(3)])
    between = 10 * ((c - blobs.mean(0)) ** 2).sum()
    within = sum(((blobs[k * 10 : k * 10 + 10] - c[k]) ** 2).sum() for k in range(3))
    assert evaluation.calinski_harabasz(p, y).first()[0] == pytest.approx((between / 2) / (within / 30))
    s = [np.linalg.norm(blobs[k * 10 : k * 10 + 10] - c[k], axis=1).mean() for k in range(3)]
    want = np.mean([max((s[a] + s[b]) / np.linalg.norm(c[a] - c[b]) for b in range(3) if b != a) for a in range(3)])
    assert evaluation.davies_bouldin(p, y).first()[0] == pytest.approx(want)


def kruskal(x, core=None):
    d = D.EUCLIDEAN.block(x, x)
    if core is not None:
        d = np.maximum(d, np.maximum.outer(core, core))
    forest, total = hierarchy.Forest(len(x)), []
    for w, i, j in sorted((d[i, j], i, j) for i in range(len(x)) for j in range(i + 1, len(x))):
        a, b = forest.find(i), forest.find(j)
        if a != b:
            forest.unite(a, b)
            total.append(w)
    return np.array(total)


def test_spanning_trees(spark, blobs, monkeypatch):
    p = table(spark, blobs)
    for dense in (10_000, 0):
        monkeypatch.setattr(hierarchy, "DENSE", dense)
        w = np.sort([r["w"] for r in hierarchy.spanning_tree(p).collect()])
        assert np.allclose(w, kruskal(blobs))
    r = np.random.default_rng(8)
    tied = table(spark, r.integers(0, 4, (40, 2)))  # many equal distances
    trees = []
    for dense in (10_000, 0):
        monkeypatch.setattr(hierarchy, "DENSE", dense)
        trees.append([sorted(map(tuple, hierarchy.HDBSCAN(3, 3).tree(tied).collect())), sorted(map(tuple, hierarchy.spanning_tree(tied).collect()))])
    assert trees[0] == trees[1] and len(trees[0][0]) == 39
    monkeypatch.setattr(hierarchy, "DENSE", 10_000)
    core = np.sort(D.EUCLIDEAN.block(blobs, blobs), axis=1)[:, 4]
    assert np.allclose(np.sort([r["w"] for r in hierarchy.HDBSCAN(4, 5).tree(p).collect()]), kruskal(blobs, core))


def test_hdbscan(spark, blobs):
    found = hierarchy.HDBSCAN(5, 5).fit(table(spark, blobs)).orderBy("id").collect()
    y = np.array([r["label"] for r in found])
    assert same_partition(y[:30], np.repeat([0, 1, 2], 10)) and (y[30:32] == -1).all()
    assert all(0 <= r["outlier_score"] <= 1 for r in found) and found[30]["outlier_score"] == 1
    one = hierarchy.HDBSCAN().fit(table(spark, [[1.0, 2.0]])).first()
    assert (one["label"], one["outlier_score"]) == (-1, 1.0)
    twins = hierarchy.HDBSCAN(2, 2).fit(table(spark, [[1.0, 1.0]] * 4 + [[9.0, 9.0]] * 4)).collect()
    assert all(math.isfinite(r["outlier_score"]) for r in twins)
    with pytest.raises(errors.InvalidParameter):
        hierarchy.HDBSCAN(5, 1)


def test_layers_and_duplicates(spark, blobs, monkeypatch):
    p = table(spark, np.concatenate([blobs, blobs[:1]]))
    tree = hierarchy.spanning_tree(p)
    direct = hierarchy.layer_at(p, tree, 1.0, 4)
    cut = hierarchy.cut_all(p, tree, [1.0, 0.0], 4)
    assert array(direct).tolist() == array(cut.where("cut = 0")).tolist() == [0] * 10 + [1] * 10 + [2] * 10 + [None] * 3 + [0]
    assert sorted((r["component"], r["id"]) for r in hierarchy.near_duplicates(p, 1e-9).collect()) == [(0, 0), (0, 33)]
    assert hierarchy.near_duplicates(p, 0).count() == 0
    merges = hierarchy.dendrogram(tree).orderBy("node").collect()
    assert len(merges) == 67 and merges[-1]["size"] == 34 and [r["distance"] for r in merges[34:]] == sorted(r["distance"] for r in merges[34:])
    fitted = hierarchy.ProjectedHierarchy(dimensions=1, min_cluster_size=4, max_layers=4).fit(p)
    counts = [labels.agg(F.countDistinct("label")).first()[0] for labels in fitted.labels]
    assert counts == sorted(counts, reverse=True) and fitted.layer_for_n_clusters(3).count() == 34
    with pytest.raises(errors.InvalidParameter):
        hierarchy.ProjectedHierarchy(dimensions=2).fit(p)
    assert fitted.dimensions == 2
    rows = lambda df: sorted(map(tuple, df.collect()), key=str)
    ways = [
        lambda: hierarchy.ProjectedHierarchy(dimensions=1, min_cluster_size=4, max_layers=4).fit(p).table(),
        lambda: hierarchy.dendrogram(tree),
        lambda: hierarchy.cut_all(p, tree, [1.0, 0.1], 4),
        lambda: fitted.layer_for_n_clusters(3),
        lambda: hierarchy.HDBSCAN().fit(p),
    ]
    whole = [rows(way()) for way in ways]
    monkeypatch.setattr(hierarchy, "FOLD", 10)  # trees that one task may not fold go in levels
    assert [rows(way()) for way in ways] == whole


def test_optics(spark, blobs):
    p = table(spark, blobs)
    o = optics.OPTICS(2.0, 3)
    rows = o.fit(p)
    found = rows.orderBy("pos").collect()
    assert sorted(r["id"] for r in found) == list(range(33)) and found[0]["reachability"] == float("inf")
    core = {r["id"]: r["core_distance"] for r in o.core_distances(p).collect()}
    assert all(core[r["id"]] == pytest.approx(r["core_distance"]) for r in found)
    cut = optics.extract_clusters(rows, 1.0)
    assert same_partition(array(cut), array(DBSCAN(1.0, 3).fit_predict(p)))
    assert optics.extract_xi(rows, 0.05).count() == 33
    assert {r["core_distance"] for r in optics.OPTICS(1.0, 1).fit(table(spark, [0.0, 9.0])).collect()} == {0.0}


def xi_loop(reach, xi):
    f, state, count, out = 1 - xi, "out", -1, []
    for k, r in enumerate(reach):
        before = reach[k - 1] if k else None
        if k == 0 or r == math.inf:
            state = "out"
        elif before == math.inf:
            state, count = "in", count + 1
        elif r < before * f:
            count, state = count + (state == "out"), "in"
        elif r > before / f:
            state = "out"
        out.append(count if state == "in" else -1)
    return out


def test_extraction_against_loops(spark):
    r = np.random.default_rng(8)
    rows, want = [], {}
    for plot in range(30):
        reach = [math.inf] + [math.inf if r.random() < 0.1 else float(v) for v in r.integers(1, 8, 20)]
        want[plot] = xi_loop(reach, 0.2)
        rows += [(plot, k, k, v, 1.0) for k, v in enumerate(reach)]
    df = spark.createDataFrame(rows, "plot long, pos long, id long, reachability double, core_distance double")
    out = optics.extract_xi(df, 0.2, F.col("plot"))
    assert out.count() == len(rows)
    for plot in range(3):
        mine = optics.extract_xi(df.where(F.col("plot") == plot), 0.2).orderBy("pos").collect()
        assert [x["label"] for x in mine] == want[plot]


def test_pivots_both_ways(spark):
    r = np.random.default_rng(4)
    rows = [(int(a), int(b), float(w)) for a, b, w in zip(r.integers(0, 25, 70), r.integers(0, 25, 70), r.uniform(-1, 1, 70))]
    edges = spark.createDataFrame(rows, "i long, j long, weight double")
    vertices = spark.range(25)
    order = np.array([x["id"] for x in vertices.select("id", F.xxhash64("id", F.lit(9)).alias("h")).orderBy("h", "id").collect()])
    i, j, w = (np.array(c) for c in zip(*rows))
    one = correlation.pivots_in_order(order, *correlation.both_ends(25, i, j, w))
    assert {x["id"]: x["label"] for x in correlation.pivot(edges, vertices, 9).collect()} == dict(enumerate(one.tolist()))


@pytest.mark.parametrize("seed", [1, 2])
def test_correlation_by_task_and_by_joins(spark, monkeypatch, seed):
    r = np.random.default_rng(seed)
    rows = [(int(a), int(b), float(w)) for a, b, w in zip(r.integers(0, 30, 160), r.integers(0, 30, 160), r.integers(-3, 4, 160))]
    edges = spark.createDataFrame(rows, "i long, j long, weight double")
    fit = correlation.CorrelationClustering(max_iter=3).fit
    one = fit(edges, 30)
    monkeypatch.setattr(correlation, "TASK_BYTES", 0)
    two = fit(edges, 30)
    assert array(one.labels).tolist() == array(two.labels).tolist() and one.cost == two.cost
    y = array(one.labels)
    cost = lambda y: sum(abs(w) for a, b, w in rows if (w > 0 and y[a] != y[b]) or (w < 0 and y[a] == y[b]))
    assert one.cost == cost(y)
    for v in range(30):  # no single move gains any more
        for to in [*set(y.tolist()), 99]:
            moved = y.copy()
            moved[v] = to
            assert cost(moved) >= one.cost - 1e-9 or len(set(y)) != len(set(one.labels.toPandas()["label"]))


def test_correlation(spark):
    cliques = [(a, b, 1.0) for base in (0, 5) for a in range(base, base + 5) for b in range(a + 1, base + 5)]
    rows = cliques + [(a, b, -1.0) for a in range(5) for b in range(5, 10)] + [(3, 3, 2.0), (0, 1, 0.0)]
    edges = spark.createDataFrame(rows, "i long, j long, weight double")
    found = correlation.CorrelationClustering().fit(edges, 11)
    assert array(found.labels).tolist() == [0] * 5 + [1] * 5 + [2] and found.cost == 0 and found.n_clusters == 3
    loose = correlation.CorrelationClustering(max_iter=0).fit(edges, 11)
    assert loose.cost >= found.cost and correlation.CorrelationClustering().fit(edges.limit(0), 0).n_clusters == 0
    with pytest.raises(errors.InvalidParameter):
        correlation.CorrelationClustering().fit(edges, 5)
    triangle = spark.createDataFrame([(0, 1, 1.0), (1, 2, 1.0), (0, 2, 1.0)], "i long, j long, weight double")
    assert graph.jaccard_links(triangle).count() == 0 and graph.jaccard_links(edges).count() == 20


def test_constraints(spark):
    p = table(spark, [[0.0], [0.1], [10.0], [10.1]])
    kinds = "a long, b long, kind string"
    fit = constrained.ConstrainedKMeans(2).fit_predict
    y = array(fit(p, spark.createDataFrame([(0, 2, "must"), (1, 3, "must"), (0, 1, "cannot"), (0, 3, "cannot"), (1, 2, "cannot"), (2, 3, "cannot")], kinds)))
    assert y[0] == y[2] and y[1] == y[3] and y[0] != y[1]
    y = array(constrained.ConstrainedKMeans(2).fit_predict(p, spark.createDataFrame([(0, 1, "must"), (1, 2, "must"), (2, 3, "must")], kinds)))
    assert len(set(y)) == 1
    for rows, error in (([(0, 1, "must"), (1, 2, "must"), (0, 2, "cannot")], errors.ConstraintViolation), ([(0, 9, "must")], errors.InvalidParameter), ([(0, 1, "cannot"), (0, 2, "cannot"), (1, 2, "cannot")], errors.ConstraintViolation)):
        with pytest.raises(error):
            fit(p, spark.createDataFrame(rows, kinds))


def test_memory(spark):
    x, c = np.array([[0.0, 0.0], [4.0, 0.2]]), np.array([[0.5, 0.0], [4.0, 0.0]])
    p = table(spark, x)
    assert array(memory.assign(p, c)).tolist() == [0, 1]
    shares = {(r["id"], r["cluster"]): r["weight"] for r in memory.soft_assign(p, c, 2.0).collect()}
    assert shares[0, 0] + shares[0, 1] == pytest.approx(1) and shares[0, 0] > 0.99
    column = p.select("id", memory.soft_weights(F.array(*[D.SQUARED_EUCLIDEAN.column(F.col("features"), F.array(*map(F.lit, map(float, k)))) for k in c]), 2.0).alias("w"))
    assert np.allclose([r["w"] for r in column.orderBy("id").collect()], [[shares[i, k] for k in range(2)] for i in range(2)])
    settled = {r["id"]: r["features"] for r in memory.contract(p, c, 20.0, 500, 0.5).collect()}
    assert np.allclose(settled[0], [0.5, 0], atol=1e-3)
    assert memory.loss(p, c, 20.0, 500, 0.5).first()[0] == pytest.approx(0.25 + 0.04, abs=1e-2)


def test_saved_models(spark, blobs, tmp_path):
    from vectorloom.functions.distance import Metric
    from vectorloom.models import load, save
    from vectorloom.operators.dbscan import DBSCAN as Dense
    from vectorloom.streaming.denstream import DenStreamParams
    from vectorloom.streaming.minibatch import MiniBatchKMeans

    p = table(spark, blobs)
    fit = KMeans(3, seed=1, max_iter=5, metric=D.EUCLIDEAN).fit(p)
    save(fit, f"{tmp_path}/kmeans")
    back = load(spark, f"{tmp_path}/kmeans")
    assert (back.centroids == fit.centroids).all() and back.metric is D.EUCLIDEAN and back.inertia_trace == fit.inertia_trace and back.iterations == fit.iterations
    assert array(back.predict(p)).tolist() == array(fit.labels).tolist() == array(back.labels).tolist()
    layers = hierarchy.ProjectedHierarchy(dimensions=1, min_cluster_size=4, max_layers=4).fit(p)
    save(layers, f"{tmp_path}/layers")
    again = load(spark, f"{tmp_path}/layers")
    assert sorted(map(str, again.table().collect())) == sorted(map(str, layers.table().collect())) and again.dendrogram().count() == layers.dendrogram().count()
    stream = MiniBatchKMeans(2)
    stream.partial_fit(p.select(F.col("id").alias("seq"), "features"))
    graph_fit = correlation.CorrelationClustering().fit(spark.createDataFrame([(0, 1, 1.0)], "i long, j long, weight double"), 3)
    for name, model in (("stream", stream), ("graph", graph_fit), ("optics", optics.OPTICS(1.0, 3)), ("den", DenStreamParams(1.0, 2)), ("warm", KMeans(1, initial=((1.0, 2.0),))), ("dense", Dense(2.0, 4))):
        save(model, f"{tmp_path}/{name}")
        found = load(spark, f"{tmp_path}/{name}")
        assert type(found) is type(model)
        if name in ("optics", "den", "warm", "dense"):
            assert found == model
    assert (load(spark, f"{tmp_path}/stream").counts == stream.counts).all() and load(spark, f"{tmp_path}/graph").cost == graph_fit.cost
    own = Metric("own", D.EUCLIDEAN.column)
    save(Dense(1.0, 2, own), f"{tmp_path}/own")
    assert load(spark, f"{tmp_path}/own", own).metric is own
    with pytest.raises(errors.InvalidParameter):
        load(spark, f"{tmp_path}/own")
    with pytest.raises(errors.InvalidParameter):
        save(object(), f"{tmp_path}/nothing")


def test_scores_check_their_input(spark, blobs):
    p, y = table(spark, blobs), labelled(spark, [0] * 16 + [1] * 17)
    bad = p.withColumn("features", F.when(F.col("id") == 3, F.array(F.lit(float("nan")), F.lit(1.0))).otherwise(F.col("features")))
    ragged = p.withColumn("features", F.when(F.col("id") == 3, F.array(F.lit(1.0))).otherwise(F.col("features")))
    scores = [evaluation.silhouette, evaluation.silhouette_noise_aware, evaluation.calinski_harabasz, evaluation.davies_bouldin, lambda p, y: evaluation.silhouette_sampled(p, y, 5), lambda p, y: evaluation.disco(p, y, 3)]
    for score in scores:
        with pytest.raises(errors.NonFinite):
            score(bad, y)
        with pytest.raises(errors.DimensionMismatch):
            score(ragged, y)
        for labels in (y.where("id > 0"), y.unionAll(labelled(spark, [1]).withColumn("id", F.lit(99).cast("long"))), y.withColumn("label", F.when(F.col("id") > 3, F.col("label")))):
            with pytest.raises(errors.InvalidParameter):
                score(p, labels)
    for score in (evaluation.adjusted_rand_index, evaluation.normalized_mutual_information, evaluation.purity):
        with pytest.raises(errors.InvalidParameter):
            score(y, y.where("id <> 5"))


def test_seeding_writes_least_distances(spark, blobs, monkeypatch):
    from vectorloom.operators import kmeans

    p = table(spark, blobs)
    whole = seed_centroids(p, 9, seed=3)
    monkeypatch.setattr(kmeans, "KEEP", 2)
    assert (seed_centroids(p, 9, seed=3) == whole).all()


def test_inertia_of_any_metric(spark, blobs):
    from vectorloom.functions.distance import Metric

    p, start = table(spark, blobs), tuple(map(tuple, blobs[:3].tolist()))
    traces = [KMeans(3, m, max_iter=3, tol=0.0, initial=start).fit(p).inertia_trace for m in (D.SQUARED_EUCLIDEAN, Metric("column", D.SQUARED_EUCLIDEAN.column))]
    assert np.allclose(*traces) and len(traces[0]) == 3


def test_staging_needs_a_shared_folder(spark, monkeypatch):
    from vectorloom.plans import staging

    class Conf:
        def get(self, key, default=None):
            return default

    class Context:
        master = "spark://host:7077"

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(errors.InvalidParameter):
        staging.shared_dir(Session())
    kept = staging.stage(spark.range(3), "test")
    fs, path = staging._on_disk(spark, kept._staged_at)
    assert kept.count() == 3 and fs.exists(path) and staging.own_dir(spark) in kept._staged_at
    staging.unstage(kept)
    assert not fs.exists(path)
