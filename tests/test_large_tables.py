"""What only large or odd tables show: each of these failed before the finding of its name was settled."""

from dataclasses import replace

import numpy as np
import pandas as pd

import pytest
from pyspark.sql import functions as F

from vectorloom import folded_queries
from vectorloom.errors import InvalidParameter
from vectorloom.functions import distance
from vectorloom.functions.distance import EUCLIDEAN, SQUARED_EUCLIDEAN
from vectorloom.operators import correlation, dbscan, evaluation, graph, hierarchy, optics, pairs, pivots, spanning
from vectorloom.queries import ORACLE_SQL
from vectorloom.streaming import denstream


def test_densities_of_tiny_values_are_rounded_as_by_sql(spark, tmp_path):
    """large densities, where scaling loses digits that a decimal keeps."""
    import duckdb

    r = np.random.default_rng(1)
    v = np.concatenate([10.0 ** r.uniform(-12, 0, 3000), 10.0 ** r.uniform(-307, -12, 500), [0.0, 12.8, 1e-308]])
    events = pd.DataFrame({"event_id": np.arange(len(v)), "value": v})
    spark.createDataFrame(events).write.parquet(f"{tmp_path}/events.parquet")
    want = duckdb.sql(ORACLE_SQL["scal_density"]).df().sort_values("event_id")["density"].to_numpy()
    got = folded_queries.scal_density(spark, str(tmp_path)).orderBy("event_id").toPandas()["density"].to_numpy()
    assert np.array_equal(want, got)


def frame(spark, x):
    return spark.createDataFrame([(k, [float(v) for v in row]) for k, row in enumerate(x)], "id long, features array<double>")


def odd(n=300, d=8):
    r = np.random.default_rng(5)
    x = r.normal(size=(n, d)) + 1e6  # products of these cancel
    x[10:30] = x[9]
    x[40:60] = x[39] + r.normal(size=(20, d)) * 1e-7
    return x


@pytest.mark.parametrize("metric", [EUCLIDEAN, SQUARED_EUCLIDEAN])
def test_products_lose_no_pair_and_change_no_bit(metric):
    """Distances by differences are worked out only where products say that they may matter."""
    x = odd()
    d = metric.block(x, x)
    for limit in (0.0, 1e-6, float(np.median(d)), float(d[0, 7])):
        r, c, near = distance.within(metric, x, x, limit)
        assert np.array_equal(np.nonzero(d <= limit), (r, c)) and np.array_equal(near, d[r, c])
    assert np.allclose(distance.for_sums(metric, x, x), d, rtol=1e-9, atol=0)
    assert distance.by_products(np.array([[np.inf]]), x[:, :1]) is None


def test_nearest_leave_a_task_once_a_row(spark, monkeypatch):
    """a task that goes over many tiles sends each row's nearest once, not once a tile."""
    x = odd()
    monkeypatch.setattr(pairs, "TILE", 32)
    p = frame(spark, x)
    groups = pairs.groups_for(len(x), 8, spark.sparkContext.defaultParallelism, 32)
    assert pairs.cheapest_ways(p, 3, EUCLIDEAN).count() <= len(x) * groups * 3
    d = EUCLIDEAN.block(x, x)
    np.fill_diagonal(d, np.inf)
    want = {(i, r + 1): (int(j), d[i, j]) for i in range(len(x)) for r, j in enumerate(np.lexsort((np.arange(len(x)), d[i]))[:3])}
    assert {(r["i"], r["rank"]): (r["j"], r["distance"]) for r in pairs.knn_join(p, 3).collect()} == want


def test_sums_leave_a_task_once_a_row(spark, monkeypatch):
    """Sums to each cluster are added up within a task."""
    x = odd() - 1e6
    monkeypatch.setattr(evaluation, "TILE", 32)
    labels = spark.createDataFrame([(k, k % 4 - 1) for k in range(len(x))], "id long, label long")
    sums = {(r["id"], r["other"]): (r["total"], r["n"]) for r in evaluation.cluster_distances(frame(spark, x), labels, noise=True).collect()}
    d, of = EUCLIDEAN.block(x, x), np.arange(len(x)) % 4 - 1
    assert len(sums) == 3 * len(x)
    for (i, c), (total, n) in sums.items():
        assert total == pytest.approx(d[i, of == c].sum(), rel=1e-9) and n == (of == c).sum() - (of[i] == c)


@pytest.mark.parametrize("border", ["textbook", "scan_order"])
def test_dense_tables_make_few_edges(spark, monkeypatch, border):
    """edges don't grow with the pairs within the radius."""
    r = np.random.default_rng(3)
    x = np.concatenate([r.normal(c, 0.2, (120, 6)) for c in (0, 3)] + [r.uniform(-2, 5, (40, 6))])
    p = frame(spark, x)
    monkeypatch.setattr(pairs, "TILE", 32)
    got = dbscan.DBSCAN(0.9, 5, border=border, plan="block").fit_predict(p).collect()
    d = EUCLIDEAN.block(x, x)
    near = d <= 0.9
    core = near.sum(1) >= 5
    seed = np.where(core, np.arange(len(x)), -1)
    for _ in range(len(x)):
        seed = np.where(core, np.where(near & core[None, :], seed[None, :], len(x)).min(1), -1)
    rank = {s: k for k, s in enumerate(sorted(set(seed[core])))}
    label = {r["id"]: r["label"] for r in got}
    assert all(label[i] == rank[seed[i]] for i in np.flatnonzero(core))
    for i in np.flatnonzero(~core):
        met = [seed[j] for j in np.flatnonzero(near[i] & core)]
        if border == "scan_order" and met and min(met) > i:
            met = [s for s in met if near[i, s]]
        assert label[i] == (rank[min(met)] if met else -1)
    made = pairs.linked(p, 0.9).count()
    groups = pairs.groups_for(len(x), 6, spark.sparkContext.defaultParallelism, 32)
    assert made <= len(x) * (groups + 1) < (near.sum() - len(x)) // 2
    parts = hierarchy.near_duplicates(p, 0.9).collect()
    assert {r["id"] for r in parts} == set(np.flatnonzero(near.sum(1) > 1))


def test_mutual_reachability_of_rows_with_core_distances(spark):
    """core distances go along with the points, not with every pair."""
    x = odd(70)
    p = frame(spark, x)
    core = {r["id"]: r["core"] for r in pairs.core_distances(p, 3).collect()}
    d = EUCLIDEAN.block(x, x)
    found = pairs.pairwise(p.join(pairs.core_distances(p, 3), "id")).collect()
    assert len(found) == 2415 and all(r["distance"] == max(d[r["i"], r["j"]], core[r["i"]], core[r["j"]]) for r in found)


@pytest.mark.parametrize(("metric", "root"), [(EUCLIDEAN, False), (SQUARED_EUCLIDEAN, True)])
def test_trees_of_points_that_cells_cannot_part(spark, monkeypatch, metric, root):
    """Rounds over blocks where cells of pivots rule nothing out."""
    r = np.random.default_rng(8)
    x = np.round(r.normal(size=(120, 12)), 1)
    x[50:56] = x[49]
    p = frame(spark, x)
    table = p.join(pairs.core_distances(p, 3, SQUARED_EUCLIDEAN if root else EUCLIDEAN), "id")
    want = sorted(map(tuple, hierarchy._prim(table, metric, np.sqrt if root else (lambda d: d)).collect()))
    monkeypatch.setattr(pivots, "SAMPLE", 60)
    monkeypatch.setattr(spanning, "LISTED", 3)
    assert not pivots.worthwhile(table, metric, k=3, root=root)
    assert sorted(map(tuple, spanning.pruned_tree(table, metric, root).collect())) == want
    assert pairs.range_join(p, 2.5, plan="pivot").count() == ((EUCLIDEAN.block(x, x) <= 2.5).sum() - len(x)) // 2


def test_nearest_of_many_on_a_line_takes_no_square():
    """a batch of rows against many centres needs neither their distances nor their time."""
    r = np.random.default_rng(2)
    c, x = np.round(r.normal(0, 3, (400, 1)), 1), np.round(r.normal(0, 3, (500, 1)), 2)
    for metric in (EUCLIDEAN, SQUARED_EUCLIDEAN):
        d = metric.block(x, c)
        label, near = pairs.nearest_of(metric, x, c)
        assert np.array_equal(label, d.argmin(1)) and np.array_equal(near, d.min(1))
    c2 = np.append(c, c, axis=1)
    assert np.array_equal(pairs.nearest_of(EUCLIDEAN, np.append(x, x, axis=1), c2)[0], EUCLIDEAN.block(np.append(x, x, axis=1), c2).argmin(1))
    assert pairs.nearest_of(EUCLIDEAN, r.normal(size=(20_000, 1)), r.normal(size=(300_000, 1)))[0].shape == (20_000,)  # 48 GB of distances


def test_metrics_of_the_user_have_a_kernel():
    """the query's own metric is worked out in blocks."""
    x = np.random.default_rng(0).normal(size=(20, 64))
    assert np.allclose(folded_queries.MANHATTAN.block(x, x), np.abs(x[:, None] - x[None]).sum(2), atol=1e-12)


@pytest.mark.parametrize("plan", ["grid", "projection"])
def test_cells_around_are_not_broadcast(spark, plan):
    """the side that goes to all cells around is larger than Spark thinks, and was broadcast."""
    p = frame(spark, np.random.default_rng(6).uniform(0, 50, (200, 2)))
    joined = pairs.range_join(p, 1.0, plan=plan)
    text = joined._jdf.queryExecution().optimizedPlan().toString() + joined._jdf.queryExecution().sparkPlan().toString()
    assert "BroadcastHashJoin [cell" not in text and "SortMergeJoin [cell" in text
    assert joined.count() == ((EUCLIDEAN.block(*[np.array([r["features"] for r in p.collect()])] * 2) <= 1.0).sum() - 200) // 2


def test_searches_by_lists_by_neighbours_and_by_a_matrix():
    """graphs of most pairs and of few edges for their vertices have their own way through one task, with the same labels."""
    for seed in range(12):
        r = np.random.default_rng(seed)
        n = int(r.integers(2, 60))
        i, j = np.triu_indices(n, 1)
        kept = r.uniform(size=len(i)) < (0.2, 1.0)[seed % 2]
        i, j = i[kept], j[kept]
        w = r.integers(-3, 4, len(i)).astype(float) if seed % 3 else r.uniform(-1, 0.6, len(i))
        order, ends = r.permutation(n), correlation.both_ends(n, i, j, w)
        merged = correlation.merge_rounds(correlation.pivots_in_order(order, *ends), i, j, w)
        want = correlation.move_rounds(merged, *ends, 200)
        m = np.zeros((n, n))
        m[i, j] = m[j, i] = w
        assert np.array_equal(correlation.move_by_neighbours(merged, *ends, 200), want)
        assert np.array_equal(correlation.search_matrix(order, m, 200), want)


@pytest.mark.parametrize(("share", "way"), [(1.0, "search_matrix"), (0.2, "move_by_neighbours")])
def test_no_joins_where_a_matrix_or_the_edges_fit(spark, monkeypatch, share, way):
    """neither the size of a list of all pairs nor that of a table of pulls sends a search to joins, which take a shuffle a round."""
    r = np.random.default_rng(1)
    i, j = np.triu_indices(40, 1)
    kept = r.uniform(size=len(i)) < share
    edges = spark.createDataFrame([(int(a), int(b), float(w)) for a, b, w in zip(i[kept], j[kept], r.integers(-3, 4, kept.sum()))], "i long, j long, weight double")
    fit = correlation.CorrelationClustering(max_iter=3).fit
    want = sorted(map(tuple, fit(edges, 40).labels.collect()))
    limit = 8 * 40 * 40 if way == "search_matrix" else 48 * edges.count()
    monkeypatch.setattr(correlation, "TASK_BYTES", limit)
    monkeypatch.setattr(correlation, "move_by_joins", lambda *a: pytest.fail("joins"))
    assert sorted(map(tuple, fit(edges, 40).labels.collect())) == want


def test_macro_clusters_make_no_table_of_pairs(spark, monkeypatch):
    """micro-clusters that touch are linked where they meet; what leaves a task is no more than its rows."""
    r = np.random.default_rng(7)
    x, radius, heavy = np.sort(r.uniform(0, 30, 240)).round(1)[r.permutation(240)], r.uniform(0, 0.2, 240), r.uniform(size=240) < 0.6
    monkeypatch.setattr(denstream, "TILE", 16)
    table = spark.createDataFrame([(k, 1, 3.0 if heavy[k] else 1.0, [float(x[k]), 1.0], float(radius[k])) for k in range(240)], "mc_id long, n long, weight double, centre array<double>, radius double")
    params = denstream.DenStreamParams(epsilon=0.2, min_points=3, beta=0.5, mu=2.5, macro_epsilon=0.25)
    near = (np.abs(x[:, None] - x) <= 0.25) & (np.abs(x[:, None] - x) <= radius[:, None] + radius)
    first = np.arange(240)
    for _ in range(240):
        first = np.where(heavy, np.where(near & heavy, first, 240).min(1), first)
    rank = {c: k for k, c in enumerate(sorted(set(first[heavy])))}
    want = [rank[first[k]] if heavy[k] else min([rank[first[j]] for j in np.flatnonzero(near[k] & heavy)], default=-1) for k in range(240)]
    assert {c["mc_id"]: c["label"] for c in denstream.macro_clusters(table, params).collect()} == dict(enumerate(want)) and -1 in want
    same = spark.range(600).selectExpr("id", "array(1.0D) as features", "1.0D as radius")
    groups = pairs.groups_for(600, 1, spark.sparkContext.defaultParallelism, pairs.TILE)
    assert denstream.touching_heavy(same, 0.25).count() <= 600 * (groups + 1) < 600 * 599 // 2


def lattice(n=160):
    return np.random.default_rng(7).integers(0, 4, size=(n, 4)).astype(float)


@pytest.mark.parametrize("x, epsilon, points", [(odd(160), 2.6, 5), (lattice(), 2.0, 4), (lattice(), 1.0, 9), (lattice(), 2.5, 1), (np.eye(90), 1.5, 3)])
def test_a_walk_holds_only_pairs_that_decide_a_step(spark, monkeypatch, x, epsilon, points):
    """the walk was refused where all pairs within epsilon were too many for it; ties, copies and noise included."""
    p = frame(spark, x).select((F.col("id") * 7919 % 1009).alias("id"), "features")  # places and ids differ
    model = optics.OPTICS(epsilon, points)
    rows = lambda: [tuple(r) for r in model.fit(p).orderBy("pos").collect()]
    want = rows()
    every = 2 * pairs.range_join(p, epsilon, plan="block").count()
    monkeypatch.setattr(pairs, "TILE", 32)
    monkeypatch.setattr(optics, "WALK", every - 1)
    if len(x) == 90:  # all as far apart as each other: any pair may decide
        with pytest.raises(InvalidParameter):
            model.fit(p)
        return
    assert rows() == want
    kept = optics.deciding(p, model.core_distances(p).select("id", F.col("core_distance").alias("core")), x.shape[1], epsilon, EUCLIDEAN)
    assert 2 * kept.count() < every


@pytest.mark.parametrize("seed", [0, 4])
def test_no_merge_gains_any_more(spark, seed):
    """a search ended where clusters gained by a merge, so planted groups came back in parts."""
    r = np.random.default_rng(seed)
    i, j = np.triu_indices(300, 1)
    kept = r.uniform(size=len(i)) < 0.03
    i, j = i[kept], j[kept]
    edges = spark.createDataFrame([(int(a), int(b), float(w)) for a, b, w in zip(i, j, r.integers(-3, 4, len(i)))], "i long, j long, weight double")
    fit = correlation.CorrelationClustering(max_iter=20).fit(edges, 300)
    assert correlation.merge_deltas(edges, fit.labels).where("delta < 0").isEmpty()


def test_merges_and_moves_go_on_in_turn():
    """by lists and by a matrix the settled labels are the same, and neither a merge nor a move gains any more."""
    for seed in range(8):
        r = np.random.default_rng(seed)
        n = int(r.integers(10, 70))
        i, j = np.triu_indices(n, 1)
        w = r.integers(-3, 4, len(i)).astype(float)
        ends, order = correlation.both_ends(n, i, j, w), r.permutation(n)
        m = np.zeros((n, n))
        m[i, j] = m[j, i] = w
        start = correlation.search_matrix(order, m, 50)
        got = correlation.settle(start, lambda x: correlation.merge_matrix(x, m), lambda x: correlation.move_matrix(x, m, 50), 99)
        assert np.array_equal(got, correlation.settle(start, lambda x: correlation.merge_rounds(x, i, j, w), lambda x: correlation.move_by_neighbours(x, *ends, 50), 99))
        assert np.array_equal(correlation.by_first(correlation.merge_rounds(got, i, j, w)), got) and np.array_equal(correlation.by_first(correlation.move_by_neighbours(got, *ends, 50)), got)


@pytest.mark.parametrize("most", [2_000_000, 0])
def test_sums_of_labels_make_no_table_of_edges(spark, monkeypatch, most):
    """weights between labels are added up where the pairs are, with what the edges as a table give."""
    x = odd(170) - 1e6
    monkeypatch.setattr(correlation, "TILE", 32)
    monkeypatch.setattr(correlation, "LABEL_PAIRS", most)
    p, labels = frame(spark, x), spark.createDataFrame([(k, None if k == 3 else (k * k) % 5 - 2) for k in range(170)], "id long, label long")
    edges = correlation.edges_from_distances(p, 3.5)
    want = {(r["i"], r["j"]): r["weight"] for r in graph.contract(edges, labels).collect()}
    assert {(r["i"], r["j"]): r["weight"] for r in correlation.contract_distances(p, labels, 3.5).collect()} == pytest.approx(want, rel=1e-9)
    assert {(r["a"], r["b"]): r["delta"] for r in correlation.merge_deltas_of_distances(p, labels, 3.5).collect()} == pytest.approx({k: -w for k, w in want.items()}, rel=1e-9)
    assert correlation.disagreement_of_distances(p, labels, 3.5).first()[0] == pytest.approx(graph.disagreement(edges, labels).first()[0], rel=1e-9)
    assert correlation.contract_distances(p.limit(0), labels, 3.5).isEmpty() and correlation.disagreement_of_distances(p.limit(0), labels, 3.5).first()[0] == 0
    if most:
        rows = correlation.label_sums(p, labels, 3.5)._jdf.queryExecution().optimizedPlan().toString()
        assert "Join" not in rows.split("FlatMapGroups")[0]


@pytest.mark.parametrize("x, y, limit", [(np.random.default_rng(0).normal(size=(90, 64)) / 8, np.random.default_rng(1).normal(size=(70, 64)) / 8, 8.0), (lattice(), lattice() + 1, 5.0), (odd(70), odd(60), 3.0), (np.full((3, 2), np.inf), np.ones((2, 2)), 9.0), (np.ones((4, 2)), np.ones((3, 2)), 0.0), (np.ones((2, 1500)), np.zeros((2, 1500)), 1500.0)])
def test_a_metric_of_the_user_may_tell_what_is_near(x, y, limit):
    """Pairs within a limit are found by small whole numbers, with the same bits as by all distances, which aren't worked out."""
    with np.errstate(all="ignore"):
        d = folded_queries.manhattan(x, y)
    found = distance.within(folded_queries.MANHATTAN, x, y, limit)
    row, column = np.nonzero(d <= limit)
    assert np.array_equal(found[0], row) and np.array_equal(found[1], column) and np.array_equal(found[2], d[row, column])
    if len(x) == 90:
        metric = replace(folded_queries.MANHATTAN_METRIC, block=lambda *a: pytest.fail("all distances"))
        assert len(distance.within(metric, x, y, limit)[0]) == len(row) > 0


@pytest.mark.parametrize(("x", "open_"), [([(0.5, 0.0), (0.5, 0.7), (0.0, 0.0), (0.0, 0.7), (0.49, 0.35), (1.48, 0.35), (1.9, 0.35), (1.9, 0.1), (2.0, 0.6), (2.0, 0.3)], True), ([(k % 3, k % 2) for k in range(60)], False)])
def test_cells_that_their_outermost_rows_link_send_no_others(spark, x, open_):
    """all rows of neighbouring full cells met, once for each block of the other, though a few of them tell; copies met each other too."""
    found = dbscan.DBSCAN(1.0, 5, plan="cells").fit_predict(frame(spark, x))
    assert {r["label"] for r in found.collect()} == {0}
    core = frame(spark, x).select("id", "features", F.transform("features", lambda v: F.floor(v / 0.7071).cast("long")).alias("cell"))
    links = dbscan.full_cell_links(core, 1.0, 1.0, EUCLIDEAN, 2, 2)
    assert links.count() >= 1 and (links.count() > dbscan.full_cell_links(core.where("id not in (4)"), 1.0, 1.0, EUCLIDEAN, 2, 2).count()) is open_
    assert "CoGroups" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_overlaps_of_points_make_no_table_of_edges(spark, monkeypatch):
    """F8: near pairs were written, shuffled and put into lists, which took the disk; ties, copies and far rows included."""
    monkeypatch.setattr(correlation, "TILE", 32)
    for x, threshold in ((odd(150) - 1e6, 2.9), (lattice(), 2.0), (odd(60), 3.0)):
        p = frame(spark, x)
        for metric, limit in ((EUCLIDEAN, threshold), (SQUARED_EUCLIDEAN, threshold**2)):
            assert np.array_equal(distance.below(metric, x, x, limit), metric.block(x, x) < limit)
        want = {tuple(r) for r in graph.jaccard_links(correlation.edges_from_distances(p, threshold, near=True), 0.2).collect()}
        found = correlation.jaccard_of_distances(p, threshold, 0.2)
        assert {tuple(r) for r in found.collect()} == want and want
        assert "parquet" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert correlation.jaccard_of_distances(p.limit(0), 1.0).isEmpty()


def test_nearest_look_at_cores_and_components_of_few(monkeypatch):
    """once a row's list is full, cores, components and ids are looked at only where the distance alone may get in."""
    r = np.random.default_rng(4)
    x, core, component = r.normal(size=(400, 6)), r.uniform(0, 1.5, 400), r.integers(0, 9, 400)
    seen, plain = [], np.maximum

    def counted(*a, **k):
        return plain(*a, **k)

    counted.outer = lambda a, b: seen.append(len(a) * len(b)) or plain.outer(a, b)
    side, best = pairs.Side(np.arange(400), x, core, component), pairs.Nearest(400, 3)
    monkeypatch.setattr(np, "maximum", counted)
    for a in range(0, 400, 50):
        for b in range(0, 400, 50):
            one, two = side[a : a + 50], side[b : b + 50]
            pairs.offer(best, a, one, two, distance.by_products(one.x, two.x), EUCLIDEAN, False, False)
    monkeypatch.undo()
    w = np.maximum(EUCLIDEAN.block(x, x), np.maximum.outer(core, core))
    w[component[:, None] == component] = np.inf
    assert np.array_equal(best.d, np.sort(w, axis=1)[:, :3]) and sum(seen) == 400 * 50


def test_limits_of_a_walk_are_two_numbers_a_pair():
    """what may lie between two rows was a matrix for every two tiles; it is the larger of a number for either row."""
    r = np.random.default_rng(3)
    gap, none = r.uniform(0, 9, 40), np.zeros(40)
    loose = np.arange(40) >= 37
    part = optics.Part(np.arange(40), none[:, None], none, np.where(loose, -np.inf, gap), loose)
    way = lambda i, j: np.inf if loose[i] or loose[j] else gap[i + 1 : j + 1].max()
    after, before = optics.ways_out(part, slice(0, 10), part, slice(30, 40), gap[10:30].max())
    assert all(max(after[i], before[j - 30]) == way(i, j) for i in range(10) for j in range(30, 40))
    inner = optics.heaviest(part, slice(20, 40))
    assert all(inner[i, j] == way(20 + i, 20 + j) for i in range(20) for j in range(i + 1, 20))
