"""Queries whose SQL goes step by step: trees, hierarchies, orderings, seeded fits and folds, and sources.

The SQL of a sequential algorithm is a recursive query whose working table is the algorithm's state.
"""

from __future__ import annotations

import math
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import vectors as V
from .functions.distance import EUCLIDEAN, SQUARED_EUCLIDEAN, Metric
from .models import load, save
from .operators import constrained, correlation, evaluation, graph, hierarchy, optics, pairs, spanning
from .operators.kmeans import KMeans, cluster_sums, new_centroids, seed_centroids
from .plans.staging import own_dir
from .queries import FIRST, K, KNN, MEANS, SQ, E, assigned_to, event_stream, first_rows, labels, long_form, mean_of, query, rounded, table, vectors
from .sources import points as S
from .streaming import denstream, minibatch

# trees ---------------------------------------------------------------------------------------------

LEAST = 5  # points of a cluster, and the rank of core distances


def prim(distance: str) -> str:
    """Recursive SQL for mst (u, v, w): the state is each point's cheapest way into the tree, ties by (u, v); x and y are the two points."""
    best = f"(w, least(t.id, src), greatest(t.id, src)) <= ({distance}, least(t.id, t.tip), greatest(t.id, t.tip))"
    return f"""total AS (SELECT count(*) AS n FROM g), grow AS (
  SELECT CAST(0 AS BIGINT) AS step, id, id = (SELECT min(id) FROM g) AS seen, CAST('infinity' AS DOUBLE) AS w, CAST(NULL AS BIGINT) AS src, (SELECT min(id) FROM g) AS tip FROM g
  UNION ALL
  SELECT step + 1, id, seen OR id = nxt, w, src, nxt FROM (
    SELECT *, first_value(id) OVER (ORDER BY seen, w, least(id, src), greatest(id, src)) AS nxt FROM (
      SELECT step, t.id, seen, CASE WHEN seen OR {best} THEN w ELSE {distance} END AS w, CASE WHEN seen OR {best} THEN src ELSE t.tip END AS src
      FROM grow t JOIN g x ON x.id = t.tip JOIN g y ON y.id = t.id) a) b WHERE step < (SELECT n - 1 FROM total)),
mst AS (SELECT least(id, src) AS u, greatest(id, src) AS v, w FROM grow WHERE step > 0 AND id = tip)"""


PLAIN = "list_distance(x.f, y.f)"
REACH = "greatest(list_distance(x.f, y.f), x.core, y.core)"
CORED = f"{KNN}, g AS (SELECT e.id, e.f, n.d AS core FROM e JOIN n ON n.i = e.id AND n.rank = {LEAST})"

#: Merges in order of weight: for each, the nodes of its two sides; history (k, id, node) is each point's node after k merges.
KRUSKAL = """m AS (SELECT row_number() OVER (ORDER BY w, u, v) AS k, u, v, w FROM mst),
history AS (
  SELECT CAST(0 AS BIGINT) AS k, id, row_number() OVER (ORDER BY id) - 1 AS node, CAST(NULL AS BIGINT) AS na, CAST(NULL AS BIGINT) AS nb FROM g
  UNION ALL
  SELECT k + 1, id, CASE WHEN node IN (na, nb) THEN (SELECT n FROM total) + k ELSE node END, na, nb FROM (
    SELECT h.k, h.id, h.node, max(CASE WHEN h.id = m.u THEN h.node END) OVER () AS na, max(CASE WHEN h.id = m.v THEN h.node END) OVER () AS nb FROM history h JOIN m ON m.k = h.k + 1)),
dg AS (SELECT h.k, h.node, any_value(na) AS na, any_value(nb) AS nb, any_value(m.w) AS w, count(*) AS size FROM history h JOIN m USING (k) WHERE h.node = (SELECT n FROM total) + h.k - 1 GROUP BY h.k, h.node)"""


@query(f"WITH RECURSIVE {CORED}, {prim(REACH)} SELECT u, v, round(w, 6) AS w FROM mst")
def mst_edges_pruned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tree in rounds over cells of pivots, as it is grown beyond what one task takes."""
    p = vectors(spark, sf_dir)
    return rounded(spanning.pruned_tree(p.join(pairs.core_distances(p, LEAST), "id"), EUCLIDEAN), "w")


@query(f"WITH RECURSIVE {CORED}, {prim(REACH)} SELECT u, v, round(w, 6) AS w FROM mst")
def mst_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(hierarchy.HDBSCAN().tree(vectors(spark, sf_dir)), "w")


@query(f"WITH RECURSIVE {E}, g AS (SELECT id, f FROM e), {prim(PLAIN)} SELECT row_number() OVER (ORDER BY w) - 1 AS position, round(w, 6) AS w FROM mst")
def mst_weights(spark, sf_dir):
    tree = hierarchy.spanning_tree(vectors(spark, sf_dir))
    return graph.ranked(tree, "w", "u", "v").select(F.col("rank").alias("position"), F.round("w", 6).alias("w"))


@query(f"WITH RECURSIVE {E}, g AS (SELECT id, f FROM e), {prim(PLAIN)}, {KRUSKAL} SELECT node, least(na, nb) AS \"left\", greatest(na, nb) AS \"right\", round(w, 6) AS distance, size FROM dg UNION ALL SELECT row_number() OVER (ORDER BY id) - 1, NULL, NULL, CAST(0 AS DOUBLE), CAST(1 AS BIGINT) FROM g")
def dendrogram(spark, sf_dir):
    return rounded(hierarchy.dendrogram(hierarchy.spanning_tree(vectors(spark, sf_dir))), "distance")


#: Density clusters from the merges. A cluster is named by the lowest node of its chain: one made of two large sides, or one that
#: is large while neither side was. ``tip`` is the order in which clusters come to be, ``born`` and ``gone`` are densities.
CONDENSED = f"""sized AS (SELECT node, size FROM dg UNION ALL SELECT DISTINCT node, 1 FROM history WHERE k = 0),
s AS (SELECT dg.*, a.size >= {LEAST} AS big_a, b.size >= {LEAST} AS big_b, 1 / dg.w AS density FROM dg JOIN sized a ON a.node = na JOIN sized b ON b.node = nb),
up AS (SELECT na AS node, k, node AS parent, density, big_b AS other, 0 AS side FROM s UNION ALL SELECT nb, k, node, density, big_a, 1 FROM s),
low AS (SELECT s.node, CASE WHEN big_a AND big_b THEN s.k * 3 + 2 ELSE up.k * 3 + up.side END AS tip, up.density, big_a AND big_b AS split FROM s LEFT JOIN up USING (node)
  WHERE s.size >= {LEAST} AND big_a = big_b AND (big_a OR up.k IS NOT NULL)),
chain AS (SELECT node AS low, node AS top FROM low UNION ALL SELECT low, s.node FROM chain JOIN s ON (na = top AND NOT big_b) OR (nb = top AND NOT big_a)),
ends AS (SELECT low, arg_max(top, sz.size) AS top, max(sz.size) AS size FROM chain JOIN sized sz ON sz.node = top GROUP BY low),
cl AS (SELECT low.node AS c, row_number() OVER (ORDER BY low.tip) AS tip, up.parent, coalesce(up.density, 0) AS born, ends.size FROM low JOIN ends ON ends.low = low.node LEFT JOIN up ON up.node = ends.top),
first AS (SELECT h.id, min(h.k) AS k FROM history h JOIN dg ON dg.node = h.node AND dg.size >= {LEAST} GROUP BY h.id),
pt AS (SELECT first.id, CASE WHEN s.big_a <> s.big_b THEN chain.low ELSE low.node END AS c, CASE WHEN s.big_a <> s.big_b THEN s.density ELSE low.density END AS density
  FROM first JOIN s USING (k) LEFT JOIN low ON low.node = s.node LEFT JOIN chain ON chain.top = s.node WHERE chain.low IS NOT NULL),
own AS (SELECT cl.c, coalesce((SELECT sum(density - born) FROM pt WHERE pt.c = cl.c), 0) + coalesce((SELECT sum(y.size * (y.born - cl.born)) FROM cl y WHERE y.parent = cl.c), 0) AS own FROM cl)"""

#: Bottom up in order of creation, so that children come before parents; then from the top down.
SELECTED = """pick AS (
  SELECT CAST(0 AS BIGINT) AS step, c, tip, parent, own, CAST(0 AS DOUBLE) AS sub, FALSE AS chosen FROM cl JOIN own USING (c)
  UNION ALL
  SELECT step + 1, c, tip, parent, own, CASE WHEN tip = step + 1 THEN greatest(own, coalesce(parts, 0)) ELSE sub END, CASE WHEN tip = step + 1 THEN parts IS NULL OR own > parts ELSE chosen END FROM (
    SELECT p.*, sum(CASE WHEN parent = now THEN sub END) OVER () AS parts FROM (SELECT *, max(CASE WHEN tip = step + 1 THEN c END) OVER () AS now FROM pick) p) WHERE step < (SELECT count(*) FROM cl)),
done AS (SELECT * FROM pick WHERE step = (SELECT count(*) FROM cl)),
home AS (SELECT c, tip, CASE WHEN chosen THEN c END AS kept FROM done WHERE parent IS NULL
  UNION ALL SELECT done.c, done.tip, coalesce(home.kept, CASE WHEN done.chosen THEN done.c END) FROM home JOIN done ON done.parent = home.c),
names AS (SELECT c, row_number() OVER (ORDER BY tip) - 1 AS label FROM home WHERE kept = c),
hd AS (SELECT pt.id, names.label, density, max(density) OVER (PARTITION BY names.label) AS most, count(*) OVER (PARTITION BY names.label) AS size FROM pt JOIN home ON home.c = pt.c JOIN names ON names.c = home.kept)"""

HD = f"WITH RECURSIVE {CORED}, {prim(REACH)}, {KRUSKAL}, {CONDENSED}, {SELECTED}"


@query(f"{HD} SELECT g.id, coalesce(CASE WHEN size >= {LEAST} THEN label END, -1) AS label FROM g LEFT JOIN hd USING (id)")
def hdbscan_labels(spark, sf_dir):
    return hierarchy.hdbscan(vectors(spark, sf_dir), LEAST)


@query(f"{HD} SELECT g.id, round(coalesce(CASE WHEN size >= {LEAST} THEN 1 - density / most END, 1), 6) AS outlier_score FROM g LEFT JOIN hd USING (id)")
def hdbscan_glosh(spark, sf_dir):
    return rounded(hierarchy.HDBSCAN().fit(vectors(spark, sf_dir)).select("id", "outlier_score"), "outlier_score")


@query(f"{HD} SELECT tip - 1 AS cluster, (SELECT y.tip - 1 FROM cl y WHERE y.c = cl.parent) AS parent, round(born, 6) AS born, size, round(own, 6) AS stability FROM cl JOIN own USING (c)")
def hdbscan_condensed(spark, sf_dir):
    return rounded(hierarchy.HDBSCAN().condensed(vectors(spark, sf_dir)), "born", "stability")


LAYERS, TARGET = 10, 8
PROJECTION = V.projection_matrix(64, 15, 42)
PROJECTED = f"{E}, g AS (SELECT id, [" + ", ".join(f"list_inner_product(f, CAST({[float(v) for v in row]} AS DOUBLE[]))" for row in PROJECTION) + "] AS f FROM e)"
LAYERED = f"""WITH RECURSIVE {PROJECTED}, {prim(PLAIN)}, {KRUSKAL},
picked AS (SELECT DISTINCT m.w FROM (SELECT CAST(floor(pow(l / {LAYERS - 1}.0, 0.5 + 1e-6) * ((SELECT max(k) FROM m) - 1) + 0.5) AS BIGINT) + 1 AS k FROM range({LAYERS}) r(l)) JOIN m USING (k)),
cut AS (SELECT picked.w AS threshold, max(m.k) AS k FROM picked JOIN m ON m.w <= picked.w GROUP BY picked.w),"""
CUTS = """comp AS (SELECT threshold, node, min(id) AS least, count(*) AS size FROM cut JOIN history USING (k) GROUP BY threshold, node),
ranks AS (SELECT threshold, node, row_number() OVER (PARTITION BY threshold ORDER BY least) - 1 AS label FROM comp WHERE size >= 5),
lab AS (SELECT cut.threshold, h.id, ranks.label FROM cut JOIN history h USING (k) LEFT JOIN ranks ON ranks.threshold = cut.threshold AND ranks.node = h.node)"""


@query(f"{LAYERED} {CUTS}, o AS (SELECT threshold, row_number() OVER (ORDER BY count(DISTINCT label) DESC, threshold) - 1 AS layer FROM lab GROUP BY threshold) SELECT CAST(layer AS INTEGER) AS layer, round(threshold, 6) AS threshold, id, label FROM lab JOIN o USING (threshold)")
def evoc_layers(spark, sf_dir):
    return rounded(hierarchy.ProjectedHierarchy(min_cluster_size=5).fit(vectors(spark, sf_dir)).table(), "threshold")


BEST = f"tally AS (SELECT k, sum(CASE WHEN size >= 5 THEN 1 ELSE 0 END) AS clusters, sum(CASE WHEN size >= 5 THEN size ELSE 0 END) AS points FROM (SELECT k, node, count(*) AS size FROM history GROUP BY k, node) GROUP BY k), chosen AS (SELECT k FROM tally ORDER BY abs(clusters - {TARGET}), points DESC, clusters DESC, k LIMIT 1)"


@query(f"{LAYERED.split('picked AS')[0]} {BEST}, cut AS (SELECT 0 AS threshold, coalesce((SELECT max(y.k) FROM m x JOIN m y ON y.w <= x.w WHERE x.k = chosen.k), 0) AS k FROM chosen), {CUTS} SELECT id, label FROM lab")
def layer_for_n_clusters(spark, sf_dir):
    return hierarchy.ProjectedHierarchy(min_cluster_size=5).fit(vectors(spark, sf_dir)).layer_for_n_clusters(TARGET)


@query(
    f"""WITH RECURSIVE {KNN}, g AS (SELECT e.id, e.f, coalesce(CASE WHEN n.d <= 1.2 THEN n.d END, CAST('infinity' AS DOUBLE)) AS core FROM e JOIN n ON n.i = e.id AND n.rank = 3),
walk AS (
  SELECT CAST(0 AS BIGINT) AS step, id, id = (SELECT min(id) FROM g) AS seen, CAST('infinity' AS DOUBLE) AS r, (SELECT min(id) FROM g) AS tip FROM g
  UNION ALL
  SELECT step + 1, id, seen OR id = nxt, r, nxt FROM (SELECT *, first_value(id) OVER (ORDER BY seen, r, id) AS nxt FROM (
    SELECT step, t.id, seen, CASE WHEN seen OR isinf(x.core) OR list_distance(x.f, y.f) > 1.2 THEN r ELSE least(r, greatest(x.core, list_distance(x.f, y.f))) END AS r
    FROM walk t JOIN g x ON x.id = t.tip JOIN g y ON y.id = t.id) a) b WHERE step < (SELECT count(*) - 1 FROM g))
SELECT step AS pos, walk.id, round(r, 6) AS reachability, round(core, 6) AS core_distance FROM walk JOIN g USING (id) WHERE walk.id = tip"""
)
def optics_ordering(spark, sf_dir):
    return rounded(optics.OPTICS(1.2, 4).fit(vectors(spark, sf_dir)), "reachability", "core_distance")


# seeded fits ---------------------------------------------------------------------------------------


def draws(k: int, alpha: float, seed: int = 42) -> str:
    """SQL for the k drawn rows, as c0 (k, c): the smallest of -ln(u) / weight."""
    u = lambda n: f"((CAST(('0x' || substr(md5('{seed}-{n}-' || id), 1, 13)) AS BIGINT) + 0.5) / {2**52})"
    out = f"s0 AS MATERIALIZED (SELECT id, f FROM e ORDER BY {u(0)}, id LIMIT 1), d0 AS MATERIALIZED (SELECT e.id, e.f, {SQ.format('e.f', 's0.f')} AS d FROM e, s0)"
    for n in range(1, k):
        weight = f"pow(d, {alpha / 2})"
        out += f", s{n} AS MATERIALIZED (SELECT id, f FROM d{n - 1} ORDER BY {weight} <= 0, CASE WHEN {weight} > 0 THEN -ln({u(n)}) / {weight} ELSE {u(n)} END, id LIMIT 1)"
        out += f", d{n} AS MATERIALIZED (SELECT b.id, b.f, least(b.d, {SQ.format('b.f', f's{n}.f')}) AS d FROM d{n - 1} b, s{n})"
    return out + ", c0 AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT CAST({n} AS BIGINT) AS k, f AS c FROM s{n}" for n in range(k)) + ")"


def rounds(number: int, tol: float) -> str:
    """SQL for Lloyd's rounds from c0: c1 ..., each the one before once that has settled."""
    out = "spread AS (SELECT avg(v) AS v FROM (SELECT var_pop(f[x]) AS v FROM (SELECT f, unnest(range(1, len(f) + 1)) AS x FROM e) GROUP BY x)), still0 AS (SELECT FALSE AS still)"
    for n in range(number):
        out += f", a{n} AS MATERIALIZED ({assigned_to(f'c{n}')}), n{n} AS MATERIALIZED ({mean_of(f'a{n}')})"
        out += f", c{n + 1} AS MATERIALIZED (SELECT k, CASE WHEN (SELECT still FROM still{n}) THEN c{n}.c ELSE n{n}.c END AS c FROM c{n} JOIN n{n} USING (k))"
        out += f", still{n + 1} AS MATERIALIZED (SELECT (SELECT still FROM still{n}) OR sum({SQ.format(f'c{n}.c', f'c{n + 1}.c')}) < {tol} * (SELECT v FROM spread) * {K} AS still FROM c{n} JOIN c{n + 1} USING (k))"
    return out


@query(f"WITH {E}, {draws(K, 2.0)} SELECT k AS cluster, x - 1 AS position, round(c[x], 6) AS value FROM (SELECT k, c, unnest(range(1, len(c) + 1)) AS x FROM c0)")
def kmeans_seeds(spark, sf_dir):
    found = seed_centroids(vectors(spark, sf_dir), K, seed=42)
    return long_form(spark.createDataFrame([(k, c.tolist()) for k, c in enumerate(found)], "cluster long, c array<double>"), "c", "cluster")


def seeded(alpha: float) -> str:
    return f"WITH {E}, {draws(K, alpha)}, {rounds(10, 1e-4)}, z AS ({assigned_to('c10')}) SELECT id, k AS label FROM z"


@query(seeded(2.0))
def kmeans_fit_seeded(spark, sf_dir):
    return KMeans(K, seed=42, max_iter=10).fit(vectors(spark, sf_dir), extra=False).labels


@query(seeded(4.0))
def kmeans_alpha4(spark, sf_dir):
    return KMeans(K, seed=42, max_iter=10, alpha=4.0).fit(vectors(spark, sf_dir), extra=False).labels


STOP = 0.02


@query(f"WITH {E}, {FIRST}, {rounds(12, STOP)} SELECT 1 + " + " + ".join(f"(SELECT CAST(NOT still AS INTEGER) FROM still{n})" for n in range(1, 12)) + " AS iterations")
def kmeans_stop(spark, sf_dir):
    p = vectors(spark, sf_dir)
    fit = KMeans(K, max_iter=12, tol=STOP, initial=tuple(map(tuple, first_rows(p)))).fit(p, extra=False)
    return spark.createDataFrame([(fit.iterations,)], "iterations int")


FAR_SQL = f"c0 AS (SELECT row_number() OVER (ORDER BY id) - 1 AS k, CASE WHEN row_number() OVER (ORDER BY id) IN (3, 7) THEN list_transform(f, lambda v: v + 100 + id) ELSE f END AS c FROM e ORDER BY id LIMIT {K})"


@query(
    f"WITH {E}, {FAR_SQL}, a AS ({assigned_to('c0')}), m AS ({mean_of('a')}), big AS (SELECT k FROM a GROUP BY k ORDER BY count(*) DESC, k LIMIT 1), "
    f"far AS (SELECT a.f FROM a JOIN big USING (k) JOIN m USING (k) ORDER BY {SQ.format('a.f', 'm.c')} DESC, a.id LIMIT 1) "
    "SELECT k AS cluster, x - 1 AS position, round(c[x], 6) AS value FROM (SELECT c0.k, coalesce(m.c, (SELECT f FROM far)) AS c, unnest(range(1, 65)) AS x FROM c0 LEFT JOIN m USING (k))"
)
def kmeans_empty_cluster(spark, sf_dir):
    """Two centroids far from all points take the farthest member of the largest cluster."""
    p = vectors(spark, sf_dir)
    old = first_rows(p)
    for k in (2, 6):
        old[k] += 100 + k
    new = new_centroids(p, old, cluster_sums(p, old, SQUARED_EUCLIDEAN), SQUARED_EUCLIDEAN)
    return long_form(spark.createDataFrame([(k, c.tolist()) for k, c in enumerate(new)], "cluster long, c array<double>"), "c", "cluster")


@query(f"WITH {E}, {FIRST}, {rounds(3, 0.0)}, z AS ({assigned_to('c3')}) SELECT id, k AS label FROM z")
def saved_model_predict(spark, sf_dir):
    """A fit, written, read and used again."""
    p = vectors(spark, sf_dir)
    path = f"{own_dir(spark)}/model-{spark.range(1).select(F.expr('uuid()')).first()[0]}"
    save(KMeans(K, max_iter=3, tol=0.0, initial=tuple(map(tuple, first_rows(p)))).fit(p), path)
    return load(spark, path).predict(p).select("id", "label")


# distances, constraints, labels ----------------------------------------------------------------------


def manhattan(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Summed in order of the coordinates, as the expression does."""
    out, gap = np.zeros((len(x), len(y))), np.empty((len(x), len(y)))
    for k in range(x.shape[1]):
        np.subtract.outer(x[:, k], y[:, k], out=gap)
        out += np.abs(gap, out=gap)
    return out


def manhattan_near(x: np.ndarray, y: np.ndarray, limit: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, distance) of pairs at most limit apart: small whole numbers tell which can be, and these alone are worked out.

    A difference of two numbers is twice their maximum less their sum. Coordinates are cut into so many steps that
    16 bits hold the sum of them all; each is then less than a step off, and so is each difference.
    """
    d = x.shape[1]
    if not limit >= 0:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    low, high = (min(x.min(), y.min()), max(x.max(), y.max())) if d else (0.0, 0.0)
    steps = 65_535 // max(1, d)
    with np.errstate(all="ignore"):
        scale = steps / (high - low) if high > low else 1.0
        sound = np.isfinite(scale) and np.isfinite(high - low)
    if steps < 64 or not d or not sound:
        apart = manhattan(x, y)
        row, column = np.nonzero(apart <= limit)
        return row, column, apart[row, column]
    a, b = (np.ascontiguousarray(np.minimum((v.T - low) * scale, steps).astype(np.uint16)) for v in (x, y))
    top, larger = np.zeros((len(x), len(y)), np.uint16), np.empty((len(x), len(y)), np.uint16)
    for k in range(d):
        np.maximum.outer(a[k], b[k], out=larger)
        np.add(top, larger, out=top)
    most = math.ceil(min(limit * scale * (1 + 1e-9), 65_535.0)) + d + 1
    both = np.add.outer(*(c.sum(0, dtype=np.int32) for c in (a, b)))
    row, column = np.divmod(np.flatnonzero(2 * top.astype(np.int32) - both <= most), len(y))
    out, step = np.empty(len(row)), max(1, 1_000_000 // d)
    for at in range(0, len(row), step):
        gaps = np.abs(x[row[at : at + step]] - y[column[at : at + step]])
        out[at : at + step] = np.add.accumulate(gaps, axis=1)[:, -1]  # in order of the coordinates
    kept = out <= limit
    return row[kept], column[kept], out[kept]


MANHATTAN = Metric("manhattan", lambda x, y: V.total(F.zip_with(x, y, lambda a, b: F.abs(a - b))), manhattan, near=manhattan_near)


@query(f"WITH {E} SELECT a.id AS i, b.id AS j, round(list_sum(list_transform(list_zip(a.f, b.f), lambda z: abs(z[1] - z[2]))), 6) AS distance FROM e a JOIN e b ON a.id < b.id AND list_sum(list_transform(list_zip(a.f, b.f), lambda z: abs(z[1] - z[2]))) <= 7.5")
def dist_custom(spark, sf_dir):
    """A metric of the user's own, as an expression and a kernel."""
    return rounded(pairs.range_join(vectors(spark, sf_dir), 7.5, MANHATTAN), "distance")


@query("SELECT event_id, round(CASE WHEN value > 0 THEN 1 / value ELSE CAST('infinity' AS DOUBLE) END, 6) AS density FROM events")
def scal_density(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", V.rounded(V.inverse(F.col("value")), 6).alias("density"))


@query("SELECT event_id, CAST(ceil(log2(bm / (bm - 1)) / rate) AS BIGINT) AS period FROM (SELECT event_id, (2 + event_id % 9) / 10 * CAST(6 + user_id % 15 AS DOUBLE) AS bm, (1 + event_id % 25) / 100 AS rate FROM events)")
def scal_pruning_period(spark, sf_dir):
    e = F.col("event_id")
    return table(spark, sf_dir, "events").select("event_id", V.pruning_periods((2 + e % 9) / 10, (6 + F.col("user_id") % 15).cast("double"), (1 + e % 25) / 100).cast("long").alias("period"))


MANHATTAN_METRIC = Metric("manhattan", MANHATTAN.column, manhattan, triangle="plain", near=manhattan_near)


@query(f"WITH {E} SELECT a.id AS i, b.id AS j, round(list_sum(list_transform(list_zip(a.f, b.f), lambda z: abs(z[1] - z[2]))), 6) AS distance FROM e a JOIN e b ON a.id < b.id AND list_sum(list_transform(list_zip(a.f, b.f), lambda z: abs(z[1] - z[2]))) <= 7.5")
def range_join_pivot_custom(spark, sf_dir):
    """Cells of pivots for a metric of the user's own."""
    return rounded(pairs.range_join(vectors(spark, sf_dir), 7.5, MANHATTAN_METRIC, plan="pivot"), "distance")


@query(f"WITH {E}, {FIRST}, d AS (SELECT id, k, {SQ.format('f', 'c')} AS d FROM e, c0) SELECT id, row_number() OVER (PARTITION BY id ORDER BY d, k) - 1 AS rank, k AS cluster, round(d, 6) AS distance FROM d")
def candidate_clusters(spark, sf_dir):
    p = vectors(spark, sf_dir)
    return rounded(constrained.candidates(p, first_rows(p)), "distance")


@query(f"WITH {E}, k AS (SELECT id AS a, id + 7 AS b FROM e WHERE id % 3 = 0 AND id + 7 IN (SELECT id FROM e)) SELECT DISTINCT k.a AS id, e.label FROM k JOIN e ON e.id = k.b UNION SELECT k.b, e.label FROM k JOIN e ON e.id = k.a")
def cannot_link_clusters(spark, sf_dir):
    p = vectors(spark, sf_dir).select("id")
    links = p.where("id % 3 = 0").select(F.col("id").alias("a"), (F.col("id") + 7).alias("b"), F.lit("cannot").alias("kind")).join(p.select(F.col("id").alias("b")), "b", "left_semi")
    return constrained.forbidden(labels(spark, sf_dir), links.select("a", "b", "kind"))


@query(f"WITH {E} SELECT id, (label * 3) % 4 AS label FROM e")
def expand_labels(spark, sf_dir):
    home = labels(spark, sf_dir)
    return correlation.expand(home, home.select(F.col("label").alias("id")).distinct().withColumn("label", (F.col("id") * 3) % 4))


PLANTED = "WITH v AS (SELECT vec_id AS id FROM embeddings)"


@query(f"{PLANTED} SELECT id, rank AS label FROM (SELECT id, dense_rank() OVER (ORDER BY first) - 1 AS rank FROM (SELECT id, min(id) OVER (PARTITION BY (id * id) % 7) AS first FROM v))")
def correlation_planted(spark, sf_dir):
    """Edges that attract within planted groups and repel across, some the other way and weaker: the groups come back."""
    v = vectors(spark, sf_dir).select("id")
    n = v.count()
    group = lambda c: (F.col(c) * F.col(c)) % 7
    near = v.select(F.col("id").alias("i"), F.explode(F.sequence(F.lit(1), F.lit(60))).alias("step")).select("i", ((F.col("i") + F.col("step") * F.col("step")) % n).alias("j")).where("i <> j")
    same = group("i") == group("j")
    weight = F.when(same, F.lit(1.0)).otherwise(F.lit(-1.0)) * F.when((F.col("i") + F.col("j")) % 19 == 0, F.lit(-0.25)).otherwise(F.lit(1.0))
    return correlation.CorrelationClustering(max_iter=20).fit(near.select("i", "j", weight.alias("weight")), n).labels


def blobs(spark: SparkSession, sf_dir: str, groups: int = 4) -> DataFrame:
    """A point for each vec_id: a far place for its group, and a small step aside."""
    g = F.col("vec_id") % groups
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("id"), F.array((g * 100).cast("double"), (g * g * 40).cast("double") + (F.col("vec_id") % 11) / 10.0).alias("features"))


@query(f"{PLANTED} SELECT id, id % 4 AS label FROM v")
def cop_kmeans_planted(spark, sf_dir):
    """Far groups under constraints that agree with them, renamed by smallest id."""
    p = blobs(spark, sf_dir)
    ends = p.select(F.col("id").alias("b"))
    pair = lambda step, kind: p.where("id % 5 = 0").select(F.col("id").alias("a"), (F.col("id") + step).alias("b"), F.lit(kind).alias("kind"))
    links = pair(8, "must").unionAll(pair(5, "cannot")).join(ends, "b", "left_semi").select("a", "b", "kind")
    return graph.relabel(constrained.ConstrainedKMeans(4, max_iter=10).fit_predict(p, links))


@query("SELECT 'points' AS what, count(*) AS n FROM embeddings UNION ALL SELECT 'must' AS what, 0 AS n UNION ALL SELECT 'cannot', 0")
def cop_kmeans_kept(spark, sf_dir):
    """Points that have a label, and the constraints that a fit breaks: none."""
    p = vectors(spark, sf_dir)
    links = cop_links(p)
    found = constrained.ConstrainedKMeans(K, max_iter=5).fit_predict(p, links)
    met = links.join(found.select(F.col("id").alias("a"), F.col("label").alias("x")), "a").join(found.select(F.col("id").alias("b"), F.col("label").alias("y")), "b")
    kinds = spark.createDataFrame([("must",), ("cannot",)], "what string")
    broken = met.where("(kind = 'must' and x <> y) or (kind = 'cannot' and x = y)").groupBy(F.col("kind").alias("what")).agg(F.count(F.lit(1)).alias("n"))
    return kinds.join(broken, "what", "left").select("what", F.coalesce("n", F.lit(0).cast("long")).alias("n")).unionAll(found.select(F.lit("points").alias("what")).groupBy("what").agg(F.count(F.lit(1)).alias("n")))


def cop_links(p: DataFrame) -> DataFrame:
    ends = p.select(F.col("id").alias("b"))
    pair = lambda rest, step, kind: p.where(F.col("id") % 20 == rest).select(F.col("id").alias("a"), (F.col("id") + step).alias("b"), F.lit(kind).alias("kind"))
    return pair(0, 1, "must").unionAll(pair(1, 1, "must")).unionAll(pair(4, 5, "cannot")).join(ends, "b", "left_semi").select("a", "b", "kind")


# sources -----------------------------------------------------------------------------------------------


@query(f"WITH {E} SELECT dense_rank() OVER (ORDER BY label) - 1 AS id, x - 1 AS position, round(CAST(CAST(avg(f[x]) AS FLOAT) AS DOUBLE), 6) AS value FROM (SELECT label, f, unnest(range(1, 65)) AS x FROM e) GROUP BY label, x")
def src_rows(spark, sf_dir):
    """Nested lists and arrays of either precision give the same points: each label's mean vector, from the driver's memory."""
    array = S.centroids_array(S.points(table(spark, sf_dir, "embeddings"), "vec_id", "embedding").join(labels(spark, sf_dir), "id").transform(lambda p: cluster_means(p)))
    half = S.from_rows(spark, array[:5].astype(np.float32))
    rest = S.from_rows(spark, array[5:].tolist()).withColumn("id", F.col("id") + 5)
    return long_form(half.unionAll(rest), "features", "id")


def cluster_means(p: DataFrame) -> DataFrame:
    """(cluster, centroid) of rows with a label: few rows, one for each label."""
    long = p.select("label", F.posexplode("features").alias("position", "v")).groupBy("label", "position").agg(F.avg("v").alias("v"))
    return long.groupBy(F.col("label").alias("cluster")).agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "v"))), lambda x: x["v"]).alias("centroid"))


@query(f"WITH {E}, r AS (SELECT label, f, row_number() OVER (PARTITION BY label ORDER BY id) - 1 AS id FROM e) SELECT id, x - 1 AS position, count(*) AS n, round(sum(f[x]), 9) AS value FROM (SELECT id, f, unnest(range(1, 65)) AS x FROM r) GROUP BY id, x")
def src_flat(spark, sf_dir):
    """Each label's vectors as one row-major array, and its rows again; summed over the labels."""
    given = table(spark, sf_dir, "embeddings").groupBy("label").agg(F.array_sort(F.collect_list(F.struct("vec_id", "embedding"))).alias("rows"))
    flat = given.select(F.flatten(F.transform("rows", lambda r: r["embedding"])).alias("flat"))
    found = S.from_flat(flat, "flat", 64).select("id", F.posexplode("features").alias("position", "value"))
    return found.groupBy("id", F.col("position").cast("long")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 9).alias("value"))


@query(f"WITH {E} SELECT row_number() OVER (ORDER BY id) - 1 AS id, CASE WHEN label = 0 THEN -1 ELSE label END AS label FROM e")
def src_labels(spark, sf_dir):
    """Labels in, with any negative one as noise, out as an array, and in again."""
    given = labels(spark, sf_dir).select("id", F.when(F.col("label") == 0, -1 - F.col("id")).otherwise(F.col("label")).alias("label"))
    return S.from_labels(spark, S.labels_array(S.from_labels(spark, S.labels_array(given))))


@query(f"WITH {E} SELECT dense_rank() OVER (ORDER BY label) - 1 AS id, label, x - 1 AS position, round((count(*) FILTER (f[x] > 0)) % 256 / 255, 6) AS value FROM (SELECT label, f, unnest(range(1, 65)) AS x FROM e) GROUP BY label, x")
def src_idx(spark, sf_dir):
    """Image and label files, from their bytes: for each label, how many vectors are positive in each place, as an image of 8 x 8."""
    e = table(spark, sf_dir, "embeddings").select(F.col("label").cast("long").alias("label"), F.posexplode("embedding").alias("position", "v"))
    pixel = F.lpad(F.hex(F.count_if(F.col("v") > 0) % 256), 2, "0")
    images = e.groupBy("label", "position").agg(pixel.alias("pixel")).groupBy("label").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "pixel"))), lambda x: x["pixel"]), "").alias("image"))
    in_order = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("label", c))), lambda x: x[c]), "")
    count = F.lpad(F.hex(F.count(F.lit(1))), 8, "0")
    file = lambda head, size, body: F.unhex(F.concat(F.lit(head), count, F.lit(size), body)).alias("content")
    marked = images.withColumn("mark", F.lpad(F.hex("label"), 2, "0"))
    return long_form(S.idx_points(marked.agg(file("00000803", "0000000800000008", in_order("image"))), marked.agg(file("00000801", "", in_order("mark")))), "features", "id", "label")


@query(f"WITH {E} SELECT label AS cluster, x - 1 AS position, round(avg(f[x]), 6) AS value FROM (SELECT label, f, unnest(range(1, 65)) AS x FROM e) GROUP BY label, x")
def src_centroids(spark, sf_dir):
    """Centroids out as an array, and in again."""
    from .operators.kmeans import centroids_of

    array = S.centroids_array(centroids_of(vectors(spark, sf_dir), labels(spark, sf_dir)))
    return long_form(S.from_rows(spark, array.tolist()).withColumnRenamed("id", "cluster"), "features", "cluster")


# streams -----------------------------------------------------------------------------------------------

MODELS = ((0.5, 0.5), (2.5, 0.5), (4.0, 0.7))
MB_FOLD = f"""WITH RECURSIVE q AS (SELECT user_id AS m, event_id AS s, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r, [ln(1 + value), length(event_type) / 10.0] AS x FROM events), f AS (
  SELECT DISTINCT user_id AS m, CAST(0 AS BIGINT) AS r, CAST(NULL AS BIGINT) AS s, CAST(NULL AS BIGINT) AS label, {[list(c) for c in MODELS]}::DOUBLE[][] AS c, [0::BIGINT, 0, 0] AS n FROM events
  UNION ALL
  SELECT m, r, s, near - 1, list_transform(c, lambda v, i: CASE WHEN i = near THEN list_transform(list_zip(v, x), lambda z: z[1] + (z[2] - z[1]) / (n[near] + 1)) ELSE v END), list_transform(n, lambda v, i: v + CAST(i = near AS BIGINT)) FROM (
    SELECT *, CAST(list_position(d, list_min(d)) AS BIGINT) AS near FROM (SELECT q.m, q.r, q.s, q.x, f.c, f.n, list_transform(f.c, lambda v: pow(v[1] - q.x[1], 2) + pow(v[2] - q.x[2], 2)) AS d FROM f JOIN q ON q.m = f.m AND q.r = f.r + 1))),
e AS (SELECT m, max(r) AS r FROM f GROUP BY m)"""


def models_of_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_stream(spark, sf_dir).select(F.col("tenant").alias("model"), "seq", "features")


def streamed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(labels, models) of a model for each user: a stream over the first half of the events, stopped and gone on with from its checkpoint."""
    folder, rows = f"{own_dir(spark)}/learnt-{uuid.uuid4().hex}", models_of_users(spark, sf_dir)
    ends = rows.agg(F.min("seq").alias("a"), F.max("seq").alias("b")).first()
    middle = ((ends["a"] or 0) + (ends["b"] or 0)) // 2
    for k, part in enumerate((F.col("seq") < middle, F.col("seq") >= middle)):
        rows.where(part).write.parquet(f"{folder}/in/{k}")
        learnt = minibatch.learn(spark.readStream.schema(rows.schema).parquet(f"{folder}/in/*"), 3, initial=MODELS)
        writer = learnt.writeStream.format("parquet").option("path", f"{folder}/labels").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True)
        minibatch.started(spark, writer).awaitTermination()
    return spark.read.parquet(f"{folder}/labels"), minibatch.models(spark, f"{folder}/checkpoint")


@query(f"{MB_FOLD} SELECT m AS model, s AS seq, label FROM f WHERE s IS NOT NULL")
def minibatch_labels(spark, sf_dir):
    return streamed(spark, sf_dir)[0].select("model", "seq", "label")


@query(f"{MB_FOLD} SELECT m AS model, CAST(i - 1 AS BIGINT) AS cluster, n[i] AS n, round(c[i][1], 9) AS x, round(c[i][2], 9) AS y FROM (SELECT m, c, n, unnest([1, 2, 3]) AS i FROM f JOIN e USING (m, r))")
def minibatch_state(spark, sf_dir):
    """What the state store holds at the end."""
    found = streamed(spark, sf_dir)[1].select("model", F.posexplode(F.arrays_zip("counts", "centroids")).alias("cluster", "v"))
    return found.select("model", F.col("cluster").cast("long"), F.col("v.counts").alias("n"), *[F.round(F.get("v.centroids", F.lit(k)), 9).alias(c) for k, c in enumerate("xy")])


@query(f"{MB_FOLD} SELECT m AS model, s AS seq, CAST(list_position(d, list_min(d)) AS BIGINT) - 1 AS label FROM (SELECT q.m, q.s, list_transform(f.c, lambda v: pow(v[1] - q.x[1], 2) + pow(v[2] - q.x[2], 2)) AS d FROM f JOIN e USING (m, r) JOIN q ON q.m = f.m)")
def minibatch_predict(spark, sf_dir):
    return minibatch.predict(models_of_users(spark, sf_dir), streamed(spark, sf_dir)[1]).select("model", "seq", "label")


SPOT = denstream.DenStreamParams(epsilon=0.5, min_points=3, beta=0.5, decay=0.05, mu=6.0, period=1000, buffer=0)
KINDS = ("click", "error", "purchase", "signup", "view")
SPOTS = f"""q AS (SELECT user_id AS t, event_id AS e, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS s, list_position({list(KINDS)}, event_type) - 1 AS spot FROM events),
fold AS (
  SELECT DISTINCT user_id AS t, CAST(NULL AS BIGINT) AS e, CAST(-1 AS BIGINT) AS s, CAST(-1 AS BIGINT) AS spot, CAST(-1 AS BIGINT) AS pos, CAST(-1 AS BIGINT) AS mc, [0.0::DOUBLE, 0.0, 0.0, 0.0, 0.0] AS w, [-1::BIGINT, -1, -1, -1, -1] AS ids, [-1::BIGINT, -1, -1, -1, -1] AS places, 0::BIGINT AS made, 0::BIGINT AS grown FROM events
  UNION ALL
  SELECT t, e, s, spot, CASE WHEN now > 3 OR places[spot + 1] >= 0 THEN CASE WHEN places[spot + 1] >= 0 THEN places[spot + 1] ELSE grown END ELSE -1 END, CASE WHEN now > 3 OR places[spot + 1] >= 0 THEN ids[spot + 1] ELSE -1 END,
    list_transform(old, lambda v, i: CASE WHEN i = spot + 1 THEN now ELSE v END), ids, list_transform(places, lambda v, i: CASE WHEN i = spot + 1 AND v < 0 AND now > 3 THEN grown ELSE v END), made, grown + CAST(places[spot + 1] < 0 AND now > 3 AS BIGINT) FROM (
    SELECT t, e, s, spot, old, old[spot + 1] + 1 AS now, list_transform(ids, lambda v, i: CASE WHEN i = spot + 1 AND v < 0 THEN made ELSE v END) AS ids, places, made + CAST(ids[spot + 1] < 0 AS BIGINT) AS made, grown FROM (
      SELECT q.t, q.e, q.s, q.spot, list_transform(f.w, lambda v: v * pow(2, -0.05)) AS old, f.ids, f.places, f.made, f.grown FROM fold f JOIN q ON q.t = f.t AND q.s = f.s + 1))),
final AS (SELECT t, max(s) AS s FROM fold GROUP BY t)"""


def spots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events as points on far spots, one for each kind: (tenant, seq, features)."""
    place = (F.array_position(F.array(*map(F.lit, KINDS)), F.col("event_type")) - 1) * 10
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("tenant"), F.col("event_id").alias("seq"), F.array(place.cast("double")).alias("features"))


@query(f"WITH RECURSIVE {SPOTS} SELECT t AS tenant, e AS seq, pos AS position, mc AS mc_id FROM fold WHERE s >= 0")
def denstream_spots(spark, sf_dir):
    """The online step: micro-clusters come to be, decay, and are promoted."""
    return denstream.replay(spots(spark, sf_dir), SPOT).drop("state")


@query(f"WITH RECURSIVE {SPOTS} SELECT t AS tenant, mc_id, round(weight, 6) AS weight, round(CAST(spot * 10 AS DOUBLE), 6) AS centre FROM (SELECT t, unnest(ids) AS mc_id, unnest(places) AS place, unnest(w) AS weight, unnest([0, 1, 2, 3, 4]) AS spot FROM fold JOIN final USING (t, s)) WHERE place >= 0")
def denstream_weights(spark, sf_dir):
    found = denstream.snapshot(denstream.replay(spots(spark, sf_dir), SPOT), SPOT)
    return found.select("tenant", "mc_id", F.round("weight", 6).alias("weight"), F.round(F.get("centre", F.lit(0)), 6).alias("centre"))


MACRO = denstream.DenStreamParams(epsilon=0.2, min_points=3, beta=0.5, mu=66.0, macro_epsilon=0.25)
MC_SQL = "mc AS (SELECT user_id AS id, avg(value) AS x, stddev_pop(value) / 400 AS r, count(*) AS w FROM events GROUP BY user_id)"


def micro_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A micro-cluster for each user, of the values of its events."""
    found = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("mc_id")).agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("deviation"))
    return found.select("mc_id", "n", F.col("n").cast("double").alias("weight"), F.array("mean").alias("centre"), (F.col("deviation") / 400).alias("radius"))


@query(
    f"WITH RECURSIVE {MC_SQL}, n AS (SELECT a.id AS i, b.id AS j, a.w >= 66 AS hi, b.w >= 66 AS hj FROM mc a JOIN mc b ON a.id <> b.id AND abs(a.x - b.x) <= 0.25 AND abs(a.x - b.x) <= a.r + b.r), "
    "t AS (SELECT id AS v, id AS c FROM mc WHERE w >= 66 UNION SELECT n.j, t.c FROM t JOIN n ON n.i = t.v AND hi AND hj WHERE t.c < n.j), cmp AS (SELECT v, min(c) AS c FROM t GROUP BY v), "
    "rk AS (SELECT c, row_number() OVER (ORDER BY c) - 1 AS label FROM (SELECT DISTINCT c FROM cmp)), lab AS (SELECT v AS id, label FROM cmp JOIN rk USING (c)), "
    "light AS (SELECT n.i AS id, min(lab.label) AS label FROM n JOIN lab ON lab.id = n.j WHERE NOT hi GROUP BY n.i) SELECT mc.id AS mc_id, coalesce(lab.label, light.label, -1) AS label FROM mc LEFT JOIN lab USING (id) LEFT JOIN light USING (id)"
)
def denstream_macro_graph(spark, sf_dir):
    """Macro-clusters of given micro-clusters."""
    return denstream.macro_clusters(micro_clusters(spark, sf_dir), MACRO)


@query(f"WITH {MC_SQL}, k AS (SELECT id, x, row_number() OVER (ORDER BY id) - 1 AS place FROM mc), d AS (SELECT event_id, place, abs(value - x) AS d, row_number() OVER (PARTITION BY event_id ORDER BY abs(value - x), place) AS r FROM events, k) SELECT event_id AS id, CASE WHEN d <= 0.2 THEN place ELSE -1 END AS label FROM d WHERE r = 1")
def denstream_predict(spark, sf_dir):
    points = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.array("value").alias("features"))
    return denstream.predict(points, micro_clusters(spark, sf_dir), MACRO).select("id", "label")


@query(
    f"WITH RECURSIVE {MC_SQL}, n AS (SELECT a.id AS i, b.id AS j FROM mc a JOIN mc b ON a.id <> b.id AND abs(a.x - b.x) <= 0.25), core AS (SELECT i AS id FROM n GROUP BY i HAVING count(*) + 1 >= 3), "
    "t AS (SELECT id AS v, id AS c FROM core UNION SELECT n.j, t.c FROM t JOIN n ON n.i = t.v JOIN core ON core.id = n.j WHERE t.c < n.j), cc AS (SELECT v, min(c) AS c FROM t GROUP BY v), rk AS (SELECT c, row_number() OVER (ORDER BY c) - 1 AS label FROM (SELECT DISTINCT c FROM cc)), "
    "near AS (SELECT n.i AS v, min(rk.label) AS label FROM n JOIN cc ON cc.v = n.j JOIN rk USING (c) WHERE n.i NOT IN (SELECT id FROM core) GROUP BY n.i), lab AS (SELECT v, label FROM cc JOIN rk USING (c) UNION ALL SELECT v, label FROM near) "
    "SELECT mc.id AS mc_id, coalesce(label, -1) AS label FROM mc LEFT JOIN lab ON v = id"
)
def denstream_macro_unweighted(spark, sf_dir):
    return denstream.macro_clusters_unweighted(micro_clusters(spark, sf_dir), MACRO)


@query(f"WITH {E}, {MEANS} SELECT label, x - 1 AS position, count(*) AS n, round(sum(f[x]), 5) AS ls, round(sum(f[x] * f[x]), 5) AS ss FROM (SELECT label, f, unnest(range(1, 65)) AS x FROM e) GROUP BY label, x")
def clustering_features(spark, sf_dir):
    found = denstream.clustering_features(vectors(spark, sf_dir), labels(spark, sf_dir))
    both = found.select("label", "n", F.posexplode(F.arrays_zip("ls", "ss")).alias("position", "v"))
    return both.select("label", F.col("position").cast("long"), "n", F.round("v.ls", 5).alias("ls"), F.round("v.ss", 5).alias("ss"))


@query("SELECT 'apart' AS given, 'InvalidParameter' AS refused UNION ALL SELECT 'not finite', 'NonFinite' UNION ALL SELECT 'ragged', 'DimensionMismatch'")
def score_checks(spark, sf_dir):
    """What a score raises on labels of other ids, on values that aren't finite and on vectors of two lengths."""
    p, y = vectors(spark, sf_dir), labels(spark, sf_dir)
    first = p.agg(F.min("id")).first()[0]
    broken = lambda v: p.withColumn("features", F.when(F.col("id") == first, v).otherwise(F.col("features")))
    cases = {"apart": (p, y.where(F.col("id") != first)), "not finite": (broken(F.transform("features", lambda v: v + float("inf"))), y), "ragged": (broken(F.slice("features", 1, 3)), y)}
    out = []
    for name, (points, marks) in cases.items():
        try:
            evaluation.silhouette(points, marks)
        except ValueError as error:
            out.append((name, type(error).__name__))
    return spark.createDataFrame(out, "given string, refused string")

