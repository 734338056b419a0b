"""Spanning trees and what is read off them: density hierarchies, dendrograms, layers, near-duplicates.

Edges of the minimum spanning tree are found in one task's dense pass up to ``DENSE`` points and by
rounds of block kernels beyond. The trees themselves are folds over n - 1 ascending edges, whose each
step needs the one before; up to ``FOLD`` edges they run in one task, and beyond in levels (``contraction``).
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..errors import InvalidParameter
from ..functions import vectors as V
from ..functions.distance import EUCLIDEAN, SQUARED_EUCLIDEAN, Metric
from ..plans.ranges import ranged, so_far, with_carry
from ..plans.staging import partitions, stage
from ..sources.points import validated
from . import contraction
from .graph import connected_components, rank_components, ranked, relabel
from .pairs import core_distances, in_blocks, links, matrix, projected
from .spanning import pruned_tree

DENSE, FOLD = 16_384, contraction.LEVEL
#: Points from which rounds go over cells of pivots rather than all pairs.
PRUNE = 4096
EDGES = "u long, v long, w double"


def spanning_tree(p: DataFrame, metric: Metric = EUCLIDEAN, core: DataFrame | None = None, root: bool = False) -> DataFrame:
    """(u, v, w) of the minimum spanning tree, ties by (u, v); with core distances over mutual reachability; w rooted if asked.

    Edges are ordered by (w, u, v), under which the tree is the same by any plan: up to ``DENSE`` points one
    task grows it; beyond, components join in rounds, over cells of pivots where the metric keeps the triangle
    inequality (``spanning``), else over all pairs.
    """
    n = p.count()
    table = p.select("id", "features").join(core, "id") if core is not None else p.select("id", "features", F.lit(0.0).alias("core"))
    weigh = np.sqrt if root else (lambda d: d)
    if n <= DENSE:
        return _prim(table, metric, weigh)
    return pruned_tree(table, metric, root) if n > PRUNE and metric.triangle is not None else _boruvka(table, metric, weigh)


def _prim(table: DataFrame, metric: Metric, weigh) -> DataFrame:
    def grow(t):
        t = t.sort_by("id")
        ids, x, core = t["id"].to_numpy(), matrix(t["features"]), t["core"].to_numpy()
        n = len(ids)
        place = np.arange(n)  # ids ascend, so places are compared for them
        best, source, out = np.full(n, np.inf), np.full(n, n), np.zeros(n, bool)
        at, edges = 0, []
        for _ in range(n - 1):
            out[at] = True
            d = np.maximum(weigh(metric.block(x[at : at + 1], x)[0]), np.maximum(core[at], core))
            low, high = np.minimum(place, at), np.maximum(place, at)
            was_low, was_high = np.minimum(place, source), np.maximum(place, source)
            sooner = (low < was_low) | ((low == was_low) & (high < was_high))
            nearer = ~out & ((d < best) | ((d == best) & sooner))
            best[nearer], source[nearer] = d[nearer], at
            ways = np.where(out, np.inf, best)
            tied = np.flatnonzero(ways == ways.min())
            at = int(tied[np.lexsort((np.maximum(tied, source[tied]), np.minimum(tied, source[tied])))[0]])
            edges.append((min(ids[at], ids[source[at]]), max(ids[at], ids[source[at]]), best[at]))
        u, v, w = zip(*edges, strict=True) if edges else ((), (), ())
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64()), "w": pa.array(w, pa.float64())})

    return table.groupBy(F.lit("all")).applyInArrow(lambda t: grow(t), EDGES)


def _boruvka(table: DataFrame, metric: Metric, weigh) -> DataFrame:
    """Each component's cheapest way out, by block kernels, until one component is left."""
    labels = stage(table.select("id", F.col("id").alias("component")), "mst-labels")
    chosen = None
    while labels.select("component").distinct().limit(2).count() > 1:

        def kernel(left, right, same):
            out = []
            for one, two in [(left, right)] if same else [(left, right), (right, left)]:
                if not one.num_rows or not two.num_rows:
                    continue
                two = two.sort_by("id")  # so that the first of equal distances has the smallest id
                d = np.maximum(weigh(metric.block(matrix(one["features"]), matrix(two["features"]))), np.maximum.outer(one["core"].to_numpy(), two["core"].to_numpy()))
                a, b, mine = one["id"].to_numpy(), two["id"].to_numpy(), one["component"].to_numpy()
                d[mine[:, None] == two["component"].to_numpy()[None, :]] = np.inf
                j = d.argmin(1)
                w = d[np.arange(len(a)), j]
                ok = np.isfinite(w)
                out.append((mine[ok], np.minimum(a, b[j])[ok], np.maximum(a, b[j])[ok], w[ok]))
            c, u, v, w = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.empty(0, "i8"), np.empty(0, "i8"), np.empty(0, "i8"), np.empty(0))
            return {"component": c, "u": u, "v": v, "w": w}

        ways = in_blocks(table.join(labels, "id"), kernel, "component long, u long, v long, w double", 1024)
        best = ways.groupBy("component").agg(F.min(F.struct("w", "u", "v")).alias("e")).select("e.*").distinct().select("u", "v", "w")
        chosen = stage(best if chosen is None else chosen.unionAll(best).distinct(), "mst-edges")
        found = connected_components(chosen, "u", "v")
        labels = stage(table.select("id").join(found, "id", "left").select("id", F.coalesce("component", "id").alias("component")), "mst-labels")
    return chosen if chosen is not None else table.sparkSession.createDataFrame([], EDGES)


def one_fold(tree: DataFrame) -> bool:
    """Whether one task may fold the tree."""
    return tree.count() <= FOLD


class Forest:
    """Disjoint sets of 0 to n - 1."""

    def __init__(self, n: int):
        self.parent, self.size = list(range(n)), [1] * n

    def find(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def unite(self, a: int, b: int) -> int:
        a, b = (a, b) if self.size[a] >= self.size[b] else (b, a)
        self.parent[b] = a
        self.size[a] += self.size[b]
        return a


@dataclass
class Condensed:
    """Clusters with their parents and births, and the cluster and density at which each point left."""

    parent: list[int]
    born: list[float]
    left: list[float]  # the density at which a cluster was split
    sizes: list[int]
    point_cluster: np.ndarray
    point_density: np.ndarray


def condense(n: int, edges: list[tuple[int, int, float]], least: int) -> Condensed:
    """Clusters of at least ``least`` points from ascending edges.

    A cluster comes to be at the first merge in which its side is large enough, and ends at a merge of
    two such sides; points of smaller sides leave at the merge's density.
    """
    forest, cluster = Forest(n), [-1] * n
    members: list[list[int]] = [[k] for k in range(n)]
    out = Condensed([], [], [], [], np.full(n, -1), np.zeros(n))

    def new_cluster() -> int:
        out.parent.append(-1)
        out.born.append(0.0)
        out.left.append(0.0)
        out.sizes.append(0)
        return len(out.parent) - 1

    def leave(root: int, into: int, density: float) -> None:
        for k in members[root]:
            out.point_cluster[k], out.point_density[k] = into, density
        members[root] = []

    for u, v, w in edges:
        density = math.inf if w <= 0 else 1 / w
        a, b = forest.find(u), forest.find(v)
        sides = []
        for root in (a, b):
            size = forest.size[root]
            if size >= least and cluster[root] < 0:
                cluster[root] = new_cluster()
                leave(root, cluster[root], density)
            sides.append((root, size, cluster[root] if size >= least else -1))
        big = [s for s in sides if s[2] >= 0]
        held = -1
        if len(big) == 2:
            held = new_cluster()
            for _, size, c in big:
                out.parent[c], out.born[c], out.left[c], out.sizes[c] = held, density, density, size
        elif big:
            held = big[0][2]
            small = next(s for s in sides if s[2] < 0)
            leave(small[0], held, density)
        joined = members[a] + members[b] if held < 0 else []
        root = forest.unite(a, b)
        members[root], cluster[root] = joined, held
    return out


def children_of(c: Condensed) -> list[list[int]]:
    children: list[list[int]] = [[] for _ in c.parent]
    for x, parent in enumerate(c.parent):
        if parent >= 0:
            children[parent].append(x)
    return children


def points_inside(c: Condensed) -> list[list[float]]:
    """The densities at which each cluster's own points left it."""
    inside: list[list[float]] = [[] for _ in c.parent]
    for cluster, density in zip(c.point_cluster.tolist(), c.point_density.tolist(), strict=True):
        if cluster >= 0:
            inside[cluster].append(density)
    return inside


def cluster_sizes(c: Condensed) -> list[int]:
    """The points of each cluster, those of its parts too."""
    sizes = np.bincount(c.point_cluster[c.point_cluster >= 0], minlength=len(c.parent)).tolist()
    for x, parent in enumerate(c.parent):  # children come before parents
        if parent >= 0:
            sizes[parent] += sizes[x]
    return sizes


def excesses(c: Condensed, inside: list[list[float]]) -> list[float]:
    """Each cluster's excess of mass: densities over that of its birth, summed over its points and the points of its parts."""
    children = children_of(c)
    return [
        sum(d - c.born[x] if d != c.born[x] else 0.0 for d in inside[x]) + sum(c.sizes[y] * (c.left[y] - c.born[x]) if c.left[y] != c.born[x] else 0.0 for y in children[x])
        for x in range(len(c.parent))
    ]


def select_clusters(c: Condensed, excess_points: list[list[float]]) -> list[int]:
    """The clusters of largest total excess of mass; a parent wins only when it beats its parts together."""
    k = len(c.parent)
    children, excess = children_of(c), excesses(c, excess_points)
    sub, chosen = [0.0] * k, [False] * k
    for x in range(k):  # children come before parents
        parts = sum(sub[y] for y in children[x])
        chosen[x] = not children[x] or excess[x] > parts
        sub[x] = excess[x] if chosen[x] else parts
    kept, todo = [], [x for x in range(k) if c.parent[x] < 0]
    while todo:
        x = todo.pop()
        if chosen[x]:
            kept.append(x)
        else:
            todo += children[x]
    return sorted(kept)


def density_labels(n: int, edges: list[tuple[int, int, float]], least: int) -> tuple[np.ndarray, np.ndarray]:
    """Labels and outlier scores of points from the ascending edges of their spanning tree."""
    labels, scores = np.full(n, -1), np.ones(n)
    c = condense(n, edges, least)
    if not c.parent:
        return labels, scores
    kept = select_clusters(c, points_inside(c))
    number = {x: k for k, x in enumerate(kept)}
    home = [-1] * len(c.parent)
    for x in reversed(range(len(c.parent))):  # parents before children
        home[x] = number.get(x, home[c.parent[x]] if c.parent[x] >= 0 else -1)
    at = c.point_cluster
    labels[at >= 0] = np.array(home)[at[at >= 0]]
    order = np.argsort(labels, kind="stable")
    bounds = np.searchsorted(labels[order], np.arange(len(kept) + 1))
    for k in range(len(kept)):
        mine = order[bounds[k] : bounds[k + 1]]
        if len(mine) < least:
            labels[mine] = -1
            continue
        density, top = c.point_density[mine], c.point_density[mine].max()
        share = np.divide(density, top, out=np.ones(len(mine)), where=np.isfinite(density) & (top > 0)) if np.isfinite(top) else np.where(np.isfinite(density), 0.0, 1.0)
        scores[mine] = np.clip(1 - share, 0, 1)
    return labels, scores


@dataclass(frozen=True)
class HDBSCAN:
    """Density clusters of any shape; labels count clusters in the order in which they came to be."""

    min_samples: int = 5
    min_cluster_size: int = 5
    metric: Metric = EUCLIDEAN

    def __post_init__(self):
        if self.min_samples < 1:
            raise InvalidParameter("min_samples", "has to be at least 1")
        if self.min_cluster_size < 2:
            raise InvalidParameter("min_cluster_size", "has to be at least 2")

    def tree(self, p: DataFrame) -> DataFrame:
        """(u, v, w): the spanning tree over mutual reachability."""
        return spanning_tree(p, self.metric, core_distances(p, self.min_samples, self.metric))

    def fit(self, p: DataFrame) -> DataFrame:
        """(id, label, outlier_score); one point alone is noise of score 1."""
        shape = validated(p)
        if shape.n == 1:
            return p.select("id", F.lit(-1).cast("long").alias("label"), F.lit(1.0).alias("outlier_score"))
        least = self.min_cluster_size
        if shape.n > FOLD:
            return contraction.density_labels(p, stage(self.tree(p), "mst"), least, FOLD)

        def fold(t):
            ids, edges = ordered_edges(t)
            labels, scores = density_labels(len(ids), edges, least)
            return pa.table({"id": pa.array(ids), "label": pa.array(labels.astype(np.int64)), "outlier_score": pa.array(scores)})

        return self.tree(p).groupBy(F.lit("all")).applyInArrow(lambda t: fold(t), "id long, label long, outlier_score double")

    def fit_predict(self, p: DataFrame) -> DataFrame:
        return self.fit(p).select("id", "label")

    def condensed(self, p: DataFrame) -> DataFrame:
        """(cluster, parent, born, size, stability) of every cluster of the tree, in the order in which they came to be."""
        least, tree = self.min_cluster_size, stage(self.tree(p), "mst")
        if not one_fold(tree):
            return contraction.all_clusters(*contraction.condensed_parts(tree, least, FOLD))

        def fold(t):
            ids, edges = ordered_edges(t)
            c = condense(len(ids), edges, least)
            own = excesses(c, points_inside(c))
            columns = (range(len(own)), [x if x >= 0 else None for x in c.parent], c.born, cluster_sizes(c), own)
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.float64())
            return pa.table({k: pa.array(v, t) for k, v, t in zip(("cluster", "parent", "born", "size", "stability"), columns, kinds, strict=True)})

        return tree.groupBy(F.lit("all")).applyInArrow(lambda t: fold(t), "cluster long, parent long, born double, size long, stability double")


def hdbscan(p: DataFrame, min_cluster_size: int, min_points: int | None = None, metric: Metric = EUCLIDEAN) -> DataFrame:
    """(id, label) of a fit with the usual defaults: as many samples as points that make a cluster."""
    return HDBSCAN(min_cluster_size if min_points is None else min_points, min_cluster_size, metric).fit_predict(p)


def ordered_edges(t: pa.Table) -> tuple[np.ndarray, list[tuple[int, int, float]]]:
    """Ids and edges between their places, ascending by weight, then ends."""
    u, v, w = t["u"].to_numpy(), t["v"].to_numpy(), t["w"].to_numpy()
    ids = np.unique(np.concatenate([u, v]))
    order = np.lexsort((v, u, w))
    return ids, list(zip(np.searchsorted(ids, u[order]).tolist(), np.searchsorted(ids, v[order]).tolist(), w[order].tolist(), strict=True))


def dendrogram(edges: DataFrame) -> DataFrame:
    """(node, left, right, distance, size): leaves 0 to n - 1 by ascending id, then merges by ascending weight."""
    if not one_fold(edges):
        merges, leaves = contraction.merges(edges, FOLD)
        nothing = F.lit(None).cast("long")
        return leaves.select(F.col("leaf").alias("node"), nothing.alias("left"), nothing.alias("right"), F.lit(0.0).alias("distance"), F.lit(1).cast("long").alias("size")).unionAll(merges)

    def fold(t):
        ids, ordered = ordered_edges(t)
        n = len(ids)
        forest, node = Forest(n), list(range(n))
        rows = [(k, None, None, 0.0, 1) for k in range(n)]
        for u, v, w in ordered:
            a, b = forest.find(u), forest.find(v)
            left, right = sorted((node[a], node[b]))
            root = forest.unite(a, b)
            node[root] = len(rows)
            rows.append((len(rows), left, right, w, forest.size[root]))
        columns = list(zip(*rows, strict=True))
        return pa.table({k: pa.array(c, t) for k, c, t in zip(("node", "left", "right", "distance", "size"), columns, (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int64()), strict=True)})

    return edges.groupBy(F.lit("all")).applyInArrow(lambda t: fold(t), "node long, left long, right long, distance double, size long")


def layer_at(p: DataFrame, edges: DataFrame, threshold: float, least: int) -> DataFrame:
    """(id, label): components of edges up to a threshold with at least ``least`` points, ranked by smallest id; null else."""
    if not 0 <= threshold < math.inf:
        raise InvalidParameter("threshold", "has to be finite and not negative")
    w = "w" if "w" in edges.columns else "distance"
    a, b = ("u", "v") if "u" in edges.columns else ("i", "j")
    found = connected_components(edges.where(F.col(w) <= threshold), a, b)
    whole = p.select("id").join(found, "id", "left").select("id", F.coalesce("component", "id").alias("component"))
    large = whole.groupBy("component").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    return whole.join(rank_components(large), "component", "left").select("id", "label")


def cut_all(p: DataFrame, tree: DataFrame, thresholds: list[float], least: int) -> DataFrame:
    """(cut, id, label) of every threshold, as ``layer_at`` labels them: in one pass over the tree's ascending edges where one task may fold it, else by components for each."""
    if not one_fold(tree):
        layers = [layer_at(p, tree, t, least).select(F.lit(k).alias("cut"), "id", "label") for k, t in enumerate(thresholds)]
        return reduce(DataFrame.unionAll, layers)

    def fold(t):
        every, ordered = ordered_edges(t.filter(pa.compute.is_valid(t["w"])))
        ids = np.unique(t["u"].to_numpy())
        at = np.searchsorted(ids, every)
        forest, done, out = Forest(len(ids)), 0, []
        for cut in np.argsort(thresholds, kind="stable").tolist():
            while done < len(ordered) and ordered[done][2] <= thresholds[cut]:
                a, b = (forest.find(int(at[x])) for x in ordered[done][:2])
                if a != b:
                    forest.unite(a, b)
                done += 1
            roots = np.array([forest.find(k) for k in range(len(ids))])
            _, first, back, size = np.unique(roots, return_index=True, return_inverse=True, return_counts=True)
            large = np.flatnonzero(size >= least)
            rank = np.full(len(size), -1)
            rank[large[np.argsort(first[large])]] = np.arange(len(large))
            out.append((np.full(len(ids), cut), ids, rank[back]))
        cuts, points, labels = (np.concatenate(c) for c in zip(*out, strict=True))
        return pa.table({"cut": pa.array(cuts, pa.int32()), "id": pa.array(points), "label": pa.array(labels, pa.int64(), mask=labels < 0)})

    rows = tree.select("u", "v", "w").unionAll(p.select("id", "id", F.lit(None).cast("double")))
    return rows.groupBy(F.lit("all")).applyInArrow(lambda t: fold(t), "cut int, id long, label long")


def threshold_layer(p: DataFrame, threshold: float, least: int, metric: Metric = EUCLIDEAN) -> DataFrame:
    """(id, label): ``layer_at`` of all pairs up to a threshold, of which no more are made than link the same points."""
    return layer_at(p, pairs_linking(p, threshold, metric), threshold, least)


def pairs_linking(p: DataFrame, threshold: float, metric: Metric) -> DataFrame:
    return links(p, threshold, metric).withColumn("distance", F.lit(0.0))


def near_duplicates(p: DataFrame, threshold: float, metric: Metric = EUCLIDEAN) -> DataFrame:
    """(component, id): groups of two or more points linked by distances up to a threshold, named by their smallest id."""
    if threshold <= 0:
        return p.select(F.col("id").alias("component"), "id").limit(0)
    found = connected_components(links(p, threshold, metric))
    return found.select("component", "id")


def picked_thresholds(tree: DataFrame, layers: int, noise_level: float) -> list[float]:
    """``layer_thresholds`` of a tree's weights, which are ranked over ranges; 0 alone for a tree without edges."""
    n = tree.count()
    if not n:
        return [0.0]
    at = layer_places(n, layers, noise_level)
    found = {r["rank"]: r["w"] for r in ranked(tree.select("w"), "w").where(F.col("rank").isin(at)).collect()}  # a row a layer
    return apart([found[k] for k in at])


def layer_places(n: int, layers: int, noise_level: float) -> list[int]:
    """The places among n ascending weights at which layers are cut; a higher noise level leans to coarser ones."""
    layers = max(1, min(layers, n))
    if layers == 1:
        return [n - 1]
    bend = 1 - min(max(noise_level, 0.0), 1.0) + 1e-6
    return sorted(min(n - 1, math.floor((k / (layers - 1)) ** bend * (n - 1) + 0.5)) for k in range(layers))


def apart(picks: list[float]) -> list[float]:
    """Ascending thresholds that differ by more than nothing."""
    return [w for k, w in enumerate(picks) if k == 0 or abs(w - picks[k - 1]) > V.NORM_FLOOR]


def layer_thresholds(weights: list[float], layers: int, noise_level: float) -> list[float]:
    """Distinct thresholds from ascending tree weights."""
    return apart([weights[k] for k in layer_places(len(weights), layers, noise_level)])


def best_by_merges(n: int, tree: DataFrame, least: int, target: int) -> float:
    """``best_threshold`` from the merges of a tree that no task folds: running sums over ranges of merges."""
    merges, _ = contraction.merges(tree, FOLD)
    merges = stage(merges, "fold-merges")
    sizes = merges.select(F.col("node").alias("part"), F.col("size").alias("n"))
    large = lambda c: (F.col(c) >= least).cast("long")
    for side in ("left", "right"):
        merges = merges.join(sizes.withColumnRenamed("part", side).withColumnRenamed("n", f"of_{side}"), side, "left").withColumn(f"of_{side}", F.coalesce(f"of_{side}", F.lit(1)))
    deltas = merges.select(
        "node",
        "distance",
        (large("size") - large("of_left") - large("of_right")).alias("clusters"),
        (large("size") * F.col("size") - large("of_left") * F.col("of_left") - large("of_right") * F.col("of_right")).alias("assigned"),
    )
    parts = stage(ranged(deltas, [F.col("node")], partitions(tree.sparkSession)), "fold-deltas")
    sums = {r["part"]: (r["c"], r["a"]) for r in parts.groupBy("part").agg(F.sum("clusters").alias("c"), F.sum("assigned").alias("a")).collect()}  # a row a part
    first = (n, n) if least <= 1 else (0, 0)
    carry = so_far(sums, lambda x, y: (x[0] + y[0], x[1] + y[1]), first)
    upto = Window.partitionBy("part").orderBy("node").rowsBetween(Window.unboundedPreceding, 0)
    ahead = with_carry(parts, carry, "before", "struct<c:long,a:long>")
    now = ahead.select("node", "distance", (F.col("before.c") + F.sum("clusters").over(upto)).alias("c"), (F.col("before.a") + F.sum("assigned").over(upto)).alias("a"))
    key = lambda c, a: F.struct(F.abs(c - target), -a, -c)
    best = now.agg(F.min(F.struct(key(F.col("c"), F.col("a")).alias("key"), "node", "distance")).alias("best")).select("best.*").first()
    start = (abs(first[0] - target), -first[1], -first[0])
    return best["distance"] if best["key"] is not None and tuple(best["key"]) < start else 0.0


def best_threshold(n: int, edges: list[tuple[int, int, float]], least: int, target: int) -> float:
    """The weight whose cut has a number of clusters nearest to a target; then more points, then more clusters."""
    forest = Forest(n)
    counted = lambda size: (1, size) if size >= least else (0, 0)
    clusters, assigned = (n, n) if least <= 1 else (0, 0)
    best, threshold = (abs(clusters - target), -assigned, -clusters), 0.0
    for u, v, w in edges:
        a, b = forest.find(u), forest.find(v)
        if a == b:
            continue
        gone = [counted(forest.size[a]), counted(forest.size[b])]
        made = counted(forest.size[forest.unite(a, b)])
        clusters += made[0] - gone[0][0] - gone[1][0]
        assigned += made[1] - gone[0][1] - gone[1][1]
        now = (abs(clusters - target), -assigned, -clusters)
        if now < best:
            best, threshold = now, w
            if best[0] == 0 and assigned == n:
                break
    return threshold


@dataclass
class Layers:
    """Layers of a projected hierarchy; layer 0 is the finest."""

    points: DataFrame
    tree: DataFrame
    thresholds: list[float]
    labels: list[DataFrame]
    min_cluster_size: int

    @property
    def finest(self) -> DataFrame:
        return self.labels[0]

    @property
    def coarsest(self) -> DataFrame:
        return self.labels[-1]

    def table(self) -> DataFrame:
        """(layer, threshold, id, label)."""
        out = None
        for k, (t, labels) in enumerate(zip(self.thresholds, self.labels, strict=True)):
            rows = labels.select(F.lit(k).alias("layer"), F.lit(t).alias("threshold"), "id", "label")
            out = rows if out is None else out.unionAll(rows)
        return out

    def clusters(self) -> DataFrame:
        """(layer, label, members)."""
        return self.table().where("label is not null").groupBy("layer", "label").agg(F.array_sort(F.collect_list("id")).alias("members"))

    @property
    def dimensions(self) -> int:
        """Of the points as they came in."""
        return self.points.select(F.size("features")).first()[0]

    def dendrogram(self) -> DataFrame:
        return dendrogram(self.tree)

    def layer_for_n_clusters(self, target: int) -> DataFrame:
        """The layer whose number of clusters is nearest to a target."""
        if target < 1:
            raise InvalidParameter("target", "has to be at least 1")
        n, least = self.points.count(), self.min_cluster_size
        if not one_fold(self.tree):
            return cut_all(self.points, self.tree, [best_by_merges(n, self.tree, least, target)], least).select("id", "label")

        def fold(t):
            _, edges = ordered_edges(t)
            return pa.table({"threshold": pa.array([best_threshold(n, edges, least, target)], pa.float64())})

        found = self.tree.groupBy(F.lit("all")).applyInArrow(lambda t: fold(t), "threshold double").first()
        return cut_all(self.points, self.tree, [found[0] if found else 0.0], least).select("id", "label")


@dataclass(frozen=True)
class ProjectedHierarchy:
    """Layers of single linkage in a random projection, and near-duplicates of the projected points."""

    dimensions: int = 15
    min_cluster_size: int = 10
    max_layers: int = 10
    noise_level: float = 0.5
    duplicate_threshold: float = 1e-6
    seed: int = 42
    metric: Metric = SQUARED_EUCLIDEAN

    def project(self, p: DataFrame) -> DataFrame:
        shape = validated(p)
        if not 1 <= self.dimensions < shape.d:
            raise InvalidParameter("dimensions", f"has to be from 1 to {shape.d - 1}")
        if not self.metric.nonnegative:
            raise InvalidParameter("metric", "may be negative, which has no root")
        return projected(p, V.projection_matrix(shape.d, self.dimensions, self.seed))

    def fit(self, p: DataFrame) -> Layers:
        projected = stage(self.project(p), "layers-points")
        tree = stage(spanning_tree(projected, self.metric, root=True), "layers-tree")
        thresholds = picked_thresholds(tree, self.max_layers, self.noise_level)
        cuts = stage(cut_all(p, tree, thresholds, self.min_cluster_size), "layers-cuts")
        counts = {r["cut"]: r["n"] for r in cuts.groupBy("cut").agg(F.countDistinct("label").alias("n")).collect()}
        order = sorted(range(len(thresholds)), key=lambda k: (-counts[k], k))
        return Layers(p, tree, [thresholds[k] for k in order], [cuts.where(F.col("cut") == k).select("id", "label") for k in order], self.min_cluster_size)

    def fit_predict(self, p: DataFrame) -> DataFrame:
        return self.fit(p).finest

    def duplicates(self, p: DataFrame) -> DataFrame:
        root = Metric("root", lambda x, y: F.sqrt(self.metric.column(x, y)), lambda x, y: np.sqrt(np.maximum(self.metric.block(x, y), 0)))
        return near_duplicates(self.project(p), self.duplicate_threshold, root)


__all__ = ["HDBSCAN", "Layers", "ProjectedHierarchy", "best_threshold", "condense", "dendrogram", "density_labels", "layer_at", "layer_thresholds", "near_duplicates", "relabel", "spanning_tree"]
