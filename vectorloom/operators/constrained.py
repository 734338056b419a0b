"""k-means under must-link and cannot-link pairs.

Constraints are (a, b, kind) with kind "must" or "cannot". Must-links close over components; each round
distances to all centroids are computed where the points are, and one task assigns points in an order
hashed from the seed, as every choice binds later ones. The table it takes is points x clusters, at most
``ASSIGN`` numbers. A group takes the cluster that its first point finds; a point whose every cluster is
forbidden fails the fit.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import ConstraintViolation, InvalidClusterCount, InvalidParameter
from ..functions.distance import SQUARED_EUCLIDEAN, Metric
from ..plans.staging import stage
from ..sources.points import validated
from .graph import connected_components
from .kmeans import Round, centroids_of, mean_variance, new_centroids, seed_centroids
from .pairs import matrix

ASSIGN = 200_000_000


def must_link_groups(p: DataFrame, constraints: DataFrame) -> DataFrame:
    """(id, component): the smallest id of each point's must-link group."""
    found = connected_components(constraints.where("kind = 'must'").select("a", "b"), "a", "b")
    return p.select("id").join(found, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def conflicts(p: DataFrame, constraints: DataFrame) -> DataFrame:
    """(a, b): cannot-links within one must-link group; a pair of one point with itself is none."""
    groups = must_link_groups(p, constraints)
    pairs = constraints.where("kind = 'cannot' and a <> b").select("a", "b")
    met = pairs.join(groups.select(F.col("id").alias("a"), F.col("component").alias("g_a")), "a").join(groups.select(F.col("id").alias("b"), F.col("component").alias("g_b")), "b")
    return met.where("g_a = g_b").select("a", "b")


def candidates(p: DataFrame, centroids: np.ndarray, metric: Metric = SQUARED_EUCLIDEAN) -> DataFrame:
    """(id, rank, cluster, distance): every cluster of every point, nearest first, ties by cluster."""

    def measure(batches):
        for batch in batches:
            x = matrix(batch.column(1))
            if len(x):
                d = metric.block(x, centroids)
                order = np.argsort(d, axis=1, kind="stable")
                ids = np.repeat(batch.column(0).to_numpy(), len(centroids))
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.tile(np.arange(len(centroids)), len(x))), pa.array(order.ravel()), pa.array(np.take_along_axis(d, order, 1).ravel())], ["id", "rank", "cluster", "distance"])

    return p.select("id", "features").mapInArrow(measure, "id long, rank long, cluster long, distance double")


def forbidden(labels: DataFrame, constraints: DataFrame) -> DataFrame:
    """(id, label): the clusters that hold a point which a point can't be together with."""
    pairs = constraints.where("kind = 'cannot' and a <> b").select("a", "b")
    both = pairs.unionAll(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return both.join(labels.select(F.col("id").alias("b"), "label"), "b").select(F.col("a").alias("id"), "label").distinct()


def assign_in_order(distance: np.ndarray, order: np.ndarray, group: np.ndarray, forbidden: dict[int, list[int]]) -> np.ndarray | None:
    """The nearest allowed cluster of each row, in an order; None if a row has none."""
    label, taken = np.full(len(order), -1), {}
    for row in order.tolist():
        g = int(group[row])
        others = {int(label[o]) for o in forbidden.get(row, ()) if label[o] >= 0}
        if g in taken:
            if taken[g] in others:
                return None
            label[row] = taken[g]
            continue
        allowed = [k for k in np.argsort(distance[row], kind="stable").tolist() if k not in others]
        if not allowed:
            return None
        label[row] = taken[g] = allowed[0]
    return label


@dataclass(frozen=True)
class ConstrainedKMeans:
    k: int
    metric: Metric = SQUARED_EUCLIDEAN
    max_iter: int = 100
    tol: float = 1e-4
    seed: int = 42

    def fit_predict(self, p: DataFrame, constraints: DataFrame) -> DataFrame:
        """(id, label)."""
        if self.k < 1:
            raise InvalidParameter("k", "has to be at least 1")
        shape = validated(p)
        if self.k > shape.n:
            raise InvalidClusterCount(self.k, shape.n)
        if shape.n * self.k > ASSIGN:
            raise InvalidParameter("k", f"more than {ASSIGN} distances, which one task would have to hold")
        ends = constraints.select(F.col("a").alias("id")).unionAll(constraints.select("b"))
        if not ends.join(p.select("id"), "id", "left_anti").isEmpty():
            raise InvalidParameter("constraints", "name a point that isn't there")
        clash = conflicts(p, constraints).first()
        if clash is not None:
            raise ConstraintViolation(f"points {clash['a']} and {clash['b']} must and can't be together")
        groups = stage(p.join(must_link_groups(p, constraints), "id"), "constrained-groups")
        pairs = constraints.where("kind = 'cannot' and a <> b").select("a", "b")
        centroids = seed_centroids(p, self.k, self.metric, 2.0, self.seed)
        enough = self.tol * mean_variance(p) * self.k
        labels = None
        for number in range(self.max_iter):
            labels = stage(self._assign(groups, pairs, centroids, number), "constrained-labels")
            if labels.isEmpty():
                raise ConstraintViolation("a point is kept from every cluster")
            old = centroids
            centroids = self._update(p, labels, old, number)
            if ((old - centroids) ** 2).sum() < enough:
                break
        return labels

    def _assign(self, groups: DataFrame, pairs: DataFrame, centroids: np.ndarray, number: int) -> DataFrame:
        metric = self.metric

        def measure(batches):
            for batch in batches:
                x = matrix(batch.column(1))
                if len(x):
                    yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), pa.array(list(metric.block(x, centroids)), pa.list_(pa.float64()))], ["id", "component", "turn", "d"])

        def run(t, c):
            t = t.sort_by("id")
            ids = t["id"].to_numpy()
            place = {i: k for k, i in enumerate(ids.tolist())}
            forbidden: dict[int, list[int]] = {}
            for a, b in zip(c["a"].to_pylist(), c["b"].to_pylist(), strict=True):
                forbidden.setdefault(place[a], []).append(place[b])
                forbidden.setdefault(place[b], []).append(place[a])
            label = assign_in_order(matrix(t["d"]), np.lexsort((ids, t["turn"].to_numpy())), t["component"].to_numpy(), forbidden)
            keep = slice(0, 0) if label is None else slice(None)
            return pa.table({"id": pa.array(ids[keep]), "label": pa.array(np.asarray([] if label is None else label, np.int64))})

        turn = F.xxhash64("id", F.lit(self.seed), F.lit(number)).alias("turn")
        measured = groups.select("id", "features", "component", turn).mapInArrow(measure, "id long, component long, turn long, d array<double>").withColumn("one", F.lit(0))
        return measured.groupBy("one").cogroup(pairs.withColumn("one", F.lit(0)).groupBy("one")).applyInArrow(lambda t, c: run(t, c), "id long, label long")

    def _update(self, p: DataFrame, labels: DataFrame, old: np.ndarray, number: int) -> np.ndarray:
        found = {r["cluster"]: r["centroid"] for r in centroids_of(p, labels).collect()}
        out = np.array([found.get(k, old[k]) for k in range(self.k)], np.float64)
        for k in set(range(self.k)) - set(found):  # a cluster without points starts again from one
            out[k] = p.agg(F.min_by("features", F.struct(F.xxhash64("id", F.lit(self.seed), F.lit(number), F.lit(k)), "id"))).first()[0]
        return new_centroids(p, old, Round(np.ones(self.k, np.int64), out), self.metric)


def cop_kmeans(p: DataFrame, k: int, must_link=(), cannot_link=(), max_iter: int = 300, seed: int = 42) -> DataFrame:
    """(id, label) of a fit with the usual defaults; links are pairs of ids."""
    rows = [(int(a), int(b), kind) for kind, links in (("must", must_link), ("cannot", cannot_link)) for a, b in links]
    return ConstrainedKMeans(k, max_iter=max_iter, seed=seed).fit_predict(p, p.sparkSession.createDataFrame(rows, "a long, b long, kind string"))
