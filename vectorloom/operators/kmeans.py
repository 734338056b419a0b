"""k-means with any metric: seeding by weighted draws, exact Lloyd rounds, prediction.

Every round is one pass: tasks assign their rows and return partial sums by cluster, which are added
up in one shuffle of clusters x dimensions rows; only centroids reach the driver. Nothing is cached
on the executors between rounds, so a lost one costs a part of a round.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import DimensionMismatch, InvalidClusterCount, InvalidParameter, NonFinite
from ..functions import vectors as V
from ..functions.distance import EUCLIDEAN, SQUARED_EUCLIDEAN, Metric
from ..plans.staging import stage, unstage
from ..sources.points import validated
from .pairs import matrix, nearest_centroid


#: Draws of seeding between two writes of the rows' least distances.
KEEP = 16


def mean_variance(p: DataFrame) -> float:
    """The mean over dimensions of population variance; 1 where it is next to nothing."""
    by_dimension = p.select(F.posexplode("features")).groupBy("pos").agg(F.var_pop("col").alias("v"))
    value = by_dimension.agg(F.avg("v")).first()[0]
    return 1.0 if value is None or value < V.VARIANCE_FLOOR else value


def unit_rows(c: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(c, axis=1, keepdims=True)
    return np.where(norms > V.NORM_FLOOR, c / np.where(norms > 0, norms, 1), c)


def uniform(seed: int, number: int, id: str = "id") -> Column:
    """A number in (0, 1) that depends on the seed, the number of the draw and the id alone; any engine with md5 can make it."""
    digits = F.substring(F.md5(F.concat_ws("-", F.lit(seed), F.lit(number), F.col(id).cast("string")).cast("binary")), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(2**52))


def seed_centroids(p: DataFrame, k: int, metric: Metric = SQUARED_EUCLIDEAN, alpha: float = 2.0, seed: int = 0) -> np.ndarray:
    """k points, each drawn with a weight of its distance to those drawn before, to the power alpha / 2.

    A weighted draw is the smallest of -ln(u) / weight over all rows, so it needs neither a running
    sum nor an order. With no weight left the draw is uniform. Each pass measures the distance to the
    centroids drawn since the rows' least distances were last written, every ``KEEP`` draws.
    """
    chosen = [p.agg(F.min_by("features", F.struct(uniform(seed, 0), "id"))).first()[0]]
    rows, since, least = p.select("id", "features"), 0, None
    for number in range(1, k):
        near = nearest_centroid(rows, np.array(chosen[since:]), metric)
        if least is not None:
            near = near.withColumn("distance", F.least("distance", "least"))
        weight = F.pow(F.greatest("distance", F.lit(0.0)), alpha / 2)
        u = uniform(seed, number)
        key = F.struct((weight <= 0) | F.isnan(weight), F.when(weight > 0, -F.log(u) / weight).otherwise(u), "id")
        chosen.append(near.agg(F.min_by("features", key)).first()[0])
        if number - since >= KEEP and number < k - 1:
            before, least = least, stage(near.select("id", "features", F.col("distance").alias("least")), "seeding")
            rows, since = least, number
            if before is not None:
                unstage(before)
    if least is not None:
        unstage(least)
    return np.array(chosen)


@dataclass
class Round:
    counts: np.ndarray
    sums: np.ndarray
    inertia: float | None = None


def cluster_sums(p: DataFrame, centroids: np.ndarray, metric: Metric, before: np.ndarray | None = None) -> Round:
    """The number and the vector sum of the rows nearest to each centroid.

    With the centroids of the round before, the same pass sums the distances of the rows to the present
    centroids of the clusters that they had then: the inertia of that round.
    """
    k, d = centroids.shape
    if metric.block is None:
        parts = nearest_centroid(p, centroids, metric).select("label", F.posexplode("features")).groupBy("label", "pos").agg(F.sum("col").alias("s"), F.count("col").alias("n"))
    else:

        def partial(batches):
            import pyarrow as pa

            counts, sums, inertia = np.zeros(k, np.int64), np.zeros((k, d)), 0.0
            for batch in batches:
                x = matrix(batch.column(0))
                if len(x):
                    distance = metric.block(x, centroids)
                    label = distance.argmin(1)
                    counts += np.bincount(label, minlength=k)
                    np.add.at(sums, label, x)
                    if before is not None:
                        inertia += float(distance[np.arange(len(x)), metric.block(x, before).argmin(1)].sum())
            used = np.flatnonzero(counts)
            if before is not None:  # as a cluster of its own
                used, counts, sums = np.append(used, k), np.append(counts, 0), np.vstack([sums, [[inertia, *[0.0] * (d - 1)]]])
            yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(counts[used]), pa.array(list(sums[used]), pa.list_(pa.float64()))], ["label", "n", "sums"])

        rows = p.select("features").mapInArrow(partial, "label long, n long, sums array<double>")
        parts = rows.select("label", "n", F.posexplode("sums")).groupBy("label", "pos").agg(F.sum("col").alias("s"), F.sum("n").alias("n"))
    out = Round(np.zeros(k, np.int64), np.zeros((k, d)))
    if before is not None:
        labelled = nearest_centroid(p, before, metric) if metric.block is None else None
        out.inertia = wcss(labelled.select("features", "label"), centroids, metric) if labelled is not None else 0.0
    for r in parts.collect():  # clusters x dimensions
        if r["label"] == k:
            out.inertia = r["s"] if r["pos"] == 0 else out.inertia
            continue
        out.sums[r["label"], r["pos"]], out.counts[r["label"]] = r["s"], r["n"]
    return out


def new_centroids(p: DataFrame, old: np.ndarray, found: Round, metric: Metric) -> np.ndarray:
    """Means of clusters; one without rows takes the farthest row of the largest (the first of equals)."""
    means = found.sums / np.maximum(found.counts, 1)[:, None]
    empty = np.flatnonzero(found.counts == 0)
    if len(empty):
        largest = int(found.counts.argmax())
        members = nearest_centroid(p, old, metric).where(F.col("label") == largest).drop("label", "distance")
        far = nearest_centroid(members, means[largest : largest + 1], metric).agg(F.max_by("features", F.struct("distance", -F.col("id")))).first()[0]
        means[empty] = far
    return unit_rows(means) if metric.normalize_centroids else means


def wcss(p: DataFrame, centroids: np.ndarray, metric: Metric) -> float:
    """The sum of distances of p's rows to the centroid of their label."""
    ways = F.array(*[F.array(*[F.lit(float(v)) for v in c]) for c in centroids])
    if metric.block is None or "label" not in p.columns:
        return p.agg(F.sum(metric.column(F.col("features"), F.get(ways, F.col("label").cast("int"))))).first()[0] or 0.0

    def partial(batches):
        import pyarrow as pa

        total = 0.0
        for batch in batches:
            x, label = matrix(batch.column(0)), batch.column(1).to_numpy()
            for k in np.unique(label):
                total += float(metric.block(x[label == k], centroids[k : k + 1]).sum())
        yield pa.RecordBatch.from_arrays([pa.array([total])], ["total"])

    return p.select("features", "label").mapInArrow(partial, "total double").agg(F.sum("total")).first()[0] or 0.0


@dataclass
class KMeansModel:
    centroids: np.ndarray
    labels: DataFrame
    iterations: int
    inertia_trace: list[float]
    metric: Metric

    def predict(self, p: DataFrame) -> DataFrame:
        """p's columns and label."""
        shape = validated(p)
        if shape.d != self.centroids.shape[1]:
            raise DimensionMismatch(self.centroids.shape[1], shape.d)
        return nearest_centroid(p, self.centroids, self.metric).drop("distance")

    def wcss(self, p: DataFrame) -> float:
        """By the labels of the fit and the metric of the fit."""
        return wcss(p.join(self.labels.select("id", "label"), "id"), self.centroids, self.metric)

    @property
    def inertia(self) -> float:
        return self.inertia_trace[-1] if self.inertia_trace else 0.0

    def centroid_table(self) -> DataFrame:
        return self.labels.sparkSession.createDataFrame([(k, [float(v) for v in c]) for k, c in enumerate(self.centroids)], "cluster long, centroid array<double>")


@dataclass(frozen=True)
class KMeans:
    k: int
    metric: Metric = SQUARED_EUCLIDEAN
    alpha: float = 2.0
    max_iter: int = 100
    tol: float = 1e-4
    seed: int = 0
    initial: tuple = field(default=())

    def __post_init__(self):
        if self.k < 1:
            raise InvalidParameter("k", "has to be at least 1")
        if self.max_iter < 1:
            raise InvalidParameter("max_iter", "has to be at least 1")
        if self.tol < 0:
            raise InvalidParameter("tol", "can't be negative")

    def fit(self, p: DataFrame, extra: bool = True) -> KMeansModel:
        """Lloyd's rounds until the squared shift of all centroids is below tol x mean variance x k."""
        shape = validated(p)
        if self.k > shape.n:
            raise InvalidClusterCount(self.k, shape.n)
        if len(self.initial):
            centroids = np.asarray(self.initial, np.float64)
            if len(centroids) != self.k:
                raise InvalidClusterCount(len(centroids), self.k)
            if centroids.ndim != 2 or centroids.shape[1] != shape.d:
                raise DimensionMismatch(shape.d, centroids.shape[-1])
            if not np.isfinite(centroids).all():
                raise NonFinite("initial centroids")
        else:
            centroids = seed_centroids(p, self.k, self.metric, self.alpha, self.seed)
        enough = self.tol * mean_variance(p) * self.k
        trace, rounds, old = [], 0, None
        for rounds in range(1, self.max_iter + 1):
            found = cluster_sums(p, centroids, self.metric, old if extra else None)
            if found.inertia is not None:
                trace.append(found.inertia)
            old, centroids = centroids, new_centroids(p, centroids, found, self.metric)
            if ((old - centroids) ** 2).sum() < enough:
                break
        if extra:
            trace.append(cluster_sums(p, centroids, self.metric, old).inertia)
        labels = nearest_centroid(p, centroids, self.metric).select("id", "label")
        return KMeansModel(centroids, labels, rounds, trace, self.metric)

    def fit_predict(self, p: DataFrame) -> DataFrame:
        return self.fit(p, extra=False).labels


def centroids_of(p: DataFrame, labels: DataFrame) -> DataFrame:
    """(cluster, centroid) of labelled points, noise left out."""
    long = p.join(labels.where("label >= 0").select("id", "label"), "id").select("label", F.posexplode("features"))
    means = long.groupBy("label", "pos").agg(F.avg("col").alias("v"))
    return means.groupBy(F.col("label").alias("cluster")).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "v"))), lambda x: x["v"]).alias("centroid"))


def kmeans(p: DataFrame, k: int, max_iter: int = 300, seed: int = 0) -> KMeansModel:
    """A fit with the usual defaults."""
    return KMeans(k, max_iter=max_iter, seed=seed, metric=SQUARED_EUCLIDEAN).fit(p)


__all__ = ["EUCLIDEAN", "KMeans", "KMeansModel", "centroids_of", "cluster_sums", "kmeans", "mean_variance", "new_centroids", "seed_centroids", "wcss"]
