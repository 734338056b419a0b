"""Clustering quality. Tables of labels are (id, label) with noise -1; scores come as one-row tables.

Scores over distances aggregate within each task: what leaves it is a sum and a count for each of its points
and each cluster, however many pairs it goes over.

Every score first checks what it is given, in one aggregate: vectors of one length and finite, and labels
for the ids of the points and for no others; scores of two labellings check that their ids agree.
"""

from __future__ import annotations

import numpy as np
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import DimensionMismatch, InvalidParameter, NonFinite
from ..functions import vectors as V
from ..functions.distance import EUCLIDEAN, Metric, for_sums
from .kmeans import centroids_of
from .pairs import TILE, core_distances, in_groups, matrix


def checked(p: DataFrame, labels: DataFrame) -> None:
    """Raises where points can't be scored by labels; no points at all are fine."""
    size = F.size("features")
    met = p.select("id", "features", F.lit(1).alias("p")).join(labels.select("id", F.col("label").isNotNull().alias("l")), "id", "full_outer")
    row = met.agg(
        F.count_if(F.col("p").isNull() | ~F.coalesce("l", F.lit(False))).alias("apart"), F.min(size).alias("low"), F.max(size).alias("high"), F.count_if(F.col("p").isNotNull() & ~F.coalesce(V.finite(F.col("features")), F.lit(False))).alias("bad")
    ).first()
    if row["apart"]:
        raise InvalidParameter("labels", f"{row['apart']} ids are points without a label or labels without a point")
    if row["bad"]:
        raise NonFinite(f"{row['bad']} points with nulls, NaN or infinities")
    if row["low"] != row["high"]:
        raise DimensionMismatch(row["high"], row["low"])


def agreeing(a: DataFrame, b: DataFrame) -> None:
    """Raises where two labellings aren't of the same ids."""
    met = a.select("id", F.col("label").isNotNull().alias("a")).join(b.select("id", F.col("label").isNotNull().alias("b")), "id", "full_outer")
    apart = met.agg(F.count_if(~F.coalesce("a", F.lit(False)) | ~F.coalesce("b", F.lit(False)))).first()[0]
    if apart:
        raise InvalidParameter("labels", f"{apart} ids have a label on one side only")


def cluster_distances(p: DataFrame, labels: DataFrame, metric: Metric = EUCLIDEAN, core: DataFrame | None = None, noise: bool = False) -> DataFrame:
    """(id, label, other, total, n): each point's summed distance to the points of each cluster, itself left out.

    With core distances, distance is mutual reachability. Noise points are left out unless asked for;
    they never are a cluster.
    """
    labelled = p.join(labels.select("id", "label"), "id")
    labelled = labelled if noise else labelled.where("label >= 0")
    reach = core is not None
    labelled = labelled.join(core, "id") if reach else labelled.withColumn("core", F.lit(0.0))

    def run(left, right, same):
        for one, two in [(left, right)] if same else [(left, right), (right, left)]:
            two = two.filter(pc.greater_equal(two["label"], 0)).sort_by("label")
            if not one.num_rows or not two.num_rows:
                continue
            x, y, ids, other = matrix(one["features"]), matrix(two["features"]), one["id"].to_numpy(), two["id"].to_numpy()
            labels, core, core_two = two["label"].to_numpy(), one["core"].to_numpy(), two["core"].to_numpy()
            clusters, place = np.unique(labels, return_inverse=True)
            for a in range(0, len(x), TILE):
                rows = slice(a, a + TILE)
                total, n = np.zeros((len(x[rows]), len(clusters))), np.zeros((len(x[rows]), len(clusters)), np.int64)
                for b in range(0, len(y), TILE):
                    cols = slice(b, b + TILE)
                    d = for_sums(metric, x[rows], y[cols])
                    if reach:
                        d = np.maximum(d, np.maximum.outer(core[rows], core_two[cols]))
                    at = place[cols]
                    starts = np.flatnonzero(np.append(True, np.diff(at) > 0))
                    sizes = np.diff(np.append(starts, len(at)))
                    if same:
                        r, c = np.nonzero(ids[rows, None] == other[None, cols])
                        d[r, c] = 0.0
                        np.subtract.at(n, (r, at[c]), 1)
                    total[:, at[starts]] += np.add.reduceat(d, starts, axis=1)
                    n[:, at[starts]] += sizes
                r, c = np.nonzero(n)
                yield {"id": ids[rows][r], "label": one["label"].to_numpy()[rows][r], "other": clusters[c], "total": total[r, c], "n": n[r, c]}

    sums = in_groups(labelled.select("id", "features", "label", "core"), run, "id long, label long, other long, total double, n long")
    return sums.where("n > 0").groupBy("id", "label", "other").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))


def silhouettes(p: DataFrame, labels: DataFrame, metric: Metric = EUCLIDEAN) -> DataFrame:
    """(id, label, silhouette) of points in clusters of two or more; empty for fewer than two clusters."""
    checked(p, labels)
    mean = F.col("total") / F.col("n")
    own, other = F.col("other") == F.col("label"), F.col("other") != F.col("label")
    x = cluster_distances(p, labels, metric).groupBy("id", "label").agg(F.max(F.when(own, mean)).alias("a"), F.min(F.when(other, mean)).alias("b"))
    top = F.greatest("a", "b")
    return x.where("a is not null and b is not null").select("id", "label", F.when(top > 0, (F.col("b") - F.col("a")) / top).otherwise(F.lit(0.0)).alias("silhouette"))


def silhouette(p: DataFrame, labels: DataFrame, metric: Metric = EUCLIDEAN) -> DataFrame:
    """(silhouette): the mean without noise and without singletons."""
    return silhouettes(p, labels, metric).agg(F.coalesce(F.avg("silhouette"), F.lit(0.0)).alias("silhouette"))


def silhouette_noise_aware(p: DataFrame, labels: DataFrame, metric: Metric = EUCLIDEAN) -> DataFrame:
    """(silhouette): singletons count as 0 in the mean, noise doesn't count."""
    total = silhouettes(p, labels, metric).agg(F.coalesce(F.sum("silhouette"), F.lit(0.0)).alias("s"))
    n = p.select("id").join(labels.where("label >= 0"), "id").agg(F.count(F.lit(1)).alias("n"))
    return total.join(n).select(F.when(F.col("n") > 0, F.col("s") / F.col("n")).otherwise(F.lit(0.0)).alias("silhouette"))


def sample_order(seed: int = 42):
    """A shuffle of ids that other engines can compute: by a multiplicative hash."""
    return F.pmod((F.col("id") + seed).cast("decimal(38,0)") * F.lit(2654435761).cast("decimal(20,0)"), F.lit(4294967296).cast("decimal(20,0)")).cast("long")


def silhouette_sampled(p: DataFrame, labels: DataFrame, size: int, seed: int = 42, metric: Metric = EUCLIDEAN) -> DataFrame:
    """(silhouette) of ``size`` points drawn without replacement; of all, if there are no more."""
    if size < 1:
        raise InvalidParameter("size", "has to be at least 1")
    checked(p, labels)
    sample = p.orderBy(sample_order(seed), "id").limit(size)
    return silhouette(sample, labels.join(sample.select("id"), "id", "left_semi"), metric)


def calinski_harabasz(p: DataFrame, labels: DataFrame, centroids: DataFrame | None = None) -> DataFrame:
    """(calinski_harabasz); noise counts in n and in the global mean, not within clusters."""
    checked(p, labels)
    c = centroids if centroids is not None else centroids_of(p, labels)
    c = c.select("cluster", F.posexplode("centroid").alias("pos", "m"))
    long = p.join(labels.select("id", "label"), "id").select("id", "label", F.posexplode("features").alias("pos", "v"))
    mean = long.groupBy("pos").agg(F.avg("v").alias("mean"))
    sizes = labels.where("label >= 0").groupBy(F.col("label").alias("cluster")).agg(F.count(F.lit(1)).alias("size"))
    between = c.join(mean, "pos").join(sizes, "cluster").agg(F.coalesce(F.sum(F.col("size") * F.pow(F.col("m") - F.col("mean"), 2.0)), F.lit(0.0)).alias("between"))
    within = long.join(c, (F.col("label") == F.col("cluster")) & (long["pos"] == c["pos"])).agg(F.coalesce(F.sum(F.pow(F.col("v") - F.col("m"), 2.0)), F.lit(0.0)).alias("within"))
    counts = p.agg(F.count(F.lit(1)).alias("n")).join(c.agg(F.countDistinct("cluster").alias("k")))
    few = (F.col("k") < 2) | (F.col("n") <= F.col("k"))
    score = F.when(few, F.lit(0.0)).when(F.col("within") < V.VARIANCE_FLOOR, F.lit(V.LARGEST)).otherwise((F.col("between") / (F.col("k") - 1)) / (F.col("within") / (F.col("n") - F.col("k"))))
    return between.join(within).join(counts).select(score.alias("calinski_harabasz"))


def davies_bouldin(p: DataFrame, labels: DataFrame, centroids: DataFrame | None = None, metric: Metric = EUCLIDEAN) -> DataFrame:
    """(davies_bouldin): the mean over all clusters of the worst ratio.

    Centroids, a row a cluster, are joined with each other: the square of the clusters, as the score is defined.
    """
    checked(p, labels)
    c = centroids if centroids is not None else centroids_of(p, labels)
    x = p.join(labels.select("id", F.col("label").alias("cluster")), "id").join(c, "cluster")
    spread = x.groupBy("cluster").agg(F.avg(metric.column(F.col("features"), F.col("centroid"))).alias("s"))
    s = c.join(spread, "cluster", "left").select("cluster", "centroid", F.coalesce("s", F.lit(0.0)).alias("s"))
    a, b = s.select(F.col("cluster").alias("a"), F.col("centroid").alias("x"), F.col("s").alias("s_a")), s.select(F.col("cluster").alias("b"), F.col("centroid").alias("y"), F.col("s").alias("s_b"))
    d = metric.column(F.col("x"), F.col("y"))
    worst = a.join(b, F.col("a") != F.col("b")).withColumn("d", d).where(F.col("d") > V.NORM_FLOOR).groupBy("a").agg(F.max((F.col("s_a") + F.col("s_b")) / F.col("d")).alias("r"))
    return worst.agg(F.coalesce(F.sum("r"), F.lit(0.0)).alias("r")).join(c.agg(F.count(F.lit(1)).alias("k"))).select(F.when(F.col("k") > 1, F.col("r") / F.col("k")).otherwise(F.lit(0.0)).alias("davies_bouldin"))


def contingency(a: DataFrame, b: DataFrame) -> DataFrame:
    """(a, b, n) of two labellings of the same ids; noise is a label like any other."""
    agreeing(a, b)
    return a.select("id", F.col("label").alias("a")).join(b.select("id", F.col("label").alias("b")), "id").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))


def adjusted_rand_index(a: DataFrame, b: DataFrame) -> DataFrame:
    t = contingency(a, b)
    both = t.agg(F.sum(V.pairs_of(F.col("n"))).alias("s"), F.sum("n").alias("n"))
    sums = [t.groupBy(c).agg(F.sum("n").alias("n")).agg(F.sum(V.pairs_of(F.col("n"))).alias(f"s_{c}")) for c in ("a", "b")]
    x = both.join(sums[0]).join(sums[1])
    expected, most = F.col("s_a") * F.col("s_b") / V.pairs_of(F.col("n")), (F.col("s_a") + F.col("s_b")) / 2
    score = F.when(F.coalesce("n", F.lit(0)) <= 1, F.lit(1.0)).when(F.abs(most - expected) < 1e-12, F.lit(1.0)).otherwise((F.col("s") - expected) / (most - expected))
    return x.select(score.alias("ari"))


def normalized_mutual_information(a: DataFrame, b: DataFrame) -> DataFrame:
    """Mutual information over the root of the product of entropies; 0 where an entropy is 0."""
    t = contingency(a, b)
    n = t.agg(F.sum("n").alias("total"))
    left, right = (t.groupBy(c).agg(F.sum("n").alias(f"n_{c}")) for c in ("a", "b"))
    share = F.col("n") / F.col("total")
    mutual = t.join(left, "a").join(right, "b").join(n).agg(F.sum(share * F.log(F.col("n") * F.col("total") / (F.col("n_a") * F.col("n_b")))).alias("i"))
    entropy = [side.join(n).agg((-F.sum(F.col(f"n_{c}") / F.col("total") * F.log(F.col(f"n_{c}") / F.col("total")))).alias(f"h_{c}")) for side, c in ((left, "a"), (right, "b"))]
    x = mutual.join(entropy[0]).join(entropy[1])
    return x.select(F.when((F.col("h_a") > 0) & (F.col("h_b") > 0), F.col("i") / F.sqrt(F.col("h_a") * F.col("h_b"))).otherwise(F.lit(0.0)).alias("nmi"))


def purity(predicted: DataFrame, truth: DataFrame) -> DataFrame:
    """The share of points whose class is the commonest of their cluster."""
    top = contingency(predicted, truth).groupBy("a").agg(F.max("n").alias("top"), F.sum("n").alias("n"))
    return top.agg((F.sum("top") / F.sum("n")).alias("purity"))


def noise_ratio(labels: DataFrame) -> DataFrame:
    return labels.agg(F.coalesce(F.avg(V.is_noise(F.col("label")).cast("double")), F.lit(0.0)).alias("noise_ratio"))


def disco(p: DataFrame, labels: DataFrame, min_points: int, metric: Metric = EUCLIDEAN) -> DataFrame:
    """(disco): a silhouette over mutual reachability in which singletons count 0 and noise +1 or -1.

    A noise point counts +1 if its mean reachability to the nearest cluster is above that cluster's own
    mean, and else -1. One cluster alone leaves the verdicts on noise; without noise it scores 0.
    """
    checked(p, labels)
    core = core_distances(p, min_points, metric)
    sums = cluster_distances(p, labels, metric, core, noise=True).withColumn("mean", F.col("total") / F.col("n"))
    inner = sums.where("label = other").groupBy(F.col("other").alias("cluster")).agg((F.sum("total") / F.sum("n")).alias("inner"))
    clusters = labels.where("label >= 0").groupBy("label").agg(F.count(F.lit(1)).alias("size"))
    many = clusters.count() > 1
    own, other = F.col("other") == F.col("label"), F.col("other") != F.col("label")
    x = sums.where("label >= 0").groupBy("id", "label").agg(F.max(F.when(own, F.col("mean"))).alias("a"), F.min(F.when(other, F.col("mean"))).alias("b"))
    top = F.greatest("a", "b")
    inside = x.select(F.when(F.col("a").isNull() | F.col("b").isNull() | (top <= 0), F.lit(0.0)).otherwise((F.col("b") - F.col("a")) / top).alias("s"))
    near = sums.where("label < 0").groupBy("id").agg(F.min(F.struct("mean", "other")).alias("m")).select("m.mean", F.col("m.other").alias("cluster"))
    noise = near.join(inner, "cluster", "left").select(F.when(F.col("mean") > F.coalesce("inner", F.lit(0.0)), F.lit(1.0)).otherwise(F.lit(-1.0)).alias("s"))
    scored = inside.unionAll(noise) if many else noise
    return scored.agg(F.coalesce(F.avg("s"), F.lit(0.0)).alias("disco"))
