"""DBSCAN as joins: range pairs, degrees, components of core points, border points.

Labels are ranks of clusters by their smallest core id; noise is -1. A border point joins the cluster
with the smallest core id among those it touches (``border="textbook"``). With ``"scan_order"`` it
does so only if that id is smaller than its own, and else joins the smallest cluster whose own first
core point is near, or none: what a scan in id order that never revisits a point gives.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import InvalidParameter
from ..functions.distance import EUCLIDEAN, Metric
from ..plans.staging import stage
from ..sources.points import validated
from .graph import connected_components, rank_components
from .pairs import both_ways, core_links, matrix, neighbours, pruning, range_join

#: Most dimensions that cells are used for, and rows of a block of a cell.
CELL_DIMENSIONS, BLOCK = 3, 4096


def core_points(edges: DataFrame, p: DataFrame, min_points: int) -> DataFrame:
    """(id) of points with min_points neighbours, themselves counted; edges in both directions."""
    if min_points <= 1:
        return p.select("id")
    return edges.groupBy(F.col("i").alias("id")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") + 1 >= min_points).select("id")


@dataclass(frozen=True)
class DBSCAN:
    epsilon: float = 0.5
    min_points: int = 5
    metric: Metric = EUCLIDEAN
    border: str = "textbook"
    plan: str = "auto"

    def __post_init__(self):
        if not self.epsilon > 0:
            raise InvalidParameter("epsilon", "has to be positive")
        if self.min_points < 1:
            raise InvalidParameter("min_points", "has to be at least 1")
        if self.border not in ("textbook", "scan_order"):
            raise InvalidParameter("border", "is textbook or scan_order")

    def with_epsilon(self, epsilon: float) -> DBSCAN:
        return replace(self, epsilon=epsilon)

    def with_min_points(self, min_points: int) -> DBSCAN:
        return replace(self, min_points=min_points)

    def fit_predict(self, p: DataFrame) -> DataFrame:
        """(id, label)."""
        return self._label(p)[0]

    def core(self, p: DataFrame) -> DataFrame:
        """(id) of the core points."""
        return self._label(p)[1]

    def _label(self, p: DataFrame) -> tuple[DataFrame, DataFrame]:
        shape = validated(p)
        euclidean = self.metric.name in ("euclidean", "sqeuclidean")
        if self.plan == "cells" or (self.plan == "auto" and euclidean and shape.d <= CELL_DIMENSIONS):
            if not euclidean:
                raise InvalidParameter("plan", "cells are for Euclidean distances")
            core, seeds, edges = cell_links(p, self.epsilon, self.metric, self.min_points, shape.d)
        elif self.metric.block is not None and (self.plan == "block" or (self.plan == "auto" and (met := pruning(p, self.epsilon, self.metric, dimensions=shape.d)) is None)):
            core, inner, edges = block_links(p, self.epsilon, self.metric, self.min_points)
            seeds = seeds_of(core, inner)
        else:
            met = met if self.plan == "auto" and self.metric.block is not None else range_join(p, self.epsilon, self.metric, self.plan, shape.d)
            edges = stage(both_ways(met.select("i", "j")), "dbscan-edges")
            core = stage(core_points(edges, p, self.min_points), "dbscan-core")
            inner = edges.join(core.select(F.col("id").alias("i")), "i").join(core.select(F.col("id").alias("j")), "j").where("i < j")
            seeds = seeds_of(core, inner)
        ranked = rank_components(seeds.select(F.col("seed").alias("component")))
        touching = edges.join(seeds.select(F.col("id").alias("j"), "seed"), "j").join(core.select(F.col("id").alias("i")), "i", "left_anti")
        least = F.min("seed")
        if self.border == "scan_order":
            own = F.min(F.when(F.col("j") == F.col("seed"), F.col("seed")))
            border = touching.groupBy(F.col("i").alias("id")).agg(least.alias("any"), own.alias("own")).select("id", F.when(F.col("any") < F.col("id"), F.col("any")).otherwise(F.col("own")).alias("seed"))
        else:
            border = touching.groupBy(F.col("i").alias("id")).agg(least.alias("seed"))
        all_seeds = seeds.unionByName(border.where("seed is not null"))
        labels = all_seeds.join(ranked, all_seeds["seed"] == ranked["component"]).select("id", "label")
        return p.select("id").join(labels, "id", "left").select("id", F.coalesce("label", F.lit(-1).cast("long")).alias("label")), core


def seeds_of(core: DataFrame, inner: DataFrame) -> DataFrame:
    """(id, seed) of core points: the smallest that the edges among them lead to."""
    return core.join(connected_components(inner), "id", "left").select("id", F.coalesce("component", "id").alias("seed"))


def block_links(p: DataFrame, epsilon: float, metric: Metric, min_points: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(core points, edges that link them as all edges among them would, edges from other points to them), over all pairs twice: first
    neighbours are counted, then linked. No pair of core points is written down that links nothing, and other points have few."""
    core = p.select("id") if min_points <= 1 else stage(neighbours(p, epsilon, metric).where(F.col("n") + 1 >= min_points).select("id"), "dbscan-core")
    told = p.select("id", "features").join(core.withColumn("inside", F.lit(True)), "id", "left").withColumn("inside", F.coalesce("inside", F.lit(False)))
    met = stage(core_links(told, epsilon, metric), "dbscan-edges")
    return core, met.where("inner").select("i", "j"), met.where("not inner").select("i", "j")


def around(cell: Column, reach: int, d: int, half: bool = False) -> Column:
    """The cells up to ``reach`` away along each axis, of a cell as an array; half: one of each two that lie opposite, and not itself."""
    steps = [()]
    for _ in range(d):
        steps = [(*s, k) for s in steps for k in range(-reach, reach + 1)]
    steps = [s for s in steps if not half or s > (0,) * d]
    return F.explode(F.array(*[F.array(*[F.get(cell, F.lit(k)) + F.lit(step) for k, step in enumerate(s)]) for s in steps]))


def cell_links(p: DataFrame, epsilon: float, metric: Metric, min_points: int, d: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(core points, their seeds, edges of points that aren't in full cells)."""
    true = math.sqrt(epsilon) if metric.triangle == "root" else epsilon
    width = true / math.sqrt(d) * (1 - 1e-9)
    reach = math.ceil(math.sqrt(d) * (1 + 2e-9))
    cell = F.transform("features", lambda v: F.floor(v / width).cast("long"))
    rows = stage(p.select("id", "features", cell.alias("cell")), "dbscan-cells")
    full = stage(rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_points).select("cell"), "dbscan-full")
    inside = rows.join(full, "cell", "left_semi")
    # rows of other cells are compared with all rows around them
    outside = rows.join(full, "cell", "left_anti").select(F.col("id").alias("i"), F.col("features").alias("x"), around(F.col("cell"), reach, d).alias("cell"))
    met = outside.join(rows.select(F.col("id").alias("j"), F.col("features").alias("y"), "cell"), "cell").where(F.col("i") != F.col("j"))
    edges = stage(met.where(metric.column(F.col("x"), F.col("y")) <= epsilon).select("i", "j"), "dbscan-edges")
    sparse = rows.join(full, "cell", "left_anti").select("id")
    few = sparse if min_points <= 1 else edges.groupBy(F.col("i").alias("id")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") + 1 >= min_points).select("id")
    core = stage(inside.select("id", "cell").unionByName(rows.join(few, "id", "left_semi").select("id", "cell")), "dbscan-core")
    first = core.groupBy("cell").agg(F.min("id").alias("first"))
    named = stage(core.join(first, "cell").select("id", "first"), "dbscan-named")
    ends = lambda end: named.select(F.col("id").alias(end), F.col("first").alias(f"first_{end}"))
    beside = edges.join(ends("i"), "i").join(ends("j"), "j").select(F.least("first_i", "first_j").alias("i"), F.greatest("first_i", "first_j").alias("j")).where("i < j").distinct()
    # a cell's core points have its first one's component
    parts = connected_components(beside.unionByName(full_cell_links(inside, epsilon, true, metric, reach, d)))
    seeds = named.join(parts.select(F.col("id").alias("first"), "component"), "first", "left").select("id", F.coalesce("component", "first").alias("seed"))
    return core.select("id"), seeds, edges


def full_cell_links(inside: DataFrame, epsilon: float, true: float, metric: Metric, reach: int, d: int) -> DataFrame:
    """(i, j) of the smallest ids of full cells: edges that link cells as all pairs of them that hold rows within epsilon of each other would.

    Equal rows count once. Rows that lie farthest out in a cell link most neighbours; rows of two cells are gone over in blocks only where
    these links don't join the two already.
    """
    at = lambda k: F.get("features", F.lit(k))
    bound = [(f"low{k}", f"high{k}") for k in range(d)]
    spots = stage(inside.groupBy("cell", "features").agg(F.min("id").alias("id")), "dbscan-spots")
    ways = [sum((at(k) * step for k, step in enumerate(steps) if step), F.lit(0.0)) for steps in product((-1, 0, 1), repeat=d) if any(steps)]
    box = stage(
        spots.groupBy("cell").agg(
            F.count(F.lit(1)).alias("n"), F.min("id").alias("first"), F.array(*[F.max_by("features", way) for way in ways]).alias("out"), *[f(at(k)).alias(name) for k, pair in enumerate(bound) for name, f in zip(pair, (F.min, F.max), strict=True)]
        ),
        "dbscan-boxes",
    )
    other = lambda end: box.select(F.col("cell").alias(end), *[F.col(c).alias(f"{c}_{end}") for c in box.columns if c != "cell"])
    apart = lambda k: F.greatest(F.col(f"low{k}_b") - F.col(f"high{k}_a"), F.col(f"low{k}_a") - F.col(f"high{k}_b"))
    near = F.lit(True)
    for k in range(d):
        near = near & (apart(k) <= true * (1 + 1e-9))
    pairs = other("a").withColumn("b", around(F.col("a"), reach, d, half=True)).join(other("b"), "b").where(near)
    pairs = stage(pairs.withColumn("pair", F.xxhash64("a", "b")), "dbscan-pairs")
    edge = (F.least("first_a", "first_b").alias("i"), F.greatest("first_a", "first_b").alias("j"))
    outer = pairs.select("first_a", "first_b", F.explode("out_a").alias("x"), "out_b").select("first_a", "first_b", "x", F.explode("out_b").alias("y"))
    found = stage(outer.where(metric.column(F.col("x"), F.col("y")) <= epsilon).select(*edge).distinct(), "dbscan-found")
    parts = connected_components(found)
    part = lambda end: parts.select(F.col("id").alias(f"first_{end}"), F.col("component").alias(f"part_{end}"))
    joined = pairs.join(part("a"), "first_a", "left").join(part("b"), "first_b", "left")
    pairs = stage(joined.where(F.coalesce("part_a", "first_a") != F.coalesce("part_b", "first_b")).drop("part_a", "part_b", "out_a", "out_b"), "dbscan-open")
    if pairs.isEmpty():
        return found

    def side(end: str, opposite: str) -> DataFrame:
        """The rows of one cell of each pair that lie near the other's box, in blocks; once for each block of the other."""
        facts = pairs.select(F.col(end).alias("cell"), "first_a", "first_b", "pair", F.col(f"n_{end}").alias("own"), F.ceil(F.col(f"n_{opposite}") / BLOCK).cast("int").alias("blocks"), *[F.col(f"{c}_{opposite}").alias(c) for pair in bound for c in pair])
        here = spots.join(facts, "cell")
        for k, (low, high) in enumerate(bound):
            here = here.where((at(k) >= F.col(low) - true * (1 + 1e-9)) & (at(k) <= F.col(high) + true * (1 + 1e-9)))
        own = F.pmod(F.xxhash64("id"), F.greatest(F.ceil(F.col("own") / BLOCK), F.lit(1))).cast("int")
        blocks = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
        return here.select("first_a", "first_b", "pair", own.alias(f"block_{end}"), blocks.alias(f"block_{opposite}"), "features")

    keys = ["first_a", "first_b", "pair", "block_a", "block_b"]

    def linked(left: pa.Table, right: pa.Table) -> pa.Table:
        if left.num_rows and right.num_rows:
            x, y = matrix(left["features"]), matrix(right["features"])
            for at in range(0, len(x), 256):
                if np.any(metric.block(x[at : at + 256], y) <= epsilon):
                    return left.select(["first_a", "first_b"]).slice(0, 1)
        return left.select(["first_a", "first_b"]).slice(0, 0)

    renamed = lambda df: df.select(*[F.col(c).alias(c) for c in (*keys, "features")])  # noqa: E731  as both sides come from one table
    met = renamed(side("a", "b")).groupBy(*keys).cogroup(renamed(side("b", "a")).groupBy(*keys))
    more = met.applyInArrow(lambda x, y: linked(x, y), "first_a long, first_b long").select(*edge).distinct()
    return found.unionByName(stage(more, "dbscan-linked"))


def with_null_noise(labels: DataFrame) -> DataFrame:
    """Noise as null."""
    return labels.select("id", F.when(F.col("label") >= 0, F.col("label")).alias("label"))


__all__ = ["DBSCAN", "core_points", "with_null_noise"]
