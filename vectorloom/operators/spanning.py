"""Minimum spanning trees in rounds that look at few pairs, over cells of pivots.

In each round every component takes its cheapest edge to another one. A point keeps its ``LISTED`` nearest others
from round to round, by weight and then id, and a bound: whatever isn't listed weighs no less. Members of
the point's own component drop out of the list. While any are left, the first of them is the point's cheapest way
out; when none is, the point is asked again only if its bound doesn't exceed what its component has
found by other points, and then for what lies within that weight alone, in cells that hold other components
(``pivots.visit``). Of a component that has found nothing, the point of least bound is asked first, so that the others
have a weight to go by. The largest component asks nothing and takes no edge: all others join something, and its points, which
are most, needn't be compared with all. Where cells would rule little out (``pivots.worthwhile``), the same is asked of blocks of all rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..functions.distance import Metric
from ..plans.staging import stage, unstage
from .graph import connected_components
from .pairs import cheapest_for, cheapest_ways, matrix, nearest_few
from .pivots import BLOCK, PAIRS, TILE, Cells, build, reach_of, visit, worthwhile

#: Nearest others that a point keeps.
LISTED = 8
NEAR = "array<struct<w:double,j:long>>"


def pruned_tree(table: DataFrame, metric: Metric, root: bool = False, looked: list[int] | None = None) -> DataFrame:
    """(u, v, w) of the minimum spanning tree of (id, features, core), edges in order of (w, u, v).

    w is the largest of the distance (its root, if asked) and both core distances. ``looked`` gets the pairs that each round looks at.
    """
    looked = [] if looked is None else looked
    weigh = np.sqrt if root else (lambda d: d)
    table = stage(table.select(F.col("id").cast("long").alias("id"), V.doubles(F.col("features")).alias("features"), "core"), "tree-points")  # core distances are worked out once
    by_cells = worthwhile(table, metric, k=LISTED, root=root)
    cells = build(table.select("id", "features"), metric) if by_cells else None
    rows = stage(cells.rows.join(table.select("id", "core"), "id"), "tree-rows") if by_cells else table
    n = rows.count()
    labels = stage(rows.select("id", F.col("id").alias("component")), "tree-labels")
    lists = chosen = None
    while True:
        largest = labels.groupBy("component").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "component").first()
        if largest is None or largest["n"] == n:
            break
        asking = labels.where(F.col("component") != largest["component"])
        seen = 0
        placed = rows.join(labels, "id")
        if lists is None:
            if by_cells:
                first, seen = search(cells, placed, with_radius(placed, own_block(cells, placed, metric, weigh), metric, root), metric, weigh, {})
            else:
                first, seen = listed(cheapest_ways(placed, LISTED, metric, root)), n * n
            lists = stage(rows.select("id").join(first, "id", "left").select("id", F.coalesce("near", F.array().cast(NEAR)).alias("near"), bound_of(F.col("near"), F.lit(float("inf"))).alias("bound")), "tree-lists")
        else:
            lists = stage(without_own(lists, labels), "tree-lists")
        best = component_best(lists, asking)
        for limited in (False, True):
            asked = open_points(lists, asking, best, limited)
            if asked.isEmpty():
                continue
            if by_cells:
                radius = F.coalesce(reach_of(metric)(unweighed(F.col("limit"), root)), F.lit(float("inf")))
                queries = stage(placed.join(asked, "id").select("id", "features", "dp", "cell", "core", "component", radius.alias("radius")), "tree-asked")
                found, looks = search(cells, placed, queries, metric, weigh, whole_cells(placed))
            else:
                queries = stage(placed.join(asked, "id").select("id", "features", "core", "component", F.coalesce("limit", F.lit(float("inf"))).alias("cap")), "tree-asked")
                found, looks = listed(cheapest_for(queries, placed, LISTED, metric, root)), queries.count() * n
            seen += looks
            new = asked.join(found, "id", "left").select("id", F.coalesce("near", F.array().cast(NEAR)).alias("new"), bound_of(F.col("near"), F.coalesce("limit", F.lit(float("inf")))).alias("new_bound"))
            new = stage(new, "tree-found")
            old, lists = lists, stage(lists.join(new, "id", "left").select("id", F.coalesce("new", "near").alias("near"), F.coalesce("new_bound", "bound").alias("bound")), "tree-lists")
            unstage(old, queries, new)
            best = component_best(lists, asking)
        looked.append(seen)
        edges = best.select("e.u", "e.v", "e.w").distinct()
        chosen = stage(edges if chosen is None else chosen.unionAll(edges).distinct(), "tree-edges")
        joined = connected_components(chosen, "u", "v")
        labels = stage(rows.select("id").join(joined, "id", "left").select("id", F.coalesce("component", "id").alias("component")), "tree-labels")
    return chosen if chosen is not None else table.sparkSession.createDataFrame([], "u long, v long, w double")


def listed(found: DataFrame) -> DataFrame:
    """(id, near) of each row's ``LISTED`` cheapest of (i, j, distance)."""
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("i").orderBy("distance", "j"))).where(F.col("rank") <= LISTED)
    return ranked.groupBy(F.col("i").alias("id")).agg(F.array_sort(F.collect_list(F.struct(F.col("distance").alias("w"), "j"))).alias("near"))


def unweighed(w: Column, root: bool) -> Column:
    return w * w if root else w


def bound_of(near: Column, otherwise: Column) -> Column:
    """What isn't listed weighs no less than the last of a full list; else no less than the weight that was asked for."""
    return F.when(F.size(near) >= LISTED, F.element_at(near, -1)["w"]).otherwise(otherwise)


def own_block(cells: Cells, placed: DataFrame, metric: Metric, weigh) -> DataFrame:
    """(id, w): a weight within which ``LISTED`` others lie, from a block of the point's own cell."""
    share = F.array(*[F.lit(max(1, -(-int(c) // BLOCK))) for c in cells.counts])
    blocks = placed.select("id", "features", "core", "component", "cell", F.pmod(F.xxhash64("id", F.lit(1)), F.get(share, F.col("cell"))).alias("block"))
    kernel = foreign_kernel(metric, weigh)

    def nearby(t: pa.Table) -> pa.Table:
        out = [kernel(t.slice(a, TILE), t.slice(b, TILE), 0) for a in range(0, t.num_rows, TILE) for b in range(0, t.num_rows, TILE)]
        return pa.Table.from_pydict({c: pa.array(np.concatenate([o[c] for o in out])) for c in ("i", "j", "distance")})

    found = blocks.groupBy("cell", "block").applyInArrow(lambda t: nearby(t), PAIRS)
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("i").orderBy("distance", "j")))
    return ranked.where(F.col("rank") == LISTED).select(F.col("i").alias("id"), F.col("distance").alias("w"))


def with_radius(placed: DataFrame, weights: DataFrame, metric: Metric, root: bool) -> DataFrame:
    radius = F.coalesce(reach_of(metric)(unweighed(F.col("w"), root)), F.lit(float("inf")))
    return stage(placed.join(weights, "id", "left").select("id", "features", "dp", "cell", "core", "component", radius.alias("radius")), "tree-asked")


def foreign_kernel(metric: Metric, weigh):
    """Each visitor's ``LISTED`` cheapest ways to other components within a block."""

    def kernel(left: pa.Table, right: pa.Table, to: int) -> dict[str, np.ndarray]:
        a, b = right["id"].to_numpy(), left["id"].to_numpy()
        if not len(a) or not len(b):
            return {"i": np.empty(0, np.int64), "j": np.empty(0, np.int64), "distance": np.empty(0)}
        w = np.maximum(weigh(metric.block(matrix(right["features"]), matrix(left["features"]))), np.maximum.outer(right["core"].to_numpy(), left["core"].to_numpy()))
        w[right["component"].to_numpy()[:, None] == left["component"].to_numpy()[None, :]] = np.inf
        i, j, near = nearest_few(a, b, w, LISTED)
        return {"i": i, "j": j, "distance": near}

    return kernel


def search(cells: Cells, placed: DataFrame, queries: DataFrame, metric: Metric, weigh, skip: dict[int, int]) -> tuple[DataFrame, int]:
    """((id, near): the cheapest ways out within each query's radius, pairs looked at)."""
    found, looked = visit(cells, placed.select("id", "features", "cell", "core", "component"), queries, PAIRS, foreign_kernel(metric, weigh), skip=skip)
    return listed(found), looked


def without_own(lists: DataFrame, labels: DataFrame) -> DataFrame:
    """Lists without members of the point's own component."""
    listed = lists.select("id", F.explode("near").alias("x")).select("id", "x.w", "x.j")
    there = labels.select(F.col("id").alias("j"), F.col("component").alias("other"))
    kept = listed.join(there, "j").join(labels, "id").where("component <> other").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("w", "j"))).alias("kept"))
    return lists.join(kept, "id", "left").select("id", F.coalesce("kept", F.array().cast(NEAR)).alias("near"), "bound")


def component_best(lists: DataFrame, labels: DataFrame) -> DataFrame:
    """(component, e): the cheapest listed way out of each component, ties by (u, v)."""
    x = F.get("near", F.lit(0))
    edge = F.struct(x["w"].alias("w"), F.least("id", x["j"]).alias("u"), F.greatest("id", x["j"]).alias("v"))
    return stage(lists.where(F.size("near") > 0).select("id", edge.alias("e")).join(labels, "id").groupBy("component").agg(F.min("e").alias("e")), "tree-best")


def open_points(lists: DataFrame, labels: DataFrame, best: DataFrame, limited: bool) -> DataFrame:
    """(id, limit): points whose list is used up and that may have a cheaper way out than their component has found.

    Not ``limited``: of components that have found nothing, the one point of least bound.
    """
    bare = lists.where((F.size("near") == 0) & (F.col("bound") < float("inf"))).select("id", "bound").join(labels, "id").join(best, "component", "left")
    if limited:
        return stage(bare.where(F.col("e").isNotNull() & (F.col("bound") <= F.col("e.w"))).select("id", F.col("e.w").alias("limit")), "tree-open")
    first = bare.where(F.col("e").isNull()).groupBy("component").agg(F.min(F.struct("bound", "id")).alias("first"))
    return stage(first.select(F.col("first.id").alias("id"), F.lit(None).cast("double").alias("limit")), "tree-open")


def whole_cells(placed: DataFrame) -> dict[int, int]:
    """Cells whose rows are all of one component: at most one row a cell."""
    found = placed.groupBy("cell").agg(F.min("component").alias("a"), F.max("component").alias("b")).where("a = b").collect()
    return {r["cell"]: r["a"] for r in found}
