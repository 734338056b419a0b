"""Metric-space cells: exact joins that look only at cells which the triangle inequality can't rule out.

A few pivots are taken from a sample, far from one another. Every row is measured against all of them and
belongs to the cell of the nearest; of each cell it is known between which bounds the distances of its rows to each
pivot lie. A row that asks for whatever is within a radius is sent to those cells alone whose bounds, widened
by the radius, hold its own distances to all pivots. No coordinates are used, so any metric will do that
keeps the triangle inequality, by itself or by a rising function of it (``Metric.triangle``): squared Euclidean distances by their
root, cosine distances by their angle.

What is sent to a cell meets it in blocks of at most ``BLOCK`` rows on either side, each pair of blocks a
task of its own, so a crowded cell is no hot key. The driver holds the pivots and the cells' bounds:
``PIVOTS`` squared numbers at most.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..errors import InvalidParameter
from ..functions import vectors as V
from ..functions.distance import EUCLIDEAN, Metric
from ..functions.distance import within as rows_within
from ..plans.staging import partitions, stage
from .pairs import cheapest_for, cheapest_ways, matrix, nearest_few, pairwise

PIVOTS, SAMPLE, SAMPLE_VALUES = 512, 4096, 4_000_000
#: Pivots where a metric has no kernel and each is part of an expression.
FEW_PIVOTS = 16
BLOCK, TILE = 4096, 512
#: Rows of the sample for which a radius is worked out, and how many times fewer pairs cells have to leave: sending rows to cells costs that much more.
TRIED, PRUNES = 128, 10
#: What rounding may change, of distances and of angles.
SLACK, ANGLE_SLACK = 1e-9, 2e-7

Kernel = Callable[[pa.Table, pa.Table, int], dict[str, np.ndarray]]


def true_metric(metric: Metric, d: np.ndarray) -> np.ndarray:
    """Distances as numbers that keep the triangle inequality."""
    if metric.triangle == "root":
        return np.sqrt(np.maximum(d, 0.0))
    if metric.triangle == "angle":
        return np.arccos(np.clip(1.0 - d, -1.0, 1.0))
    return d


@dataclass
class Bounds:
    """Between which distances to each pivot the rows of each cell lie, and how many they are; the last cell is for vectors of no direction."""

    low: np.ndarray
    high: np.ndarray
    counts: np.ndarray
    slack: float

    def reached(self, dp: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, cell) of all cells that may hold something within each row's radius."""
        own = np.append(np.diagonal(self.high), np.inf)
        wide = np.append(dp, np.zeros((len(dp), 1)), axis=1)
        row, cell = np.nonzero((wide - radius[:, None] <= own + self.slack) & (self.counts > 0))
        keep = np.ones(len(row), bool)
        for at in range(0, len(row), max(1, 2_000_000 // dp.shape[1])):
            part = slice(at, at + max(1, 2_000_000 // dp.shape[1]))
            d, r = dp[row[part]], radius[row[part]][:, None]
            keep[part] = ((d - r <= self.high[cell[part]] + self.slack) & (d + r >= self.low[cell[part]] - self.slack)).all(1)
        return row[keep], cell[keep]


@dataclass
class Cells:
    """rows: (id, features, dp, cell), staged; dp are distances to the pivots, as a true metric's."""

    rows: DataFrame
    metric: Metric
    bounds: Bounds

    @property
    def counts(self) -> np.ndarray:
        return self.bounds.counts


def far_apart(x: np.ndarray, metric: Metric, many: int) -> np.ndarray:
    """Rows far from one another."""
    chosen = [0]
    near = true_metric(metric, metric.block(x, x[:1])[:, 0])
    while len(chosen) < min(many, len(x)) and near.max() > 0:
        chosen.append(int(near.argmax()))
        near = np.minimum(near, true_metric(metric, metric.block(x, x[chosen[-1:]])[:, 0]))
    return x[chosen]


def worthwhile(table: DataFrame, metric: Metric, epsilon: float | None = None, k: int = 1, root: bool = False) -> bool:
    """Whether cells would leave few pairs to be looked at, by cells of a sample, whose bounds are narrower than those of all rows.

    The radius is epsilon, or that within which a row of (id, features) or (id, features, core) has its k cheapest ways, found exactly
    for ``TRIED`` rows. Small tables and metrics without a kernel are taken to be worth it. Where cells aren't, blocks of all pairs give the same.
    """
    n = table.count()
    if n <= SAMPLE or metric.block is None:
        return True
    core = F.col("core") if "core" in table.columns else F.lit(0.0)
    given = table.select(F.col("id").cast("long").alias("id"), V.doubles(F.col("features")).alias("features"), core.alias("core"), F.col("id").cast("long").alias("component"))
    d = given.select(F.size("features")).first()[0] or 1
    picked = given.orderBy(F.xxhash64("id"), "id").limit(max(TRIED, min(SAMPLE, SAMPLE_VALUES // d))).toArrow()  # a bounded sample
    ids, x = picked["id"].to_numpy(), matrix(picked["features"].combine_chunks())
    c = far_apart(np.unique(x, axis=0), metric, min(PIVOTS, math.ceil(math.sqrt(n) / 2)))
    dp = true_metric(metric, metric.block(x, c))
    cell, many = dp.argmin(1), len(c)
    low, high = np.full((many + 1, many), np.inf), np.full((many + 1, many), -np.inf)
    np.minimum.at(low, cell, dp)
    np.maximum.at(high, cell, dp)
    counts = np.bincount(cell, minlength=many + 1)
    tried = min(TRIED, len(ids))
    if epsilon is not None:
        radius = np.full(tried, float(true_metric(metric, np.array([epsilon]))[0]))
    else:
        asked = table.sparkSession.createDataFrame([(int(i),) for i in ids[:tried]], "id long").join(given, "id").withColumn("cap", F.lit(float("inf")))
        ranked = cheapest_for(asked, given, k, metric, root).withColumn("rank", F.row_number().over(Window.partitionBy("i").orderBy("distance", "j")))
        kth = {r["i"]: r["distance"] for r in ranked.where(F.col("rank") == k).select("i", "distance").collect()}  # a row for each tried
        w = np.array([kth.get(int(i), np.inf) for i in ids[:tried]])
        radius = true_metric(metric, w * w if root else w)
    _, reached = Bounds(low, high, counts, SLACK).reached(dp[:tried], radius)
    return bool(counts[reached].sum() * PRUNES <= tried * len(ids))


def build(p: DataFrame, metric: Metric = EUCLIDEAN, pivots: int | None = None) -> Cells:
    """The cells of points (id, features)."""
    if metric.triangle is None:
        raise InvalidParameter("metric", f"{metric.name} isn't known to keep the triangle inequality")
    shape = p.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("features")).alias("d")).first()
    n, d = shape["n"], max(shape["d"] or 1, 1)
    many = pivots or max(1, min(PIVOTS if metric.block else FEW_PIVOTS, math.ceil(math.sqrt(n) / 2)))
    sample = p.select("id", "features").orderBy(F.xxhash64("id"), "id").limit(min(SAMPLE, max(many, SAMPLE_VALUES // d))).toArrow()  # a bounded sample
    x = matrix(sample["features"].combine_chunks()) if sample.num_rows else np.zeros((1, d))
    x = np.unique(x, axis=0)
    c = far_apart(x, metric, many) if metric.block else x[:: max(1, len(x) // many)][:many]
    many, angled = len(c), metric.triangle == "angle"
    schema = "id long, features array<double>, dp array<double>, cell int"

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            v = matrix(batch.column(1))
            raw = metric.block(v, c) if metric.block else matrix(batch.column(2))
            dp = true_metric(metric, raw)
            cell = dp.argmin(1).astype(np.int32)
            if angled:
                cell[(v**2).sum(1) * max(float((c**2).sum(1).max()), 1.0) < V.COSINE_FLOOR * 4] = many
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(list(dp), pa.list_(pa.float64())), pa.array(cell)], ["id", "features", "dp", "cell"])

    given = p.select(F.col("id").cast("long"), V.doubles(F.col("features")).alias("features"))
    if not metric.block:
        given = given.withColumn("raw", F.array(*[metric.column(F.col("features"), F.array(*[F.lit(float(v)) for v in row])) for row in c]))
    rows = stage(given.mapInArrow(measured, schema), "pivot-cells")

    def bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low, high, count = np.full((many + 1, many), np.inf), np.full((many + 1, many), -np.inf), np.zeros(many + 1, np.int64)
        for batch in batches:
            if batch.num_rows:
                dp, cell = matrix(batch.column(0)), batch.column(1).to_numpy()
                np.minimum.at(low, cell, dp)
                np.maximum.at(high, cell, dp)
                count += np.bincount(cell, minlength=many + 1)
        yield pa.RecordBatch.from_arrays([pa.array(range(many + 1), pa.int32()), pa.array(count), pa.array(list(low), pa.list_(pa.float64())), pa.array(list(high), pa.list_(pa.float64()))], ["cell", "n", "low", "high"])

    ends = rows.select("dp", "cell").mapInArrow(bounds, "cell int, n long, low array<double>, high array<double>")
    least = lambda c, f: F.array(*[f(F.get(c, F.lit(k))) for k in range(many)]).alias(c)
    found = ends.groupBy("cell").agg(F.sum("n").alias("n"), least("low", F.min), least("high", F.max)).collect()  # a row a cell
    low, high, counts = np.full((many + 1, many), np.inf), np.full((many + 1, many), -np.inf), np.zeros(many + 1, np.int64)
    for r in found:
        low[r["cell"]], high[r["cell"]], counts[r["cell"]] = r["low"], r["high"], r["n"]
    low[many], high[many] = -np.inf, np.inf  # nothing is known of vectors of no direction
    widest = float(high[np.isfinite(high)].max()) if np.isfinite(high).any() else 1.0
    return Cells(rows, metric, Bounds(low, high, counts, ANGLE_SLACK if angled else SLACK * (1 + widest)))


def visit(cells: Cells, homes: DataFrame, queries: DataFrame, schema: str, kernel: Kernel | None, forward: bool = False, skip: dict[int, int] | None = None) -> tuple[DataFrame, int]:
    """Queries sent to the cells that they may reach: what ``kernel`` makes of each pair of blocks, and how many pairs are looked at.

    homes: (id, features, cell, ...) of all rows. queries: (id, features, dp, cell, radius, ...), radius as a true metric's.
    kernel(home rows, visitors, cell); without one, the joined rows come back: those of homes, and those of queries with
    names that begin with q_. forward sends a row to its own cell and those of higher numbers alone, so that each pair is met once but for
    its own cell. skip: cells whose rows all have one ``component`` (a column of queries, then), left out for its own rows.
    """
    bounds, many = cells.bounds, len(cells.counts)
    alone = np.array([(skip or {}).get(c, -1) for c in range(many)], np.int64)

    def reached(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        at = batch.schema.get_field_index
        own = batch.column(at("cell")).to_numpy()
        radius = batch.column(at("radius")).to_numpy().copy()
        radius[own == many - 1] = np.inf
        row, cell = bounds.reached(matrix(batch.column(at("dp"))), radius)
        if forward:
            row, cell = row[cell >= own[row]], cell[cell >= own[row]]
        if skip:
            mine = batch.column(at("component")).to_numpy()
            keep = alone[cell] != mine[row]
            row, cell = row[keep], cell[keep]
        return row, cell

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(many, np.int64)
        for batch in batches:
            if batch.num_rows:
                total += np.bincount(reached(batch)[1], minlength=many)
        yield pa.RecordBatch.from_arrays([pa.array(range(many), pa.int32()), pa.array(total)], ["to", "n"])

    needed = ["dp", "cell", "radius", *(["component"] if skip else [])]
    visits = {r["to"]: r["n"] for r in queries.select(*needed).mapInArrow(count, "to int, n long").groupBy("to").agg(F.sum("n").alias("n")).collect()}  # a row a cell
    looked = sum(int(n) * int(cells.counts[c]) for c, n in visits.items())
    blocks = lambda of: F.array(*[F.lit(max(1, -(-int(of(c)) // BLOCK))) for c in range(many)])
    home_blocks, visit_blocks = blocks(lambda c: cells.counts[c]), blocks(lambda c: visits.get(c, 0))
    names = [c for c in queries.columns if c not in ("dp",)]

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                row, cell = reached(batch)
                keep = batch.select(names).take(pa.array(row))
                yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), *keep.columns], ["to", *names])

    kinds = {f.name: f.dataType.simpleString() for f in queries.schema}
    going = queries.mapInArrow(sent, "to int, " + ", ".join(f"{c} {kinds[c]}" for c in names))
    pick = lambda of, to: F.get(of, F.col(to))
    number = lambda of, to, salt: F.pmod(F.xxhash64("id", F.lit(salt)), pick(of, to)).cast("int")
    every = lambda of, to: F.explode(F.sequence(F.lit(0), pick(of, to) - 1))
    here = homes.select(F.col("cell").alias("to"), number(home_blocks, "cell", 1).alias("hb"), every(visit_blocks, "cell").alias("vb"), *homes.columns)
    there = going.select("to", number(visit_blocks, "to", 2).alias("vb"), every(home_blocks, "to").alias("hb"), *names)
    keys = ["to", "hb", "vb"]
    if kernel is None:
        return here.join(there.select(*keys, *[F.col(c).alias(f"q_{c}") for c in names]), keys).drop(*keys), looked
    parts = max(partitions(homes.sparkSession), math.ceil(looked / 50_000_000))
    met = here.repartition(parts, *keys).groupBy(*keys).cogroup(there.repartition(parts, *keys).groupBy(*keys))

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        out = [kernel(left.slice(0, 0), right.slice(0, 0), 0)]
        if left.num_rows and right.num_rows:
            to = left["to"][0].as_py()
            for a in range(0, left.num_rows, TILE):
                for b in range(0, right.num_rows, TILE):
                    out.append(kernel(left.slice(a, TILE), right.slice(b, TILE), to))
        return pa.Table.from_pydict({k: pa.array(np.concatenate([o[k] for o in out])) for k in out[0]})

    return met.applyInArrow(lambda a, b: meet(a, b), schema), looked


PAIRS = "i long, j long, distance double"


def range_join(p: DataFrame, epsilon: float, metric: Metric = EUCLIDEAN, cells: Cells | None = None) -> tuple[DataFrame, int]:
    """((i, j, distance) of pairs i < j at most epsilon apart, pairs looked at); by blocks where cells wouldn't rule much out."""
    if cells is None and metric.triangle is not None and not worthwhile(p, metric, epsilon):
        return pairwise(p, metric, epsilon), p.count() ** 2
    cells = cells or build(p, metric)
    radius = float(true_metric(metric, np.array([epsilon]))[0])
    queries = cells.rows.withColumn("radius", F.lit(radius))
    homes = cells.rows.select("id", "features", "cell")
    if metric.block is None:
        met, looked = visit(cells, homes, queries, PAIRS, None, forward=True)
        met = met.where((F.col("q_cell") != F.col("cell")) | (F.col("id") < F.col("q_id")))
        out = met.select(F.least("id", "q_id").alias("i"), F.greatest("id", "q_id").alias("j"), metric.column(F.col("features"), F.col("q_features")).alias("distance"))
        return out.where(F.col("distance") <= epsilon), looked

    def kernel(left: pa.Table, right: pa.Table, to: int) -> dict[str, np.ndarray]:
        a, b = left["id"].to_numpy(), right["id"].to_numpy()
        if not len(a) or not len(b):
            return {"i": np.empty(0, np.int64), "j": np.empty(0, np.int64), "distance": np.empty(0)}
        r, c, d = rows_within(metric, matrix(left["features"]), matrix(right["features"]), epsilon)
        keep = (a[r] < b[c]) | (right["cell"].to_numpy() != to)[c]
        r, c, d = r[keep], c[keep], d[keep]
        return {"i": np.minimum(a[r], b[c]), "j": np.maximum(a[r], b[c]), "distance": d}

    return visit(cells, homes, queries, PAIRS, kernel, forward=True)


def nearest_kernel(metric: Metric, k: int, include_self: bool) -> Kernel:
    """Each visitor's k nearest of a block."""

    def kernel(left: pa.Table, right: pa.Table, to: int) -> dict[str, np.ndarray]:
        a, b = right["id"].to_numpy(), left["id"].to_numpy()
        if not len(a) or not len(b):
            return {"i": np.empty(0, np.int64), "j": np.empty(0, np.int64), "distance": np.empty(0)}
        d = metric.block(matrix(right["features"]), matrix(left["features"]))
        if not include_self:
            d[a[:, None] == b[None, :]] = np.inf
        i, j, near = nearest_few(a, b, d, k)
        return {"i": i, "j": j, "distance": near}

    return kernel


def reach_of(metric: Metric):
    """A column expression of ``true_metric``."""
    ways = {"plain": lambda d: d, "root": lambda d: F.sqrt(F.greatest(d, F.lit(0.0))), "angle": lambda d: F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), 1 - d)))}
    return ways[metric.triangle]


def knn_join(p: DataFrame, k: int, metric: Metric = EUCLIDEAN, include_self: bool = False, cells: Cells | None = None) -> tuple[DataFrame, int]:
    """((i, j, distance, rank) of each point's k nearest, ties by id; pairs looked at).

    A point's own block gives a radius within which k others lie; then whatever may be within it is looked at. Where cells wouldn't rule
    much out, blocks of all pairs are.
    """
    if cells is None and metric.triangle is not None and not worthwhile(p, metric, k=k):
        found = cheapest_ways(p.select("id", "features"), k, metric, include_self=include_self)
        return found.withColumn("rank", F.row_number().over(Window.partitionBy("i").orderBy("distance", "j")).cast("long")).where(F.col("rank") <= k), p.count() ** 2
    cells = cells or build(p, metric)
    homes = cells.rows.select("id", "features", "cell")
    order = Window.partitionBy("i").orderBy("distance", "j")
    share = F.array(*[F.lit(max(1, -(-int(c) // BLOCK))) for c in cells.counts])
    own = homes.withColumn("block", F.pmod(F.xxhash64("id", F.lit(1)), F.get(share, F.col("cell"))).cast("int"))
    loose = len(cells.counts) - 1

    if metric.block is None:
        other = own.select(F.col("id").alias("j"), F.col("features").alias("y"), "cell", "block")
        near = own.join(other, ["cell", "block"]).where(F.lit(include_self) | (F.col("id") != F.col("j"))).select(F.col("id").alias("i"), "j", metric.column(F.col("features"), F.col("y")).alias("distance"))
    else:
        kernel = nearest_kernel(metric, k, include_self)

        def nearby(table: pa.Table) -> pa.Table:
            out = [kernel(table.slice(a, TILE), table.slice(b, TILE), 0) for a in range(0, table.num_rows, TILE) for b in range(0, table.num_rows, TILE)]
            return pa.Table.from_pydict({c: pa.array(np.concatenate([o[c] for o in out])) for c in ("i", "j", "distance")})

        near = own.select("id", "features", "cell", "block").groupBy("cell", "block").applyInArrow(lambda t: nearby(t), PAIRS)
    kth = near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") == k).select(F.col("i").alias("id"), reach_of(metric)(F.col("distance")).alias("radius"))
    infinite = F.lit(float("inf"))
    queries = cells.rows.join(kth, "id", "left").withColumn("radius", F.when(F.col("cell") == loose, infinite).otherwise(F.coalesce("radius", infinite)))
    queries = stage(queries.select("id", "features", "dp", "cell", "radius"), "pivot-queries")
    if metric.block is None:
        met, looked = visit(cells, homes, queries, PAIRS, None)
        found = met.where(F.lit(include_self) | (F.col("id") != F.col("q_id"))).select(F.col("q_id").alias("i"), F.col("id").alias("j"), metric.column(F.col("q_features"), F.col("features")).alias("distance"))
    else:
        found, looked = visit(cells, homes, queries, PAIRS, kernel)
    return found.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k), looked
