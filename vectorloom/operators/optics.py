"""OPTICS: neighbour lists by a distributed join, the ordering by one task's walk over them.

The walk takes the unseen point of least reachability (ties by id) and can't be split; it holds at most ``WALK``
pairs. Where all pairs within max_epsilon could be more, it gets those that can decide a step. A step from p to
o weighs the larger of p's core distance and their distance. Where some way from p to o has lighter steps only, one of these
leaves what is seen whenever the step from p to o does, and goes first. The spanning tree of mutual reachability tells the
heaviest step of such a way, so a pair is left out if it is farther apart than that. What is left are the nearest few
of each point, a tree, and whatever ties with these, which is a few pairs a point. What is extracted from many orderings are window queries, one
task an ordering; one ordering alone is cut into ranges of positions, each range tells how many clusters it starts,
its last reachability and its last event, and what comes before a range is carried into it.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import InvalidParameter
from ..functions.distance import EUCLIDEAN, Metric, by_products, of_rows
from ..plans.ranges import PART, ranged, so_far, with_carry
from ..plans.staging import partitions, stage
from ..sources.points import validated
from . import hierarchy, pairs
from .pairs import both_ways, knn_join, range_join

WALK = 50_000_000
ORDERING = "pos long, id long, reachability double, core_distance double"


def walk(ids: np.ndarray, i: np.ndarray, j: np.ndarray, d: np.ndarray, min_points: int) -> list[tuple[int, float, float]]:
    """(id, reachability, core distance) in order of the walk, from pairs in both directions."""
    n = len(ids)
    a, b = np.searchsorted(ids, i), np.searchsorted(ids, j)
    order = np.lexsort((b, d, a))
    a, b, d = a[order], b[order], d[order]
    begin = np.searchsorted(a, np.arange(n + 1))
    core = np.full(n, np.inf)
    if min_points == 1:
        core[:] = 0.0
    else:
        enough = np.flatnonzero(np.diff(begin) >= min_points - 1)
        core[enough] = d[begin[enough] + min_points - 2]
    seen, reach, out = np.zeros(n, bool), np.full(n, np.inf), []
    for first in range(n):
        queue = [(np.inf, first)]
        while queue:
            r, at = heapq.heappop(queue)
            if seen[at] or r > reach[at]:
                continue
            seen[at] = True
            out.append((int(ids[at]), float(reach[at]), float(core[at])))
            if np.isfinite(core[at]):
                near, gap = b[begin[at] : begin[at + 1]], np.maximum(d[begin[at] : begin[at + 1]], core[at])
                closer = ~seen[near] & (gap < reach[near])
                reach[near[closer]] = gap[closer]
                for item in zip(gap[closer].tolist(), near[closer].tolist(), strict=True):
                    heapq.heappush(queue, item)
    return out


def leaves(t: pa.Table) -> pa.Table:
    """(id, pos, gap) of a tree's vertices, so placed that the heaviest edge on the way between two is the largest gap after the first, up to the second."""
    ids, ends = np.unique(np.concatenate([t["u"].to_numpy(), t["v"].to_numpy()]), return_inverse=True)
    n, w = len(ids), t["w"].to_numpy()
    u, v = ends[: len(w)].tolist(), ends[len(w) :].tolist()
    sets, head, tail, after = hierarchy.Forest(n), list(range(n)), list(range(n)), [-1] * n
    gap = np.full(n, -np.inf)
    for e in np.argsort(w, kind="stable").tolist():
        a, b = sets.find(u[e]), sets.find(v[e])
        first, last = head[a], tail[b]
        after[tail[a]] = head[b]
        gap[head[b]] = w[e]
        at = sets.unite(a, b)
        head[at], tail[at] = first, last
    order, at = [], head[sets.find(0)] if n else -1
    while at >= 0:
        order.append(at)
        at = after[at]
    return pa.table({"id": pa.array(ids[order], pa.int64()), "pos": pa.array(np.arange(len(order))), "gap": pa.array(gap[order])})


@dataclass
class Part:
    """Points of one group in the order of their places; those that have none come last and are loose."""

    ids: np.ndarray
    x: np.ndarray
    core: np.ndarray
    gap: np.ndarray
    loose: np.ndarray

    @staticmethod
    def of(t: pa.Table) -> Part:
        t = t.sort_by("pos")  # nulls last
        loose = pa.compute.is_null(t["pos"]).to_numpy()
        return Part(t["id"].to_numpy(), pairs.matrix(t["features"]), t["core"].to_numpy(), np.where(loose, -np.inf, t["gap"].to_numpy()), loose)


def heaviest(one: Part, x: slice) -> np.ndarray:
    """The heaviest edge on the way from each row of a tile to each later one; infinite for loose ones."""
    out = np.maximum.accumulate(np.triu(np.broadcast_to(one.gap[x], (len(one.gap[x]),) * 2), 1) + np.where(np.tri(len(one.gap[x]), dtype=bool), -np.inf, 0.0), axis=1)
    out[one.loose[x]] = np.inf
    out[:, one.loose[x]] = np.inf
    return out


def ways_out(one: Part, x: slice, two: Part, y: slice, between: float) -> tuple[np.ndarray, np.ndarray]:
    """For rows x of one and rows y of two, which come later: two numbers whose larger is the heaviest edge on the way; infinite for loose ones."""
    after = np.append(np.maximum.accumulate(one.gap[x][:0:-1])[::-1], -np.inf)
    return np.where(one.loose[x], np.inf, np.maximum(after, between)), np.where(two.loose[y], np.inf, np.maximum.accumulate(two.gap[y]))


def deciding(p: DataFrame, core: DataFrame, d: int, epsilon: float, metric: Metric) -> DataFrame:
    """(i, j, distance), i < j: pairs at most epsilon apart, without those that no walk's step can go by; core: (id, core), infinite beyond epsilon."""
    spark, finite = p.sparkSession, F.col("core") < float("inf")
    core = stage(core, "optics-core")
    tree = hierarchy.spanning_tree(p.join(core.where(finite).select("id"), "id"), metric, core.where(finite))
    order = stage(tree.groupBy(F.lit("all")).applyInArrow(lambda t: leaves(t), "id long, pos long, gap double"), "optics-leaves")
    n, placed = core.count(), order.count()
    groups = pairs.groups_for(n, d, spark.sparkContext.defaultParallelism, pairs.TILE)
    group = F.coalesce(F.floor(F.col("pos") * groups / max(1, placed)), F.pmod(F.xxhash64("id"), F.lit(groups))).cast("int")
    points = stage(p.select("id", "features").join(core, "id").join(order, "id", "left").withColumn("group", group), "optics-points")
    most = {r["group"]: r["most"] for r in points.where("pos is not null").groupBy("group").agg(F.max("gap").alias("most")).collect()}  # one row a group
    power = metric.power

    def run(left: pa.Table, right: pa.Table, same: bool) -> Iterator[dict[str, np.ndarray]]:
        if not left.num_rows or not right.num_rows:
            return
        one, tile = Part.of(left), pairs.TILE
        two = one if same else Part.of(right)
        mid = max([most.get(g, -np.inf) for g in range(left["group"][0].as_py() + 1, right["group"][0].as_py())], default=-np.inf)
        for a in range(0, len(one.ids), tile):
            for b in range(a if same else 0, len(two.ids), tile):
                x, y = slice(a, a + tile), slice(b, b + tile)
                between = one.gap[a + tile : b].max(initial=-np.inf) if same else max(mid, one.gap[a + tile :].max(initial=-np.inf), two.gap[:b].max(initial=-np.inf))
                near = by_products(one.x[x], two.x[y]) if power else None
                far, off = near or (metric.block(one.x[x], two.x[y]), 0.0)
                reach = lambda limit: limit if near is None else np.maximum(limit, 0.0) ** power * (1 + 1e-12) + off  # noqa: E731, B023
                # the largest limit of the tile leaves few pairs, whose own limits are then looked at; a pair too many does no harm
                if same and a == b:
                    own = heaviest(one, x)
                    r, c = np.nonzero(np.triu(far <= reach(epsilon), 1))
                    limit = own[r, c]
                else:
                    after, before = ways_out(one, x, two, y, between)
                    top = max(after.max(), before.max())
                    r, c = np.divmod(np.flatnonzero(far <= reach(min(epsilon, top * (1 + 2e-9 * np.sign(top))))), far.shape[1])
                    limit = np.maximum(after[r], before[c])
                limit = np.minimum(limit * (1 + 1e-9 * np.sign(limit)), epsilon)  # a metric's last bits may hang on the block
                may = (far[r, c] <= reach(limit)) & (np.isfinite(one.core[x])[r] | np.isfinite(two.core[y])[c])
                r, c, limit = r[may], c[may], limit[may]
                gap = far[r, c] if near is None else of_rows(metric, one.x[x], two.x[y], r, c)
                keep = gap <= limit
                i, j = one.ids[x][r[keep]], two.ids[y][c[keep]]
                yield {"i": np.minimum(i, j), "j": np.maximum(i, j), "distance": gap[keep]}

    return pairs.in_groups(points, run, "i long, j long, distance double", groups=groups, group=F.col("group"))


@dataclass(frozen=True)
class OPTICS:
    max_epsilon: float
    min_points: int
    metric: Metric = EUCLIDEAN

    def __post_init__(self):
        if not self.max_epsilon > 0:
            raise InvalidParameter("max_epsilon", "has to be positive")
        if self.min_points < 1:
            raise InvalidParameter("min_points", "has to be at least 1")

    def core_distances(self, p: DataFrame) -> DataFrame:
        """(id, core_distance): of the (min_points - 1)-th nearest other within max_epsilon, infinite if there is none."""
        k = self.min_points - 1
        if k == 0:
            return p.select("id", F.lit(0.0).alias("core_distance"))
        kth = knn_join(p, k, self.metric).where((F.col("rank") == k) & (F.col("distance") <= self.max_epsilon))
        return p.select("id").join(kth.select(F.col("i").alias("id"), "distance"), "id", "left").select("id", F.coalesce("distance", F.lit(float("inf"))).alias("core_distance"))

    def steps(self, p: DataFrame, n: int, d: int) -> DataFrame:
        """(i, j, distance), i < j: all pairs within max_epsilon where these can't be more than the walk holds, else those that can decide a step."""
        if n * (n - 1) <= WALK or self.metric.block is None:
            return range_join(p, self.max_epsilon, self.metric, dimensions=d)
        pruned = pairs.pruning(p, self.max_epsilon, self.metric, dimensions=d)
        if pruned is not None and 2 * pruned.count() <= WALK:
            return pruned
        return deciding(p, self.core_distances(p).select("id", F.col("core_distance").alias("core")), d, self.max_epsilon, self.metric)

    def fit(self, p: DataFrame) -> DataFrame:
        """(pos, id, reachability, core_distance); undefined ones are infinite."""
        shape = validated(p)
        edges = stage(both_ways(self.steps(p, shape.n, shape.d)), "optics-edges")
        if edges.count() > WALK:
            raise InvalidParameter("max_epsilon", f"gives more than {WALK} pairs that may decide a step, which one task would have to hold")
        every = p.select(F.col("id").alias("i"), F.lit(None).cast("long").alias("j"), F.lit(None).cast("double").alias("distance"))
        min_points = self.min_points

        def run(t):
            ids = np.sort(t.filter(pa.compute.is_null(t["j"]))["i"].to_numpy())
            t = t.filter(pa.compute.is_valid(t["j"]))
            rows = walk(ids, t["i"].to_numpy(), t["j"].to_numpy(), t["distance"].to_numpy(), min_points)
            i, r, c = zip(*rows, strict=True)
            return pa.table({"pos": pa.array(np.arange(len(rows))), "id": pa.array(i, pa.int64()), "reachability": pa.array(r, pa.float64()), "core_distance": pa.array(c, pa.float64())})

        return edges.unionByName(every).groupBy(F.lit("all")).applyInArrow(lambda t: run(t), ORDERING)


def extract_clusters(ordering: DataFrame, epsilon: float, by: Column | None = None) -> DataFrame:
    """(pos, id, label): clusters of an ordering cut at epsilon; a running count of starts.

    ``by`` splits independent orderings; without it there is one, which is scanned over ranges.
    """
    start = (F.col("reachability") > epsilon) & (F.col("core_distance") <= epsilon)
    x = ordering if by is not None else _in_ranges(ordering)
    x = label_of(x, by, start)
    label = F.col("count") - 1
    return x.select("pos", "id", F.when(start, label).when(F.col("reachability") <= epsilon, F.greatest(label, F.lit(0).cast("long"))).otherwise(F.lit(-1).cast("long")).alias("label"))


def extract_xi(ordering: DataFrame, xi: float, by: Column | None = None) -> DataFrame:
    """(pos, id, label): valleys that reachability falls into by a factor 1 - xi and leaves by its inverse.

    An infinite reachability closes; after one, the next point opens a cluster in any case. ``by`` as in ``extract_clusters``.
    """
    if not 0 < xi < 1:
        raise InvalidParameter("xi", "has to be between 0 and 1")
    f = 1 - xi
    by_pos = _windows(by).orderBy("pos")
    now, before, infinite = F.col("reachability"), F.col("before"), F.lit(float("inf"))
    x = ordering if by is not None else _in_ranges(ordering)
    x = x.withColumn("before", F.lag("reachability").over(by_pos))
    if by is None:  # the first of a range comes after the last of the one before
        last = {r[PART]: r["v"] for r in x.groupBy(PART).agg(F.max_by("reachability", "pos").alias("v")).collect()}  # one row a part
        x = with_carry(x, so_far(last, lambda a, b: b, None), "carried", "double").withColumn("before", F.coalesce("before", "carried")).drop("carried")
    event = F.when(before.isNull(), "out").when(now == infinite, "out").when(before == infinite, "new").when(now < before * f, "in").when(now > before / f, "out")
    x = x.withColumn("event", event)
    x = x.withColumn("state", F.last("event", ignorenulls=True).over(by_pos.rowsBetween(Window.unboundedPreceding, 0)))
    x = x.withColumn("previous", F.lag("state").over(by_pos))
    if by is None:
        last = {r[PART]: r["v"] for r in x.groupBy(PART).agg(F.max_by("event", F.when(F.col("event").isNotNull(), F.col("pos"))).alias("v")).collect()}  # one row a part
        x = with_carry(x, so_far(last, lambda a, b: a if b is None else b, None), "carried", "string")
        x = x.withColumn("state", F.coalesce("state", "carried")).withColumn("previous", F.coalesce("previous", "carried")).drop("carried")
    opens = F.coalesce((F.col("event") == "new") | ((F.col("event") == "in") & (F.col("previous") == "out")), F.lit(False))
    x = label_of(x, by, opens)
    return x.select("pos", "id", F.when(F.col("state") != "out", F.col("count") - 1).otherwise(F.lit(-1).cast("long")).alias("label"))


def _in_ranges(ordering: DataFrame) -> DataFrame:
    return stage(ranged(ordering, [F.col("pos")], partitions(ordering.sparkSession)), "optics-ranges")


def _windows(by: Column | None):
    return Window.partitionBy(by if by is not None else F.col(PART))


def label_of(x: DataFrame, by: Column | None, starts: Column) -> DataFrame:
    """x with count: how many rows up to each one start a cluster."""
    w = _windows(by).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    x = x.withColumn("count", F.sum(F.coalesce(starts, F.lit(False)).cast("long")).over(w))
    if by is not None:
        return x
    each = {r[PART]: r["v"] for r in x.groupBy(PART).agg(F.max("count").alias("v")).collect()}  # one row a part
    return with_carry(x, so_far(each, lambda a, b: a + b, 0), "carried", "long").withColumn("count", F.col("count") + F.col("carried")).drop("carried")
