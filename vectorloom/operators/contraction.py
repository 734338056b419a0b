"""Folds over a tree's ascending edges in levels: light components at once, heavy edges between what they became.

A fold over ascending edges needs, at an edge, what the two components that it joins came to before. Edges up
to some weight fall into components that know nothing of each other, so each is folded in whatever task it
comes to; what is left of one is a single vertex with a bounded state (its size, and what is still open
in it), and the heavier edges go on between such vertices. A level takes half of the edges that are left, or fewer, until no
component has more than ``LEVEL``; at most ``LEVEL`` edges always fit. So no task holds more than
that in one component, whatever the tree. What a level folds is written before the next begins.

Ranks of edges by (w, u, v) number merges and clusters, so results don't hang on levels or tasks. Only the sums
of densities are added in another order than one task adds them, which tells where two sums are equal but for rounding.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field, replace
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.staging import partitions, stage, unstage
from .graph import connected_components, rank_components, ranked

#: Edges of one component that one task folds.
LEVEL = 1_000_000


def levels(tree: DataFrame, fold, schema: str, state: str, largest: int = LEVEL, cuts: int | None = None) -> list[DataFrame]:
    """What ``fold`` gives at each level, as staged tables of columns component and level's own (``schema``).

    ``fold(edges, states)`` takes Arrow tables of (component, rank, u, v, w), some components' whole, and (vertex, ``state`` columns); it returns
    ``schema``'s rows, of which those with ``left`` true are what each component is afterwards. ``cuts``, for tests, sets the number of levels.
    """
    spark = tree.sparkSession
    edges = stage(ranked(tree.select("u", "v", "w"), "w", "u", "v").select("rank", "u", "v", "w"), "fold-edges")
    total = edges.count()
    states = spark.createDataFrame([], f"vertex long, {state}")
    names = [f.name for f in states.schema.fields[1:]]
    out, done, number = [], 0, 0
    while done < total:
        number += 1
        if cuts:
            upto = max(done + 1, total * number // cuts)
        else:
            upto = done + max(min(largest, total - done), (total - done) // 2)
        while True:
            light = edges.where(F.col("rank") < upto)
            found = stage(connected_components(light, "u", "v"), "fold-components")
            inside = light.join(found.withColumnRenamed("id", "u"), "u")
            if cuts or upto - done <= largest or inside.groupBy("component").count().agg(F.max("count")).first()[0] <= largest:
                break
            unstage(found)
            upto = done + max(largest, (upto - done) // 2)
        bucket = F.pmod(F.xxhash64("component"), F.lit(max(partitions(spark), -(-(upto - done) // largest)))).alias("bucket")
        known = states.join(found.withColumnRenamed("id", "vertex"), "vertex")
        met = inside.select(bucket, "component", "rank", "u", "v", "w").groupBy("bucket").cogroup(known.select(bucket, "vertex", *names).groupBy("bucket"))
        rows = stage(met.applyInArrow(lambda e, s: fold(e, s), schema), "fold-level")
        out.append(rows)
        now = rows.where("left").select(F.col("component").alias("vertex"), *names)
        states = stage(states.join(found.select(F.col("id").alias("vertex")), "vertex", "left_anti").unionByName(now), "fold-states")
        heavy = edges.where(F.col("rank") >= upto)
        for end in ("u", "v"):
            heavy = heavy.join(found.select(F.col("id").alias(end), F.col("component").alias("into")), end, "left").withColumn(end, F.coalesce("into", end)).drop("into")
        before, edges = edges, stage(heavy.select("rank", "u", "v", "w"), "fold-edges")
        unstage(before, found)
        done = upto
    return out


def in_order(edges: pa.Table):
    """(component, rank, u, v, w) by ascending rank."""
    t = edges.sort_by("rank")
    return zip(*(t[c].to_pylist() for c in ("component", "rank", "u", "v", "w")), strict=True)


class Joined:
    """Vertices with what their components are at present."""

    def __init__(self, start, known: dict):
        self.parent: dict[int, int] = {}
        self.now: dict = dict(known)
        self.start = start

    def find(self, x: int) -> int:
        if x not in self.parent:
            self.parent[x] = x
            if x not in self.now:
                self.now[x] = self.start(x)
            return x
        root = x
        while self.parent[root] != root:
            root = self.parent[root]
        while self.parent[x] != root:
            self.parent[x], x = root, self.parent[x]
        return root

    def unite(self, a: int, b: int, into) -> None:
        if self.now[a].size < self.now[b].size:
            a, b = b, a
        self.parent[b] = a
        self.now[a] = into
        del self.now[b]


@dataclass(frozen=True)
class Node:
    node: int
    size: int


MERGES = "component long, left boolean, node long, a long, b long, w double, size long"


def merges(tree: DataFrame, largest: int = LEVEL, cuts: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(node, left, right, distance, size) as ``dendrogram`` numbers them, the merges alone; and (id, leaf) of the ends."""
    ids = tree.select(F.col("u").alias("component")).unionAll(tree.select(F.col("v").alias("component")))
    leaves = stage(rank_components(ids).select(F.col("component").alias("id"), F.col("label").alias("leaf")), "fold-leaves")
    n = leaves.count()
    named = tree.select("u", "v", "w")
    for end in ("u", "v"):
        named = named.join(leaves.withColumnRenamed("id", end), end).drop(end).withColumnRenamed("leaf", end)

    def fold(edges: pa.Table, states: pa.Table) -> pa.Table:
        known = {r["vertex"]: Node(r["node"], r["size"]) for r in states.to_pylist()}
        all_, rows, last = Joined(lambda x: Node(x, 1), known), [], {}
        for component, rank, u, v, w in in_order(edges):
            a, b = all_.find(u), all_.find(v)
            one, two = all_.now[a], all_.now[b]
            made = Node(n + rank, one.size + two.size)
            all_.unite(a, b, made)
            last[component] = len(rows)
            rows.append([component, False, made.node, min(one.node, two.node), max(one.node, two.node), w, made.size])
        for at in last.values():
            rows[at][1] = True
        columns = list(zip(*rows, strict=True)) or [()] * 7
        kinds = (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int64())
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["component", "left", "node", "a", "b", "w", "size"])

    parts = levels(named, fold, MERGES, "node long, size long", largest, cuts)
    if not parts:
        return tree.sparkSession.createDataFrame([], "node long, left long, right long, distance double, size long"), leaves
    every = reduce(DataFrame.unionAll, parts)
    return every.select("node", F.col("a").alias("left"), F.col("b").alias("right"), F.col("w").alias("distance"), "size"), leaves


@dataclass(frozen=True)
class Open:
    """A component: its size, the points not yet in any cluster, and its cluster, which isn't ended.

    Of the cluster: ``mass`` and ``count`` are the densities at which points and parts left it and how many did; ``endless`` how
    many left at no distance at all; ``parts`` the excess of what is best below it.
    """

    size: int
    members: list[int] = field(default_factory=list)
    cluster: int = -1
    mass: float = 0.0
    count: int = 0
    endless: int = 0
    parts: float = 0.0
    split: bool = False

    def take(self, size: int, density: float) -> Open:
        """With so many points that leave it at a density."""
        if math.isinf(density):
            return replace(self, endless=self.endless + size)
        return replace(self, mass=self.mass + size * density, count=self.count + size)

    def ended(self, born: float) -> tuple[float, float, bool]:
        """The excess of mass, the best excess of it or its parts, and whether it beats them."""
        own = 0.0 if math.isinf(born) else math.inf if self.endless else self.mass - self.count * born
        chosen = not self.split or own > self.parts
        return own, own if chosen else self.parts, chosen


OPEN = "size long, members array<long>, cluster long, mass double, count long, endless long, parts double, split boolean"
FIELDS = [f.split(" ")[0] for f in OPEN.split(", ")]
CLUSTERS = f"component long, left boolean, kind string, {OPEN}, point long, parent long, density double, excess double, chosen boolean"


def condensed_parts(tree: DataFrame, least: int, largest: int = LEVEL, cuts: int | None = None) -> tuple[list[DataFrame], DataFrame]:
    """Per level: rows of kind "cluster" that ended there (cluster, parent, density of its end, size, excess, chosen) and of kind
    "point" (point, cluster, density); and the clusters that no merge ended, as a table of the first kind."""

    def fold(edges: pa.Table, states: pa.Table) -> pa.Table:
        known = {r["vertex"]: Open(**{c: r[c] for c in FIELDS}) for r in states.to_pylist()}
        all_, rows, roots = Joined(lambda x: Open(1, [x]), known), [], {}

        def leave(side: Open, into: int, density: float) -> None:
            rows.extend({"kind": "point", "point": k, "cluster": into, "density": density} for k in side.members)

        for component, rank, u, v, w in in_order(edges):
            density = math.inf if w <= 0 else 1 / w
            a, b = all_.find(u), all_.find(v)
            sides = [all_.now[a], all_.now[b]]
            for k, side in enumerate(sides):
                if side.size >= least and side.cluster < 0:
                    key = 3 * rank + k
                    leave(side, key, density)
                    sides[k] = Open(side.size, [], key).take(len(side.members), density)
            size = sides[0].size + sides[1].size
            big = [s for s in sides if s.cluster >= 0]
            if len(big) == 2:
                made, best = Open(size, [], 3 * rank + 2, split=True), 0.0
                for s in big:
                    own, sub, chosen = s.ended(density)
                    rows.append({"component": component, "kind": "cluster", "cluster": s.cluster, "parent": made.cluster, "density": density, "size": s.size, "excess": own, "chosen": chosen})
                    made, best = made.take(s.size, density), best + sub
                made = replace(made, parts=best)
            elif big:
                small = next(s for s in sides if s.cluster < 0)
                leave(small, big[0].cluster, density)
                made = replace(big[0].take(len(small.members), density), size=size)
            else:
                made = Open(size, sides[0].members + sides[1].members)
            all_.unite(a, b, made)
            roots[component] = u
        for component, u in roots.items():
            now = all_.now[all_.find(u)]
            rows.append({"component": component, "left": True, "kind": "state", **{c: getattr(now, c) for c in FIELDS}})
        return pa.Table.from_pylist([{"left": False, **r} for r in rows], KIND)

    parts = levels(tree, fold, CLUSTERS, OPEN, largest, cuts)
    if not parts:
        return parts, tree.sparkSession.createDataFrame([], "cluster long, size long, excess double, chosen boolean")
    # of the last level alone whole components are left, one of a tree
    last = parts[-1].where("left and cluster >= 0")
    own = F.when(F.col("endless") > 0, F.lit(math.inf)).otherwise(F.col("mass"))
    return parts, last.select("cluster", "size", own.alias("excess"), (~F.col("split") | (own > F.col("parts"))).alias("chosen"))


KIND = pa.schema(
    [("component", pa.int64()), ("left", pa.bool_()), ("kind", pa.string()), ("size", pa.int64()), ("members", pa.list_(pa.int64())), ("cluster", pa.int64()), ("mass", pa.float64())]
    + [("count", pa.int64()), ("endless", pa.int64()), ("parts", pa.float64()), ("split", pa.bool_()), ("point", pa.int64()), ("parent", pa.int64()), ("density", pa.float64()), ("excess", pa.float64()), ("chosen", pa.bool_())]
)


def all_clusters(parts: list[DataFrame], roots: DataFrame) -> DataFrame:
    """(cluster, parent, born, size, excess), numbered in the order in which they came to be."""
    ended = [p.where("kind = 'cluster'").select("cluster", "parent", F.col("density").alias("born"), "size", "excess") for p in parts]
    whole = reduce(DataFrame.unionAll, [*ended, roots.select("cluster", F.lit(None).cast("long").alias("parent"), F.lit(0.0).alias("born"), "size", "excess")])
    numbers = stage(rank_components(whole.select(F.col("cluster").alias("component"))), "fold-numbers")
    named = whole.join(numbers.select(F.col("component").alias("cluster"), "label"), "cluster").join(numbers.select(F.col("component").alias("parent"), F.col("label").alias("above")), "parent", "left")
    return named.select(F.col("label").alias("cluster"), F.col("above").alias("parent"), "born", "size", F.col("excess").alias("stability"))


def descend(t: pa.Table) -> pa.Table:
    """The homes of one component's clusters; ``outer`` is that of a parent which a later level ended."""
    t, out = t.sort_by([("cluster", "descending")]), {}  # parents first
    for cluster, parent, chosen, outer in zip(*(t[c].to_pylist() for c in ("cluster", "parent", "chosen", "outer")), strict=True):
        home = out[parent] if parent in out else outer
        out[cluster] = home if home is not None else cluster if chosen else None
    return pa.table({"cluster": pa.array(list(out), pa.int64()), "home": pa.array(list(out.values()), pa.int64())})


def homes(parts: list[DataFrame], roots: DataFrame) -> DataFrame:
    """(cluster, home): the topmost chosen cluster that each lies in, from the last level to the first; null where none is."""
    found = [roots.select("cluster", F.when(F.col("chosen"), F.col("cluster")).alias("home"))]
    for rows in reversed(parts):
        above = reduce(DataFrame.unionAll, found).select(F.col("cluster").alias("parent"), F.col("home").alias("outer"))
        mine = rows.where("kind = 'cluster'").select("component", "cluster", "parent", "chosen").join(above, "parent", "left")
        found.append(stage(mine.groupBy("component").applyInArrow(lambda t: descend(t), "cluster long, home long"), "fold-homes"))
    return reduce(DataFrame.unionAll, found)


def density_labels(ids: DataFrame, tree: DataFrame, least: int, largest: int = LEVEL, cuts: int | None = None) -> DataFrame:
    """(id, label, outlier_score) of every id, as one task's fold gives them."""
    parts, roots = condensed_parts(tree, least, largest, cuts)
    none = ids.select("id", F.lit(-1).cast("long").alias("label"), F.lit(1.0).alias("outlier_score"))
    if not parts:
        return none
    points = reduce(DataFrame.unionAll, [p.where("kind = 'point'").select(F.col("point").alias("id"), "cluster", "density") for p in parts])
    home = stage(homes(parts, roots), "fold-homes")
    placed = stage(points.join(home, "cluster").where("home is not null").select("id", F.col("home").alias("component"), "density"), "fold-placed")
    kept = home.where("cluster = home").select(F.col("cluster").alias("component"))
    about = placed.groupBy("component").agg(F.count(F.lit(1)).alias("n"), F.max("density").alias("top")).where(F.col("n") >= least)
    named = placed.join(rank_components(kept).join(about, "component"), "component")
    endless = F.lit(math.inf)
    share = F.when(F.col("top") == endless, F.when(F.col("density") == endless, 1.0).otherwise(0.0)).when(F.col("top") > 0, F.col("density") / F.col("top")).otherwise(1.0)
    scored = named.select("id", F.col("label").alias("found"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - share)).alias("score"))
    return ids.select("id").join(scored, "id", "left").select("id", F.coalesce("found", F.lit(-1)).cast("long").alias("label"), F.coalesce("score", F.lit(1.0)).alias("outlier_score"))
