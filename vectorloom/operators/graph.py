"""Graph primitives over edge tables: connected components, adjacency, relabelling, contraction."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.staging import stage, unstage
from .pairs import TILE, groups_for, in_groups


#: Edges up to which components are found in one task, by disjoint sets.
ONE_TASK = 200_000
#: Neighbourhoods are compared as bits where there are more edges than that, and than a vertex pair in so many; bytes of bits in a group of rows.
BITS_EDGES, BITS_SHARE, BITS_BYTES = 200_000, 3200, 200_000_000


def connected_components(edges: DataFrame, src: str = "i", dst: str = "j", one_task: int = ONE_TASK) -> DataFrame:
    """(id, component) of every vertex that has an edge; a component is named by its smallest id.

    Alternates two contractions, each a grouped minimum and a join: every vertex passes its larger
    neighbours to the smallest vertex it knows, then its smaller ones. The number of rounds grows
    with the logarithm of the longest path. Each round's edges are written to the shared folder, so
    that no lineage piles up and a lost executor costs one round. Self-loops keep their vertex. At most
    ``one_task`` distinct edges go through one task instead, in a single pass.
    """
    i, j = F.col(src).cast("long"), F.col(dst).cast("long")
    pairs = edges.select(F.least(i, j).alias("a"), F.greatest(i, j).alias("b")).dropna()
    loops = pairs.where("a = b").select(F.col("a").alias("id")).distinct()
    now = stage(pairs.where("a < b").distinct(), "cc")
    if one_task and now.count() <= one_task:
        named = now.groupBy(F.lit("all")).applyInArrow(lambda t: _disjoint_sets(t), "id long, component long")
        return named.unionAll(loops.join(named.select("id"), "id", "left_anti").select("id", F.col("id").alias("component")))
    before = None
    while True:
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("m").alias("a"), F.col("v").alias("b")).where("a < b").distinct()
        down = large.select(F.col("b").alias("u"), F.col("a").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        met = down.join(least, "u")
        small = met.select(F.col("m").alias("a"), F.col("v").alias("b")).unionAll(met.select(F.col("m").alias("a"), F.col("u").alias("b"))).where("a < b").distinct()
        after = stage(small, "cc")
        unstage(now)
        now = after
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == before:
            break
        before = mark
    named = now.select(F.col("b").alias("id"), F.col("a").alias("component")).unionAll(now.select(F.col("a").alias("id"), F.col("a").alias("component")).distinct())
    return named.unionAll(loops.join(named.select("id"), "id", "left_anti").select("id", F.col("id").alias("component")))


def _disjoint_sets(t):
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while parent[root] != root:
            root = parent[root]
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    for a, b in zip(t["a"].to_pylist(), t["b"].to_pylist(), strict=True):
        parent.setdefault(a, a)
        parent.setdefault(b, b)
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return pa.table({"id": pa.array(list(parent), pa.int64()), "component": pa.array([find(x) for x in parent], pa.int64())})


def ranked(rows: DataFrame, *order: str) -> DataFrame:
    """The rows with rank, from 0 in an order: by range, each range's rows after those of the ranges before it.

    The ranges are read twice, so they are written first: made again they might be cut elsewhere.
    """
    cut = stage(rows.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), "ranks")
    before = cut.groupBy("__part").count().withColumn("before", F.coalesce(F.sum("count").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    within = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    return cut.withColumn("within", within).join(F.broadcast(before.select("__part", "before")), "__part").select(*rows.columns, (F.col("within") + F.col("before") - 1).cast("long").alias("rank"))


def rank_components(components: DataFrame) -> DataFrame:
    """(component, label): ranks from 0 by ascending component."""
    return ranked(components.select("component").distinct(), "component").withColumnRenamed("rank", "label")


def relabel(labels: DataFrame) -> DataFrame:
    """(id, label) with labels counted from 0 in order of their smallest id."""
    first = labels.groupBy("label").agg(F.min("id").alias("component"))
    ranks = rank_components(first).withColumnRenamed("label", "new")
    return labels.join(first.join(ranks, "component").select("label", "new"), "label").select("id", F.col("new").alias("label"))


def adjacency(edges: DataFrame) -> DataFrame:
    """Signed edges from either end."""
    return edges.select("i", "j", "weight").unionAll(edges.select(F.col("j").alias("i"), F.col("i").alias("j"), "weight"))


def across(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Edges with the labels of both ends: i, j, weight, a, b."""
    return edges.join(labels.select(F.col("id").alias("i"), F.col("label").alias("a")), "i").join(labels.select(F.col("id").alias("j"), F.col("label").alias("b")), "j").select("i", "j", "weight", "a", "b")


def contract(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Summed weights between different labels: i < j."""
    a, b = F.col("a"), F.col("b")
    return across(edges, labels).where(a != b).groupBy(F.least(a, b).alias("i"), F.greatest(a, b).alias("j")).agg(F.sum("weight").alias("weight"))


def disagreement(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """(cost): weights of positive edges that are cut and, without their sign, of negative ones that aren't."""
    bad = ((F.col("weight") > 0) & (F.col("a") != F.col("b"))) | ((F.col("weight") < 0) & (F.col("a") == F.col("b")))
    return across(edges, labels).agg(F.coalesce(F.sum(F.when(bad, F.abs("weight"))), F.lit(0.0)).alias("cost"))


def jaccard_links(edges: DataFrame, least: float = 0.5) -> DataFrame:
    """Positive edges (i < j) whose ends' open positive neighbourhoods overlap enough; parallel edges count each.

    What two ends have in common are the triangles over their edge, and their loops. Edges are directed from the end with fewer
    neighbours to the one with more (ties by id), so a vertex has at most the square root of twice the edges
    going out, and each triangle is found once, from its least end: a hub of many leaves costs no pairs of leaves.
    Where a simple graph is so dense that triangles would be many more than words of bits, ``_overlaps_by_bits`` finds the same.
    """
    ends = stage(adjacency(edges.where("weight > 0")).groupBy("i", "j").agg(F.count(F.lit(1)).alias("m")), "jaccard-ends")
    degree = ends.groupBy(F.col("i").alias("v")).agg(F.sum("m").alias("d"), F.count_if(F.col("i") != F.col("j")).alias("n"), F.max(F.when(F.col("i") == F.col("j"), F.col("m"))).alias("loops"))
    shape = degree.agg(F.count(F.lit(1)).alias("n"), F.sum("n").alias("ways"), F.count("loops").alias("loops"), F.sum("d").alias("all")).first()
    n, ways = shape["n"], shape["ways"] or 0
    if ways > 2 * BITS_EDGES and ways * BITS_SHARE > 2 * n * n and not shape["loops"] and shape["all"] == ways:
        return _overlaps_by_bits(ends, n, least)
    of = lambda end: degree.select(F.col("v").alias(end), *[F.col(c).alias(f"{c}_{end}") for c in ("d", "n", "loops")])
    pairs = stage(ends.where("i < j").join(of("i"), "i").join(of("j"), "j"), "jaccard-pairs")
    up = F.struct("n_i", "i") < F.struct("n_j", "j")
    low = pairs.select(F.when(up, F.col("i")).otherwise(F.col("j")).alias("a"), F.when(up, F.col("j")).otherwise(F.col("i")).alias("b"), F.when(up, F.col("n_j")).otherwise(F.col("n_i")).alias("n_b"), "m")
    one = low.select("a", "b", "n_b", F.col("m").alias("ab"))
    two = low.select("a", F.col("b").alias("c"), F.col("n_b").alias("n_c"), F.col("m").alias("ac"))
    wedges = one.join(two, "a").where(F.struct("n_b", "b") < F.struct("n_c", "c"))
    triangles = wedges.join(low.select(F.col("a").alias("b"), F.col("b").alias("c"), F.col("m").alias("bc")), ["b", "c"])
    edge = lambda x, y, both: F.struct(F.least(x, y).alias("i"), F.greatest(x, y).alias("j"), both.alias("both"))
    shared = triangles.select(F.explode(F.array(edge("a", "b", F.least("ac", "bc")), edge("a", "c", F.least("ab", "bc")), edge("b", "c", F.least("ab", "ac")))).alias("x")).select("x.*")
    common = shared.groupBy("i", "j").agg(F.sum("both").alias("both"))
    loops = F.least("m", F.coalesce("loops_i", F.lit(0))) + F.least("m", F.coalesce("loops_j", F.lit(0)))
    both = F.coalesce("both", F.lit(0)) + loops
    sized = pairs.join(common, ["i", "j"], "left")
    return sized.withColumn("jaccard", both / (F.col("d_i") + F.col("d_j") - both)).where(F.col("jaccard") >= least).select("i", "j", "jaccard")


def _bits(lengths: np.ndarray, values: np.ndarray, words: int) -> np.ndarray:
    """A row of words for each list of places, with the bits at these places set."""
    out, ends = np.empty((len(lengths), words), np.uint64), np.append(0, np.cumsum(lengths))
    for x in range(0, len(lengths), TILE):
        part = lengths[x : x + TILE]
        flags = np.zeros((len(part), words * 64), bool)
        flags[np.repeat(np.arange(len(part)), part), values[ends[x] : ends[x + len(part)]]] = True
        out[x : x + TILE] = np.packbits(flags, axis=1).view(np.uint64)
    return out


def _overlaps_by_bits(ends: DataFrame, n: int, least: float) -> DataFrame:
    """``jaccard_links`` of a simple graph's edges from either end, over n vertices: each pair of groups of vertices is one task.

    A task holds its vertices' neighbours as bits; the edges between its groups are in these too, so no table of wedges comes to be.
    """
    place = ranked(ends.select(F.col("i").alias("v")).distinct(), "v")
    at = lambda end: place.select(F.col("v").alias(end), F.col("rank").cast("int").alias(f"at_{end}"))
    lists = ends.join(at("j"), "j").groupBy("i").agg(F.collect_list("at_j").alias("near"))
    lists = stage(lists.join(at("i"), "i").select(F.col("i").alias("id"), F.col("at_i").alias("at"), "near"), "jaccard-lists")
    words = -(-n // 64)
    groups = max(groups_for(n, 1, ends.sparkSession.sparkContext.defaultParallelism, TILE), -(-n * words * 8 // BITS_BYTES))

    def run(left: pa.Table, right: pa.Table, same: bool) -> Iterator[dict[str, np.ndarray]]:
        if not left.num_rows or not right.num_rows:
            return
        sides = []
        for t in (left, right):
            near = t["near"].combine_chunks()
            lengths, values = near.value_lengths().to_numpy(zero_copy_only=False), near.flatten().to_numpy()
            sides.append((t["id"].to_numpy(), lengths, values, _bits(lengths, values, words)))
        (a, n_a, values, one), (b, n_b, _, two) = sides
        here = np.full(n, -1)
        here[right["at"].to_numpy()] = np.arange(len(b))
        r, c = np.repeat(np.arange(len(a)), n_a), here[values]
        met = (c >= 0) & ((a[r] < b[c]) if same else True)
        r, c = r[met], c[met]
        step = max(1, 2_000_000 // words)
        for x in range(0, len(r), step):
            u, v = r[x : x + step], c[x : x + step]
            both = np.bitwise_count(one[u] & two[v]).sum(1, dtype=np.int64)
            jaccard = both / (n_a[u].astype(np.int64) + n_b[v] - both)
            keep = jaccard >= least
            u, v = a[u[keep]], b[v[keep]]
            yield {"i": np.minimum(u, v), "j": np.maximum(u, v), "jaccard": jaccard[keep]}

    return in_groups(lists, run, "i long, j long, jaccard double", groups=groups)


__all__ = ["across", "adjacency", "connected_components", "contract", "disagreement", "jaccard_links", "rank_components", "relabel"]
