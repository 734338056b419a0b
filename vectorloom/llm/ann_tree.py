"""Approximate nearest neighbours: a hierarchical k-means tree searched best bin first.

The tree is fitted on a sample of the vectors, those with the smallest hash of vec_id: a twentieth of
the rows, at least ``LEAST_ROWS`` and at most ``MOST_ROWS``. Each node splits its vectors by k-means
into ``BRANCHES`` until ``LEAF_ROWS`` are left, so leaves grow in number with the table up to a few
thousand. Every row is then indexed: it falls to the leaf that it reaches by the nearest centre at each
level. A query walks the tree with a priority queue of nodes by the distance of their centres and
visits leaves in the order they come out. How many is calibrated: on sampled queries against the whole
sample, visits widen until the mean recall is ``RECALL``.

Queries travel to the leaves they visit, in blocks; rows are dealt by leaf, and a leaf of more than
``BLOCK_ROWS`` rows is split into blocks that each see its queries, so a third of all rows in one
leaf (a common vector, say) is no task of its own. Each block returns its nearest few, which are
merged by query. Distances are Euclidean on the original vectors in double precision.

Defined results: vectors that are null, all zero, or hold nulls, NaN or infinities take no part, as
query or candidate; nor do those whose length isn't the table's most frequent one, nor rows without
vec_id. Of rows that repeat a vec_id, the nearest to a query counts, once; a query that repeats asks
with the first of its vectors in order. Ties go to the smaller vec_id; fewer candidates than ``k`` are
all returned; an empty table gives no rows; further columns are ignored. Vectors of any length fit as
long as ``MOST_ROWS`` of them do on the driver.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.staging import stage

LEAST_ROWS, MOST_ROWS, SHARE = 20_000, 200_000, 20
#: Values of the sample, which bound its rows where vectors are wide; and the largest component that squares are taken of unscaled.
MOST_VALUES, LARGE = 40_000_000, 1e100
BRANCHES, LEAF_ROWS, ROUNDS = 8, 100, 12
CALIBRATION_QUERIES, RECALL = 200, 0.97
BLOCK_ROWS = 8192
FOUND = "query_id long, vec_id long, score double"


@dataclass
class Tree:
    """Nodes with their children's numbers and centres; a leaf has none, and its own number."""

    children: list[list[int]] = field(default_factory=list)
    centres: list[np.ndarray | None] = field(default_factory=list)
    leaf: list[int] = field(default_factory=list)
    leaves: int = 0
    visits: int = 1

    def order(self, query: np.ndarray, most: int) -> list[int]:
        """Leaves by best bin first, ``most`` of them."""
        queue, out = [(0.0, 0)], []
        while queue and len(out) < most:
            _, node = heapq.heappop(queue)
            if self.leaf[node] >= 0:
                out.append(self.leaf[node])
                continue
            gaps = ((self.centres[node] - query) ** 2).sum(1)
            for gap, child in zip(gaps.tolist(), self.children[node], strict=True):
                heapq.heappush(queue, (gap, child))
        return out

    def assign(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each vector."""
        out = np.empty(len(x), np.int64)
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if self.leaf[node] >= 0:
                out[rows] = self.leaf[node]
                continue
            near = nearest(x[rows], self.centres[node])
            todo += [(child, rows[near == k]) for k, child in enumerate(self.children[node]) if (near == k).any()]
        return out


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres**2).sum(1) - 2 * (x @ centres.T)).argmin(1)


def split(x: np.ndarray, branches: int, r: np.random.Generator) -> tuple[np.ndarray, np.ndarray] | None:
    """Centres and members by k-means, or None if the vectors can't be told apart."""
    distinct = np.unique(x, axis=0)
    if len(distinct) < 2:
        return None
    centres = distinct[r.choice(len(distinct), min(branches, len(distinct)), replace=False)]
    for _ in range(ROUNDS):
        near = nearest(x, centres)
        used = np.unique(near)
        centres = np.stack([x[near == k].mean(0) for k in used])
    near = nearest(x, centres)
    return (centres, near) if len(np.unique(near)) > 1 else None


def fit(x: np.ndarray, branches: int = BRANCHES, leaf_rows: int = LEAF_ROWS, seed: int = 5) -> Tree:
    """A tree over sampled vectors."""
    r, tree = np.random.default_rng(seed), Tree()

    def grow(rows: np.ndarray) -> int:
        node = len(tree.leaf)
        tree.children.append([])
        tree.centres.append(None)
        tree.leaf.append(-1)
        parts = split(x[rows], branches, r) if len(rows) > leaf_rows else None
        if parts is None:
            tree.leaf[node], tree.leaves = tree.leaves, tree.leaves + 1
        else:
            tree.centres[node] = parts[0]
            tree.children[node] = [grow(rows[parts[1] == k]) for k in range(len(parts[0]))]
        return node

    grow(np.arange(len(x)))
    return tree


def calibrate(tree: Tree, x: np.ndarray, k: int, recall: float = RECALL, queries: int = CALIBRATION_QUERIES) -> int:
    """The fewest leaf visits whose mean recall over sampled queries reaches the target."""
    if len(x) <= 1:
        return tree.leaves
    leaf = tree.assign(x)
    chosen = np.linspace(0, len(x) - 1, min(queries, len(x))).astype(int)
    found = np.zeros(tree.leaves + 1)
    for q in chosen:
        gaps = ((x - x[q]) ** 2).sum(1)
        gaps[q] = np.inf
        near = np.argpartition(gaps, min(k, len(x) - 1) - 1)[: min(k, len(x) - 1)]
        place = np.empty(tree.leaves, int)
        order = tree.order(x[q], tree.leaves)
        place[order] = np.arange(len(order))
        np.add.at(found, place[leaf[near]] + 1, 1 / len(near))
    return int(np.argmax(np.cumsum(found) / len(chosen) >= recall - 1e-9))


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v) of the rows that take part."""
    v = F.transform("embedding", lambda e: e.cast("double"))
    bad = F.exists("v", lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long"), v.alias("v")).where(F.col("vec_id").isNotNull() & (F.size("v") > 0)).where(~bad & F.exists("v", lambda e: e != 0))
    return rows


def search(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """query_id, rank, vec_id, score of each query's k nearest found; queries has (vec_id, v) as ``usable`` gives."""
    rows = usable(vectors)
    most = F.array_max(F.transform("v", lambda e: F.abs(e)))
    width = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("count"), F.max(most).alias("most")).orderBy(F.desc("count"), "d").first()
    spark = vectors.sparkSession
    if width is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows, queries = rows.where(F.size("v") == width["d"]), queries.where(F.size("v") == width["d"])
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(min(max(width["count"] // SHARE, LEAST_ROWS), MOST_ROWS, max(1, MOST_VALUES // width["d"]))).toArrow()
    # the tree is the same whatever all vectors are multiplied by, so very large ones are scaled by a power of two
    scale = 2.0 ** -math.frexp(width["most"])[1] if width["most"] > LARGE else 1.0
    x = np.array(sample["v"].combine_chunks().flatten()).reshape(-1, width["d"]) * scale
    tree = fit(x)
    tree.visits = calibrate(tree, x, k)

    def indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = matrix(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(tree.assign(v * scale)), batch.column(1)], ["vec_id", "leaf", "v"])

    def routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, v = batch.column(0).to_numpy(), matrix(batch.column(1))
            by_leaf: dict[int, list[int]] = {}
            for q in range(len(ids)):
                for leaf in tree.order(v[q] * scale, tree.visits):
                    by_leaf.setdefault(leaf, []).append(q)
            packed = [ids[at].astype("i8").tobytes() + v[at].astype("f8").tobytes() for at in by_leaf.values()]
            yield pa.RecordBatch.from_arrays([pa.array(list(by_leaf), pa.int64()), pa.array([len(at) for at in by_leaf.values()], pa.int64()), pa.array(packed, pa.binary())], ["leaf", "n", "packed"])

    index = stage(rows.mapInArrow(indexed, "vec_id long, leaf long, v array<double>"), "tree-index")  # read twice
    sizes = {r["leaf"]: -(-r["count"] // BLOCK_ROWS) for r in index.groupBy("leaf").count().collect()}  # one row a leaf
    blocks = F.coalesce(F.get(F.array(*[F.lit(sizes.get(leaf, 1)) for leaf in range(tree.leaves)]), F.col("leaf").cast("int")), F.lit(1))
    index = index.withColumn("block", F.pmod(F.xxhash64("vec_id"), blocks))
    sent = queries.mapInArrow(routed, "leaf long, n long, packed binary").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), blocks.cast("long") - 1)))

    def nearest_in_block(candidates: pa.Table, asked: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, ...]] = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
        if candidates.num_rows:
            ids, c = candidates["vec_id"].to_numpy(), matrix(candidates["v"])
            order = np.argsort(ids, kind="stable")
            ids, c = ids[order], c[order]
            scaled = c * scale
            norms = (scaled**2).sum(1)
            first = np.flatnonzero(np.diff(ids, prepend=ids[0] - 1))  # where each id begins
            for n, packed in zip(asked["n"].to_pylist(), asked["packed"].to_pylist(), strict=True):
                query_ids, q = np.frombuffer(packed, "i8", n), np.frombuffer(packed, "f8", offset=8 * n).reshape(n, -1)
                gaps = norms - 2 * ((q * scale) @ scaled.T)
                for row in range(n):
                    out.append(nearest_of(int(query_ids[row]), q[row], ids, first, c, gaps[row], k))
        a, b, s = (np.concatenate(p) for p in zip(*out, strict=True))
        return pa.Table.from_arrays([pa.array(a), pa.array(b), pa.array(s)], ["query_id", "vec_id", "score"])

    found = index.groupBy("leaf", "block").cogroup(sent.groupBy("leaf", "block")).applyInArrow(lambda c, q: nearest_in_block(c, q), FOUND)
    found = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))  # rows of one id may lie in several blocks
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest_of(query_id: int, q: np.ndarray, ids: np.ndarray, first: np.ndarray, c: np.ndarray, gaps: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """A block's k nearest ids to one query: by the quick gaps with a margin for rounding, then exactly."""
    keep = gaps.copy()
    keep[ids == query_id] = np.inf
    by_id = np.minimum.reduceat(keep, first) if len(first) < len(ids) else keep
    most = min(k, len(by_id)) - 1
    limit = np.partition(by_id, most)[most]
    near = np.flatnonzero(keep <= limit + 1e-9 * (1 + np.abs(gaps).max())) if np.isfinite(limit) else np.flatnonzero(np.isfinite(keep))
    exact = distances(c[near], q)
    order = np.lexsort((ids[near], exact))
    _, once = np.unique(ids[near][order], return_index=True)
    best = order[np.sort(once)][:k]
    return np.full(len(best), query_id, np.int64), ids[near][best].astype(np.int64), exact[best]


def distances(c: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Euclidean distances; those whose squares don't fit are taken from scaled differences."""
    with np.errstate(over="ignore", invalid="ignore"):
        apart = c - q
        out = np.sqrt((apart**2).sum(1))
        wide = ~np.isfinite(out)
        if wide.any():
            most = np.abs(apart[wide]).max(1, keepdims=True)
            out[wide] = most[:, 0] * np.sqrt(((apart[wide] / most) ** 2).sum(1))
        return np.where(np.isnan(out), np.inf, out)


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    flat = np.asarray((column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).flatten(), np.float64)
    return flat.reshape(len(column), -1)


def every_hundredth(vectors: DataFrame, k: int = 10, every: int = 100) -> DataFrame:
    """The search whose queries are the rows with a vec_id that ``every`` divides."""
    asked = usable(vectors.where(F.col("vec_id") % every == 0)).groupBy("vec_id").agg(F.min("v").alias("v"))
    return search(vectors, asked, k)
