"""Decayed summaries of long streams, made in parts and merged.

A micro-cluster's features are sums over its points, each weighed by 2 to the power of -decay times its
age, so they add up whatever the points' order, and a common factor takes them to a later time. One stream
is cut into ranges of time (``plans.ranges``): each part takes its points in order, one at a time, to the nearest
micro-cluster whose radius, with the point, stays within epsilon, else to a new one, counting time from its
own start; once the parts' lengths are known, their times are shifted. Then ``FAN`` parts in a row are merged at a
time, until one is left: a later part's micro-clusters join the nearest of the earlier ones with which
their radius stays within epsilon. So a single stream is no task of its own, and what meets at last are its
micro-clusters, which cover the space that its points lie in and don't grow with their number. Sums are the same in
any order of merging; which micro-clusters are joined follows the order of time.

The sequential fold drops light micro-clusters as it goes; here all are kept until the merge is done, and
are told apart by their weight then: potential ones, and outliers above the floor of their age.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..errors import DimensionMismatch, NonFinite
from ..functions import vectors as V
from ..operators.pairs import matrix
from ..plans.ranges import PART, carried, ranged
from ..plans.staging import partitions, stage, unstage
from .denstream import DenStreamParams

#: Parts merged at a time.
FAN = 8
SUMS = "n long, ls array<double>, ss array<double>, weight double, born long"
PARTIAL = f"{PART} int, tenant long, points long, {SUMS}"
MERGED = f"tenant long, slot int, now long, {SUMS}"


class Sums:
    """Micro-clusters of one stream, as rows of arrays: n, ls, ss, weight at their time, time, and when they began."""

    def __init__(self, d: int):
        self.size, self.d = 0, d
        self.n, self.weight, self.time, self.born = (np.zeros(4, t) for t in (np.int64, float, np.int64, np.int64))
        self.ls, self.ss = np.zeros((4, d)), np.zeros((4, d))

    def add(self, n: int, ls: np.ndarray, ss: np.ndarray, weight: float, born: int, now: int, epsilon: float, rate: float) -> None:
        """Take sums at a time that is not before the others': to the nearest micro-cluster, or as a new one."""
        if self.size:
            near = int(((self.ls[: self.size] / self.weight[: self.size, None] - ls / weight) ** 2).sum(1).argmin())
            f = 2.0 ** (-rate * (now - self.time[near]))
            w, a, b = self.weight[near] * f + weight, self.ls[near] * f + ls, self.ss[near] * f + ss
            if float(np.maximum(b / w - (a / w) ** 2, 0.0).sum()) <= epsilon * epsilon:
                self.n[near] += n
                self.weight[near], self.ls[near], self.ss[near], self.time[near] = w, a, b, now
                self.born[near] = min(self.born[near], born)
                return
        if self.size == len(self.n):
            for name in ("n", "weight", "time", "born", "ls", "ss"):
                old = getattr(self, name)
                setattr(self, name, np.concatenate([old, np.zeros_like(old)]))
        k, self.size = self.size, self.size + 1
        self.n[k], self.ls[k], self.ss[k], self.weight[k], self.born[k], self.time[k] = n, ls, ss, weight, born, now

    def at(self, now: int, rate: float) -> list[tuple]:
        """Rows (n, ls, ss, weight, born), decayed to a time."""
        f = 2.0 ** (-rate * (now - self.time[: self.size]))
        return [(int(self.n[k]), (self.ls[k] * f[k]).tolist(), (self.ss[k] * f[k]).tolist(), float(self.weight[k] * f[k]), int(self.born[k])) for k in range(self.size)]


def rows_of(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "array<double>": pa.list_(pa.float64())}
    names, types = zip(*(c.split() for c in schema.split(", ")), strict=True)
    columns = list(zip(*rows, strict=True)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, t in zip(columns, types, strict=True)], list(names))


def in_parts(points: DataFrame, params: DenStreamParams, parts: int) -> DataFrame:
    """The micro-clusters of each part of each stream, with times from the stream's start: tenant, slot (the part), now, sums."""
    epsilon, rate = params.epsilon, params.decay

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tenant, s, seen, part = None, None, 0, None
        for batch in batches:
            tenants, part = batch.column(0).to_pylist(), batch.column(2)[0].as_py() if len(batch) else part
            for key, x in zip(tenants, batch.column(1), strict=True):
                x = np.asarray(x.as_py(), np.float64)
                if s is None or key != tenant:
                    if s is not None:
                        yield rows_of([(part, tenant, seen, *r) for r in s.at(seen, rate)], PARTIAL)
                    tenant, s, seen = key, Sums(len(x)), 0
                if len(x) != s.d:
                    raise DimensionMismatch(s.d, len(x))
                if not np.isfinite(x).all():
                    raise NonFinite("a point of the stream")
                seen += 1
                s.add(1, x, x * x, 1.0, seen, seen, epsilon, rate)
        if s is not None:
            yield rows_of([(part, tenant, seen, *r) for r in s.at(seen, rate)], PARTIAL)

    given = points.select(F.col("tenant").cast("long"), F.col("seq").cast("long"), V.doubles(F.col("features")).alias("features")).where("tenant is not null and seq is not null")
    dealt = ranged(given, [F.col("tenant"), F.col("seq")], parts).select("tenant", "features", PART)
    staged = stage(dealt.mapInArrow(fold, PARTIAL), "summary-parts")
    ends = staged.groupBy(PART).agg(F.min("tenant").alias("first"), F.max(F.struct("tenant", "points")).alias("last")).collect()  # one row a part
    begun = carried([(e[PART], e["first"], e["last"]["tenant"], e["last"]["points"]) for e in ends], lambda a, b: a + b)
    before = points.sparkSession.createDataFrame([(part, tenant, points_) for part, (tenant, points_) in begun.items()], f"{PART} int, tenant long, before long")
    start = F.coalesce("before", F.lit(0).cast("long"))
    return staged.join(F.broadcast(before), [PART, "tenant"], "left").select("tenant", F.col(PART).alias("slot"), (start + F.col("points")).alias("now"), "n", "ls", "ss", "weight", (start + F.col("born")).alias("born"))


def merged(found: DataFrame, params: DenStreamParams) -> DataFrame:
    """Micro-clusters of parts put together, ``FAN`` in a row at a time: one slot for each tenant, all at the tenant's last time."""
    epsilon, rate = params.epsilon, params.decay

    def join(table: pa.Table) -> pa.Table:
        table = table.sort_by([("slot", "ascending"), ("born", "ascending"), ("weight", "descending")])
        tenant, slot, now = table["tenant"][0].as_py(), table["slot"][0].as_py(), table["now"].to_numpy()
        ls, ss = matrix(table["ls"]), matrix(table["ss"])
        s = Sums(ls.shape[1])
        for k, (n, weight, born) in enumerate(zip(table["n"].to_pylist(), table["weight"].to_pylist(), table["born"].to_pylist(), strict=True)):
            s.add(n, ls[k], ss[k], weight, born, int(now[k]), epsilon, rate)
        last = int(now.max())
        return pa.Table.from_batches([rows_of([(tenant, slot // FAN, last, *r) for r in s.at(last, rate)], MERGED)])

    while True:
        spread = found.groupBy("tenant").agg(F.min("slot").alias("low"), F.max("slot").alias("high"))
        if spread.where("low < high").isEmpty():
            return found
        group = F.floor(F.col("slot") / FAN).cast("int").alias("group")
        old, found = found, stage(found.groupBy("tenant", group).applyInArrow(lambda t: join(t), MERGED), "summary-merged")
        if hasattr(old, "_staged_at"):
            unstage(old)


def summarise(points: DataFrame, params: DenStreamParams, parts: int | None = None) -> DataFrame:
    """The micro-clusters of streams (tenant, seq, features): tenant, mc_id, n, ls, ss, weight, born, centre, radius, kind.

    Weights and sums are those of the stream's last point. kind is potential, outlier, or dropped for those
    that the floor of their age lets go. mc_id counts from 0 by when they began, then by weight.
    """
    found = merged(in_parts(points, params, parts or partitions(points.sparkSession)), params)
    mean = F.transform("ls", lambda v: v / F.col("weight"))
    spread = F.aggregate(F.zip_with(F.transform("ss", lambda v: v / F.col("weight")), "centre", lambda q, c: q - c * c), F.lit(0.0), lambda s, v: s + v)
    floor = V.outlier_floor(params.decay, params.every, F.col("now") - F.col("born"))
    kind = F.when(F.col("weight") >= params.least, "potential").when(F.col("weight") >= floor * (1 - 1e-12), "outlier").otherwise("dropped")
    number = F.row_number().over(Window.partitionBy("tenant").orderBy("born", F.desc("weight"), "ls")) - 1
    return found.withColumn("centre", mean).select("tenant", number.cast("long").alias("mc_id"), "n", "ls", "ss", "weight", "born", "centre", F.sqrt(F.greatest(spread, F.lit(0.0))).alias("radius"), kind.alias("kind"))


def potential(summary: DataFrame) -> DataFrame:
    """(tenant, mc_id, n, weight, centre, radius) of a summary's potential micro-clusters, as ``denstream.snapshot`` gives them."""
    return summary.where("kind = 'potential'").select("tenant", "mc_id", "n", "weight", "centre", "radius")
