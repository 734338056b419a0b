"""Mini-batch k-means over a stream, and the same fold over a table in sequence order.

The model is a few centroids with counts. Each micro-batch's points, in order of ``seq``, pull their
nearest centroid by 1 / count. Folding is sequential by definition, so a micro-batch of one model is one task; its
size is bounded by the stream's trigger options. Streams keep their models in the state store
(``learn``), a model for each key, so models are learnt next to each other and outlive a restart.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor

from ..errors import DimensionMismatch, EmptyInput, InvalidParameter, NonFinite
from ..functions.distance import SQUARED_EUCLIDEAN, Metric
from ..operators.kmeans import seed_centroids, unit_rows
from ..operators.pairs import matrix, nearest_centroid
from ..plans.staging import stage

STATE = "counts array<long>, centroids array<array<double>>, batch long"
LEARNT = f"model long, seq long, label long, state struct<{STATE.replace(' ', ':').replace(',:', ', ')}>"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def pull(centroids: np.ndarray, counts: np.ndarray, x: np.ndarray, metric: Metric) -> np.ndarray:
    """Move centroids in place by each point in turn; the label each point had."""
    labels = np.empty(len(x), np.int64)
    for row, point in enumerate(x):
        k = int(metric.block(point[None], centroids)[0].argmin())
        counts[k] += 1
        rate = 1.0 / counts[k]
        centroids[k] = (1 - rate) * centroids[k] + rate * point
        if metric.normalize_centroids:
            centroids[k : k + 1] = unit_rows(centroids[k : k + 1])
        labels[row] = k
    return labels


@dataclass
class MiniBatchKMeans:
    k: int
    metric: Metric = SQUARED_EUCLIDEAN
    seed: int = 42
    centroids: np.ndarray | None = None
    counts: np.ndarray | None = field(default=None)

    def __post_init__(self):
        if self.k < 1:
            raise InvalidParameter("k", "has to be at least 1")

    @property
    def n_clusters(self) -> int:
        return 0 if self.centroids is None else len(self.centroids)

    def partial_fit(self, batch: DataFrame) -> DataFrame:
        """(seq, label) of a batch (seq, features); the first batch also seeds the centroids."""
        if batch.isEmpty():
            raise EmptyInput("an empty batch")
        if self.centroids is None:
            points = batch.select(F.col("seq").alias("id"), "features")
            if self.k > 1 and batch.limit(self.k).count() < self.k:
                raise InvalidParameter("k", "the first batch has fewer points")
            self.centroids, self.counts = seed_centroids(points, self.k, self.metric, 2.0, self.seed), np.zeros(self.k, np.int64)
        metric, start, counted = self.metric, self.centroids.copy(), self.counts.copy()

        def fold(t):
            t = t.sort_by("seq")
            x = matrix(t["features"])
            if x.shape[1] != start.shape[1]:
                raise DimensionMismatch(start.shape[1], x.shape[1])
            if not np.isfinite(x).all():
                raise NonFinite("a point of the stream")
            c, n = start.copy(), counted.copy()
            labels = pull(c, n, x, metric)
            rows = len(labels)
            state = pa.array([None] * (rows - 1) + [np.column_stack([n, c]).ravel().tolist()], pa.list_(pa.float64()))
            return pa.table({"seq": t["seq"], "label": pa.array(labels), "state": state})

        out = stage(batch.select("seq", "features").groupBy(F.lit("all")).applyInArrow(lambda t: fold(t), "seq long, label long, state array<double>"), "minibatch")
        state = np.array(out.where("state is not null").first()["state"]).reshape(self.k, -1)
        self.counts, self.centroids = state[:, 0].astype(np.int64), state[:, 1:]
        return out.select("seq", "label")

    def predict(self, p: DataFrame) -> DataFrame:
        """p's columns and label; the model stays."""
        if self.centroids is None:
            raise EmptyInput("no batch has been seen")
        return nearest_centroid(p, self.centroids, self.metric).drop("distance")

    def start(self, stream: DataFrame, checkpoint: str, sink=None):
        """Learn from a streaming table (seq, features) with the model in the state store; ``sink(labels, number)`` gets each batch's labels.

        A stream that is started again from its checkpoint goes on with the model that lies there.
        """
        spark = stream.sparkSession
        self._take(models(spark, checkpoint))
        one = stream.select(F.lit(0).cast("long").alias("model"), "seq", "features")
        initial = None if self.centroids is None else tuple(map(tuple, self.centroids.tolist()))

        def learn_batch(batch: DataFrame, number: int) -> None:
            labels = stage(batch, "minibatch-labels")  # once: each reading would go through the state again
            self._take(labels.where("state is not null").select("state.*"))
            if sink is not None:
                sink(labels.select("seq", "label"), number)

        out = learn(one, self.k, self.metric, self.seed, initial)
        return started(spark, out.writeStream.foreachBatch(learn_batch).option("checkpointLocation", checkpoint))

    def _take(self, found: DataFrame | None) -> None:
        """The model of a state's row, if there is one."""
        row = found.first() if found is not None else None  # one model
        if row is not None:
            self.counts, self.centroids = np.array(row["counts"], np.int64), np.array(row["centroids"], np.float64)


class Learner(StatefulProcessor):
    """Each model's centroids and counts, with the number of the micro-batch that made them, in the state store.

    Spark gives a repeated micro-batch the state from before it; one whose number the state already
    has is labelled and not learnt again. Points wait in the state until there are k to seed from.
    """

    def __init__(self, k: int, metric: Metric, seed: int, initial: tuple[tuple[float, ...], ...] | None):
        self.k, self.metric, self.seed, self.initial = k, metric, seed, initial

    def init(self, handle) -> None:
        self.model = handle.getValueState("model", STATE)
        self.waiting = handle.getListState("waiting", "seq long, features array<double>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        number = int(TaskContext.get().getLocalProperty("streaming.sql.batchId") or -1)
        batch = pd.concat(list(rows))
        seq, points = batch["seq"].tolist(), [np.asarray(f, np.float64) for f in batch["features"]]
        if self.model.exists():
            counts, centroids, made = self.model.get()
            c, n = np.array([list(row) for row in centroids], np.float64), np.array(counts, np.int64)
        else:
            if self.waiting.exists():
                before = list(self.waiting.get())
                seq, points = [b[0] for b in before] + seq, [np.asarray(b[1], np.float64) for b in before] + points
            made, c, n = -1, None, np.zeros(self.k, np.int64)
        order = np.argsort(np.array(seq, np.int64), kind="stable")
        seq, points = [seq[i] for i in order], [points[i] for i in order]
        width = len(points[0]) if c is None else c.shape[1]
        if wrong := [p for p in points if len(p) != width]:
            raise DimensionMismatch(width, len(wrong[0]))
        x = np.stack(points)
        if not np.isfinite(x).all():
            raise NonFinite("a point of the stream")
        if c is None:
            if self.initial is not None:
                c = np.array(self.initial, np.float64)
            elif len(x) < self.k:
                self.waiting.put([(s, p.tolist()) for s, p in zip(seq, points, strict=True)])
                return
            else:
                c = seeded(x, self.k, self.metric, (self.seed, int(key[0] or 0)))
                self.waiting.clear()
        if c.shape[1] != width:
            raise DimensionMismatch(c.shape[1], width)
        if number >= 0 and number <= made:
            labels = self.metric.block(x, c).argmin(1)
        else:
            labels = pull(c, n, x, self.metric)
            self.model.update((n.tolist(), c.tolist(), number))
        out = pd.DataFrame({"model": [key[0]] * len(x), "seq": seq, "label": labels.tolist()})
        out["state"] = [None] * (len(x) - 1) + [{"counts": n.tolist(), "centroids": c.tolist(), "batch": number}]
        yield out

    def close(self) -> None:
        pass


def seeded(x: np.ndarray, k: int, metric: Metric, seed: tuple[int, ...]) -> np.ndarray:
    """k-means++ centroids of a first batch: each next one drawn by its distance to the nearest so far."""
    draw = np.random.default_rng([abs(s) for s in seed])
    chosen = [int(draw.integers(len(x)))]
    while len(chosen) < k:
        weight = np.maximum(metric.block(x, x[chosen]).min(1), 0.0)
        total = weight.sum()
        chosen.append(int(draw.choice(len(x), p=weight / total)) if total > 0 else int(draw.integers(len(x))))
    return x[chosen].copy()


def learn(stream: DataFrame, k: int, metric: Metric = SQUARED_EUCLIDEAN, seed: int = 42, initial: tuple[tuple[float, ...], ...] | None = None) -> DataFrame:
    """A streaming table (model, seq, features) to (model, seq, label, state): a model of k centroids for each number in ``model``.

    ``state`` (counts, centroids, batch) stands on the last row of each model in a micro-batch. Rows are learnt in
    order of seq within a micro-batch, models next to each other. Start the query by ``started``.
    """
    if k < 1:
        raise InvalidParameter("k", "has to be at least 1")
    if initial is not None and len(initial) != k:
        raise InvalidParameter("initial", "has to have k centroids")
    rows = stream.select(F.col("model").cast("long"), F.col("seq").cast("long"), F.col("features").cast("array<double>"))
    return rows.groupBy("model").transformWithStateInPandas(Learner(k, metric, seed, initial), LEARNT, "append", "none")


def started(spark: SparkSession, writer: DataStreamWriter):
    """The query of a writer, whose state lies in RocksDB as such processors ask for."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        return writer.start()
    finally:
        spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)


def models(spark: SparkSession, checkpoint: str) -> DataFrame | None:
    """(model, counts, centroids, batch) as a stream's checkpoint has them; None before its first batch."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{checkpoint}/state/0")
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return None
    return spark.read.format("statestore").option("stateVarName", "model").load(checkpoint).select("key.model", "value.*")


def predict(p: DataFrame, found: DataFrame, metric: Metric = SQUARED_EUCLIDEAN) -> DataFrame:
    """p's columns and label: the nearest centroid, ties to the first, of the model that ``p``'s column ``model`` names."""
    distances = F.transform("centroids", lambda c: metric.column(F.col("features"), c))
    near = F.array_position(distances, F.array_min(distances)) - 1
    return p.join(found.select("model", "centroids"), "model").select(*p.columns, near.alias("label"))
