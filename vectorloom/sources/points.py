"""Points in and out: tables of (id LONG, features ARRAY<DOUBLE>).

Null ids are refused by ``validated``; the order of rows means nothing, the order of ids does.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import DimensionMismatch, EmptyInput, NonFinite
from ..functions import vectors as V


def points(df: DataFrame, id: str = "id", features: str = "features") -> DataFrame:
    """(id, features) of any table with a key and a numeric array."""
    return df.select(F.col(id).cast("long").alias("id"), V.doubles(F.col(features)).alias("features"))


def from_columns(df: DataFrame, id: str, *columns: str) -> DataFrame:
    """(id, features) of numeric columns."""
    return df.select(F.col(id).cast("long").alias("id"), F.array(*[F.col(c).cast("double") for c in columns]).alias("features"))


def from_rows(spark: SparkSession, rows) -> DataFrame:
    """Points of nested lists or a two-dimensional array, with their positions as ids; values pass through single precision.

    They go to Spark as one Arrow table; lists may be ragged, which ``validated`` refuses.
    """
    parts = [np.asarray(row, np.float32).astype(np.float64) for row in rows]
    ends = np.cumsum([0, *map(len, parts)]).astype(np.int32)
    features = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(parts) if parts else np.empty(0)))
    return spark.createDataFrame(pa.table({"id": pa.array(np.arange(len(parts))), "features": features}))


def from_flat(df: DataFrame, flat: str, d: int) -> DataFrame:
    """Points of one row-major array, by position; its length has to be a multiple of d."""
    n = F.size(flat) / d
    checked = df.select(F.when(F.size(flat) % d == 0, F.col(flat)).otherwise(F.raise_error(F.lit(f"length isn't a multiple of {d}"))).alias("flat"), n.cast("int").alias("n"))
    return checked.where("n > 0").select("flat", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("i")).select(F.col("i").cast("long").alias("id"), V.doubles(V.flat_row(F.col("flat"), F.col("i"), d)).alias("features"))


def from_labels(spark: SparkSession, labels) -> DataFrame:
    """(id, label) by position; every negative label is noise."""
    return spark.createDataFrame([(i, V.NOISE if v is None or v < 0 else int(v)) for i, v in enumerate(labels)], "id long, label long")


def labels_array(labelled: DataFrame) -> np.ndarray:
    """Labels by ascending id, as a local array: for results that are known to be small."""
    return labelled.select("id", "label").toPandas().sort_values("id")["label"].to_numpy(np.int64)


def centroids_array(centroids: DataFrame) -> np.ndarray:
    """Centroids by cluster, as a local array."""
    return np.stack(centroids.toPandas().sort_values("cluster")["centroid"].to_list())


@dataclass(frozen=True)
class Shape:
    n: int
    d: int


def validated(p: DataFrame) -> Shape:
    """The shape of a table of points, from one aggregate; raises on empty, ragged or non-finite data."""
    size = F.size("features")
    row = p.agg(F.count(F.lit(1)).alias("n"), F.min(size).alias("low"), F.max(size).alias("high"), F.coalesce(F.bool_and(V.finite(F.col("features")) & F.col("id").isNotNull()), F.lit(True)).alias("fine"), F.count("features").alias("there")).first()
    if not row["n"] or (row["high"] or 0) < 1:
        raise EmptyInput("no points")
    if row["low"] != row["high"]:
        raise DimensionMismatch(row["high"], row["low"])
    if not row["fine"] or row["there"] != row["n"]:
        raise NonFinite("points with nulls, NaN or infinities")
    return Shape(row["n"], row["high"])


def not_finite(p: DataFrame) -> DataFrame:
    """(id, position, value) of every value that isn't finite."""
    return p.select("id", F.posexplode("features").alias("position", "value")).where("value is null or isnan(value) or abs(value) = double('infinity')")


def read_idx(spark: SparkSession, images: str, labels: str | None = None) -> DataFrame:
    """Points of IDX image files, scaled to [0, 1], with their labels if a file of these is named.

    One file is one task's work; the format has no places to split at.
    """
    files = lambda path: spark.read.format("binaryFile").load(path)
    return idx_points(files(images), None if labels is None else files(labels))


def idx_points(images: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """What ``read_idx`` gives, of tables with the files in a binary column ``content``."""

    def images_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                magic, n, rows, columns = struct.unpack(">iiii", content[:16])
                if magic != 2051:
                    raise ValueError("not an IDX image file")
                pixels = np.frombuffer(content, np.uint8, n * rows * columns, 16).reshape(n, -1)
                for at in range(0, n, 1000):
                    yield pd.DataFrame({"id": np.arange(at, min(n, at + 1000)), "features": list(pixels[at : at + 1000] / 255.0)})

    def labels_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                magic, n = struct.unpack(">ii", content[:8])
                if magic != 2049:
                    raise ValueError("not an IDX label file")
                yield pd.DataFrame({"id": np.arange(n), "label": np.frombuffer(content, np.uint8, n, 8).astype(np.int64)})

    out = images.select("content").mapInPandas(images_of, "id long, features array<double>")
    if labels is None:
        return out
    return out.join(labels.select("content").mapInPandas(labels_of, "id long, label long"), "id")
