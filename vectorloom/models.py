"""Fitted models in files: each a folder with a table for each DataFrame and one JSON line for the rest.

The folder is written and read through Spark, so it may lie in any store that the cluster reaches. A
metric is stored by its name; one of the caller's own has to be handed to ``load`` again.
"""

from __future__ import annotations

import json
from dataclasses import fields
from typing import Any

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from .errors import InvalidParameter
from .functions.distance import COSINE, EUCLIDEAN, INNER_PRODUCT, SQUARED_EUCLIDEAN, Metric
from .operators.constrained import ConstrainedKMeans
from .operators.correlation import CorrelationClustering, CorrelationResult
from .operators.dbscan import DBSCAN
from .operators.hierarchy import HDBSCAN, Layers, ProjectedHierarchy
from .operators.kmeans import KMeans, KMeansModel
from .operators.optics import OPTICS
from .streaming.denstream import DenStreamParams
from .streaming.minibatch import MiniBatchKMeans

KINDS = {k.__name__: k for k in (KMeans, KMeansModel, ConstrainedKMeans, DBSCAN, HDBSCAN, Layers, ProjectedHierarchy, OPTICS, CorrelationClustering, CorrelationResult, MiniBatchKMeans, DenStreamParams)}
METRICS = {m.name: m for m in (SQUARED_EUCLIDEAN, EUCLIDEAN, COSINE, INNER_PRODUCT)}


def save(model: Any, path: str, spark: SparkSession | None = None) -> None:
    """Write a model or its parameters into a new folder."""
    kind = type(model).__name__
    if kind not in KINDS:
        raise InvalidParameter("model", f"is a {kind}, which isn't one of {', '.join(KINDS)}")
    spark = spark or SparkSession.active()
    plain: dict[str, Any] = {}
    for f in fields(model):
        value = getattr(model, f.name)
        if isinstance(value, DataFrame):
            value.write.parquet(f"{path}/{f.name}")
            plain[f.name] = {"table": f.name}
        elif isinstance(value, list) and value and isinstance(value[0], DataFrame):
            for k, table in enumerate(value):
                table.write.parquet(f"{path}/{f.name}-{k}")
            plain[f.name] = {"tables": len(value)}
        elif isinstance(value, Metric):
            plain[f.name] = {"metric": value.name}
        elif isinstance(value, np.ndarray):
            plain[f.name] = {"array": value.tolist(), "kind": str(value.dtype)}
        else:
            plain[f.name] = {"value": value}
    line = json.dumps({"model": kind, "fields": plain}, default=float)
    spark.createDataFrame([(line,)], "value string").coalesce(1).write.text(f"{path}/model")


def load(spark: SparkSession, path: str, metric: Metric | None = None) -> Any:
    """The model in a folder."""
    found = json.loads(spark.read.text(f"{path}/model").first()["value"])

    def value(name: str, stored: dict[str, Any]) -> Any:
        if "table" in stored:
            return spark.read.parquet(f"{path}/{name}")
        if "tables" in stored:
            return [spark.read.parquet(f"{path}/{name}-{k}") for k in range(stored["tables"])]
        if "array" in stored:
            return np.array(stored["array"], stored["kind"])
        if "metric" in stored:
            if metric is None and stored["metric"] not in METRICS:
                raise InvalidParameter("metric", f"{stored['metric']} isn't built in and has to be handed over")
            return metric or METRICS[stored["metric"]]
        held = stored["value"]
        return tuple(map(tuple, held)) if name == "initial" else held

    return KINDS[found["model"]](**{name: value(name, stored) for name, stored in found["fields"].items()})
