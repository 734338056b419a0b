"""Scans over a whole ordered table whose groups may be of any size.

A running sum by group needs its group's earlier rows. With a window, a group is one task, and a table
without groups is one task altogether. Here the rows are sorted over ranges, so a large group lies in
many consecutive parts; each part is scanned by itself, what the last group of each part has come to is
gathered (one row a part), and ``carried`` works out what each part's first group starts from.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PART = "part"


def ranged(df: DataFrame, by: list[Column], parts: int) -> DataFrame:
    """``df`` in ``parts`` ranges of ``by``, sorted within each, with the number of the part as column ``part``."""
    return df.repartitionByRange(parts, *by).sortWithinPartitions(*by).withColumn(PART, F.spark_partition_id())


def carried(ends: Iterable[tuple[int, Any, Any, Any]], join: Callable[[Any, Any], Any]) -> dict[int, tuple[Any, Any]]:
    """For each part whose first group began in an earlier one: the group and what it had come to there.

    ``ends`` has a row for each part: its number, its first group, its last group, and what the last
    group comes to within the part. ``join`` puts two successive results of one group together.
    """
    found: dict[int, tuple[Any, Any]] = {}
    group, came_to, begun = None, None, False
    for part, first, last, result in sorted(ends, key=lambda e: e[0]):
        if begun and first == group:
            found[part] = group, came_to
            came_to = join(came_to, result) if first == last else result
        else:
            came_to = result
        group, begun = last, True
    return found


def with_carry(df: DataFrame, values: dict[int, Any], name: str, kind: str) -> DataFrame:
    """``df`` with a column of what each part has to know of the parts before it; null where it is nothing."""
    rows = df.sparkSession.createDataFrame(list(values.items()), f"{PART} int, {name} {kind}")
    return df.join(F.broadcast(rows), PART, "left")  # one row a part


def so_far(values: dict[int, Any], join: Callable[[Any, Any], Any], start: Any) -> dict[int, Any]:
    """For each part, what the values of all earlier parts come to."""
    out = {}
    for part in sorted(values):
        out[part] = start
        start = join(start, values[part])
    return out
