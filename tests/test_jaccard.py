"""Overlaps of neighbourhoods against brute force, and a hub."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from vectorloom.operators import graph


def test_overlaps(spark):
    r = np.random.default_rng(2)
    rows = [(int(a), int(b), float(w)) for a, b, w in zip(r.integers(0, 25, 220), r.integers(0, 25, 220), r.choice([1.0, 1.0, -1.0], 220))]
    near = {}
    for a, b, w in rows:
        if w > 0:
            near.setdefault(a, Counter())[b] += 1
            near.setdefault(b, Counter())[a] += 1
    want = {}
    for a, b in {(min(a, b), max(a, b)) for a, b, w in rows if w > 0 and a != b}:
        both = sum((near[a] & near[b]).values())
        want[a, b] = both / (sum(near[a].values()) + sum(near[b].values()) - both)
    found = {(x["i"], x["j"]): x["jaccard"] for x in graph.jaccard_links(spark.createDataFrame(rows, "i long, j long, weight double"), 0.0).collect()}
    assert found == pytest.approx(want) and len(want) > 100


def test_a_hub_costs_no_pairs_of_leaves(spark):
    star = spark.range(1, 100_001).select(F.lit(0).cast("long").alias("i"), F.col("id").alias("j"), F.lit(1.0).alias("weight"))
    rim = star.where("j % 1000 = 1").select("j", (F.col("j") + 1).alias("k"), "weight").toDF("i", "j", "weight")
    found = graph.jaccard_links(star.unionAll(rim), 0.1).collect()
    assert len(found) == 100 and all(x["i"] % 1000 == 1 and x["jaccard"] == pytest.approx(1 / 3) for x in found)


def test_dense_neighbourhoods_are_compared_as_bits(spark, monkeypatch):
    """a dense graph's wedges, which grow with the cube of its vertices, are never a table."""
    r = np.random.default_rng(3)
    ids = np.sort(r.choice(10_000, 150, replace=False))
    rows = [(int(ids[a]), int(ids[b]), 1.0) for a in range(150) for b in range(a + 1, 150) if r.uniform() < (0.6 if a % 3 == b % 3 else 0.1)]
    edges = spark.createDataFrame(rows, "i long, j long, weight double")
    found = lambda df: sorted((x["i"], x["j"], x["jaccard"]) for x in graph.jaccard_links(df, 0.25).collect())
    want = found(edges)
    monkeypatch.setattr(graph, "BITS_EDGES", 0)
    made, bits = [], graph._overlaps_by_bits
    monkeypatch.setattr(graph, "_overlaps_by_bits", lambda *a: made.append(1) or bits(*a))
    assert found(edges) == want and made == [1] and len(want) > 100
    twice = edges.unionAll(edges.limit(5))  # parallel edges count each, which bits can't tell
    assert graph.jaccard_links(twice, 0.25).count() > 100 and made == [1]
