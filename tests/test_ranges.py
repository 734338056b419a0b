"""Scans over ranges against windows over the whole."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vectorloom.operators import optics
from vectorloom.plans.ranges import carried, so_far


def test_carried():
    ends = [(0, "a", "b", 2), (2, "b", "b", 5), (3, "b", "c", 1), (5, "d", "d", 4)]
    assert carried(ends, lambda a, b: a + b) == {2: ("b", 2), 3: ("b", 7)}
    assert carried([], lambda a, b: a) == {} and so_far({4: 1, 2: 3}, lambda a, b: a + b, 0) == {2: 0, 4: 3}


@pytest.mark.parametrize("extract", [lambda o, by: optics.extract_clusters(o, 0.8, by), lambda o, by: optics.extract_xi(o, 0.3, by)])
def test_one_ordering_over_ranges(spark, extract):
    r = np.random.default_rng(3)
    reach = np.where(r.random(400) < 0.06, np.inf, np.repeat(r.uniform(0.1, 2, 80), 5))
    rows = [(k * 3, k, float(v), float(c)) for k, (v, c) in enumerate(zip(reach, r.uniform(0.1, 2, 400)))]
    o = spark.createDataFrame(rows, "pos long, id long, reachability double, core_distance double")
    want = sorted(tuple(x) for x in extract(o, F.lit(1)).collect())
    found = extract(o, None)
    assert "SinglePartition" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted(tuple(x) for x in found.collect()) == want and len({x[2] for x in want}) > 5
    assert extract(o.limit(0), None).count() == 0
