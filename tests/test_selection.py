"""Order statistics against sorted lists."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from trailmark.operators.selection import at_ranks, nearest_rank, quantile


def groups():
    r = random.Random(2)
    return {
        1: [r.gauss(0, 1) for _ in range(500)],
        2: [7.0] * 50,
        3: [2.0**k for k in range(-60, 60, 2)],
        4: [1.5],
        5: [-1e308, 1e308, 0.0, -0.0, 5e-324],
        6: [float("inf"), float("-inf"), 1.0, 2.0, float("nan"), float("inf")],
        None: [3.0, 1.0, 2.0],
    }


@pytest.mark.parametrize("bins", [2, 1024])
def test_ranks(spark, bins):
    data = groups() if bins > 2 else {k: v for k, v in groups().items() if k in (2, 4, None)} | {1: groups()[1][:20]}
    table = spark.createDataFrame([(k, x) for k, v in data.items() for x in [*v, None]], "k long, v double")
    got = {(r.k, r.which): r.value for r in at_ranks(table, ["k"], "v", lambda n: [F.lit(0), F.floor(n / 2), n - 1], bins).collect()}
    for k, v in data.items():
        want = sorted(v, key=lambda x: (math.isnan(x), x))
        for i, rank in enumerate([0, len(v) // 2, len(v) - 1]):
            assert got[k, i] == want[rank] or (math.isnan(got[k, i]) and math.isnan(want[rank])), (k, i)


def test_quantiles(spark):
    data = {k: v for k, v in groups().items() if k not in (5, 6)}
    table = spark.createDataFrame([(k, x) for k, v in data.items() for x in v], "k long, v double")
    for r in quantile(table, ["k"], "v", 0.95, "q").collect():
        assert r.q == pytest.approx(np.quantile(data[r.k], 0.95), rel=1e-12)
    for r in nearest_rank(table, ["k"], "v", 0.95, "q").collect():
        v = sorted(data[r.k])
        assert r.q == v[min(len(v) - 1, int(0.95 * len(v)))]
    assert quantile(table.limit(0), ["k"], "v", 0.5, "q").count() == 0
