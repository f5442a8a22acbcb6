"""Ranks, running aggregates and frames over keys that cover many parts, against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from trailmark.operators.ranges import deal, frame, numbered, running, with_halo

SCHEMA = "k long, o long, v long"


def rows_of(kind):
    rng = random.Random(7)
    if kind == "hot":
        return [(1 if rng.random() < 0.9 else rng.choice([None, 2, 3]), i, rng.randrange(1000)) for i in range(3000)]
    if kind == "many":
        return [(rng.randrange(400), i, rng.randrange(1000)) for i in range(1500)]
    return [(rng.choice([None, 1, 2]), i if i % 5 else None, i) for i in range(40)]


@pytest.mark.parametrize("kind", ["hot", "many", "few"])
def test_against_loops(spark, kind):
    rows = rows_of(kind)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        d = deal(spark.createDataFrame(rows, SCHEMA), ["k"], ["o", "v"])
        place = {(r.k, r.o, r.v): r["_place"] for r in numbered(d).collect()}
        sums = {(r.k, r.o, r.v): (r.s, r.x, r.m) for r in running(d, {"s": ("sum", "v"), "x": ("bit_xor", "v"), "m": ("max", F.col("v") % 10)}).collect()}
        rest = {(r.k, r.o, r.v): r.s for r in running(d, {"s": ("sum", "v")}, reverse=True).collect()}
        lagged = with_halo(d, 30).withColumns({"before": F.lag("v", 30).over(frame(d)), "some": F.sum("v").over(frame(d).rowsBetween(-29, 0))}).where("not _halo")
        frames = {(r.k, r.o, r.v): (r.before, r.some) for r in lagged.collect()}
        if kind == "hot":
            sizes = [r["count"] for r in d.rows.groupBy("_part").count().collect()]
            assert len(sizes) >= 12 and max(sizes) < len(rows) / 6
            assert max(r["count"] for r in with_halo(d, 30).groupBy("k", "_part").count().collect()) < len(rows) / 6
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert len(place) == len(sums) == len(frames) == len(rows)
    first = lambda x: (x is not None, x or 0)
    for k in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == k), key=lambda r: (first(r[1]), r[2]))
        total, x, m = 0, 0, 0
        for i, r in enumerate(mine):
            total, x, m = total + r[2], x ^ r[2], max(m, r[2] % 10)
            assert place[r] == i + 1 and sums[r] == (total, x, m) and rest[r] == sum(q[2] for q in mine[i:])
            assert frames[r] == (mine[i - 30][2] if i >= 30 else None, sum(q[2] for q in mine[max(0, i - 29) : i + 1]))


def test_empty(spark):
    d = deal(spark.createDataFrame([], SCHEMA), ["k"], ["o"])
    assert numbered(d).count() == running(d, {"s": ("sum", "v")}).count() == with_halo(d, 3).count() == 0
