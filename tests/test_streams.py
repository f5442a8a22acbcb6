"""Streams whose keys share a state by buckets, and rolling rates over dense times."""

import numpy as np
from pyspark.sql import functions as F

from trailmark.operators import throttle
from trailmark.plans.sequences import rolling_rate
from trailmark.session import written
from trailmark.streaming import twins


def stream(spark, rows, files=3):
    table = spark.createDataFrame(rows, "id long, user_id long, camera_id long, event_type string, status string, us long")
    for low in range(0, len(rows), -(-len(rows) // files)):  # a file for each micro-batch, in order of ids
        part = written(table.where((F.col("id") >= low) & (F.col("id") < low + -(-len(rows) // files))).coalesce(1), "part")
        part.write.mode("append").parquet(f"{stream.place}")
    return twins.observation_stream(spark, stream.place)


def fed(spark, tmp_path, rows):
    stream.place = str(tmp_path / "in")
    return stream(spark, rows)


def rows_of(n, users, r):
    return [(i, None if i % 50 == 7 else int(r.integers(0, users)), 1, "x", ["in", "IN", "out"][int(r.integers(0, 3))], i * 1000 + int(r.integers(0, 900))) for i in range(n)]



def test_guard_by_buckets(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(twins, "BUCKETS", 5)
    rows = rows_of(900, 60, np.random.default_rng(1))
    guarded = twins.transition_guard(fed(spark, tmp_path, rows))
    got = sorted(r.id for r in twins.run_to_table(guarded, str(tmp_path / "out"), str(tmp_path / "state")).collect())
    last, want = {}, []
    for i, user, *_, status, _ in rows:
        if last.get(user) != status.lower():
            want.append(i)
        last[user] = status.lower()
    assert got == want
    states = spark.read.format("statestore").load(str(tmp_path / "state"))
    assert states.count() <= 6  # five buckets and that of rows without a user, not sixty keys


def test_first_within_by_buckets(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(twins, "BUCKETS", 5)
    rows = rows_of(900, 60, np.random.default_rng(2))
    keyed = fed(spark, tmp_path, rows).withColumn("key", F.col("user_id").cast("string"))
    kept = twins.first_within(keyed, "key", 100_000)
    got = sorted(r.id for r in twins.run_to_table(kept, str(tmp_path / "out"), str(tmp_path / "state")).collect())
    last, want = {}, []
    for i, user, *_, us in rows:
        if user is None or user not in last or us - last[user] >= 100_000:
            want.append(i)
            last[user] = us
    assert got == want
    assert spark.read.format("statestore").load(str(tmp_path / "state")).count() <= 5


def test_throttle_by_buckets(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(twins, "BUCKETS", 5)
    rows = rows_of(600, 40, np.random.default_rng(3))
    kept = twins.greedy_throttle(fed(spark, tmp_path, rows), "user_id", 70_000)
    got = sorted((r.user_id, r.us) for r in twins.run_to_table(kept, str(tmp_path / "out"), str(tmp_path / "state")).where("user_id is not null").collect())
    table = spark.createDataFrame([(r[1], r[5]) for r in rows], "user_id long, us long")
    assert got == sorted(tuple(r) for r in throttle.greedy_throttle(table, "user_id", "us", 70_000).collect())


def test_rates_over_dense_times(spark):
    """All rows of a key within the reach, equal times, few rows, a null time: no frame of times is looked through."""
    r = np.random.default_rng(4)
    rows = [(i, int(r.integers(0, 2)), int(r.integers(0, 3000)) * (1 + 50 * (i % 3 == 0))) for i in range(4000)] + [(5000, 3, 5), (5001, 3, 5), (5002, 4, None)]
    found = rolling_rate(spark.createDataFrame(rows, "id long, camera_id long, us long"), 4000, 120)
    assert "RangeFrame, -" not in found._jdf.queryExecution().optimizedPlan().toString().replace("specifiedwindowframe(", "").replace("RangeFrame, unbounded", "")
    got = {x.id: x.fps for x in found.collect()}
    want = {5000: 0.0, 5001: 0.0, 5002: 0.0}
    for camera in (0, 1):
        own = sorted((us, i) for i, k, us in rows if k == camera)
        times = np.array([us for us, _ in own])
        for at, (us, i) in enumerate(own):
            low = np.searchsorted(times, us - 4000)
            n = min(120, int(np.searchsorted(times, us, "right") - low))
            first = max(times[low], times[at - 119]) if at >= 119 else times[low]
            want[i] = 0.0 if n < 2 or us == first else round((n - 1) / ((us - first) / 1e6), 9)
    assert all(abs(got[i] - want[i]) <= 1e-9 * max(1, want[i]) for i in want) and len(got) == len(want)
