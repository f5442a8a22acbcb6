"""A static side that is replaced while a stream runs; a register with late and lost reports."""

import random
from types import SimpleNamespace

import pandas as pd
import pytest
from pyspark.sql import functions as F

from trailmark.operators.lifecycle import Lives, lives, overlaps, visits
from trailmark.streaming.register import Register
from trailmark.streaming.reload import Versions

SCHEMA = "id long, name string"


def versions(spark, path):
    return Versions(spark, f"file://{path}", SCHEMA, lambda x: bool(x.limit(1).count()) and not x.where("id is null").limit(1).count())


def test_last_good_version_stays(spark, tmp_path):
    side = versions(spark, tmp_path / "v")
    with pytest.raises(ValueError, match="no valid version"):
        side.chosen(0)
    side.publish(spark.createDataFrame([(1, "a")], SCHEMA))
    assert side.chosen(0) == 1
    side.publish(spark.createDataFrame([], SCHEMA))
    side.publish(spark.createDataFrame([(None, "b")], SCHEMA))
    assert side.chosen(1) == 1
    side.publish(spark.createDataFrame([(1, "c")], SCHEMA))
    # A repeated batch, in a new process, keeps what it chose; the next one takes the new version.
    again = versions(spark, tmp_path / "v")
    assert [again.chosen(i) for i in (0, 1, 2)] == [1, 1, 4]


def test_lives(spark):
    rows = [
        (1, 7, 0, 1, "seen"), (2, 7, 5, 2, "seen"), (3, 7, 6, 1, "left"), (4, 7, 8, 2, "left"),  # all left: idle since 5, archived at 15
        (5, 7, 14, 1, "seen"),  # still the same life
        (6, 7, 50, 1, "seen"),  # the report that camera 1 was left is lost: forced at 14 + 30
        (7, 7, 55, 9, "left"), (8, 7, 65, 1, "left"),  # idle since 50, archived as the last camera leaves
        (9, 8, 1, 1, "left"), (10, 8, 2, 1, "seen"), (11, 8, 2, 1, "left"),
    ]
    table = spark.createDataFrame(rows, "id long, k long, us long, camera_id long, kind string")
    got = sorted(tuple(r) for r in lives(table, "k", 100, 10, 30).collect())
    assert got == [(7, 0, 14, 3, "forced", 44), (7, 50, 50, 1, "inactive", 65), (8, 2, 2, 1, "inactive", 12)]
    assert len(lives(table, "k", 43, 10, 30).collect()) == 1


class Store:
    """The state of one track and its timers; counts the calls."""

    def __init__(self):
        self.calls, self.value, self.timers = 0, None, set()

    def called(self, result=None):
        self.calls += 1
        return result

    def getValueState(self, name, schema):
        return SimpleNamespace(get=lambda: self.called(self.value), update=lambda v: self.called(setattr(self, "value", v)), clear=lambda: self.called(setattr(self, "value", None)))

    def registerTimer(self, at):
        self.called(self.timers.add(at))

    def deleteTimer(self, at):
        self.called(self.timers.remove(at))


@pytest.mark.parametrize("seed", range(5))
def test_register_reads_and_writes_a_track_once(seed):
    """Rows that come late, in batches, give the lives of the rows in order; each batch is four calls to the state at most."""
    r = random.Random(seed)
    rows = sorted((r.randrange(400) * 1000, i, r.randrange(3), r.choice(["seen", "seen", "left"])) for i in range(60))
    batches = [[] for _ in range(9)]
    for x in rows:
        batches[min(8, x[0] // 50_000 + r.randrange(2))].append(x)
    store, got, watermark = Store(), [], 0
    register = Register("k", 6_000, 15_000)
    register.init(store)

    def run(frames, calls):
        before = store.calls
        got.extend(tuple(x) for f in frames for x in f.itertuples(index=False))
        assert store.calls - before <= calls

    for batch in [*batches, []]:
        now = SimpleNamespace(getCurrentWatermarkInMs=lambda at=watermark: at)
        if batch:
            run(register.handleInputRows((7,), iter([pd.DataFrame(batch, columns=["us", "id", "camera_id", "kind"])]), now), 4)
        for at in sorted(t for t in store.timers if t <= watermark):
            run(register.handleExpiredTimer((7,), now, SimpleNamespace(getExpiryTimeInMs=lambda at=at: at)), 4)
            store.timers.discard(at)
        watermark = max([watermark, *[x[0] // 1000 - 100 for x in batch]])
    end = watermark * 1000
    ready = [x for x in rows if x[0] <= end] + [(end, 0, None, "tick")]
    want, _ = Lives(6_000, 15_000).replay({"us": [x[0] for x in ready], "camera_id": [x[2] for x in ready], "kind": [x[3] for x in ready]}, None)
    assert got == [(7, *x) for x in zip(*want.values(), strict=True)] and len(got) > 2


def test_overlaps_are_of_intervals(spark):
    # Two disjoint visits to camera 2 around one to camera 1: no conflict; a third one touches it.
    rows = [(1, 1, 100), (1, 1, 110), (1, 2, 50), (1, 2, 60), (1, 2, 150), (1, 2, 160), (1, 3, 105), (1, 3, 111), (None, 1, 5), (None, 2, 5)]
    seen = visits(spark.createDataFrame(rows, "k long, camera long, us long"), ["k", "camera"], "us", 20)
    assert sorted((r.k, r.camera, r.begin, r.end) for r in seen.where("k is not null").collect()) == [(1, 1, 100, 110), (1, 2, 50, 60), (1, 2, 150, 160), (1, 3, 105, 111)]
    for width in (1, 7, 1000):
        found = overlaps(seen, "k", "camera", "begin", "end", width)
        assert [tuple(r) for r in found.collect()] == [(1, 1, 3, 105, 110)]


def test_overlaps_against_all_pairs(spark):
    cells = spark.range(400).select((F.col("id") % 3).alias("k"), (F.col("id") % 7).alias("camera"), (F.col("id") * 37 % 1000).alias("begin"))
    cells = cells.withColumn("end", F.col("begin") + F.col("begin") % 60)
    got = sorted(tuple(r) for r in overlaps(cells, "k", "camera", "begin", "end", 25).collect())
    rows = [tuple(r) for r in cells.collect()]
    want = sorted((a[0], a[1], b[1], max(a[2], b[2]), min(a[3], b[3])) for a in rows for b in rows if a[0] == b[0] and a[1] < b[1] and a[2] <= b[3] and b[2] <= a[3])
    assert got == want
