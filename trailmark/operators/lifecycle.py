"""Lives of tracks that several cameras report on, and intervals that overlap."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .folds import Rows, settled_fold
from .ranges import deal, frame, with_halo


class Lives:
    """A track's record begins when a camera first sees it; each camera that sees it is active until it reports that the track has left.

    The record is archived when no camera is active and it was not seen for ``idle`` (why: inactive), or when it was not seen for ``forced``
    whatever the cameras say (a lost report must not keep it for ever). Rows: ``kind`` seen, left, or tick, which only tells the time.
    The state is (first, last, rows, active cameras). A life that began inside a block is known from the block alone, which is the guess.
    """

    schema = "first_us long, last_us long, n long, why string, archived_us long"

    def __init__(self, idle: int, forced: int):
        self.idle, self.forced = idle, forced

    def summary(self, rows: Rows):
        return self.replay(rows, None)[1]

    def leave(self, summary, state):
        return state if summary is None else summary

    def due(self, state: tuple) -> tuple[int, str]:
        return (state[1] + self.forced, "forced") if state[3] else (state[1] + self.idle, "inactive")

    def step(self, state: tuple | None, us: int, camera, kind: str) -> tuple[tuple | None, tuple | None]:
        """The state after a row, and the life that it ends."""
        over = None
        if state is not None:
            at, why = self.due(state)
            if at <= us:
                over, state = (*state[:3], why, at), None
        if kind == "seen":
            first, _, n, active = state or (us, us, 0, [])
            state = (first, us, n + 1, sorted({*active, camera}))
        elif kind == "left" and state is not None:
            state = (*state[:3], [x for x in state[3] if x != camera])
            if not state[3] and state[1] + self.idle <= us:
                over, state = (*state[:3], "inactive", us), None
        return state, over

    def replay(self, rows: Rows, state: tuple | None) -> tuple[Rows, tuple | None]:
        out = []
        for us, camera, kind in zip(rows["us"], rows["camera_id"], rows["kind"], strict=True):
            state, over = self.step(state, us, camera, kind)
            if over:
                out.append(over)
        return {n: [x[i] for x in out] for i, n in enumerate(["first_us", "last_us", "n", "why", "archived_us"])}, state


def lives(rows: DataFrame, key: str, until: int, idle: int, forced: int) -> DataFrame:
    """(key, first_us, last_us, n, why, archived_us) of the lives that are archived by ``until``; ``rows``: key, id, us, camera_id, kind."""
    rows = rows.select(key, "id", "us", "camera_id", "kind").where(F.col("us") <= until)
    ticks = rows.select(key).distinct().select(key, F.lit(2**62).alias("id"), F.lit(until).alias("us"), F.lit(None).cast("long").alias("camera_id"), F.lit("tick").alias("kind"))
    return settled_fold(rows.unionByName(ticks), key, ["us", "id"], Lives(idle, forced))


def visits(rows: DataFrame, keys: list[str], us: str, gap_us: int) -> DataFrame:
    """(keys, begin, end) of runs of rows with less than ``gap_us`` between neighbours. A run that crosses parts is put together from its pieces.

    A key may have very many rows: beginnings are found beside neighbours, and each beginning is matched with the last row before the next one.
    """
    c = F.col
    dealt = deal(rows.select(*keys, c(us).cast("long").alias("_us")), keys, ["_us"])
    gap = with_halo(dealt, 1).withColumn("_gap", c("_us") - F.lag("_us").over(frame(dealt)))
    # Of each break: where the run before ends and the next one begins.
    gap = gap.withColumn("_before", F.lag("_us").over(frame(dealt))).where("not _halo").where(c("_gap").isNull() | (c("_gap") >= gap_us))
    breaks = deal(gap.select(*keys, c("_us").alias("begin"), c("_before").alias("_ended")), keys, ["begin"])
    last = dealt.rows.groupBy(*keys).agg(F.max("_us").alias("_last"))
    starts = with_reverse_halo(breaks, keys)
    on = [starts[k].eqNullSafe(last[k]) for k in keys]
    joined = starts.join(last, on)
    return joined.select(*[starts[k] for k in keys], "begin", F.coalesce("_end", "_last").alias("end"))


def with_reverse_halo(breaks, keys: list[str]) -> DataFrame:
    """Each break with where its run ends: the row before the next break of the key."""
    turned = deal(breaks.rows.select(*keys, "begin", "_ended", (-F.col("begin")).alias("_back")), keys, ["_back"])
    found = with_halo(turned, 1).withColumn("_end", F.lag("_ended").over(frame(turned)))
    return found.where("not _halo").select(*keys, "begin", "_end")


def overlaps(intervals: DataFrame, key: str, part: str, begin: str, end: str, width: int) -> DataFrame:
    """(key, one, other, begin, end): where intervals of one key but different parts (one < other) overlap.

    Time is cut into buckets; an interval is in each that it touches, and two meet on (key, bucket), so a key with very many is split by
    time. A pair that meets in several buckets is taken in that where the later of the two begins.
    """
    c = F.col
    spread = F.explode(F.sequence(F.floor(c(begin) / width), F.floor(c(end) / width))).alias("_bucket")
    cells = intervals.where(c(key).isNotNull() & (c(begin) <= c(end))).select(c(key).alias("_key"), c(part).alias("_part"), c(begin).alias("_begin"), c(end).alias("_end"), spread)
    a, b = cells.alias("a"), cells.alias("b")
    on = (c("a._key") == c("b._key")) & (c("a._bucket") == c("b._bucket")) & (c("a._part") < c("b._part")) & (c("a._begin") <= c("b._end")) & (c("b._begin") <= c("a._end"))
    later = F.greatest("a._begin", "b._begin")
    met = a.join(b, on).where(F.floor(later / width) == c("a._bucket"))
    return met.select(c("a._key").alias(key), c("a._part").alias("one"), c("b._part").alias("other"), later.alias("begin"), F.least("a._end", "b._end").alias("end"))
