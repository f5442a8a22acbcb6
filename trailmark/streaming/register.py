"""ST10 as a stream: the register of tracks that several cameras report on, with event-time timers."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from trailmark.operators.lifecycle import Lives

NAMES = ["first_us", "last_us", "n", "why", "archived_us"]


class Register(StatefulProcessor):
    """Per track: the open record, which cameras are active, the rows that the watermark has not passed yet, and the timer.

    Rows wait in state until the watermark passes them and are then taken in order of time and id, so rows that come late within the
    watermark's delay count as if they had come in order. A timer is set for the next waiting row and for the time at which the
    record is to be archived. All is one value, as each look at the state is a call to the JVM: a track is read once and written once.
    """

    STATE = "first long, last long, n long, cameras array<long>, timer long, us array<long>, id array<long>, camera array<long>, kind array<string>"

    def __init__(self, key: str, idle: int, forced: int):
        self.key, self.rule = key, Lives(idle, forced)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.track = handle.getValueState("track", self.STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = [r for part in rows for r in zip(part["us"].tolist(), part["id"].tolist(), part["camera_id"].tolist(), part["kind"].tolist(), strict=True)]
        return self.advance(key, timerValues, new)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        return self.advance(key, timerValues, [], expiredTimerInfo.getExpiryTimeInMs())

    def advance(self, key, timerValues, new: list[tuple], expired: int | None = None) -> Iterator[pd.DataFrame]:
        """Takes what the watermark has passed."""
        watermark = timerValues.getCurrentWatermarkInMs()
        now, out = watermark * 1000, []
        first, last, n, cameras, timer, *waiting = self.track.get() or (None, None, None, None, None, [], [], [], [])
        state = None if first is None else (first, last, n, list(cameras))
        rows = sorted([*zip(*waiting, strict=True), *new])
        ready = [r for r in rows if r[0] <= now]
        for us, _, camera, kind in [*ready, (now, 0, None, "tick")]:
            state, over = self.rule.step(state, us, camera, kind)
            if over:
                out.append((key[0], *over))
        rest = rows[len(ready) :]
        wanted = [r[0] for r in rest[:1]] + ([self.rule.due(state)[0]] if state else [])
        at = max(-(-min(wanted) // 1000), watermark + 1) if wanted else None
        if timer == expired:  # that one is spent, and deleted by Spark
            timer = None
        if timer is not None and timer != at:
            self.handle.deleteTimer(timer)
        if at is not None and timer != at:
            self.handle.registerTimer(at)
        if wanted:
            waiting = [list(x) for x in zip(*rest, strict=True)] or [[], [], [], []]
            self.track.update((*(state or (None, None, None, None)), at, *waiting))
        else:
            self.track.clear()
        if out:
            yield pd.DataFrame(out, columns=[self.key, *NAMES])

    def close(self) -> None:
        pass


def lives(rows: DataFrame, key: str, idle: int, forced: int, delay: str) -> DataFrame:
    """(key, first_us, last_us, n, why, archived_us) as the watermark passes the time of archiving; ``rows``: key, id, us, ts, camera_id, kind.

    The session needs the RocksDB state store (``with_timers``).
    """
    schema = f"{key} long, first_us long, last_us long, n long, why string, archived_us long"
    rows = rows.withWatermark("ts", delay).select(key, "id", "us", "ts", "camera_id", "kind")
    return rows.groupBy(key).transformWithStateInPandas(Register(key, idle, forced), schema, "Append", "EventTime")


def with_timers(spark) -> None:
    """State with timers lives in RocksDB."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def until(rows: DataFrame, delay_ms: int) -> int:
    """The final watermark of a stream over ``rows``, in microseconds."""
    return ((rows.agg(F.max("us")).first()[0] or 0) // 1000 - delay_ms) * 1000
