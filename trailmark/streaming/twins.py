"""Structured Streaming forms of the stateful operators; each equals its batch form on the same rows.

Order holds where the server ids arrive in order across micro-batches, as with a source that appends.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def observation_stream(spark: SparkSession, folder: str, files_per_trigger: int = 1) -> DataFrame:
    """Appended Parquet files of observations (id, user_id, camera_id, status, us) with ``ts`` for watermarks; back-pressure by files per trigger."""
    schema = "id long, user_id long, camera_id long, event_type string, status string, us long"
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder).withColumn("ts", F.timestamp_micros("us"))


#: Groups of keys whose states are kept together: calls and states are as many, not as many as keys.
BUCKETS = 2048


def by_bucket(rows: DataFrame, key: str):
    """``rows`` grouped by buckets of the key, those without a key in bucket -1. A call then takes many keys at once; a bucket holds about keys / ``BUCKETS``."""
    return rows.withColumn("_bucket", F.when(F.col(key).isNull(), -1).otherwise(F.pmod(F.xxhash64(key), F.lit(BUCKETS))).cast("long")).groupBy("_bucket")


def known(state: GroupState) -> dict:
    """The state of a bucket: key -> value, from two arrays."""
    return dict(zip(*state.get, strict=True)) if state.exists else {}


def keys_in(bucket: tuple, part: pd.DataFrame, key: str) -> list:
    return [None] * len(part) if bucket[0] < 0 else part[key].tolist()


def transition_guard(rows: DataFrame) -> DataFrame:
    """ST1: the last recorded status of a user is state; repeats are dropped."""

    def step(bucket: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, keep = known(state), []
        part = pd.concat(batches).sort_values("id")
        for user, status in zip(keys_in(bucket, part, "user_id"), part["status"].str.lower().tolist(), strict=True):
            before = last.get(user)
            keep.append(before is None or before != status)
            last[user] = status
        state.update((list(last), list(last.values())))
        yield part.loc[keep, ["id", "user_id", "status"]]

    kept = by_bucket(rows.select("id", "user_id", "status"), "user_id")
    return kept.applyInPandasWithState(step, "id long, user_id long, status string", "users array<long>, statuses array<string>", "append", GroupStateTimeout.NoTimeout)


def greedy_throttle(rows: DataFrame, key: str, cooldown_us: int) -> DataFrame:
    """ST3, ST4: the time of the last emitted row is state."""

    def step(bucket: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, out = known(state), []
        part = pd.concat(batches).sort_values("us")
        for k, us in zip(keys_in(bucket, part, key), part["us"].tolist(), strict=True):
            before = last.get(k)
            if before is None or us - before >= cooldown_us:
                out.append((k, us))
                last[k] = us
        state.update((list(last), list(last.values())))
        yield pd.DataFrame(out, columns=[key, "us"])

    kept = by_bucket(rows.select(key, "us"), key)
    return kept.applyInPandasWithState(step, f"{key} long, us long", "keys array<long>, times array<long>", "append", GroupStateTimeout.NoTimeout)


def send_once(rows: DataFrame, keys: list[str], unless_null: str, within: str = "24 hours") -> DataFrame:
    """ST2, ST6: first of each key within the watermark's delay, which bounds the state; keyless rows pass."""
    keyed = rows.where(F.col(unless_null).isNotNull()).withWatermark("ts", within).dropDuplicatesWithinWatermark(keys)
    return keyed.unionByName(rows.where(F.col(unless_null).isNull()))


def first_within(rows: DataFrame, key: str, ttl_us: int) -> DataFrame:
    """ST6 with its rule: (id, key, us) of rows whose key passed none in the ``ttl_us`` before; a repeat does not renew the key, and a row without a key always passes.

    The time of the key's last row that passed is state, and is dropped when the watermark says that it has expired.
    """

    def step(bucket: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:  # the last key of the bucket has expired
            state.remove()
            return
        now = state.getCurrentWatermarkMs()
        last = {k: us for k, us in known(state).items() if (us + ttl_us) // 1000 + 1 > now}
        out = []
        part = pd.concat(batches).sort_values(["us", "id"])
        for k, us, i in zip(part[key].tolist(), part["us"].tolist(), part["id"].tolist(), strict=True):
            before = last.get(k)
            if before is None or us - before >= ttl_us:
                out.append((i, k, us))
                last[k] = us
        state.update((list(last), list(last.values())))
        state.setTimeoutTimestamp(max((max(last.values()) + ttl_us) // 1000 + 1, now + 1))
        yield pd.DataFrame(out, columns=["id", key, "us"])

    keyed = by_bucket(rows.where(F.col(key).isNotNull()).withWatermark("ts", "1 second").select("id", key, "us", "ts"), key)
    kept = keyed.applyInPandasWithState(step, f"id long, {key} string, us long", "keys array<string>, times array<long>", "append", GroupStateTimeout.EventTimeTimeout)
    return kept.unionByName(rows.where(F.col(key).isNull()).select("id", key, "us"))


def lifecycles(rows: DataFrame, gap: str = "10 minutes") -> DataFrame:
    """ST10: a session window per track; it is emitted when the watermark passes its end."""
    g = rows.withWatermark("ts", "1 second").groupBy("user_id", F.session_window("ts", gap).alias("w"))
    return g.agg(F.count("*").alias("n"), F.min("us").alias("first_us"), F.max("us").alias("last_us")).drop("w")


def consume(rows: DataFrame, handled: str, dead: str, checkpoint: str):
    """ST7: splits rows with an ``error_type`` (null: fine) into handled rows and dead letters, two tables per micro-batch; batch ids make repeats harmless."""

    def split(batch: DataFrame, batch_id: int) -> None:
        batch = batch.withColumn("batch_id", F.lit(batch_id))
        batch.where("error_type is null").drop("error_type", "raw").write.mode("overwrite").parquet(f"{handled}/batch={batch_id}")
        batch.where("error_type is not null").write.mode("overwrite").parquet(f"{dead}/batch={batch_id}")

    return rows.writeStream.foreachBatch(split).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_to_table(rows: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Runs a stream over all that is there and returns what it wrote."""
    query = rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    if query.exception():
        raise query.exception()
    return rows.sparkSession.read.schema(rows.schema).parquet(path)
