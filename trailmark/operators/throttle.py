"""Greedy throttle: a fold in order of time, split over blocks of time."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Cooldowns in a block of time. A task holds the times of one block of one key at once.
BLOCK = 256


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Rows with the bounds of their blocks (key, block), none of which is cut by the end of a batch; the rows come sorted."""
    held: list[pa.RecordBatch] = []
    last = None

    def whole() -> tuple[pa.RecordBatch, np.ndarray]:
        rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        return rows, np.append(beginnings(rows), len(rows))

    for batch in batches:
        if not len(batch):
            continue
        starts = beginnings(batch)
        if last == (batch.column("key")[0], batch.column("block")[0]):
            starts = starts[1:]
        last = (batch.column("key")[len(batch) - 1], batch.column("block")[len(batch) - 1])
        if len(starts):
            held.append(batch.slice(0, starts[-1]))
            if sum(map(len, held)):
                yield whole()
            held = [batch.slice(starts[-1])]
        else:
            held.append(batch)
    if held:
        yield whole()


def beginnings(rows: pa.RecordBatch) -> np.ndarray:
    """Places where key or block changes, the first row included."""
    new = np.ones(len(rows), bool)
    codes = [rows.column(name).dictionary_encode().indices.to_numpy(zero_copy_only=False) for name in ("key", "block")]
    new[1:] = (codes[0][1:] != codes[0][:-1]) | (codes[1][1:] != codes[1][:-1])
    return np.flatnonzero(new)


def chain(us: np.ndarray, at: int, cooldown: int) -> list[int]:
    """Places of what is emitted from place ``at`` on."""
    out = []
    while at < len(us):
        out.append(at)
        at = int(np.searchsorted(us, us[at] + cooldown))
    return out


def exits(us: np.ndarray, begin: int, cooldown: int) -> list[tuple[int, int]]:
    """What a block does to the time of the last emission: (entry, exit), for each exit the last row that leads to it as first emission.

    Only rows up to a cooldown after the block's beginning, and the next one, can be first. The rows are walked backwards once:
    where the next emission of a row leads is known by then.
    """
    end = min(len(us), int(np.searchsorted(us, begin + cooldown)) + 1)
    n, after, last = len(us), np.searchsorted(us, us + cooldown).tolist(), list(range(len(us)))
    for i in range(n - 1, -1, -1):
        if after[i] < n:
            last[i] = last[after[i]]
    final = us[last[:end]]
    keep = np.append(final[1:] != final[:-1], True)
    return list(zip(us[:end][keep].tolist(), final[keep].tolist(), strict=True))


def greedy_throttle(rows: DataFrame, key: str, us: str, cooldown_us: int, block: int = BLOCK) -> DataFrame:
    """(key, us) of what is emitted: a row passes if the last *emitted* one is at least ``cooldown_us`` before. Not a lag: a fold in order.

    Time is cut into blocks of ``block`` cooldowns, dealt to tasks by key and block, so a key with very many rows is split.
    Each block tells once which last emission follows from which first one (few rows, as chains meet); these are composed
    in order of the blocks, and with the last emission before it known each block is folded by itself. Rows without a key or
    a time never pass; equal times of a key pass once.
    """
    span = cooldown_us * block
    c = F.col
    cells = rows.where(c(key).isNotNull() & c(us).isNotNull()).select(c(key).alias("key"), F.floor(c(us) / span).alias("block"), c(us).cast("long").alias("us"))
    dealt = cells.repartition("key", "block").sortWithinPartitions("key", "block", "us")
    kind = dealt.schema["key"].dataType.simpleString()

    def summarised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(key, block, entry, leave)."""
        for got, bounds in blocks(batches):
            times, begins = got.column("us").to_numpy(), got.column("block").to_numpy() * span
            found = [(low, *x) for low, high in pairwise(bounds.tolist()) for x in exits(times[low:high], int(begins[low]), cooldown_us)]
            at, entry, leave = map(list, zip(*found, strict=True))
            some = got.take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([some.column("key"), some.column("block"), pa.array(entry, pa.int64()), pa.array(leave, pa.int64())], ["key", "block", "entry", "leave"])

    def composed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(key, block, before): the last emission before each block."""
        key_now = block_now = last = least = None
        entered = True
        for batch in batches:
            keys, places, before = [], [], []
            for k, number, entry, leave in zip(*[batch.column(i).to_pylist() for i in range(4)], strict=True):
                if k != key_now:
                    key_now, block_now, last = k, None, None
                if number != block_now:
                    block_now, entered = number, False
                    least = None if last is None else last + cooldown_us
                    keys.append(k)
                    places.append(number)
                    before.append(last)
                if not entered and (least is None or entry >= least):
                    last, entered = leave, True
            yield pa.RecordBatch.from_arrays([pa.array(keys, batch.schema.field(0).type), pa.array(places, pa.int64()), pa.array(before, pa.int64())], ["key", "block", "before"])

    def folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """What is emitted; the first row of a block holds the last emission before it."""
        for got, bounds in blocks(batches):
            times, before = got.column("us").to_numpy(), got.column("before")
            keep: list[int] = []
            for low, high in pairwise(bounds.tolist()):
                own, last = times[low + 1 : high], before[low].as_py()
                first = 0 if last is None else int(np.searchsorted(own, last + cooldown_us))
                keep += [low + 1 + i for i in chain(own, first, cooldown_us)]
            some = got.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([some.column("key"), some.column("us")], [key, us])

    steps = dealt.mapInArrow(summarised, f"key {kind}, block long, entry long, leave long")
    ordered = steps.repartition("key").sortWithinPartitions("key", "block", "entry")
    known = ordered.mapInArrow(composed, f"key {kind}, block long, before long").withColumn("us", F.lit(-(2**63)))
    ready = cells.withColumn("before", F.lit(None).cast("long")).unionByName(known)
    ready = ready.repartition("key", "block").sortWithinPartitions("key", "block", "us")
    return ready.mapInArrow(folded, f"{key} {kind}, {us} long")
