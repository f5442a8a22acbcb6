"""Reuse distances: what an LRU cache of any size would do with a sequence of accesses, without running the cache.

The distance of an access is the number of different keys used since the last use of its own key; an LRU cache of ``cap`` keys holds the
key exactly if the distance is below ``cap``. With places 1, 2, ... and p(i) the place of the key's use before i (0: none),
the distance is  #{j < i: p(j) < p(i)} - p(i) , a count of earlier rows with a smaller p. That is counted over a tree of blocks of
places: inside blocks of ``base`` rows by a sorted list, and at each level above, for all rows under one parent in order of p, by a
running count for each of the ``fan`` children. Rows under a parent are dealt by ranges of p, so no task holds a parent's.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailmark.session import written

from .ranges import deal, frame, numbered, running, with_halo

#: Rows of a lowest block; children of a block.
BASE, FAN = 4096, 16


def places(rows: DataFrame, key: str, order: str) -> DataFrame:
    """(order, key, place, before): the place of each access, and that of the key's access before, 0 if there is none."""
    c = F.col
    one = rows.select(c(order), c(key), F.lit(0).alias("_all"))
    ranked = numbered(deal(one, ["_all"], [order]), "place").select(order, key, "place")
    by_key = deal(ranked, [key], ["place"])
    lagged = with_halo(by_key, 1).withColumn("before", F.coalesce(F.lag("place").over(frame(by_key)), F.lit(0))).where("not _halo")
    return lagged.select(order, key, "place", "before")


def in_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds to each row how many rows before it in its block have a smaller ``before``; blocks come whole and sorted."""
    now, seen = None, []
    for batch in batches:
        found = []
        for block, before in zip(batch.column("_block").to_pylist(), batch.column("before").to_pylist(), strict=True):
            if block != now:
                now, seen = block, []
            found.append(bisect_left(seen, before))
            insort(seen, before)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.int64())], [*batch.schema.names, "_smaller"])


def reuse_distances(rows: DataFrame, key: str, order: str, base: int = BASE, fan: int = FAN) -> DataFrame:
    """(order, key, place, distance) per access; the distance of a key's first access is null. ``order`` tells all rows apart; a null key is a key."""
    c = F.col
    known = written(places(rows, key, order).withColumn("_block", F.floor((c("place") - 1) / base)), "places")
    total = known.agg(F.max("place")).first()[0] or 0
    schema = f"{order} {known.schema[order].dataType.simpleString()}, {key} {known.schema[key].dataType.simpleString()}, place long, before long, _block long, _smaller long"
    counted = known.repartition("_block").sortWithinPartitions("_block", "place").mapInArrow(in_blocks, schema)
    level = 0
    while base * fan**level < total:
        child, parent = F.floor(c("_block") / fan**level), F.floor(c("_block") / fan ** (level + 1))
        under = counted.select(order, key, "place", "before", "_block", "_smaller", parent.alias("_parent"), (child % fan).alias("_child"))
        dealt = deal(under, ["_parent"], ["before", "place"])
        sums = running(dealt, {f"_n{k}": ("sum", F.when(c("_child") == k, 1).otherwise(0)) for k in range(fan - 1)})
        earlier = sum((F.when(c("_child") > k, c(f"_n{k}")).otherwise(0) for k in range(fan - 1)), F.lit(0))
        counted = sums.withColumn("_smaller", c("_smaller") + earlier).select(order, key, "place", "before", "_block", "_smaller")
        level += 1
    return counted.select(order, key, "place", F.when(c("before") > 0, c("_smaller") - c("before")).alias("distance"))


def lru(rows: DataFrame, key: str, order: str, cap: int, base: int = BASE, fan: int = FAN) -> DataFrame:
    """(order, key, outcome, evicts) per access to a cache of ``cap`` keys.

    ``outcome``: hit; cold, a key's first access; evicted, its entry had been pushed out. ``evicts``: the access pushes one out.
    """
    c = F.col
    found = reuse_distances(rows, key, order, base, fan).withColumn("_all", F.lit(0))
    dealt = deal(found, ["_all"], ["place"])
    new = F.when(c("distance").isNull(), 1).otherwise(0)
    seen = running(dealt, {"_keys": ("sum", new)}).withColumn("_keys", c("_keys") - new)  # different keys before
    outcome = F.when(c("distance").isNull(), "cold").when(c("distance") < cap, "hit").otherwise("evicted")
    return seen.select(order, key, outcome.alias("outcome"), ((outcome != "hit") & (c("_keys") >= cap)).alias("evicts"))
