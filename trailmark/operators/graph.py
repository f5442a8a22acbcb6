"""Connected components of links."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailmark.session import discard, written

#: Links from which on a hub may have more rows than a task should.
MANY = 200_000


def contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The links of a task as stars: each node with the smallest one that the task's links lead to."""
    root: dict = {}

    def find(x):
        while (y := root.setdefault(x, x)) != x:
            root[x] = root[y] if y in root else y
            x = root[x]
        return x

    kind = None
    for batch in batches:
        kind = batch.schema
        for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            x, y = find(x), find(y)
            root[max(x, y)] = min(x, y)
    if kind is not None:
        nodes = [x for x in root if find(x) != x]
        for low in range(0, len(nodes), 100_000):
            some = nodes[low : low + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(some, kind.field(0).type), pa.array(map(find, some), kind.field(1).type)], schema=kind)


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", contract: bool = False) -> DataFrame:
    """(node, root) for every node of ``edges``: the smallest node that its links reach.

    Alternating large-star and small-star contractions (Kiveris et al. 2014): each round is two
    grouped minimums and joins on the node, so no component is ever gathered in one task, and the
    number of rounds grows with the logarithm of the longest chain. Every round is written to the
    shared folder and replaces the one before. From ``MANY`` links on the minimums are tables of
    their own, so the joins read two shuffles and the rows of a hub are split. Loops and repeated
    links are dropped; an empty table gives an empty result. With ``contract`` the links of each task are
    contracted in it first (Python in the tasks, a task's nodes in memory), which saves rounds where linked nodes are near each other.
    """

    def star(e: DataFrame, large: bool, many: bool) -> DataFrame:
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v"))
        if large:
            both = both.union(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        low = written(low, "low") if many else low
        pairs = both.join(low, "u")
        if large:
            pairs = pairs.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        else:
            pairs = pairs.select(F.col("v").alias("a"), F.col("m").alias("b")).union(low.select(F.col("u").alias("a"), F.col("m").alias("b")))
        out = written(pairs.where("a <> b").distinct(), "links")
        if many:
            discard(low)
        return out

    pairs = edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a <> b")
    if contract:
        pairs = pairs.mapInArrow(contracted, pairs.schema)
    now = written(pairs.distinct(), "links")
    before = None
    while True:
        state = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if state["n"] == 0 or (state["n"], state["h"]) == before:
            break
        before = (state["n"], state["h"])
        large = star(now, True, state["n"] >= MANY)
        small = star(large, False, state["n"] >= MANY)
        discard(now, large)
        now = small
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
