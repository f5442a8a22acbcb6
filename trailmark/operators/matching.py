"""Similarity matching of query vectors with a gallery."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Vectors of a block of pairs; products that a task holds at once; what the order of summing may change in a product of vectors of length 1.
PAIRS, PRODUCTS, SLACK = 2_000, 1_000_000, 1e-9
#: Gallery vectors of a block, and queries of a part: what a task holds at once.
BLOCK, QUERIES = 20_000, 50_000


def best_match(queries: DataFrame, gallery: DataFrame, block: int = BLOCK, most: int = QUERIES, but_itself: bool = False) -> DataFrame:
    """(query_id, gallery_id, similarity): the gallery vector with the largest dot product; the smallest id wins ties. ``but_itself``: never one of the query's own id.

    The gallery is cut into blocks and the queries into parts of bounded size; every part visits every block, their products
    are one matrix product, and only the best of a block leaves the task. So nothing grows with gallery or queries but the
    number of tasks. Small galleries are dealt to several tasks too.
    """
    n = max(1, math.ceil(gallery.count() / block))
    parts = max(1, math.ceil(queries.count() / most), 64 // n)
    g = gallery.select(F.pmod(F.xxhash64("id"), F.lit(n)).alias("block"), F.col("id").alias("gallery_id"), F.col("embedding").alias("g"))
    g = g.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias("block")
    q = queries.select(every, F.pmod(F.hash("id"), F.lit(parts)).alias("part"), F.col("id").alias("query_id"), F.col("embedding").alias("q"))

    def match(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"query_id": [], "gallery_id": [], "similarity": []})
        right = right.sort_values("gallery_id")
        m = np.stack(right["g"].to_numpy()).astype(float)
        out = []
        for low in range(0, len(left), 1000):
            part = left.iloc[low : low + 1000]
            s = np.stack(part["q"].to_numpy()).astype(float) @ m.T
            s = np.round(s, 9)
            if but_itself:
                s[part["query_id"].to_numpy()[:, None] == right["gallery_id"].to_numpy()[None, :]] = -np.inf
            at = s.argmax(1)
            out.append(pd.DataFrame({"query_id": part["query_id"].to_numpy(), "gallery_id": right["gallery_id"].to_numpy()[at], "similarity": s[np.arange(len(part)), at]}))
        return pd.concat(out)

    each = q.groupBy("block", "part").cogroup(g.groupBy("block", "part")).applyInPandas(match, "query_id long, gallery_id long, similarity double")
    each = each.where(F.col("similarity") > float("-inf"))
    best = each.groupBy("query_id").agg(F.max_by(F.struct("gallery_id", "similarity"), F.struct("similarity", -F.col("gallery_id"))).alias("b"))
    return best.select("query_id", "b.gallery_id", "b.similarity")


def near_pairs(rows: DataFrame, key: str, most: float) -> DataFrame:
    """(a, b): the ids (a < b) of the pairs of a key whose 1 - dot product is ``most`` or less. ``rows``: id, key, embedding; rows without a key or vector have no pairs.

    All pairs of a key are compared, as is asked for; its rows are dealt into blocks of about ``PAIRS``, a task holds two blocks and
    ``PRODUCTS`` products, and only pairs that are near leave it. What matrix products decide by less than ``SLACK`` is summed in order.
    """
    c = F.col
    rows = rows.where(c(key).isNotNull() & c("embedding").isNotNull()).select(c(key).alias("key"), c("id").cast("long").alias("id"), c("embedding").alias("v"))
    sizes = rows.groupBy("key").agg(F.ceil(F.count("*") / PAIRS).cast("int").alias("n"))
    dealt = rows.join(sizes, "key").withColumn("own", F.pmod(F.xxhash64("id"), c("n")).cast("int"))
    other = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), c("n") - 1)))
    met = other.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (c("own") <= c("other")).alias("left"), (c("own") >= c("other")).alias("right"), "id", "v")

    def compare(part: pd.DataFrame) -> pd.DataFrame:
        x, y = part[part["left"]], part[part["right"]]
        if x.empty or y.empty:
            return pd.DataFrame({"a": [], "b": []})
        ids, m = y["id"].to_numpy(), np.stack(y["v"].to_numpy()).astype(float)
        same, out, n = bool(part["i"].iloc[0] == part["j"].iloc[0]), [], max(1, PRODUCTS // len(y))
        for low in range(0, len(x), n):
            some, v = x["id"].to_numpy()[low : low + n], np.stack(x["v"].to_numpy()[low : low + n]).astype(float)
            far = 1 - v @ m.T
            at, to = np.nonzero((far <= most + SLACK) & ((some[:, None] < ids[None]) if same else (some[:, None] != ids[None])))
            unsure = np.flatnonzero(far[at, to] > most - SLACK)
            keep = np.ones(len(at), bool)
            if len(unsure):
                exact = np.cumsum(v[at[unsure]] * m[to[unsure]], axis=1)[:, -1]
                keep[unsure] = 1 - exact <= most
            a, b = some[at[keep]], ids[to[keep]]
            out.append(pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)}))
        return pd.concat(out)

    return met.groupBy("key", "i", "j").applyInPandas(compare, "a long, b long")
