"""Exact best match by dot product over cells of the gallery, most of which a query never visits.

Pivots cut the gallery into cells: a vector belongs to the pivot nearest to it, and a cell's radius is the largest distance of a member to
the pivot. For a query q and a member g of a cell with pivot p and radius r,  q·g = q·p + q·(g - p) <= q·p + |q| r.  Each query first visits
the cell with the largest q·p; what it finds there is its least result, and after that only cells whose bound reaches it can
hold a better one. Nothing is approximate: on vectors without clusters most cells are visited, on clustered ones few.

Pivots are means of a sample of ``SAMPLE`` gallery vectors at most, refined a few times on the driver; at most ``PIVOTS`` of them are
broadcast. Cells larger than ``BLOCK`` are dealt to several tasks, and so are the queries of a cell beyond ``QUERIES``.
"""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailmark.session import written

from .matching import BLOCK, QUERIES

#: Vectors that pivots are fitted on, pivots at most, gallery vectors for each pivot, refinements; what rounding of products may hide.
SAMPLE, PIVOTS, EACH, ROUNDS, SLACK = 20_000, 1024, 200, 4, 2e-9
#: Products that a task holds at once (8 bytes each).
PRODUCTS = 2_000_000
BEST = "query_id long, gallery_id long, similarity double"


class Match(NamedTuple):
    """``best``: (query_id, gallery_id, similarity); ``share``: products taken, by all pairs."""

    best: DataFrame
    share: float


def pivots_of(gallery: DataFrame, n: int) -> np.ndarray:
    """Means of a sample taken by hashes of the ids."""
    want = max(1, min(PIVOTS, math.ceil(n / EACH)))
    part = max(1, math.ceil(n / SAMPLE * 2))
    rows = gallery.where(F.pmod(F.xxhash64("id", F.lit("pivot")), F.lit(part)) == 0).orderBy(F.xxhash64("id")).limit(SAMPLE).select("embedding").toPandas()
    if rows.empty:
        rows = gallery.limit(want).select("embedding").toPandas()
    x = np.stack(rows["embedding"].to_numpy()).astype(float)
    p = x[np.random.default_rng(0).permutation(len(x))[:want]]
    for _ in range(ROUNDS):
        at = ((p**2).sum(1)[None] - 2 * x @ p.T).argmin(1)
        counts = np.bincount(at, minlength=len(p))
        sums = np.zeros_like(p)
        np.add.at(sums, at, x)
        p = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], p)
    return p


def best_match(queries: DataFrame, gallery: DataFrame, but_itself: bool = False) -> Match:
    """As ``matching.best_match``: products are rounded to 9 places, the smallest id wins ties; ``but_itself``: never one of the query's own id."""
    c, spark = F.col, queries.sparkSession
    n, n_queries = gallery.count(), queries.count()
    if not n or not n_queries:
        return Match(spark.createDataFrame([], BEST), 0.0)
    pivots = spark.sparkContext.broadcast(pivots_of(gallery, n))

    def placed(batches):
        p = pivots.value
        for batch in batches:
            x = np.stack(batch["g"].to_numpy()).astype(float)
            at = ((p**2).sum(1)[None] - 2 * x @ p.T).argmin(1)
            yield batch.assign(cell=at, distance=np.sqrt(((x - p[at]) ** 2).sum(1)))

    kind = gallery.schema["embedding"].dataType.simpleString()
    cells = gallery.select(c("id").cast("long").alias("gallery_id"), c("embedding").alias("g")).mapInPandas(placed, f"gallery_id long, g {kind}, cell long, distance double")
    cells = written(cells, "cells")
    found = cells.groupBy("cell").agg(F.max("distance").alias("r"), F.count("*").alias("n")).toPandas()  # a row for each pivot at most
    radius, size = np.full(len(pivots.value), -np.inf), np.zeros(len(pivots.value), np.int64)
    radius[found["cell"]], size[found["cell"]] = found["r"], found["n"]
    q = queries.select(c("id").cast("long").alias("query_id"), c("embedding").alias("q"))

    def nearest(batches):
        """The cell that each query visits first."""
        for batch in batches:
            s = np.stack(batch["q"].to_numpy()).astype(float) @ pivots.value.T
            s[:, size == 0] = -np.inf
            yield batch.assign(cell=s.argmax(1))

    first = written(q.mapInPandas(nearest, f"query_id long, q {kind}, cell long"), "first")
    low = written(matched(first, cells, size, kind, but_itself), "low")

    def others(batches):
        """The cells that can still win, block by block; not the one that was visited. A vector leaves the task once, not once for each cell."""
        for batch in batches:
            for begin in range(0, len(batch), 1000):
                part = batch.iloc[begin : begin + 1000]
                x = np.stack(part["q"].to_numpy()).astype(float)
                bound = x @ pivots.value.T + np.sqrt((x**2).sum(1))[:, None] * radius[None]
                least = part["similarity"].fillna(-np.inf).to_numpy()
                open_ = bound * (1 + 1e-12 * np.sign(bound)) >= (least - SLACK)[:, None]
                open_[:, size == 0] = False
                open_[np.arange(len(part)), part["cell"].to_numpy()] = False
                yield pd.DataFrame({"query_id": part["query_id"], "q": part["q"], "cells": [np.flatnonzero(x) for x in open_]})

    known = first.join(low.select("query_id", "similarity"), "query_id", "left")
    rest = known.mapInPandas(others, f"query_id long, q {kind}, cells array<long>")
    rest = written(rest.select("query_id", "q", F.explode("cells").alias("cell")), "open")
    visits = rest.groupBy("cell").count().unionByName(first.groupBy("cell").count()).toPandas()  # two rows for each pivot at most
    share = float((visits["count"] * size[visits["cell"]]).sum()) / (n * n_queries)
    every = low.unionByName(matched(rest, cells, size, kind, but_itself))
    best = every.groupBy("query_id").agg(F.max_by(F.struct("gallery_id", "similarity"), F.struct("similarity", -c("gallery_id"))).alias("b"))
    return Match(best.select("query_id", "b.gallery_id", "b.similarity"), share)


def matched(visits: DataFrame, cells: DataFrame, size: np.ndarray, kind: str, but_itself: bool) -> DataFrame:
    """The best of each visit of a query to a block of a cell."""
    c = F.col
    asked = {int(r["cell"]): r["count"] for r in visits.groupBy("cell").count().collect()}  # a row for each pivot at most
    blocks = {k: max(1, math.ceil(int(size[k]) / BLOCK)) for k in asked}
    parts = {k: max(1, math.ceil(v / QUERIES)) for k, v in asked.items()}

    def number(of: dict[int, int]) -> Column:
        """The number of a cell, where it is not 1."""
        several = {k: v for k, v in of.items() if v > 1}
        if not several:
            return F.lit(1)
        return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in several.items() for x in kv]), c("cell").cast("int")), F.lit(1))

    upto = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    left = visits.withColumn("part", F.pmod(F.xxhash64("query_id"), number(parts)).cast("int")).withColumn("block", upto(number(blocks)))
    right = cells.select("gallery_id", "g", "cell").withColumn("block", F.pmod(F.xxhash64("gallery_id"), number(blocks)).cast("int")).withColumn("part", upto(number(parts)))

    def match(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if a.empty or b.empty:
            return pd.DataFrame({"query_id": [], "gallery_id": [], "similarity": []})
        b = b.sort_values("gallery_id")
        m, ids = np.stack(b["g"].to_numpy()).astype(float), b["gallery_id"].to_numpy()
        out, n = [], max(1, PRODUCTS // len(b))
        for low in range(0, len(a), n):
            some = a.iloc[low : low + n]
            s = np.stack(some["q"].to_numpy()).astype(float) @ m.T
            np.round(s, 9, out=s)
            if but_itself:
                s[some["query_id"].to_numpy()[:, None] == ids[None, :]] = -np.inf
            at = s.argmax(1)
            out.append(pd.DataFrame({"query_id": some["query_id"].to_numpy(), "gallery_id": ids[at], "similarity": s[np.arange(len(some)), at]}))
        return pd.concat(out)

    by = ["cell", "block", "part"]
    return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInPandas(match, BEST).where(c("similarity") > float("-inf"))
