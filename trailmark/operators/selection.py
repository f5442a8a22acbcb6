"""Exact order statistics of groups of any size: the bin that holds a rank is found by counting, and narrowed until it holds one value."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trailmark.session import written

#: Bins of an interval in a pass; open searches up to which they are broadcast (about 60 bytes each).
BINS, BROADCAST = 1024, 200_000


def at_ranks(rows: DataFrame, keys: list[str], value: str, ranks: Callable[[Column], list[Column]], bins: int = BINS) -> DataFrame:
    """(keys, n, which, value): the values at the ranks (from 0 on, as a function of the group's size n) of each group, nulls left out.

    A search is an interval of values and the rank within it. A pass counts its values in ``bins`` bins of equal width, takes the bin
    that holds the rank, and goes on with that bin's least and largest value. The largest and the least of an interval are in
    different bins, so each pass narrows it; a search ends when both are equal. Counts combine in the tasks: no task and no buffer
    holds a group. Null keys are keys; NaN counts as the largest value, and infinite ones are values of their own.
    """
    c = F.col
    values = rows.select(*keys, c(value).cast("double").alias("_v")).where("_v is not null")
    large = (c("_v") == float("inf")) | F.isnan("_v")
    apart = F.when(F.isnan("_v"), 2).when(c("_v") == float("inf"), 1).when(c("_v") == float("-inf"), -1).otherwise(0)
    finite = F.when(apart == 0, c("_v"))
    sizes = values.groupBy(*keys).agg(F.count("*").alias("n"), F.min(finite).alias("_low"), F.max(finite).alias("_high"), F.count_if(apart == -1).alias("_below"), F.count_if(apart == 1).alias("_inf"), F.count_if(F.isnan("_v")).alias("_nan"))
    which = F.array(*[r.cast("long") for r in ranks(c("n"))])
    wanted = sizes.select(*keys, "n", "_low", "_high", "_below", "_inf", "_nan", F.posexplode(which).alias("which", "_rank"))
    past = c("_rank") - (c("n") - c("_nan"))
    outer = F.when(past >= 0, float("nan")).when(past + c("_inf") >= 0, float("inf")).when(c("_rank") < c("_below"), float("-inf"))
    outer = wanted.withColumn("_outer", outer)
    search = outer.select(*keys, "n", "which", F.coalesce("_outer", "_low").alias("_low"), F.coalesce("_outer", "_high").alias("_high"), (c("_rank") - c("_below")).alias("_rank"))
    done: list[DataFrame] = []
    plain = values.where(~large & (c("_v") > float("-inf")))
    ids = [F.col(k).alias(f"_key_{k}") for k in keys]
    while True:
        search = written(search, "search")
        done.append(search.where(c("_low") == c("_high")).select(*keys, "n", "which", c("_low").alias("value")))
        still = search.where(c("_low") < c("_high"))
        n = still.count()
        if not n:
            break
        side = still.select(*ids, "n", "which", "_low", "_high", "_rank")
        on = (c("_v") >= c("_low")) & (c("_v") <= c("_high"))
        for k in keys:
            on = on & c(k).eqNullSafe(c(f"_key_{k}"))
        # Halves first: the width of an interval may be more than the largest number.
        place = F.floor((c("_v") / 2 - c("_low") / 2) / F.nullif(c("_high") / 2 - c("_low") / 2, F.lit(0.0)) * bins)
        of = plain.join(F.broadcast(side) if n <= BROADCAST else side, on).withColumn("_bin", F.when(c("_v") == c("_high"), bins).otherwise(F.least(F.coalesce(place, F.lit(0)), F.lit(bins - 1))))
        counted = of.groupBy(*keys, "n", "which", "_rank", "_bin").agg(F.count("*").alias("_k"), F.min("_v").alias("_low"), F.max("_v").alias("_high"))
        by = Window.partitionBy(*keys, "which").orderBy("_bin")  # bins + 1 rows at most
        before = counted.withColumn("_upto", F.sum("_k").over(by)).withColumn("_before", c("_upto") - c("_k"))
        hit = before.where((c("_rank") >= c("_before")) & (c("_rank") < c("_upto")))
        search = hit.select(*keys, "n", "which", "_low", "_high", (c("_rank") - c("_before")).alias("_rank"))
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def quantile(rows: DataFrame, keys: list[str], value: str, q: float, name: str) -> DataFrame:
    """(keys, name): the quantile with linear interpolation between the two ranks around q (n - 1)."""
    c = F.col
    place = lambda n: (n - 1) * q
    found = at_ranks(rows, keys, value, lambda n: [F.floor(place(n)), F.ceil(place(n))])
    two = found.groupBy(*keys, "n").agg(F.min("value").alias("_a"), F.max("value").alias("_b"))
    share = place(c("n")) - F.floor(place(c("n")))
    return two.select(*keys, (c("_a") + (c("_b") - c("_a")) * share).alias(name))


def nearest_rank(rows: DataFrame, keys: list[str], value: str, q: float, name: str) -> DataFrame:
    """(keys, name): the value at place min(n - 1, int(q n)) of the sorted ones."""
    found = at_ranks(rows, keys, value, lambda n: [F.least(n - 1, F.floor(n * q))])
    return found.select(*keys, F.col("value").alias(name))
