"""Ordered work on keys of any size: ranks, running aggregates and frames that no single task computes for a whole key.

Rows are dealt to tasks by ranges of (key, order), so a key with very many rows covers many parts, and each boundary between two
parts is crossed by one key at most. What a row needs of other parts is then small: the sums of the parts of its own key
before it (two rows for each part at most), or a few neighbours across the boundary (the halo of a part).
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trailmark.session import written

#: Low bits of a row's number that count within its part.
INDEX_BITS = 33


class Dealt(NamedTuple):
    """``rows`` with ``_part`` and ``_at`` (numbers in order); ``spans``: (keys, _part, _first, _n, _before) of the keys that cover several parts."""

    rows: DataFrame
    spans: DataFrame
    keys: list[str]


def deal(rows: DataFrame, keys: list[str], order: list[str | Column], keep: list[Column | str] | None = None, ties: list[str | Column] | None = None) -> Dealt:
    """``rows`` in ranges of keys and order, as a table; ``keep`` are the columns that stay, computed after the sort.

    Nulls come first, as a key or in the order. Equal rows of a key are numbered in any order, so ``order`` should tell all different rows apart,
    or ``ties`` the rows of equal order, which then stay in one part.
    """
    c = F.col
    ordered = rows.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order, *(ties or []))
    ordered = ordered.select(*(keep or rows.columns), F.monotonically_increasing_id().alias("_at"))
    table = written(ordered.withColumn("_part", F.shiftright("_at", INDEX_BITS)), "dealt")
    sizes = table.groupBy(*keys, "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    by = Window.partitionBy(*keys)  # of a key a row for each part
    before = F.coalesce(F.sum("_n").over(by.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    spans = sizes.withColumns({"_before": before, "_parts": F.count("*").over(by)}).where(c("_parts") > 1).drop("_parts")
    return Dealt(table, written(spans, "spans"), keys)


def beside(rows: DataFrame, small: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Joins a table of at most two rows for each part, by key (nulls are equal) and part."""
    small = small.select(*[F.col(k).alias(f"_key_{k}") for k in keys], F.col("_part").alias("_of"), *[n for n in small.columns if n not in (*keys, "_part")])
    on = F.col("_part") == F.col("_of")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_key_{k}"))
    return rows.join(F.broadcast(small), on, how).drop("_of", *[f"_key_{k}" for k in keys])


#: Aggregates that compose: the grouped one, and how two parts' values become one.
COMPOSED: dict[str, tuple[Callable, Callable]] = {
    "sum": (F.sum, lambda a, b: a + b),
    "bit_xor": (F.bit_xor, lambda a, b: a.bitwiseXOR(b)),
    "max": (F.max, F.greatest),
    "min": (F.min, F.least),
}


def running(dealt: Dealt, columns: dict[str, tuple[str, str | Column]], reverse: bool = False, rows: DataFrame | None = None) -> DataFrame:
    """Running aggregates over all rows of a key up to each row (``reverse``: from it on), itself included: name -> (aggregate, column).

    ``rows`` are the dealt rows with more columns. Within a part it is a window; across parts the totals of the parts are composed.
    """
    c, keys = F.col, dealt.keys
    rows = dealt.rows if rows is None else rows
    inside = Window.partitionBy(*keys, "_part").orderBy(F.desc("_at") if reverse else c("_at")).rowsBetween(Window.unboundedPreceding, 0)
    across = Window.partitionBy(*keys).orderBy(F.desc("_part") if reverse else c("_part")).rowsBetween(Window.unboundedPreceding, -1)
    value = {n: c(v) if isinstance(v, str) else v for n, (_, v) in columns.items()}
    several = beside(rows, dealt.spans.select(*keys, "_part"), keys, "left_semi")
    totals = several.groupBy(*keys, "_part").agg(*[COMPOSED[k][0](value[n]).alias(n) for n, (k, _) in columns.items()])
    carried = totals.select(*keys, "_part", *[COMPOSED[k][0](n).over(across).alias(f"_carry_{n}") for n, (k, _) in columns.items()])
    out = beside(rows.withColumns({n: COMPOSED[k][0](value[n]).over(inside) for n, (k, _) in columns.items()}), carried, keys)
    joined = {n: F.coalesce(COMPOSED[k][1](c(n), c(f"_carry_{n}")), n, f"_carry_{n}") for n, (k, _) in columns.items()}
    return out.withColumns(joined).drop(*[f"_carry_{n}" for n in columns])


def numbered(dealt: Dealt, name: str = "_place") -> DataFrame:
    """The place of each row among those of its key, from 1 on."""
    place = F.row_number().over(Window.partitionBy(*dealt.keys, "_part").orderBy("_at")) + F.coalesce("_before", F.lit(0))
    return beside(dealt.rows, dealt.spans.select(*dealt.keys, "_part", "_before"), dealt.keys).withColumn(name, place.cast("long")).drop("_before")


def with_halo(dealt: Dealt, n: int) -> DataFrame:
    """The dealt rows, and for each part the ``n`` rows of its first key that lie before it, marked ``_halo``.

    Frames of up to ``n`` rows before the current one are then right in ``frame(dealt)``; keep what is not ``_halo`` afterwards.
    A row that is in reach of several parts (of fewer than ``n`` rows each) is in the halo of each.
    """
    c, keys = F.col, dealt.keys
    place = c("_before") + c("_at") - c("_first")  # from 0 on, of rows whose key covers several parts
    several = beside(dealt.rows, dealt.spans, keys, "inner").withColumn("_bin", F.floor(place / n)).withColumn("_place", place)
    starts = dealt.spans.where("_before > 0").select(*keys, c("_part").alias("_to"), c("_before").alias("_begin"))
    starts = starts.withColumn("_bin", F.explode(F.sequence(F.floor(F.greatest(c("_begin") - n, F.lit(0)) / n), F.floor((c("_begin") - 1) / n))))
    starts = starts.select(*[c(k).alias(f"_key_{k}") for k in keys], "_to", "_begin", c("_bin").alias("_near"))
    on = (c("_bin") == c("_near")) & (c("_place") < c("_begin")) & (c("_place") >= c("_begin") - n)
    for k in keys:
        on = on & c(k).eqNullSafe(c(f"_key_{k}"))
    halo = several.join(F.broadcast(starts), on).withColumn("_part", c("_to"))  # two bins for each part at most
    own = dealt.rows.withColumn("_halo", F.lit(False))
    return own.unionByName(halo.withColumn("_halo", F.lit(True)).select(*own.columns))


def frame(dealt: Dealt):
    """The window of a part of a key, in order."""
    return Window.partitionBy(*dealt.keys, "_part").orderBy("_at")
