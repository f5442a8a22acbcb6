"""Keyed sequence operators: transitions, throttles, latest state, best frames. Every one has an explicit order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def transition_guard(rows: DataFrame, key: str = "user_id", state: str = "status", order: str = "id") -> DataFrame:
    """Drops rows whose state (case folded) equals the key's one before by ``order``; since only repeats go, last seen is last recorded."""
    before = F.lag(F.lower(state)).over(Window.partitionBy(key).orderBy(order))
    return rows.withColumn("_before", before).where(F.col("_before").isNull() | (F.col("_before") != F.lower(state))).drop("_before")


def latest_per_key(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The upsert view: the row of each key that came last; a grouped maximum, so it combines before the shuffle."""
    rest = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_last"))
    return best.select(*keys, *[F.col(f"_last.{c}").alias(c) for c in rest])


def send_once(rows: DataFrame, keys: list[str], order: str, unless_null: str) -> DataFrame:
    """The first row of each key; rows without ``unless_null`` always pass."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    first = rows.where(F.col(unless_null).isNotNull()).withColumn("_n", place).where("_n = 1").drop("_n")
    return first.unionByName(rows.where(F.col(unless_null).isNull()))


def top_per_key(rows: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_n") <= n).drop("_n")


def required_unique(rows: DataFrame, keys: list[str], what: str) -> DataFrame:
    """The rows, of which no two may share a key: the job that reads them fails on the first repeated one, as a set with two cameras of one id must not be used.

    Each key is counted in one grouped sum, and its row is given out from there, so the check cannot be pruned away.
    """
    rest = [c for c in rows.columns if c not in keys]
    one = rows.groupBy(*keys).agg(F.count("*").alias("_n"), F.first(F.struct(F.lit(0).alias("_"), *rest)).alias("_row"))
    shown = F.concat(F.lit(f"{what} is there more than once: "), F.to_json(F.struct(*keys)))
    checked = F.when(F.col("_n") > 1, F.raise_error(shown)).otherwise(F.col("_row"))
    return one.withColumn("_row", checked).where(F.col("_row").isNotNull()).select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest]).select(*rows.columns)


def best_frame(crops: DataFrame, frontality: float = 0.6, pitch: float = 0.4) -> DataFrame:
    """Per track the largest frontality * pitch among frames that pass both gates, else among all; the first frame wins ties, null signals never count."""
    c = F.col
    scored = crops.where("frontality is not null and pitch is not null").withColumns({"score": c("frontality") * c("pitch"), "passes": (c("frontality") >= frontality) & (c("pitch") >= pitch)})
    best = F.max_by(F.struct("frame_num", "frontality", "pitch", "passes"), F.struct("passes", "score", -c("frame_num")))
    return scored.groupBy("track_id").agg(best.alias("b")).select("track_id", "b.*")


def sessions(rows: DataFrame, key: str, us: str, gap_us: int) -> DataFrame:
    """(key, session, first, last, n): islands of rows with less than ``gap_us`` between neighbours."""
    w = Window.partitionBy(key).orderBy(us)
    new = F.coalesce((F.col(us) - F.lag(us).over(w) >= gap_us).cast("int"), F.lit(1))
    marked = rows.withColumn("_new", new).withColumn("session", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(key, "session").agg(F.min(us).alias("first_us"), F.max(us).alias("last_us"), F.count("*").alias("n"))
