"""Streaming twins and numeric operators as queries; a stream gives what its batch form gives."""

from __future__ import annotations

import uuid
from itertools import pairwise

from pyspark.sql import functions as F

from trailmark.functions.columns import distorted
from trailmark.operators import registry
from trailmark.operators.geometry import homographies, undistorted
from trailmark.session import shared_folder
from trailmark.sources import messages
from trailmark.streaming import register, twins
from trailmark.streaming.reload import Versions, join_reloaded

from .stateful import _DAY, FORCED, IDLE, _lives, reports
from .views import Tables, op

c = F.col


def folder(t: Tables, name: str) -> str:
    return f"{shared_folder(t.spark)}/{name}-{uuid.uuid4().hex}"


#: Micro-batches of a fed stream, and files of each.
BATCHES, FILES = 3, 4


def thirds(t: Tables):
    """The observations in order of ids, cut where ids are pushed down to the scan."""
    rows = t.observations
    top = rows.agg(F.max("id")).first()[0] or 0
    ends = [(top + 1) * i // BATCHES for i in range(BATCHES + 1)]
    return [rows.where((c("id") >= low) & (c("id") < high)) for low, high in pairwise(ends)]


def fed(t: Tables):
    """The observations as a stream: appended in order of ids, so many files per micro-batch."""
    place = folder(t, "observations")
    for rows in thirds(t):
        rows.select("id", "user_id", "camera_id", "event_type", "status", "us").repartition(FILES).write.mode("append").parquet(place)
    return twins.observation_stream(t.spark, place, FILES)


STREAMS = ["streams:commands"]


def payload():
    """A message: broken JSON (here: every eleventh), an unknown stream (every thirteenth), else a good one."""
    whole = F.to_json(F.struct("id", "user_id", "event_type", F.when(c("id") % 13 == 0, "streams:other").otherwise(STREAMS[0]).alias("stream")))
    return F.when(c("id") % 11 == 0, F.expr("substr(whole, 1, length(whole) - 3)")).otherwise(c("whole")), whole


def messages_of(rows):
    text, whole = payload()
    return rows.withColumn("whole", whole).select(text.alias("value"))


def fed_messages(t: Tables):
    """The same as text messages, parsed."""
    place = folder(t, "messages")
    for rows in thirds(t):
        messages_of(rows).repartition(FILES).write.mode("append").text(place)
    raw = t.spark.readStream.option("maxFilesPerTrigger", FILES).text(place)
    return messages.commands(raw, STREAMS)


_guard = "SELECT id, user_id, status FROM (SELECT *, lag(lower(status)) OVER (PARTITION BY user_id ORDER BY id) AS before FROM observations) WHERE before IS NULL OR before <> lower(status)"


@op("st1_stream", _guard)
def st1_stream(t: Tables):
    return twins.run_to_table(twins.transition_guard(fed(t)), folder(t, "st1"), folder(t, "st1-state"))


@op("st3_stream")
def st3_stream(t: Tables):
    return twins.run_to_table(twins.greedy_throttle(fed(t), "user_id", 21_600_000_000), folder(t, "st3"), folder(t, "st3-state"))


registry.ORACLES["st3_stream"] = registry.ORACLES["st3_throttle"]


@op("st2_stream", "SELECT user_id, event_type FROM observations GROUP BY ALL")
def st2_stream(t: Tables):
    once = twins.send_once(fed(t), ["user_id", "event_type"], "user_id", "400 days")
    return twins.run_to_table(once.select("user_id", "event_type"), folder(t, "st2"), folder(t, "st2-state"))


@op("st6_stream")
def st6_stream(t: Tables):
    key = F.when(c("id") % 4 != 0, F.concat_ws("|", c("user_id").cast("string"), "event_type"))
    once = twins.first_within(fed(t).withColumn("key", key), "key", _DAY)
    return twins.run_to_table(once, folder(t, "st6"), folder(t, "st6-state")).select("id")


registry.ORACLES["st6_stream"] = registry.ORACLES["st6_idempotent"]


@op(
    "st7_stream",
    "SELECT 'handled' AS kind, count(*) AS n FROM observations WHERE id % 11 <> 0 AND id % 13 <> 0 UNION ALL SELECT CASE WHEN id % 11 = 0 THEN "
    "'PARSE_ERROR' ELSE 'UNKNOWN_STREAM' END, count(*) FROM observations WHERE id % 11 = 0 OR id % 13 = 0 GROUP BY 1",
)
def st7_stream(t: Tables):
    good, dead = folder(t, "handled"), folder(t, "dead")
    twins.consume(fed_messages(t), good, dead, folder(t, "st7-state")).awaitTermination()
    kinds = t.spark.read.parquet(good).select(F.lit("handled").alias("kind")).union(t.spark.read.parquet(dead).select("error_type"))
    return kinds.groupBy("kind").agg(F.count("*").alias("n"))


_sessions = registry.ORACLES["st10_lifecycle"]


@op("st10_stream", f"SELECT user_id, n, first_us, last_us FROM ({_sessions}) WHERE last_us + 28800000000 < (SELECT max(epoch_us(ts)) - 1000000 FROM events)")
def st10_stream(t: Tables):
    """Sessions that the watermark has closed; those still open at the end of the input stay state."""
    return twins.run_to_table(twins.lifecycles(fed(t), "8 hours"), folder(t, "st10"), folder(t, "st10-state"))


K, D = [[800.0, 0.0, 320.0], [0.0, 810.0, 240.0], [0.0, 0.0, 1.0]], [-0.2, 0.05, 0.001, -0.0005, 0.01]


@op("p24_undistort", "SELECT frame_num, box, round(x1, 3) AS x, round(y1, 3) AS y FROM boxes")
def p24(t: Tables):
    """Places are distorted by the camera's model in closed form; undistorting them must give the places back."""
    x, y = distorted(c("x1"), c("y1"), K, D)
    found = undistorted(t.boxes.select("frame_num", "box", x.alias("x"), y.alias("y")), K, D)
    return found.select("frame_num", "box", F.round("ux", 3).alias("x"), F.round("uy", 3).alias("y"))


@op(
    "v5_homography",
    "SELECT id AS camera_id, CASE id % 4 WHEN 3 THEN 0 WHEN 2 THEN 9 ELSE 4 END AS inliers, id % 4 = 3 AS failed, CASE WHEN id % 4 < 3 THEN (id "
    "+ 10)::DOUBLE END AS shift FROM cameras",
)
def v5(t: Tables):
    """Four exact pairs, or nine and two that are far off (every fourth camera), or three, with which a camera fails."""
    n = F.element_at(F.array(F.lit(4), F.lit(4), F.lit(11), F.lit(3)), (c("id") % 4 + 1).cast("int"))
    points = t.cameras.select(c("id").alias("camera_id"), F.explode(F.sequence(F.lit(0), n - 1)).alias("n"), (n == 11).alias("many"))
    side = F.when(c("many"), 3).otherwise(2)
    x, y = (c("n") % side * 100).cast("double"), F.floor(c("n") / side).cast("double") * 100
    off = F.when(c("n") >= 9, 250.0).otherwise(0.0)
    points = points.select("camera_id", "n", x.alias("x"), y.alias("y"), (x * 2 + c("camera_id") + 10 + off).alias("u"), (y * 3 + x * 0.5 - 5 - off).alias("v"))
    shift = F.round(F.get("h", 2), 4)
    return homographies(points).select("camera_id", "inliers", c("error").isNotNull().alias("failed"), shift.alias("shift"))


@op("sc10_events", "SELECT event_type, count(*) AS n FROM observations WHERE event_type IN ('click', 'view') GROUP BY 1")
def sc10(t: Tables):
    """A listener's stream of JSON events, filtered by type."""
    place = folder(t, "events")
    t.observations.select("event_type", F.lit("1.0").alias("version"), F.to_json(F.struct("user_id")).alias("data")).write.json(place)
    heard = messages.event_stream(t.spark, place, ["click", "view"])
    return twins.run_to_table(heard, folder(t, "sc10"), folder(t, "sc10-state")).groupBy("event_type").agg(F.count("*").alias("n"))


@op("sc11_images", "SELECT id, length(code)::BIGINT + 1 AS bytes FROM branches")
def sc11(t: Tables):
    """Files by reference: paths and sizes, without reading what is in them."""
    place = folder(t, "images")
    t.branches.write.partitionBy("id").text(place)
    found = messages.images(t.spark, place)
    return found.select(F.regexp_extract("path", r"/id=(\d+)/", 1).cast("long").alias("id"), c("length").alias("bytes"))


@op("sc17_answers", "SELECT CAST(user_id AS VARCHAR) AS crop_id, arg_max(event_type, id) AS answer FROM observations WHERE id % 3 = 0 GROUP BY user_id")
def sc17(t: Tables):
    """Cached answers in JSON lines; those of another prompt are ignored, the last of a crop wins."""
    place = folder(t, "answers")
    rows = t.observations.select(c("user_id").cast("string").alias("crop_id"), F.when(c("id") % 3 == 0, "now").otherwise("old").alias("prompt_hash"), c("event_type").alias("answer"), c("id").alias("at"))
    messages.export_json(rows, place)
    return messages.answers(t.spark, place, "now")


@op(
    "st8_micro_batches",
    "WITH m AS (SELECT max(id) + 1 AS top FROM observations) SELECT CASE WHEN id < top // 3 THEN 0 WHEN id < top * 2 // 3 THEN 1 ELSE 2 "
    "END::BIGINT AS batch_id, count(*) AS n FROM observations, m GROUP BY 1",
)
def st8(t: Tables):
    """A micro-batch is bounded by files per trigger; its rows are those that arrived together."""
    good, dead = folder(t, "st8"), folder(t, "st8-dead")
    twins.consume(fed_messages(t), good, dead, folder(t, "st8-state")).awaitTermination()
    rows = t.spark.read.parquet(good).select("batch_id").unionAll(t.spark.read.parquet(dead).select("batch_id"))
    return rows.groupBy(c("batch_id").cast("long").alias("batch_id")).agg(F.count("*").alias("n"))


@op(
    "st14_reload",
    "WITH m AS (SELECT max(id) + 1 AS top FROM observations), o AS (SELECT id, user_id, CASE WHEN id < top * 2 // 3 THEN 1 ELSE 3 END AS version FROM observations, m) "
    "SELECT o.id, CASE version WHEN 1 THEN full_name ELSE upper(full_name) END AS full_name, version FROM o JOIN users u ON u.id = o.user_id WHERE version = 1 OR u.id % 5 <> 0",
)
def st14(t: Tables):
    """Three micro-batches, before each of which the static side is published anew: the second version is broken (rows without an id), so the first one stays
    until the third, which has other names and lacks some users."""
    people = t.users.select(c("id").alias("user_id"), "full_name")
    broken = people.withColumn("user_id", F.when(c("user_id") % 2 == 0, c("user_id")))
    renamed = people.where("user_id % 5 <> 0").withColumn("full_name", F.upper("full_name"))
    side = Versions(t.spark, folder(t, "people"), "user_id long, full_name string", lambda x: bool(x.limit(1).count()) and not x.where("user_id is null").limit(1).count())
    place, out, checkpoint = folder(t, "observations"), folder(t, "st14"), folder(t, "st14-state")
    for rows, version in zip(thirds(t), [people, broken, renamed], strict=True):
        side.publish(version)
        rows.select("id", "user_id", "camera_id", "event_type", "status", "us").repartition(FILES).write.mode("append").parquet(place)
        join_reloaded(twins.observation_stream(t.spark, place, FILES).select("id", "user_id"), side, "user_id", out, checkpoint)
    return t.spark.read.parquet(out).select("id", "full_name", c("version").cast("int").alias("version"))


#: Micro-batches of the register's stream, and its delay: a row in seven comes a micro-batch late, which is less.
LATE_BATCHES, DELAY_MS = 5, 7 * 86_400_000


@op("st10_register_stream", _lives.replace("UNTIL", f"(SELECT (max(us) // 1000 - {DELAY_MS}) * 1000 FROM observations)").replace("FROM observations UNION ALL", f"FROM observations WHERE us <= (SELECT (max(us) // 1000 - {DELAY_MS}) * 1000 FROM observations) UNION ALL").replace("count(*) + 1 FROM observations GROUP BY", f"count(*) + 1 FROM observations WHERE us <= (SELECT (max(us) // 1000 - {DELAY_MS}) * 1000 FROM observations) GROUP BY"))
def st10_register(t: Tables):
    """The stream of st10_lives, with rows that come late: what the watermark has archived. What is open then stays state."""
    register.with_timers(t.spark)
    place, rows = folder(t, "reports"), reports(t.observations)
    low, high = rows.agg(F.min("us"), F.max("us")).first()
    step = ((high or 0) - (low or 0)) // LATE_BATCHES + 1
    arrives = F.floor((c("us") - (low or 0)) / step) + F.when(c("id") % 7 == 0, 1).otherwise(0)
    for i in range(LATE_BATCHES + 1):
        rows.where(arrives == i).repartition(FILES).write.mode("append").parquet(place)
    stream = t.spark.readStream.schema("id long, user_id long, camera_id long, us long, kind string").option("maxFilesPerTrigger", FILES).parquet(place)
    found = register.lives(stream.withColumn("ts", F.timestamp_micros("us")), "user_id", IDLE, FORCED, f"{DELAY_MS} milliseconds")
    return twins.run_to_table(found, folder(t, "st10r"), folder(t, "st10r-state"))
