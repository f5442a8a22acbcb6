"""Order-dependent states over blocks as queries: caches with eviction, leases, batches, lives, idempotency that expires."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trailmark.operators.folds import CountOrTime, Fifo, Leases, fold, settled_fold
from trailmark.operators.graph import connected_components
from trailmark.operators.lifecycle import lives, overlaps, visits
from trailmark.operators.ranges import deal, frame, running, with_halo
from trailmark.operators.reuse import lru
from trailmark.operators.throttle import greedy_throttle

from .sequences import _fold, _merge
from .views import Tables, op

c = F.col
#: The testbed is slow: hours stand for what are seconds or milliseconds there.
HOUR = 3_600_000_000
#: Its caches are small too; the operators' own sizes are 4096 (sent attendance) and 10 000 (embeddings).
SENT, HELD = 64, 40


@op(
    "st2_send_once",
    "WITH RECURSIVE o AS (SELECT id, camera_id AS k, CASE WHEN user_id % 10 <> 0 THEN user_id || '|' || event_type END AS m, row_number() OVER "
    "(PARTITION BY camera_id ORDER BY id) AS n FROM observations), r AS (SELECT k, 0::BIGINT AS n, NULL::BIGINT AS id, false AS passes, "
    "[]::VARCHAR[] AS held FROM (SELECT DISTINCT k FROM o) UNION ALL SELECT r.k, o.n, o.id, o.m IS NULL OR NOT list_contains(r.held, o.m), CASE "
    f"WHEN o.m IS NULL OR list_contains(r.held, o.m) THEN r.held ELSE list_append(r.held, o.m)[-{SENT}:] END FROM r JOIN o ON o.k = r.k AND o.n "
    "= r.n + 1) SELECT id FROM r WHERE passes",
)
def st2(t: Tables):
    """Sent once for each track and name, as long as the camera's logger remembers it: it forgets the one that was sent first. Rows without a track always pass."""
    member = F.when(c("user_id") % 10 != 0, F.concat_ws("|", "user_id", "event_type"))
    rows = t.observations.select("id", "camera_id", member.alias("member"))
    return settled_fold(rows, "camera_id", ["id"], Fifo(SENT, "member")).where("passes").select("id")


@op(
    "st20_lru",
    "WITH o AS (SELECT id, user_id, row_number() OVER (ORDER BY id) AS place FROM observations), p AS (SELECT *, lag(place) OVER (PARTITION BY "
    "user_id ORDER BY place) AS before FROM o), d AS (SELECT p.id, count(DISTINCT x.user_id) AS n FROM p LEFT JOIN o x ON x.place > p.before AND "
    "x.place < p.place WHERE p.before IS NOT NULL GROUP BY p.id), f AS (SELECT p.id, p.user_id, CASE WHEN before IS NULL THEN 'cold' WHEN d.n < "
    f"{HELD} THEN 'hit' ELSE 'evicted' END AS outcome, sum(CASE WHEN before IS NULL THEN 1 ELSE 0 END) OVER (ORDER BY place) - CASE WHEN before "
    f"IS NULL THEN 1 ELSE 0 END AS known FROM p LEFT JOIN d ON d.id = p.id) SELECT id, user_id, outcome, outcome <> 'hit' AND known >= {HELD} AS "
    "evicts FROM f",
)
def st20(t: Tables):
    """What a cache of embeddings by user does on each access."""
    return lru(t.observations.select("id", "user_id"), "user_id", "id", HELD).select("id", "user_id", "outcome", "evicts")


_TTL = 6 * HOUR
_lease_rows = (
    "SELECT id, us, camera_id AS k, user_id % 3 AS worker, CASE WHEN event_type IN ('click', 'view') THEN 'claim' WHEN event_type = 'signup' THEN "
    "'release' ELSE 'renew' END AS action, row_number() OVER (PARTITION BY camera_id ORDER BY us, id) AS n FROM observations"
)
_leases = (
    f"WITH RECURSIVE o AS ({_lease_rows}), r AS (SELECT k, 0::BIGINT AS n, NULL::BIGINT AS us, NULL::BIGINT AS holder, NULL::BIGINT AS ends, "
    "0::BIGINT AS lease, NULL::BIGINT AS own, false AS released FROM (SELECT DISTINCT k FROM o) UNION ALL SELECT r.k, o.n, o.us, CASE WHEN good THEN CASE action WHEN "
    f"'claim' THEN worker WHEN 'release' THEN NULL ELSE r.holder END ELSE r.holder END, CASE WHEN good THEN o.us + {_TTL} ELSE r.ends END, "
    "r.lease + CASE WHEN good AND action = 'claim' THEN 1 ELSE 0 END, CASE WHEN good THEN worker END, good AND action = 'release' FROM (SELECT r.*, o.n AS m, CASE WHEN "
    "o.action = 'claim' THEN r.holder IS NULL OR o.us >= r.ends ELSE r.holder = o.worker AND o.us < r.ends END AS good FROM r JOIN o ON o.k = r.k "
    "AND o.n = r.n + 1) r JOIN o ON o.k = r.k AND o.n = r.m), l AS (SELECT k AS camera_id, lease, own AS worker, min(us) AS begin, max(us) AS last, bool_or(released) AS "
    f"released FROM r WHERE own IS NOT NULL GROUP BY ALL), v AS (SELECT camera_id, lease, worker, begin, CASE WHEN released THEN last ELSE last + {_TTL} END AS "
    "until, released FROM l) "
)


def leases(t: Tables):
    """Intervals of ownership: (camera_id, lease, worker, begin, until, why)."""
    action = F.when(c("event_type").isin("click", "view"), "claim").when(c("event_type") == "signup", "release").otherwise("renew")
    rows = t.observations.select("id", "us", "camera_id", (c("user_id") % 3).alias("worker"), action.alias("action"))
    told = fold(rows, "camera_id", ["us", "id"], Leases(_TTL)).where("lease is not null")
    told = told.join(rows.select("id", "us", "worker"), "id")
    each = told.groupBy("camera_id", "lease", "worker").agg(F.min("us").alias("begin"), F.max("us").alias("last"), F.max(c("outcome") == "released").alias("released"))
    now = F.broadcast(t.observations.agg(F.max("us").alias("now")))  # one row
    until = F.when(c("released"), c("last")).otherwise(c("last") + _TTL)
    why = F.when(c("released"), "released").when(c("until") > c("now"), "held").otherwise("expired")
    return each.withColumn("until", until).join(now).withColumn("why", why).select("camera_id", "lease", "worker", "begin", "until", "why", "now")


@op(
    "st12_leases",
    _leases + "SELECT camera_id, lease, worker, begin, until, CASE WHEN released THEN 'released' WHEN until > (SELECT max(us) FROM o) THEN 'held' "
    "ELSE 'expired' END AS why FROM v",
)
def st12_leases(t: Tables):
    """Who held each camera, from when to when, and why it ended: claims, renewals and releases with a time to live of six hours."""
    return leases(t).drop("now")


@op(
    "w16_orphans",
    _leases + ", g AS (SELECT camera_id, until AS since, coalesce(lead(begin) OVER (PARTITION BY camera_id ORDER BY begin), (SELECT max(us) FROM o)) AS next FROM v) "
    f"SELECT camera_id, since FROM g WHERE next - since >= {4 * HOUR}",
)
def w16(t: Tables):
    """When cameras became orphans: nobody held them for the grace of four hours or more."""
    rows = leases(t).select("camera_id", "begin", "until", "now", (-c("begin")).alias("back"))
    dealt = deal(rows, ["camera_id"], ["back"])
    following = with_halo(dealt, 1).withColumn("next", F.coalesce(F.lag("begin").over(frame(dealt)), "now")).where("not _halo")
    return following.where(c("next") - c("until") >= 4 * HOUR).select("camera_id", c("until").alias("since"))


@op(
    "st8_flush",
    "WITH RECURSIVE o AS (SELECT id, us, camera_id AS k, row_number() OVER (PARTITION BY camera_id ORDER BY us, id) AS n FROM observations), r AS "
    "(SELECT k, 0::BIGINT AS n, NULL::BIGINT AS id, NULL::BIGINT AS begin, 0::BIGINT AS place, 0::BIGINT AS batch FROM (SELECT DISTINCT k FROM o) UNION "
    f"ALL SELECT r.k, o.n, o.id, CASE WHEN fresh THEN o.us ELSE r.begin END, CASE WHEN fresh THEN 1 ELSE r.place + 1 END, r.batch + fresh::BIGINT FROM (SELECT r.*, o.n AS m, "
    f"r.begin IS NULL OR r.place = 8 OR o.us >= r.begin + {6 * HOUR} AS fresh FROM r JOIN o ON o.k = r.k AND o.n = r.n + 1) r JOIN o ON o.k = r.k AND o.n = r.m) SELECT id, k AS "
    "camera_id, batch, count(*) OVER (PARTITION BY k, batch) AS size, CASE WHEN count(*) OVER (PARTITION BY k, batch) = 8 THEN 'count' ELSE 'time' END AS why FROM r WHERE id IS NOT NULL",
)
def st8_flush(t: Tables):
    """Batches of a queue for each camera: flushed at 8 rows, or six hours after the first."""
    found = fold(t.observations.select("id", "us", "camera_id"), "camera_id", ["us", "id"], CountOrTime(8, 6 * HOUR))
    size = F.count("*").over(Window.partitionBy("camera_id", "batch"))  # 8 rows at most
    return found.select("id", "camera_id", "batch", size.alias("size"), F.when(size == 8, "count").otherwise("time").alias("why"))


_DAY = 24 * HOUR
_key = "CASE WHEN id % 4 <> 0 THEN user_id || '|' || event_type END"


def _first(source: str) -> str:
    """The rows that a key of ``source`` (k, us) passes, with the recursion of a throttle."""
    return _fold(source, "k", _DAY).replace("SELECT k AS k, us FROM r WHERE us IS NOT NULL", "").removeprefix("WITH RECURSIVE ").rstrip()


@op(
    "st6_idempotent",
    f"WITH RECURSIVE m AS (SELECT id, us, {_key} AS k FROM observations), {_first('m WHERE k IS NOT NULL')} SELECT m.id FROM m LEFT JOIN r ON r.k = m.k AND r.us = m.us WHERE m.k IS NULL OR r.us IS NOT NULL",
)
def st6(t: Tables):
    """Messages whose key was not handled in the 24 hours before; a repeat does not renew the key. Messages without a key (here: every fourth) always pass."""
    rows = t.observations.select("id", "us", F.when(c("id") % 4 != 0, F.concat_ws("|", "user_id", "event_type")).alias("key"))
    kept = rows.join(greedy_throttle(rows, "key", "us", _DAY), ["key", "us"]).groupBy("key", "us").agg(F.min("id").alias("id"))
    return kept.select("id").union(rows.where("key is null").select("id"))


@op(
    "st7_consume",
    f"WITH RECURSIVE m AS (SELECT id, us, user_id, {_key} AS k, id % 11 = 0 AS broken, id % 13 = 0 AS unknown FROM observations), {_first('m WHERE k IS NOT NULL AND NOT broken AND NOT unknown')} "
    "SELECT m.id, CASE WHEN broken THEN 'PARSE_ERROR' WHEN m.k IS NOT NULL AND NOT unknown AND r.us IS NULL THEN 'DUPLICATE' WHEN unknown AND EXISTS (SELECT 1 FROM r x WHERE x.k = "
    f"m.k AND x.us <= m.us AND x.us > m.us - {_DAY}) THEN 'DUPLICATE' WHEN unknown THEN 'UNKNOWN_STREAM' WHEN user_id % 5 = 0 THEN 'OTHER_TENANT' ELSE 'handled' END AS outcome FROM m "
    "LEFT JOIN r ON r.k = m.k AND r.us = m.us AND NOT broken AND NOT unknown",
)
def st7(t: Tables):
    """Parse, duplicates within 24 hours of a handled message, route, tenant, in this order. Only messages of known streams mark their key."""
    key = F.when(c("id") % 4 != 0, F.concat_ws("|", "user_id", "event_type"))
    rows = t.observations.select("id", "us", "user_id", key.alias("key"), (c("id") % 11 == 0).alias("broken"), (c("id") % 13 == 0).alias("unknown"))
    marks = greedy_throttle(rows.where("not broken and not unknown"), "key", "us", _DAY).select("key", "us", F.lit(True).alias("marks"))
    keyed = rows.where("key is not null and not broken").join(marks, ["key", "us"], "left")
    own = keyed.withColumn("marks", c("marks") & ~c("unknown"))
    seen = running(deal(own, ["key"], ["us", "id"]), {"last": ("max", F.when(c("marks"), c("us")))})
    repeat = F.when(c("unknown"), F.coalesce(c("us") - c("last") < _DAY, F.lit(False))).otherwise(c("marks").isNull())
    known = seen.select("id", "user_id", "broken", "unknown", repeat.alias("repeat"))
    every = known.unionByName(rows.where("key is null or broken").select("id", "user_id", "broken", "unknown", F.lit(False).alias("repeat")))
    out = F.when(c("broken"), "PARSE_ERROR").when(c("repeat"), "DUPLICATE").when(c("unknown"), "UNKNOWN_STREAM").when(c("user_id") % 5 == 0, "OTHER_TENANT").otherwise("handled")
    return every.select("id", out.alias("outcome"))


#: Hours after which a track with no active camera is archived, and any track.
IDLE, FORCED = 8 * HOUR, 20 * HOUR
_lives = (
    "WITH RECURSIVE o AS (SELECT id, us, user_id AS k, camera_id AS cam, event_type <> 'error' AS seen, row_number() OVER (PARTITION BY user_id ORDER BY us, id) AS n FROM "
    "observations UNION ALL SELECT NULL, UNTIL, user_id, NULL, NULL, count(*) + 1 FROM observations GROUP BY user_id), r AS (SELECT k, 0::BIGINT AS n, NULL::BIGINT AS first, "
    "NULL::BIGINT AS last, 0::BIGINT AS cnt, []::BIGINT[] AS act, NULL::BIGINT AS o_first, NULL::BIGINT AS o_last, NULL::BIGINT AS o_n, NULL::VARCHAR AS o_why, NULL::BIGINT AS o_us "
    "FROM (SELECT DISTINCT k FROM o) UNION ALL SELECT k, m, CASE WHEN seen THEN coalesce(CASE WHEN live THEN first END, us) WHEN live AND NOT done THEN first END, CASE WHEN seen "
    "THEN us WHEN live AND NOT done THEN last END, CASE WHEN seen THEN CASE WHEN live THEN cnt ELSE 0 END + 1 ELSE cnt END, CASE WHEN seen THEN list_distinct(list_append(CASE WHEN "
    "live THEN act ELSE [] END, cam)) ELSE rest END, CASE WHEN gone OR done THEN first END, CASE WHEN gone OR done THEN last END, CASE WHEN gone OR done THEN cnt END, CASE WHEN "
    "gone AND len(act) > 0 THEN 'forced' WHEN gone OR done THEN 'inactive' END, CASE WHEN gone THEN due WHEN done THEN us END FROM (SELECT *, live AND seen = false AND len(rest) = 0 AND "
    f"us >= last + {IDLE} AS done FROM (SELECT *, first IS NOT NULL AND NOT gone AS live, CASE WHEN seen = false THEN list_filter(act, lambda x: x <> cam) ELSE act END AS rest FROM (SELECT *, first IS NOT NULL AND "
    f"due <= us AS gone FROM (SELECT r.*, o.n AS m, o.us, o.cam, o.seen, CASE WHEN len(r.act) = 0 THEN r.last + {IDLE} ELSE r.last + {FORCED} END AS due FROM r JOIN o ON o.k = r.k AND "
    "o.n = r.n + 1)))))"
    " SELECT k AS user_id, o_first AS first_us, o_last AS last_us, o_n AS n, o_why AS why, o_us AS archived_us FROM r WHERE o_first IS NOT NULL"
)


def reports(rows):
    """What cameras report: an error stands for a track that left."""
    return rows.select("id", "user_id", "camera_id", "us", F.when(c("event_type") == "error", "left").otherwise("seen").alias("kind"))


@op("st10_lives", _lives.replace("UNTIL", "(SELECT max(us) FROM observations)"))
def st10_lives(t: Tables):
    """Archived tracks: no camera is active and the track was idle for eight hours, or it was not seen for twenty hours whatever the cameras say."""
    until = t.observations.agg(F.max("us")).first()[0] or 0
    return lives(reports(t.observations), "user_id", until, IDLE, FORCED)


_visits = (
    "v AS (SELECT user_id, camera_id, min(us) AS a, max(us) AS b FROM (SELECT *, sum(new) OVER (PARTITION BY user_id, camera_id ORDER BY us) AS run FROM (SELECT *, CASE WHEN us - "
    f"lag(us) OVER (PARTITION BY user_id, camera_id ORDER BY us) < {30 * HOUR} THEN 0 ELSE 1 END AS new FROM observations)) GROUP BY user_id, camera_id, run)"
)


@op(
    "st19_conflicts",
    f"WITH {_visits} SELECT x.user_id, x.camera_id AS one, y.camera_id AS other, greatest(x.a, y.a) AS begin, least(x.b, y.b) AS until FROM v x JOIN v y ON x.user_id = y.user_id AND "
    "x.camera_id < y.camera_id AND x.a <= y.b AND y.a <= x.b WHERE x.camera_id // 2 <> y.camera_id // 2",
)
def st19(t: Tables):
    """One identity on two cameras at once, unless they share an overlap group (here: pairs 0-1, 2-3 ...). A visit is a run of rows with less than thirty hours between."""
    found = overlaps(visits(t.observations, ["user_id", "camera_id"], "us", 30 * HOUR), "user_id", "camera_id", "begin", "end", 48 * HOUR)
    return found.where(F.floor(c("one") / 2) != F.floor(c("other") / 2)).select("user_id", "one", "other", "begin", c("end").alias("until"))


@op(
    "st11_last_known",
    "WITH RECURSIVE " + _first("(SELECT user_id AS k, us FROM observations WHERE event_type <> 'error')").replace(str(_DAY), str(2 * HOUR)) + ", e AS (SELECT o.user_id, o.us "
    f"+ {2 * HOUR} AS us, 0 AS kind, o.value FROM observations o JOIN r ON r.k = o.user_id AND r.us = o.us WHERE event_type <> 'error' UNION ALL SELECT user_id, us, 1, NULL FROM observations "
    "WHERE event_type = 'error') SELECT o.id, (SELECT arg_max(e.value, (e.us, e.kind)) FILTER (e.us <= o.us) FROM e WHERE e.user_id = o.user_id AND (e.us, e.kind) = (SELECT max((x.us, "
    "x.kind)) FROM e x WHERE x.user_id = o.user_id AND x.us <= o.us)) AS assigned FROM observations o",
)
def st11(t: Tables):
    """What is known of a track at each of its rows: one request at a time, answered two hours later; a removal (here: an error) forgets the answer, a later one brings it back."""
    rows = t.observations.select("id", "user_id", "us", "value", "event_type")
    asked = greedy_throttle(rows.where("event_type <> 'error'"), "user_id", "us", 2 * HOUR).withColumn("asks", F.lit(True))
    asking = rows.where("event_type <> 'error'").join(asked, ["user_id", "us"])
    none = F.lit(None)
    answers = asking.select("user_id", (c("us") + 2 * HOUR).alias("us"), F.lit(0).alias("kind"), none.cast("long").alias("id"), "value")
    removals = rows.where("event_type = 'error'").select("user_id", "us", F.lit(1).alias("kind"), none.cast("long").alias("id"), none.cast("double").alias("value"))
    asks = rows.select("user_id", "us", F.lit(2).alias("kind"), "id", none.cast("double").alias("value"))
    dealt = deal(answers.unionByName(removals).unionByName(asks), ["user_id"], ["us", "kind", "id"])
    last = running(dealt, {"last": ("max", F.when(c("kind") < 2, F.struct("us", "kind", "value")))})
    return last.where("kind = 2").select("id", c("last.value").alias("assigned"))


@op(
    "st13_moved_rows",
    f"WITH RECURSIVE e AS (SELECT a, b FROM ({_merge}) UNION SELECT b, a FROM ({_merge})), r AS (SELECT a AS id, a AS reach FROM e UNION SELECT r.id, e.b FROM r JOIN e ON r.reach = e.a)"
    + ", m AS (SELECT id, min(reach) AS root FROM r GROUP BY id) SELECT o.id, coalesce(m.root, o.user_id) AS user_id FROM observations o LEFT JOIN m ON m.id = o.user_id",
)
def st13_moved(t: Tables):
    """The rows of merged tracks, moved to the track that takes over; a hot track's rows are split by the adaptive join."""
    edges = t.users.where("into_id is not null").select(c("id").alias("a"), c("into_id").alias("b"))
    roots = connected_components(edges, contract=True).select(c("node").alias("user_id"), "root")
    return t.observations.select("id", "user_id").join(roots, "user_id", "left").select("id", F.coalesce("root", "user_id").alias("user_id"))


@op(
    "w12_stream_state",
    "SELECT camera_id, CASE WHEN camera_id = 0 THEN 'offline' WHEN age < 9000000000 THEN 'streaming' WHEN lost AND age <= 27000000000 THEN 'connecting' ELSE 'offline' END AS state FROM "
    "(SELECT camera_id, (SELECT max(us) FROM observations) - max(us) FILTER (event_type <> 'error') AS age, arg_max(event_type, id) = 'error' AS lost FROM observations GROUP BY 1)",
)
def w12(t: Tables):
    """By the age of the last frame: streaming; connecting while it reconnects (its last row is an error) within the grace; else offline. Stopped cameras (here: 0) first."""
    now = F.broadcast(t.observations.agg(F.max("us").alias("now")))  # one row
    frame_us = F.when(c("event_type") != "error", c("us"))
    seen = t.observations.groupBy("camera_id").agg(F.max(frame_us).alias("last"), (F.max_by("event_type", "id") == "error").alias("lost")).join(now)
    age = c("now") - c("last")
    state = F.when(c("camera_id") == 0, "offline").when(age < F.lit(9_000_000_000), "streaming").when(c("lost") & (age <= F.lit(27_000_000_000)), "connecting").otherwise("offline")
    return seen.select("camera_id", state.alias("state"))
