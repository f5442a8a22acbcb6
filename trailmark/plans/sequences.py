"""Windows and sequence analytics (W) and stateful semantics in batch form (ST) as queries."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trailmark.functions.columns import dot, foot_point
from trailmark.operators.graph import connected_components
from trailmark.operators.ranges import deal, frame, numbered, with_halo
from trailmark.operators.sequences import best_frame, latest_per_key, sessions, top_per_key, transition_guard
from trailmark.operators.throttle import greedy_throttle

from .rows import size_gate, with_branch
from .views import Tables, op

c = F.col


@op(
    "st1_daily_presence",
    "SELECT branch_id, CAST(make_timestamp(us) AS DATE)::VARCHAR AS day, lower(status) AS status, count(*) AS n FROM (SELECT o.*, "
    "coalesce(k.branch_id, u.branch_id) AS branch_id, lag(lower(status)) OVER (PARTITION BY user_id ORDER BY o.id) AS before FROM observations o "
    "LEFT JOIN cameras k ON k.id = o.camera_id LEFT JOIN users u ON u.id = o.user_id) WHERE before IS NULL OR before <> lower(status) GROUP BY "
    "ALL",
)
def st1_daily(t: Tables):
    """The flagship: guarded transitions, the branch of each, daily counts."""
    rows = with_branch(transition_guard(t.observations), t)
    return rows.groupBy("branch_id", F.date_format(F.timestamp_micros("us"), "yyyy-MM-dd").alias("day"), F.lower("status").alias("status")).agg(F.count("*").alias("n"))


@op("w1_prior_row", "SELECT id, lag(status) OVER (PARTITION BY user_id ORDER BY id) AS prior FROM observations")
def w1(t: Tables):
    return t.observations.select("id", F.lag("status").over(Window.partitionBy("user_id").orderBy("id")).alias("prior"))


@op(
    "w2_rolling_rate",
    "SELECT id, CASE WHEN n < 2 OR us = first THEN 0 ELSE round((n - 1) / ((us - first) / 1e6), 9) END AS fps FROM (SELECT id, us, least(n, 120) "
    "AS n, greatest(first, coalesce(capped, first)) AS first FROM (SELECT id, us, count(*) OVER w AS n, min(us) OVER w AS first, lag(us, 119) "
    "OVER (PARTITION BY camera_id ORDER BY us) AS capped FROM observations WINDOW w AS (PARTITION BY camera_id ORDER BY us RANGE BETWEEN "
    "36000000000 PRECEDING AND CURRENT ROW)))",
)
def w2(t: Tables):
    """Events per second among those of the last ten hours (the testbed is slow), the last 120 at most."""
    return rolling_rate(t.observations.select("id", "camera_id", "us"), 36_000_000_000, 120)


def rolling_rate(rows, reach: int, most: int):
    """(id, fps). A row looks at ``most`` rows at most, however many its time holds; rows of equal time, later ones by id included, are counted without being looked at."""
    dealt = deal(rows, ["camera_id"], ["us"], ties=["id"])
    upto = F.count("*").over(Window.partitionBy("camera_id", "_part").orderBy("us").rangeBetween(Window.unboundedPreceding, 0))
    w = frame(dealt)
    rows = with_halo(dealt, most - 1).withColumn("upto", upto)
    rows = rows.withColumns({"at": F.row_number().over(w), "seen": F.collect_list("us").over(w.rowsBetween(1 - most, 0))}).where("not _halo")
    rows = rows.withColumn("inside", F.when(F.get("seen", F.lit(0)) >= c("us") - reach, F.size("seen")).otherwise(F.size(F.filter("seen", lambda x: x >= c("us") - reach))))
    n = F.least(F.when(c("us").isNull(), c("upto")).otherwise(c("inside") + c("upto") - c("at")), F.lit(most))
    rows = rows.select("id", "us", n.alias("n"), F.get("seen", F.size("seen") - c("inside")).alias("first"))
    fps = F.when((c("n") < 2) | (c("us") == c("first")), 0.0).otherwise(F.round((c("n") - 1) / F.nullif((c("us") - c("first")) / 1e6, F.lit(0.0)), 9))
    return rows.select("id", fps.alias("fps"))


@op(
    "w3_rolling_mean",
    "SELECT id, round(avg(value) OVER (PARTITION BY camera_id ORDER BY id ROWS BETWEEN 49 PRECEDING AND CURRENT ROW), 9) AS mean FROM "
    "observations",
)
def w3(t: Tables):
    dealt = deal(t.observations.select("id", "camera_id", "value"), ["camera_id"], ["id"])
    rows = with_halo(dealt, 49).withColumn("mean", F.round(F.avg("value").over(frame(dealt).rowsBetween(-49, 0)), 9))
    return rows.where("not _halo").select("id", "mean")


_ticks = "SELECT stage, tick, v * CASE WHEN tick % 7 = 0 THEN 0.1 ELSE tick END AS ms, k * tick AS n FROM (SELECT event_type AS stage, us // 86400000000 AS tick, sum(value) AS v, count(*) AS k FROM observations GROUP BY ALL)"


@op(
    "w4_counter_rate",
    "SELECT stage, tick, round(dms / dn, 4) AS rate FROM (SELECT stage, tick, ms - lag(ms) OVER w AS dms, n - lag(n) OVER w AS dn FROM "
    f"({_ticks}) WINDOW w AS (PARTITION BY stage ORDER BY tick)) WHERE dms >= 0 AND dn > 0",
)
def w4(t: Tables):
    """The fleet's sum per tick, then differences; none for the first tick, after a reset, or without new counts."""
    day = F.floor(c("us") / 86_400_000_000)
    g = t.observations.groupBy(c("event_type").alias("stage"), day.alias("tick")).agg(F.sum("value").alias("v"), F.count("*").alias("k"))
    g = g.select("stage", "tick", (c("v") * F.when(c("tick") % 7 == 0, 0.1).otherwise(c("tick").cast("double"))).alias("ms"), (c("k") * c("tick")).alias("n"))
    w = Window.partitionBy("stage").orderBy("tick")
    d = g.withColumns({"dms": c("ms") - F.lag("ms").over(w), "dn": c("n") - F.lag("n").over(w)}).where("dms >= 0 and dn > 0")
    return d.select("stage", "tick", F.round(c("dms") / c("dn"), 4).alias("rate"))


@op(
    "w5_counter_fps",
    "SELECT id, CASE WHEN dn >= 0 AND du > 0 THEN round(dn / (du / 1e6), 9) END AS fps FROM (SELECT id, seq - lag(seq) OVER w AS dn, us - "
    "lag(us) OVER w AS du FROM (SELECT id, camera_id, us, id % 2000 AS seq FROM observations) WINDOW w AS (PARTITION BY camera_id ORDER BY id))",
)
def w5(t: Tables):
    """Null at first, after a reset or without elapsed time; a true 0 stays."""
    dealt = deal(t.observations.select("id", "camera_id", "us", (c("id") % 2000).alias("seq")), ["camera_id"], ["id"])
    w = frame(dealt)
    rows = with_halo(dealt, 1).withColumns({"dn": c("seq") - F.lag("seq").over(w), "du": c("us") - F.lag("us").over(w)}).where("not _halo")
    return rows.select("id", F.when((c("dn") >= 0) & (c("du") > 0), F.round(c("dn") / F.nullif(c("du") / 1e6, F.lit(0.0)), 9)).alias("fps"))


@op(
    "w6_best_frame",
    "SELECT track_id, frame_num, frontality, pitch, frontality >= 0.6 AND pitch >= 0.4 AS passes FROM (SELECT *, row_number() OVER (PARTITION BY "
    "track_id ORDER BY frontality >= 0.6 AND pitch >= 0.4 DESC, frontality * pitch DESC, frame_num) AS n FROM crops WHERE frontality IS NOT "
    "NULL) WHERE n = 1",
)
def w6(t: Tables):
    return best_frame(t.crops).select("track_id", "frame_num", "frontality", "pitch", "passes")


@op(
    "w7_proof_image",
    "SELECT track_id, coalesce(arg_max(frame_num, (0.6 * height + 0.4 * sharpness, -frame_num)) FILTER (height >= 160 AND sharpness >= 100), "
    "max(frame_num)) AS frame_num FROM crops GROUP BY track_id",
)
def w7(t: Tables):
    good = F.when((c("height") >= 160) & (c("sharpness") >= 100), F.struct((0.6 * c("height") + 0.4 * c("sharpness")).alias("s"), -c("frame_num")))
    return t.crops.groupBy("track_id").agg(F.coalesce(F.max_by("frame_num", good), F.max("frame_num")).alias("frame_num"))


@op(
    "w8_last_crops",
    "SELECT frame_num FROM (SELECT frame_num, row_number() OVER (PARTITION BY track_id ORDER BY frame_num DESC) AS n FROM crops) WHERE n <= 30",
)
def w8(t: Tables):
    return top_per_key(t.crops, ["track_id"], [F.desc("frame_num")], 30).select("frame_num")


@op(
    "w18_trajectory",
    "SELECT camera_id, frame_num, box FROM (SELECT *, row_number() OVER w AS n, count(*) OVER (PARTITION BY camera_id) AS total FROM boxes "
    "WINDOW w AS (PARTITION BY camera_id ORDER BY frame_num DESC, box, x1, y1, x2, y2)) WHERE n <= 30 AND total >= 2",
)
def w18(t: Tables):
    """Among the last 30 it shows whether a camera has fewer than two."""
    last = top_per_key(t.boxes, ["camera_id"], [F.desc("frame_num"), c("box"), c("x1"), c("y1"), c("x2"), c("y2")], 30)
    return last.withColumn("total", F.count("*").over(Window.partitionBy("camera_id"))).where("total >= 2").select("camera_id", "frame_num", "box")


@op(
    "w9_recent",
    "SELECT user_id, id, n FROM (SELECT user_id, id, row_number() OVER (PARTITION BY user_id ORDER BY id DESC) AS n FROM observations) WHERE n "
    "<= 3",
)
def w9(t: Tables):
    w = Window.partitionBy("user_id").orderBy(F.desc("id"))
    return t.observations.select("user_id", "id", F.row_number().over(w).cast("long").alias("n")).where("n <= 3")


@op(
    "w11_downsample",
    "SELECT camera_id, id FROM (SELECT camera_id, id, row_number() OVER (PARTITION BY camera_id ORDER BY id) - 1 AS i, greatest(1, count(*) OVER "
    "(PARTITION BY camera_id) // 300) AS step FROM observations) WHERE i % step = 0",
)
def w11(t: Tables):
    rows = numbered(deal(t.observations.select("camera_id", "id"), ["camera_id"], ["id"]), "place")
    steps = t.observations.groupBy("camera_id").agg(F.greatest(F.lit(1).cast("long"), F.floor(F.count("*") / 300)).alias("step"))
    return rows.join(steps, "camera_id").where("(place - 1) % step = 0").select("camera_id", "id")


@op(
    "w13_location_change",
    "SELECT id, camera_id FROM (SELECT id, camera_id, lag(camera_id) OVER (PARTITION BY user_id ORDER BY id) AS before FROM observations) WHERE "
    "before IS NULL OR before <> camera_id",
)
def w13(t: Tables):
    return transition_guard(t.observations.withColumn("camera", c("camera_id").cast("string")), state="camera").select("id", "camera_id")


@op(
    "w14_stable_ids",
    "SELECT user_id, 999 + dense_rank() OVER (ORDER BY first) AS global_id, -row_number() OVER (ORDER BY first) AS fallback_id FROM (SELECT "
    "user_id, min(id) AS first FROM observations GROUP BY 1)",
)
def w14(t: Tables):
    """Ids by first sight: ranks inside range partitions, plus the counts of the partitions before, so no single task sees all."""
    first = t.observations.groupBy("user_id").agg(F.min("id").alias("first"))
    step = Window.partitionBy("bucket").orderBy("first")
    rows = first.withColumn("bucket", F.floor(c("first") / 1_000_000)).withColumn("n", F.row_number().over(step))
    sizes = rows.groupBy("bucket").agg(F.count("*").alias("k"))
    earlier = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)  # a row for each million ids
    before = sizes.select("bucket", F.coalesce(F.sum("k").over(earlier), F.lit(0)).alias("base"))
    place = c("n") + c("base")
    return rows.join(before, "bucket").select("user_id", (place + 999).alias("global_id"), (-place).alias("fallback_id"))


@op(
    "w15_identity_vote",
    "WITH r AS (SELECT track_id, frame_num, camera_id % 3 AS name, us, count(*) OVER (PARTITION BY track_id, camera_id % 3 ORDER BY frame_num) "
    "AS votes, count(*) OVER (PARTITION BY track_id ORDER BY frame_num) AS total, us - min(us) OVER (PARTITION BY track_id) AS span FROM crops) "
    "SELECT track_id, arg_min(name, frame_num) AS name, min(frame_num) AS frame_num FROM r WHERE total >= 5 AND span >= 333000 AND votes >= 0.6 "
    "* total GROUP BY track_id",
)
def w15(t: Tables):
    """Our definition: the first frame at which a name has 60 % of at least 5 votes over at least 333 ms locks it."""
    track = Window.partitionBy("track_id")
    r = t.crops.withColumn("name", c("camera_id") % 3)
    r = r.withColumns({"votes": F.count("*").over(Window.partitionBy("track_id", "name").orderBy("frame_num")), "total": F.count("*").over(track.orderBy("frame_num")), "span": c("us") - F.min("us").over(track)})
    lock = r.where("total >= 5 and span >= 333000 and votes >= 0.6 * total")
    return lock.groupBy("track_id").agg(F.min_by("name", "frame_num").alias("name"), F.min("frame_num").alias("frame_num"))


@op("w17_latest", "SELECT camera_id, arg_max(value, id) AS value FROM observations GROUP BY camera_id")
def w17(t: Tables):
    return latest_per_key(t.observations.select("camera_id", "value", "id"), ["camera_id"], "id").drop("id")


def _fold(source: str, key: str, cooldown: int) -> str:
    return f"WITH RECURSIVE o AS (SELECT {key} AS k, us FROM {source}), r AS (SELECT k, min(us) AS us FROM o GROUP BY k UNION ALL SELECT r.k, (SELECT min(o.us) FROM o WHERE o.k = r.k AND o.us >= r.us + {cooldown}) AS us FROM r WHERE r.us IS NOT NULL) SELECT k AS {key}, us FROM r WHERE us IS NOT NULL"


@op("st3_throttle", _fold("observations", "user_id", 21600000000))
def st3(t: Tables):
    """A cooldown of six hours per user, counted from what was emitted."""
    return greedy_throttle(t.observations, "user_id", "us", 21_600_000_000)


@op("sk12_snapshots", _fold("observations", "camera_id", 7200000000))
def sk12(t: Tables):
    """Snapshots at most every two hours per camera, as a writer's trigger makes them (the testbed is slow)."""
    return greedy_throttle(t.observations, "camera_id", "us", 7_200_000_000)


@op("st4_identity_throttle", _fold("observations WHERE event_type <> 'error'", "camera_id", 7200000000))
def st4(t: Tables):
    """Claims across cameras: cancelled ones (here: errors) never count."""
    return greedy_throttle(t.observations.where("event_type <> 'error'"), "camera_id", "us", 7_200_000_000)


@op("st5_gate_order", _fold("crops WHERE height >= 200 AND width >= 80 AND track_id % 7 <> 0", "track_id", 21600000000))
def st5(t: Tables):
    """Size gate and user lookup before the throttle: what they reject must not start a cooldown."""
    known = t.users.where("id % 7 <> 0").select(c("id").alias("track_id"))
    return greedy_throttle(size_gate(t.crops, 200, 80, 0).join(known, "track_id", "left_semi"), "track_id", "us", 21_600_000_000)


@op(
    "st10_lifecycle",
    "SELECT user_id, session::BIGINT AS session, min(us) AS first_us, max(us) AS last_us, count(*) AS n FROM (SELECT user_id, us, sum(new) OVER "
    "(PARTITION BY user_id ORDER BY us) AS session FROM (SELECT user_id, us, CASE WHEN us - lag(us) OVER (PARTITION BY user_id ORDER BY us) < "
    "28800000000 THEN 0 ELSE 1 END AS new FROM observations)) GROUP BY ALL",
)
def st10(t: Tables):
    """A track ends after eight idle hours."""
    return sessions(t.observations, "user_id", "us", 28_800_000_000)


@op("st12_fair_share", "SELECT id, (row_number() OVER (ORDER BY id) - 1) % 3 AS replica, least(4, ceil(count(*) OVER () / 3))::BIGINT AS share FROM cameras")
def st12(t: Tables):
    """Cameras dealt to three replicas; a share is at most its capacity of four. Ranks inside buckets of ids, plus the counts of the buckets before."""
    rows = t.cameras.select("id", F.floor(c("id") / 1_000_000).alias("bucket"))
    rows = rows.withColumn("n", F.row_number().over(Window.partitionBy("bucket").orderBy("id")))
    sizes = rows.groupBy("bucket").agg(F.count("*").alias("k"))
    w = Window.orderBy("bucket")  # a row for each million ids
    before = sizes.select("bucket", (F.sum("k").over(w) - c("k")).alias("base"), F.sum("k").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("all"))
    place = c("n") + c("base") - 1
    return rows.join(before, "bucket").select("id", (place % 3).cast("long").alias("replica"), F.least(F.lit(4), F.ceil(c("all") / 3)).cast("long").alias("share"))


_merge = "SELECT DISTINCT id AS a, into_id AS b FROM users WHERE into_id IS NOT NULL"


@op(
    "st13_track_merge",
    f"WITH RECURSIVE e AS (SELECT a, b FROM ({_merge}) UNION SELECT b, a FROM ({_merge})), r AS (SELECT a AS id, a AS reach FROM e UNION SELECT "
    "r.id, e.b FROM r JOIN e ON r.reach = e.a) SELECT id, min(reach) AS root FROM r GROUP BY id",
)
def st13(t: Tables):
    """Merges are links; the smallest id of a component takes over."""
    edges = t.users.where("into_id is not null").select(c("id").alias("a"), c("into_id").alias("b"))
    return connected_components(edges, contract=True).select(c("node").alias("id"), "root")


@op(
    "st15_prototypes",
    "SELECT label, dim, round(list_reduce(list(x ORDER BY id), lambda a, x: 0.8 * a + 0.2 * x), 6) AS value FROM (SELECT id, label, "
    "unnest(range(len(embedding))) AS dim, unnest(embedding)::DOUBLE AS x FROM face_embeddings) GROUP BY label, dim",
)
def st15(t: Tables):
    """Our definition: p <- 0.8 p + 0.2 x in order of ids, in every dimension. Unrolled, the weight of a row is a power of its place from the end, so it is a grouped sum."""
    turned = t.face_embeddings.select("label", "id", "embedding", (-c("id")).alias("turned"))
    rows = numbered(deal(turned, ["label"], ["turned"]), "back").withColumn("back", c("back") - 1)
    rows = rows.join(turned.groupBy("label").agg(F.count("*").alias("n")), "label")
    weight = F.pow(F.lit(0.8), c("back")) * F.when(c("back") == c("n") - 1, 1.0).otherwise(0.2)
    each = rows.select("label", weight.alias("weight"), F.posexplode("embedding").alias("dim", "x"))
    sums = each.groupBy("label", "dim").agg(F.round(F.sum(c("weight") * c("x").cast("double")), 6).alias("value"))
    return sums.select("label", c("dim").cast("long").alias("dim"), "value")


@op(
    "st15_closest",
    "SELECT label, id, n FROM (SELECT label, id, row_number() OVER (PARTITION BY label ORDER BY round(s, 9) DESC, id) AS n FROM (SELECT f.label, "
    "f.id, list_sum(list_transform(list_zip(f.embedding, p.embedding), lambda z: z[1]::DOUBLE * z[2]::DOUBLE)) AS s FROM face_embeddings f JOIN "
    "(SELECT label, arg_max(embedding, id) AS embedding FROM face_embeddings GROUP BY label) p ON f.label = p.label)) WHERE n <= 5",
)
def st15_closest(t: Tables):
    """The five embeddings of a track that are closest to its last one."""
    e = t.face_embeddings.select("label", "id", "embedding")
    last = e.groupBy("label").agg(F.max_by("embedding", "id").alias("last"))
    scored = e.join(last, "label").select("label", "id", F.round(dot(c("embedding"), c("last")), 9).alias("s"))
    top = top_per_key(scored, ["label"], [F.desc("s"), c("id")], 5)
    return top.select("label", "id", F.row_number().over(Window.partitionBy("label").orderBy(F.desc("s"), "id")).cast("long").alias("n"))


@op("st16_ring_slots", "SELECT id, greatest(3, ceil((id % 7 + 0.5) / (0.1 + id % 3 * 0.2)))::BIGINT AS slots FROM cameras")
def st16(t: Tables):
    return t.cameras.select("id", F.greatest(F.lit(3), F.ceil((c("id") % 7 + 0.5) / (0.1 + c("id") % 3 * 0.2))).cast("long").alias("slots"))


@op("st17_expiry_per_method", "SELECT id FROM observations WHERE id * 37 % 40000 <= CASE event_type WHEN 'error' THEN 30000 ELSE 1000 END")
def st17(t: Tables):
    limit = F.when(c("event_type") == "error", 30_000).otherwise(1_000)
    return t.observations.where(c("id") * 37 % 40_000 <= limit).select("id")


@op(
    "st21_outcomes",
    "SELECT crop_id, CASE WHEN parse_failure THEN 'parse_fail' WHEN failed THEN 'error' WHEN latency_s > 1.2 THEN 'timeout' ELSE 'ok' END AS "
    "status, CASE WHEN NOT failed AND latency_s <= 1.2 THEN pred END AS recorded FROM predictions",
)
def st21(t: Tables):
    status = F.when(c("parse_failure"), "parse_fail").when(c("failed"), "error").when(c("latency_s") > 1.2, "timeout").otherwise("ok")
    return t.predictions.select("crop_id", status.alias("status"), F.when(status == "ok", c("pred")).alias("recorded"))


_boxes = "(SELECT camera_id, frame_num * 1000000 + box AS us FROM boxes)"


@op(
    "st3_positions",
    "SELECT camera_id, us, (x1 + x2) / 2 AS x, y2 AS y FROM (SELECT *, frame_num * 1000000 + box AS us FROM boxes) SEMI JOIN "
    f"({_fold(_boxes, 'camera_id', 60000000)}) USING (camera_id, us)",
)
def positions(t: Tables):
    """Foot points of throttled tracks."""
    x, y = foot_point(c("x1"), c("x2"), c("y2"))
    rows = t.boxes.select("camera_id", (c("frame_num") * 1_000_000 + c("box")).alias("us"), x.alias("x"), y.alias("y"))
    kept = greedy_throttle(rows, "camera_id", "us", 60_000_000)
    return rows.join(kept, ["camera_id", "us"], "left_semi")
