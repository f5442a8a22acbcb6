"""Joins (J), sorts and set operations (T) as queries."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trailmark.functions.columns import band, dot, hundredths
from trailmark.operators.matching import near_pairs
from trailmark.operators.pruned import best_match
from trailmark.operators.ranges import deal, numbered
from trailmark.operators.sequences import top_per_key

from .scans_sinks import apps
from .views import Tables, op

c = F.col


@op("j1_cast_key", "SELECT f.id, u.full_name FROM face_embeddings f JOIN users u ON f.user_id = u.id::VARCHAR")
def j1(t: Tables):
    return t.face_embeddings.join(t.users.select(c("id").cast("string").alias("user_id"), "full_name"), "user_id").select("id", "full_name")


@op("j2_left", "SELECT k.id, b.code FROM cameras k LEFT JOIN branches b ON k.branch_id = b.id")
def j2(t: Tables):
    b = t.branches.select(c("id").alias("branch_id"), "code")
    return t.cameras.join(b, "branch_id", "left").select("id", "code")


_dot = "list_sum(list_transform(list_zip(q.embedding, g.embedding), lambda z: z[1]::DOUBLE * z[2]::DOUBLE))"


@op(
    "j3_best_match",
    f"SELECT id AS query_id, arg_max(gid, (s, -gid)) AS gallery_id, round(max(s), 6) AS similarity FROM (SELECT q.id, g.id AS gid, round({_dot}, 9) AS s "
    "FROM face_embeddings q, face_embeddings g WHERE q.id % 50 = 0 AND g.id <> q.id) GROUP BY id",
)
def j3(t: Tables):
    """Every fiftieth embedding against all others, in the cells of the gallery that can hold its best match."""
    e = t.face_embeddings.select("id", "embedding")
    return best_match(e.where("id % 50 = 0"), e, but_itself=True).best.withColumn("similarity", F.round("similarity", 6))


@op(
    "j4_reid_candidates",
    "SELECT q.id, g.id AS other FROM face_embeddings q JOIN face_embeddings g ON g.label = q.label AND g.id < q.id AND q.id - g.id <= 60 "
    f"AND (q.id % 10 <> g.id % 10 OR q.id - g.id >= 10) WHERE {_dot} >= 0.3",
)
def j4(t: Tables):
    """The testbed's vectors are random, so from 0.3 on here; real ones from 0.7 on."""
    return reid_candidates(t.face_embeddings, 0.3)


def reid_candidates(rows, least: float = 0.7):
    """(id, other): same label, seen at most 60 s before (ids stand for seconds), and 10 s at least on the same camera. The band is
    an equi-join on minutes, the one of the query and the one before."""
    e = rows.select("id", "label", "embedding").withColumn("minute", F.floor(c("id") / 60))
    g = e.select(c("id").alias("other"), "label", c("embedding").alias("g"), F.explode(F.array(c("minute"), c("minute") + 1)).alias("minute"))
    near = e.join(g, ["label", "minute"]).where("other < id and id - other <= 60 and (id % 10 <> other % 10 or id - other >= 10)")
    return near.where(dot(c("embedding"), c("g")) >= least).select("id", "other")


@op(
    "j5_added_and_removed",
    "SELECT id, 'added' AS change FROM users u WHERE employment_status = 'active' AND branch_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM face_embeddings f WHERE f.user_id "
    "= u.id::VARCHAR) UNION ALL SELECT f.id, 'removed' FROM face_embeddings f WHERE NOT EXISTS (SELECT 1 FROM users u WHERE u.id::VARCHAR = "
    "f.user_id AND employment_status = 'active')",
)
def j5(t: Tables):
    """Active users with images (here: those with a branch) that the gallery lacks; gallery rows whose user is gone, repeats included."""
    known = t.users.where("employment_status = 'active'").select("id", c("id").cast("string").alias("user_id"), "branch_id")
    faces = t.face_embeddings.select("id", "user_id")
    added = known.where("branch_id is not null").join(faces.select("user_id"), "user_id", "left_anti").select("id", F.lit("added").alias("change"))
    return added.union(faces.join(known.select("user_id"), "user_id", "left_anti").select("id", F.lit("removed")))


_want = "SELECT CAST(id % 211 AS VARCHAR) AS user_id, 'https://store/img' || (id * 7 % 53) || '.jpg' AS image_url_norm FROM users WHERE employment_status = 'active'"


@op(
    "j6_gallery_sync",
    f"WITH want AS (SELECT DISTINCT * FROM ({_want})), have AS (SELECT DISTINCT user_id, image_url_norm FROM face_embeddings) SELECT user_id, "
    "image_url_norm, 'missing' AS what FROM (FROM want EXCEPT FROM have) UNION ALL SELECT user_id, image_url_norm, CASE WHEN user_id IN (SELECT "
    "user_id FROM want) THEN 'stale image' ELSE 'stale user' END FROM (FROM have EXCEPT FROM want)",
)
def j6(t: Tables):
    keys = ["user_id", "image_url_norm"]
    image = F.concat(F.lit("https://store/img"), (c("id") * 7 % 53).cast("string"), F.lit(".jpg"))
    want = t.users.where("employment_status = 'active'").select((c("id") % 211).cast("string").alias("user_id"), image.alias("image_url_norm")).distinct()
    have = t.face_embeddings.select(*keys).distinct()
    missing = want.join(have, keys, "left_anti").withColumn("what", F.lit("missing"))
    people = want.select("user_id").distinct().withColumn("_known", F.lit(True))
    stale = have.join(want, keys, "left_anti").join(people, "user_id", "left")
    return missing.unionByName(stale.select(*keys, F.when(c("_known"), "stale image").otherwise("stale user").alias("what")))


@op("j7_homography_lookup", "SELECT b.frame_num, b.box, CASE WHEN camera_id < 6 THEN camera_id + 100 END AS map_id FROM boxes b")
def j7(t: Tables):
    maps = t.cameras.where("id < 6").select(c("id").alias("camera_id"), (c("id") + 100).alias("map_id"))
    return t.boxes.join(maps, "camera_id", "left").select("frame_num", "box", "map_id")


@op(
    "j8_positional_zip",
    "SELECT camera_id, count(*) AS n, sum(id * (us % 1000))::BIGINT AS checksum FROM observations WHERE camera_id % 3 <> 0 AND event_type = "
    "'signup' GROUP BY camera_id",
)
def j8(t: Tables):
    """Results and regions by index; cameras whose lists differ in length (here: divisible by 3) lose all of them."""
    rows = numbered(deal(t.observations.where("event_type = 'signup'").select("camera_id", "id", "us"), ["camera_id"], ["id"]), "n").select("camera_id", "id", "us", "n")
    shifted = F.when(c("camera_id") % 3 == 0, c("n") - 1).otherwise(c("n"))  # a list that lacks its first region
    zipped = rows.select("camera_id", "n", "id").join(rows.select("camera_id", shifted.alias("n"), "us").where("n > 0"), ["camera_id", "n"], "outer")
    whole = (F.count("id") == F.count("us")) & (F.count("id") == F.count("*"))
    sums = zipped.groupBy("camera_id").agg(F.count("*").alias("n"), F.sum(c("id") * (c("us") % 1000)).alias("checksum"), whole.alias("whole"))
    return sums.where("whole").drop("whole")


@op(
    "j9_duplicate_tracks",
    "SELECT q.id AS keep, g.id AS merge FROM face_embeddings q JOIN face_embeddings g ON q.image_url_norm = g.image_url_norm AND q.id < g.id "
    f"WHERE 1 - {_dot} <= 0.6",
)
def j9(t: Tables):
    return near_pairs(t.face_embeddings, "image_url_norm", 0.6).select(c("a").alias("keep"), c("b").alias("merge"))


@op(
    "j10_current_labels",
    "SELECT p.crop_id, p.pred, CASE WHEN l.quality = 1 THEN 'working' ELSE 'other' END AS truth FROM predictions p JOIN labels l ON l.doc_id = "
    "p.crop_id",
)
def j10(t: Tables):
    now = t.labels.select(c("doc_id").alias("crop_id"), F.when(c("quality") == 1, "working").otherwise("other").alias("truth"))
    return t.predictions.drop("truth").join(now, "crop_id").select("crop_id", "pred", "truth")


@op(
    "j11_full_outer",
    "SELECT coalesce(a.user_id, b.user_id) AS user_id, coalesce(a.day, b.day) AS day, a.n AS purchases, b.n AS errors FROM (SELECT user_id, us // 86400000000 AS day, count(*) AS n FROM "
    "observations WHERE event_type = 'purchase' GROUP BY ALL) a FULL JOIN (SELECT user_id, us // 86400000000 AS day, count(*) AS n FROM observations WHERE event_type = 'error' GROUP BY ALL) b "
    "ON a.user_id = b.user_id AND a.day = b.day",
)
def j11(t: Tables):
    """Purchases and errors of users by day; some days have only one of them."""
    day = F.floor(c("us") / 86_400_000_000).alias("day")
    n = lambda kind, name: t.observations.where(c("event_type") == kind).groupBy("user_id", day).agg(F.count("*").alias(name))
    return n("purchase", "purchases").join(n("error", "errors"), ["user_id", "day"], "outer")


@op(
    "j12_locked_elsewhere",
    "SELECT id FROM face_embeddings a WHERE EXISTS (SELECT 1 FROM face_embeddings b WHERE b.user_id = a.user_id AND b.id <> a.id AND b.label = "
    "a.label)",
)
def j12(t: Tables):
    e = t.face_embeddings.select("id", "user_id", "label")
    n = e.groupBy("user_id", "label").agg(F.count_distinct("id").alias("n")).where("n > 1")
    return e.join(n, ["user_id", "label"], "left_semi").select("id")


@op("t1_order", "SELECT id, full_name FROM users ORDER BY full_name, id")
def t1(t: Tables):
    return t.users.select("id", "full_name").orderBy("full_name", "id")


@op("t2_last_row", "SELECT id, status FROM observations WHERE user_id = 7 ORDER BY id DESC LIMIT 1")
def t2(t: Tables):
    return t.observations.where("user_id = 7").orderBy(F.desc("id")).limit(1).select("id", "status")


@op("t3_most_common", "SELECT user_id, count(*) AS n FROM observations GROUP BY 1 ORDER BY n DESC, user_id LIMIT 12")
def t3(t: Tables):
    return t.observations.groupBy("user_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "user_id").limit(12)


@op("t4_union_by_name", "SELECT id, full_name, NULL AS name FROM users UNION ALL SELECT id, NULL, name FROM cameras")
def t4(t: Tables):
    return t.users.select("id", "full_name").unionByName(t.cameras.select("id", "name"), allowMissingColumns=True)


@op(
    "t5_cameras_per_application",
    "SELECT id, app, count(*) OVER (PARTITION BY id) > 1 AS duplicate FROM (SELECT id, unnest(CASE WHEN application LIKE '[%' THEN "
    "from_json(application, '[\"VARCHAR\"]') ELSE [application] END) AS app FROM cameras WHERE application IS NOT NULL)",
)
def t5(t: Tables):
    rows = t.cameras.where("application is not null").select("id", F.explode(apps(c("application"))).alias("app"))
    return rows.withColumn("duplicate", F.count("*").over(Window.partitionBy("id")) > 1)


@op(
    "t6_set_difference",
    "WITH a AS (SELECT DISTINCT user_id FROM observations WHERE event_type = 'signup'), b AS (SELECT DISTINCT user_id FROM observations WHERE event_type = 'error') "
    "SELECT user_id, 'gone' AS change FROM (FROM a EXCEPT FROM b) UNION ALL SELECT user_id, 'stays' FROM (FROM a INTERSECT FROM b)",
)
def t6(t: Tables):
    a, b = [t.observations.where(c("event_type") == kind).select("user_id") for kind in ("signup", "error")]
    return a.subtract(b).withColumn("change", F.lit("gone")).union(a.intersect(b).withColumn("change", F.lit("stays")))


@op(
    "t7_alerts",
    "SELECT id, 'LOW_FPS' AS type, printf('Camera %s FPS=%.2f is below threshold (3.5)', name, fps_raw / 1000) AS message FROM cameras WHERE "
    "fps_raw / 1000 > 0 AND fps_raw / 1000 < 3.5 UNION ALL SELECT id, 'GPU_MEMORY_HIGH', printf('GPU VRAM at %d%%', id % 100) FROM cameras WHERE "
    "id % 100 > 90 UNION ALL SELECT id, 'RAM_HIGH', printf('System RAM at %d%%', id * 7 % 100) FROM cameras WHERE id * 7 % 100 > 90",
)
def t7(t: Tables):
    """Strictly beyond each bound; a rate of 0 means a camera that has only begun."""
    k = t.cameras.withColumn("fps", c("fps_raw") / 1000)
    low = k.where("fps > 0 and fps < 3.5").select("id", F.lit("LOW_FPS").alias("type"), F.concat(F.lit("Camera "), F.coalesce("name", F.lit("null")), F.lit(" FPS="), hundredths(c("fps")), F.lit(" is below threshold (3.5)")).alias("message"))
    gpu = k.where("id % 100 > 90").select("id", F.lit("GPU_MEMORY_HIGH"), F.format_string("GPU VRAM at %d%%", c("id") % 100))
    return low.union(gpu).union(k.where("id * 7 % 100 > 90").select("id", F.lit("RAM_HIGH"), F.format_string("System RAM at %d%%", c("id") * 7 % 100)))


@op(
    "t8_banding",
    "SELECT id, CASE WHEN id % 100 >= 90 THEN 'bad' WHEN id % 100 >= 70 THEN 'warn' ELSE 'ok' END AS cpu, CASE WHEN id % 100 >= 90 THEN 'bad' "
    "WHEN id % 100 >= 75 THEN 'warn' ELSE 'ok' END AS ram FROM cameras",
)
def t8(t: Tables):
    x = c("id") % 100
    return t.cameras.select("id", band(x, 70, 90).alias("cpu"), band(x, 75, 90).alias("ram"))


def variant_scores(predictions):
    """Per variant: accuracy (no answer is wrong), mean recall of the classes, latency, failures."""
    right = (F.coalesce(c("pred"), F.lit("")) == c("truth")).cast("double")
    per_class = predictions.groupBy("variant", "truth").agg(F.avg(right).alias("recall"), F.sum(right).alias("hits"), F.count("*").alias("n"), F.sum("latency_s").alias("latency"), F.sum(c("parse_failure").cast("long")).alias("parse"))
    return per_class.groupBy("variant").agg((F.sum("hits") / F.sum("n")).alias("accuracy"), F.avg("recall").alias("balanced"), (F.sum("latency") / F.sum("n")).alias("latency"), F.sum("parse").alias("parse_failures"))


_scores = "SELECT variant, sum(hits) / sum(n) AS accuracy, avg(recall) AS balanced, sum(latency) / sum(n) AS latency, sum(parse) AS parse_failures FROM (SELECT variant, truth, avg(CASE WHEN pred = truth THEN 1.0::DOUBLE ELSE 0 END) AS recall, sum(CASE WHEN pred = truth THEN 1.0::DOUBLE ELSE 0 END) AS hits, count(*) AS n, sum(latency_s) AS latency, sum(parse_failure::INT) AS parse FROM predictions GROUP BY ALL) GROUP BY variant"


@op(
    "t9_regression_gate",
    f"WITH s AS ({_scores}) SELECT s.variant, s.accuracy > b.accuracy AND s.balanced > b.balanced AND s.latency <= 1.1 * b.latency AND "
    "s.parse_failures <= b.parse_failures AS ship FROM s, s b WHERE b.variant = 0",
)
def t9(t: Tables):
    s = variant_scores(t.predictions)
    base = F.broadcast(s.where("variant = 0").select(*[c(x).alias(f"b_{x}") for x in ("accuracy", "balanced", "latency", "parse_failures")]))  # one row
    ship = (c("accuracy") > c("b_accuracy")) & (c("balanced") > c("b_balanced")) & (c("latency") <= 1.1 * c("b_latency")) & (c("parse_failures") <= c("b_parse_failures"))
    return s.join(base).select("variant", ship.alias("ship"))


@op(
    "w10_top_boxes",
    "SELECT frame_num, box, area FROM (SELECT *, row_number() OVER (PARTITION BY camera_id ORDER BY frame_num, box, area DESC, x1, y1) AS m FROM "
    "(SELECT *, (x2 - x1) * (y2 - y1) AS area, row_number() OVER (PARTITION BY frame_num ORDER BY (x2 - x1) * (y2 - y1) DESC, box, x1, y1) AS n "
    "FROM boxes) WHERE n <= 8) WHERE m <= 60",
)
def w10(t: Tables):
    rows = t.boxes.withColumn("area", (c("x2") - c("x1")) * (c("y2") - c("y1")))
    largest = top_per_key(rows, ["frame_num"], [F.desc("area"), c("box"), c("x1"), c("y1")], 8)
    return top_per_key(largest, ["camera_id"], [c("frame_num"), c("box"), F.desc("area"), c("x1"), c("y1")], 60).select("frame_num", "box", "area")
