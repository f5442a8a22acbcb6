"""Projections (P), gates (F) and vector functions (V) as queries."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trailmark.functions import columns as K
from trailmark.operators.ranges import deal, frame, numbered, with_halo

from .scans_sinks import BRANCH, apps, in_branch_or_free
from .views import Tables, op

c = F.col


@op(
    "p1_detections",
    "SELECT frame_num, box, row_number() OVER (PARTITION BY frame_num ORDER BY box, l_partkey, x1, y1, x2, confidence) - 1 AS ordinal, "
    "confidence FROM boxes WHERE class_id = 0",
)
def p1(t: Tables):
    order = F.row_number().over(Window.partitionBy("frame_num").orderBy("box", "l_partkey", "x1", "y1", "x2", "confidence")) - 1
    return t.boxes.where("class_id = 0").select("frame_num", "box", order.cast("long").alias("ordinal"), "confidence")


def clipped(rows, width: int = 640, height: int = 480):
    """Truncated to whole numbers first, then into the frame."""
    limit = {"x1": width, "x2": width, "y1": height, "y2": height}
    return rows.withColumns({k: F.greatest(F.lit(0), F.least(F.lit(n), c(k).cast("int"))) for k, n in limit.items()})


_clip = "SELECT frame_num, box, " + ", ".join(f"greatest(0, least({n}, trunc({k})::INT)) AS {k}" for k, n in (("x1", 640), ("y1", 480), ("x2", 640), ("y2", 480))) + " FROM boxes"


@op("p2_clamp", _clip)
def p2(t: Tables):
    return clipped(t.boxes).select("frame_num", "box", "x1", "y1", "x2", "y2")


@op("p3_not_empty", f"SELECT * FROM ({_clip}) WHERE x2 > x1 AND y2 > y1")
def p3(t: Tables):
    return p2(t).where("x2 > x1 and y2 > y1")


@op("p4_foot_point", "SELECT frame_num, box, (x1 + x2) / 2 AS foot_x, y2 AS foot_y FROM boxes")
def p4(t: Tables):
    x, y = K.foot_point(c("x1"), c("x2"), c("y2"))
    return t.boxes.select("frame_num", "box", x.alias("foot_x"), y.alias("foot_y"))


_w = "(0.001 * x1 - 0.0005 * y1 + camera_id)"


@op(
    "p5_project",
    f"SELECT frame_num, box, CASE WHEN {_w} = 0 THEN 0 ELSE round((2 * x1 + 0.1 * y1 + 10) / {_w}, 6) END AS px, CASE WHEN {_w} = 0 THEN 0 ELSE "
    f"round((0.2 * x1 + 3 * y1 - 5) / {_w}, 6) END AS py FROM boxes",
)
def p5(t: Tables):
    h = F.array(F.array(F.lit(2.0), F.lit(0.1), F.lit(10.0)), F.array(F.lit(0.2), F.lit(3.0), F.lit(-5.0)), F.array(F.lit(0.001), F.lit(-0.0005), c("camera_id").cast("double")))
    x, y = K.project(h, c("x1"), c("y1"))
    return t.boxes.select("frame_num", "box", F.round(x, 6).alias("px"), F.round(y, 6).alias("py"))


@op(
    "p6_camera_config",
    "SELECT id, upper(camera_type) AS type, coalesce(nullif(matching_threshold, 0), 0.3) AS threshold, CASE WHEN id % 2 = 0 THEN [id, id + 1, id "
    "+ 2, id + 3] END::VARCHAR AS roi FROM cameras",
)
def p6(t: Tables):
    points = F.when(c("id") % 2 == 0, F.array(F.array(c("id"), c("id") + 1), F.array(c("id") + 2, c("id") + 3))).otherwise(F.array(F.array(c("id"))))
    roi = F.when(F.size(points) >= 2, F.concat(F.get(points, 0), F.get(points, 1)))
    return t.cameras.select("id", F.upper("camera_type").alias("type"), F.coalesce(F.nullif("matching_threshold", F.lit(0.0)), F.lit(0.3)).alias("threshold"), roi.cast("string").alias("roi"))


@op(
    "p7_stream_url",
    "SELECT id, CASE WHEN regexp_replace(lower(name), '[^a-z0-9]', '', 'g') <> '' THEN 'rtsp://edge:8554/' || regexp_replace(lower(name), "
    "'[^a-z0-9]', '', 'g') END AS by_slug, 'rtsp://edge:8554/' || id AS by_id FROM cameras",
)
def p7(t: Tables):
    base = F.lit("rtsp://edge:8554/")
    return t.cameras.select("id", F.when(K.slug(c("name")) != "", F.concat(base, K.slug(c("name")))).alias("by_slug"), F.concat(base, c("id").cast("string")).alias("by_id"))


@op("p8_slug", "SELECT full_name, regexp_replace(lower(full_name), '[^a-z0-9]', '', 'g') AS slug FROM users")
def p8(t: Tables):
    return t.users.select("full_name", K.slug(c("full_name")).alias("slug"))


@op("p9_partition_key", "SELECT id, 'cam.' || camera_id AS queue FROM observations")
def p9(t: Tables):
    return t.observations.select("id", F.concat(F.lit("cam."), c("camera_id").cast("string")).alias("queue"))


@op(
    "p10_branch",
    "SELECT o.id, coalesce(k.branch_id, u.branch_id) AS branch_id FROM observations o LEFT JOIN cameras k ON k.id = o.camera_id LEFT JOIN users "
    "u ON u.id = o.user_id",
)
def p10(t: Tables):
    return with_branch(t.observations, t).select("id", "branch_id")


def with_branch(rows, t: Tables):
    """The camera's branch, else the user's, else null."""
    cam, user = t.cameras.select(c("id").alias("camera_id"), c("branch_id").alias("_cb")), t.users.select(c("id").alias("user_id"), c("branch_id").alias("_ub"))
    return rows.join(cam, "camera_id", "left").join(user, "user_id", "left").withColumn("branch_id", F.coalesce("_cb", "_ub")).drop("_cb", "_ub")


@op("p11_status_fold", "SELECT lower(status) AS status, count(*) AS n FROM observations GROUP BY 1")
def p11(t: Tables):
    return t.observations.groupBy(F.lower("status").alias("status")).agg(F.count("*").alias("n"))


_iso = "CASE id % 3 WHEN 0 THEN '2024-01-02T03:04:05Z' WHEN 1 THEN '2024-05-06T07:08:09+00:00' ELSE 'yesterday' END"


@op(
    "p12_iso_parse",
    "SELECT id, coalesce(epoch_us(CASE id % 3 WHEN 0 THEN TIMESTAMP '2024-01-02 03:04:05' WHEN 1 THEN TIMESTAMP '2024-05-06 07:08:09' END), us) "
    "AS us FROM observations",
)
def p12(t: Tables):
    parsed = F.try_to_timestamp(F.replace(F.expr(_iso), F.lit("Z"), F.lit("+00:00")))
    return t.observations.select("id", F.coalesce(F.unix_micros(parsed), c("us")).alias("us"))


@op("p13_utc_format", "SELECT id, strftime(make_timestamp(us), '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS at FROM observations")
def p13(t: Tables):
    return t.observations.select("id", F.date_format(F.timestamp_micros("us"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("at"))


@op("p14_url_norm", "SELECT page_id, regexp_replace(regexp_replace(url, '[?#].*$', ''), ';[^/]*$', '') AS url_norm FROM pages")
def p14(t: Tables):
    return t.pages.select("page_id", K.url_norm(c("url")).alias("url_norm"))


@op("p15_storage_uri", "SELECT page_id, 'gs://bucket/a ' || page_id || '+b.jpg' AS uri FROM pages")
def p15(t: Tables):
    url = F.concat(F.lit("https://storage.googleapis.com/bucket/a%20"), c("page_id").cast("string"), F.lit("+b.jpg?sig=1"))
    return t.pages.select("page_id", K.storage_uri(url).alias("uri"))


@op(
    "p16_image_urls",
    "SELECT id, CASE WHEN id % 4 < 2 THEN 'u' || id END AS original, CASE WHEN id % 4 = 1 THEN 't' || id END AS thumb FROM users WHERE id % 4 < 2",
)
def p16(t: Tables):
    """Strings, objects and empty entries become array<struct<original, thumb>>."""
    blob = F.when(c("id") % 4 == 0, F.format_string('["u%d", "", null]', "id")).when(c("id") % 4 == 1, F.format_string('[{"original": "u%d", "thumb": "t%d"}, {}]', "id", "id")).when(c("id") % 4 == 2, "[]")
    entry = lambda x: F.when(x.startswith("{"), F.from_json(x, "original string, thumb string")).otherwise(F.struct(x.alias("original"), F.lit(None).cast("string").alias("thumb")))
    images = F.filter(F.transform(F.from_json(blob, "array<string>"), entry), lambda x: F.coalesce(x["original"], F.lit("")) != "")
    return t.users.select("id", F.explode(images).alias("image")).select("id", "image.original", "image.thumb")


_slug = "CASE id % 4 WHEN 0 THEN 'acme_' || id WHEN 1 THEN 'Acme' WHEN 2 THEN repeat('a', 64) ELSE 'a-b' END"


@op("p17_valid_slug", f"SELECT id, regexp_full_match({_slug}, '[a-z0-9_]+') AND length({_slug}) <= 63 AS valid, 'org_' || {_slug} AS schema_name FROM users")
def p17(t: Tables):
    s = F.expr(_slug)
    return t.users.select("id", K.valid_slug(s).alias("valid"), F.concat(F.lit("org_"), s).alias("schema_name"))


@op("p18_redact", "SELECT id, CASE WHEN id % 2 = 0 THEN 'redis://***@host/' || id ELSE 'redis://host/' || id END AS url FROM users")
def p18(t: Tables):
    url = F.when(c("id") % 2 == 0, F.concat(F.lit("redis://me:pw@host/"), c("id").cast("string"))).otherwise(F.concat(F.lit("redis://host/"), c("id").cast("string")))
    return t.users.select("id", K.redact_credentials(url).alias("url"))


@op(
    "p19_envelope",
    "SELECT id, '{\"event_type\":\"' || event_type || '\",\"version\":\"1.0\",\"data\":{\"user_id\":' || user_id || '}}' AS event FROM "
    "observations",
)
def p19(t: Tables):
    """Without the random id and the time of sending."""
    return t.observations.select("id", F.to_json(F.struct("event_type", F.lit("1.0").alias("version"), F.struct("user_id").alias("data"))).alias("event"))


#: Recognised activities and their types at the backend.
BACKEND_TYPE = {"sleeping": "sleeping", "using phone": "phone_usage", "working with computer": "working", "talking with someone": "talking", "idle": "unknown"}


@op(
    "p20_backend_type",
    "SELECT crop_id, variant, CASE pred WHEN 'working' THEN 'working' WHEN 'phone' THEN 'phone_usage' WHEN 'idle' THEN 'unknown' END AS "
    "backend_type FROM predictions",
)
def p20(t: Tables):
    full = F.when(c("pred") == "working", "working with computer").when(c("pred") == "phone", "using phone").otherwise(c("pred"))
    kinds = F.create_map(*[F.lit(x) for pair in BACKEND_TYPE.items() for x in pair])
    return t.predictions.select("crop_id", "variant", F.when(full.isNotNull(), F.try_element_at(kinds, full)).alias("backend_type"))


@op("p21_label_remap", "SELECT crop_id, CASE WHEN variant = 2 AND truth = 'phone' THEN 'idle' ELSE truth END AS truth FROM predictions")
def p21(t: Tables):
    return t.predictions.select("crop_id", F.when((c("variant") == 2) & (c("truth") == "phone"), "idle").otherwise(c("truth")).alias("truth"))


@op("p22_area_aspect", "SELECT frame_num, box, (x2 - x1) * (y2 - y1) AS area, (y2 - y1) / nullif(x2 - x1, 0) AS aspect FROM boxes")
def p22(t: Tables):
    w, h = c("x2") - c("x1"), c("y2") - c("y1")
    return t.boxes.select("frame_num", "box", (w * h).alias("area"), (h / F.nullif(w, F.lit(0.0))).alias("aspect"))


@op("p23_content_hash", "SELECT doc_id, substr(sha1(text), 1, 12) AS h FROM documents")
def p23(t: Tables):
    return t.documents.select("doc_id", F.substr(F.sha1(c("text").cast("binary")), F.lit(1), F.lit(12)).alias("h"))


@op(
    "p25_label",
    "SELECT id, CASE WHEN id % 2 = 0 THEN 'L:' || user_id || ' G:' || (1000 + id) ELSE 'ID:' || user_id END || CASE WHEN id % 3 = 0 THEN ' | ' "
    "|| event_type || CASE WHEN id % 5 <> 0 THEN ' | ' || (id % 5) || '/5v' ELSE '' END ELSE '' END || CASE WHEN status = 'out' THEN ' | [out]' "
    "ELSE '' END AS label FROM observations",
)
def p25(t: Tables):
    text = lambda x: x.cast("string")
    ids = F.when(c("id") % 2 == 0, F.concat(F.lit("L:"), text(c("user_id")), F.lit(" G:"), text(c("id") + 1000))).otherwise(F.concat(F.lit("ID:"), text(c("user_id"))))
    known = c("id") % 3 == 0
    votes = F.when(known & (c("id") % 5 != 0), F.concat(text(c("id") % 5), F.lit("/5v")))
    return t.observations.select("id", F.concat_ws(" | ", ids, F.when(known, c("event_type")), votes, F.when(c("status") == "out", "[out]")).alias("label"))


@op(
    "p27_summary_line",
    "SELECT camera_id, string_agg(event_type || '=' || n, ' ' ORDER BY event_type) AS line FROM (SELECT camera_id, event_type, count(*) AS n "
    "FROM observations GROUP BY 1, 2) GROUP BY 1",
)
def p27(t: Tables):
    counts = t.observations.groupBy("camera_id", "event_type").agg(F.count("*").alias("n"))
    parts = F.array_sort(F.collect_list(F.concat_ws("=", "event_type", c("n").cast("string"))))
    return counts.groupBy("camera_id").agg(F.array_join(parts, " ").alias("line"))


@op("f1_active", "SELECT id FROM users WHERE employment_status = 'active'")
def f1(t: Tables):
    return t.users.where("employment_status = 'active'").select("id")


@op("f2_branch_scope_users", f"SELECT u.id FROM users u LEFT JOIN branches b ON u.branch_id = b.id WHERE lower(b.code) = '{BRANCH}' OR u.branch_id IS NULL")
def f2(t: Tables):
    return in_branch_or_free(t.users, t.branches, BRANCH).select("id")


@op("f3_branch_scope_cameras", f"SELECT k.id FROM cameras k LEFT JOIN branches b ON k.branch_id = b.id WHERE lower(b.code) = '{BRANCH}'")
def f3(t: Tables):
    b = F.broadcast(t.branches.where(F.lower("code") == BRANCH).select(c("id").alias("branch_id")))
    return t.cameras.join(b, "branch_id", "left_semi").select("id")


@op("f4_application", "SELECT id FROM cameras WHERE application = 'attendance' OR application LIKE '%\"activity\"%'")
def f4(t: Tables):
    return t.cameras.where(F.array_contains(apps(c("application")), "activity") | F.array_contains(apps(c("application")), "attendance") & (c("application") == "attendance")).select("id")


@op("f5_accept", "SELECT frame_num FROM crops WHERE frontality >= 0.5")
def f5(t: Tables):
    return t.crops.where("frontality >= 0.5").select("frame_num")


@op(
    "f6_face_gate",
    "SELECT frame_num, CASE WHEN frontality IS NULL OR frontality < 0.6 THEN 'frontality' WHEN pitch < 0.4 THEN 'pitch' END AS drop_reason FROM "
    "crops",
)
def f6(t: Tables):
    reason = F.when(F.coalesce(c("frontality"), F.lit(0.0)) < 0.6, "frontality").when(c("pitch") < 0.4, "pitch")
    return t.crops.select("frame_num", reason.alias("drop_reason"))


@op("f7_crop_size", "SELECT frame_num FROM crops WHERE height >= 200 AND width >= 80 AND height * width >= 16000")
def f7(t: Tables):
    return size_gate(t.crops, 200, 80, 16000).select("frame_num")


def size_gate(rows, height: int, width: int, area: int):
    """A bound of 0 is off; equal passes."""
    keep = F.lit(True)
    for value, least in ((c("height"), height), (c("width"), width), (c("height") * c("width"), area)):
        keep = keep & (value >= least) if least else keep
    return rows.where(keep)


@op("f8_quality", "SELECT frame_num FROM crops WHERE height >= 160 AND sharpness >= 100")
def f8(t: Tables):
    return t.crops.where("height >= 160 and sharpness >= 100").select("frame_num")


@op(
    "f9_reid_quality",
    "SELECT frame_num FROM crops WHERE height >= 80 AND width >= 40 AND height * width >= 3200 AND height::DOUBLE / width BETWEEN 1.5 AND 4.0 "
    "AND pitch >= 0.5",
)
def f9(t: Tables):
    return size_gate(t.crops, 80, 40, 3200).where((c("height") / c("width")).between(1.5, 4.0) & (c("pitch") >= 0.5)).select("frame_num")


@op("f10_frame_skip", "SELECT frame_num FROM crops WHERE frame_num % 3 = 0")
def f10(t: Tables):
    return t.crops.where("frame_num % 3 = 0").select("frame_num")


@op(
    "f11_nth_detection",
    "SELECT frame_num FROM (SELECT frame_num, row_number() OVER (PARTITION BY camera_id ORDER BY frame_num) AS n FROM crops WHERE frame_num % 3 "
    "= 0) WHERE n % 5 = 0",
)
def f11(t: Tables):
    """Every fifth of a camera's detection frames, by count."""
    frames = t.crops.where("frame_num % 3 = 0").select("camera_id", "frame_num")
    return numbered(deal(frames, ["camera_id"], ["frame_num"]), "n").where("n % 5 = 0").select("frame_num")


_urls = {0: ("https://storage.googleapis.com/b/o.jpg", "ok"), 1: ("ftp://storage.googleapis.com/x", "blocked scheme"), 2: ("http://LOCALHOST/x", "blocked host"), 3: ("http://10.1.2.3/x", "blocked range"), 4: ("http://8.8.8.8:80/x", "ok"), 5: ("https://evil.com/storage.googleapis.com", "domain not allowed"), 6: ("gs://bucket/x", "ok"), 7: ("gs://", "invalid bucket url"), 8: ("", "empty"), 9: ("http://u:p@172.31.0.1/", "blocked range"), 10: ("https://a.storage.cloud.google.com/x", "ok"), 11: ("http://[fe80::1]/", "blocked range")}


@op("f12_url_safety", "SELECT id, CASE id % 12 " + " ".join(f"WHEN {k} THEN '{v}'" for k, (_, v) in _urls.items()) + " END AS verdict FROM observations")
def f12(t: Tables):
    url = F.element_at(F.array(*[F.lit(u) for u, _ in _urls.values()]), (c("id") % 12 + 1).cast("int"))
    return t.observations.select("id", K.url_verdict(url).alias("verdict"))


@op("f13_deadline", "SELECT id, 500 + id % 500 - id * 7 % 900 AS left_ms FROM observations WHERE id % 10 = 0 OR id * 7 % 900 <= 500 + id % 500")
def f13(t: Tables):
    """Rows past their deadline drop out; the others carry the rest of their budget. Without a deadline (every tenth) a row never expires."""
    deadline, now = c("id") % 500 + 500, c("id") * 7 % 900
    return t.observations.where((c("id") % 10 == 0) | (now <= deadline)).select("id", (deadline - now).alias("left_ms"))


@op("f14_tenant", "SELECT id FROM observations WHERE id % 3 = 0 OR id % 3 = 1")
def f14(t: Tables):
    slug = F.when(c("id") % 3 == 1, "acme").when(c("id") % 3 == 2, "other")
    return t.observations.where(slug.isNull() | (slug == "acme")).select("id")


@op(
    "f15_duplicate_frames",
    "SELECT id FROM (SELECT id, id // 20 AS seq, lag(id // 20) OVER (PARTITION BY camera_id ORDER BY id) AS before FROM observations) WHERE "
    "before IS NULL OR before <> seq",
)
def f15(t: Tables):
    rows = t.observations.select("id", "camera_id", F.floor(c("id") / 20).alias("seq"))
    dealt = deal(rows, ["camera_id"], ["id"])
    return with_halo(dealt, 1).withColumn("before", F.lag("seq").over(frame(dealt))).where("not _halo").where("before is null or before <> seq").select("id")


@op("f16_persist_guard", "SELECT id FROM observations WHERE id % 7 - 3 >= 0")
def f16(t: Tables):
    return t.observations.where(c("id") % 7 - 3 >= 0).select("id")


@op(
    "f17_routes",
    "SELECT id, coalesce(application LIKE '%activity%', false) AS activity, coalesce(application LIKE '%unrecognized%', false) AS unrecognized "
    "FROM cameras",
)
def f17(t: Tables):
    has = lambda a: F.coalesce(F.array_contains(apps(c("application")), a), F.lit(False))
    return t.cameras.select("id", has("activity").alias("activity"), has("unrecognized").alias("unrecognized"))


@op("f18_recordable", "SELECT id FROM observations WHERE event_type IN ('click', 'view', 'purchase', 'signup') AND user_id <> 0 AND camera_id <> 0")
def f18(t: Tables):
    return t.observations.where(c("event_type").isin("click", "view", "purchase", "signup") & (c("user_id") != 0) & (c("camera_id") != 0)).select("id")


@op("f19_fresh", "SELECT id FROM observations WHERE (SELECT max(us) FROM observations) - us <= 15000000000")
def f19(t: Tables):
    now = F.broadcast(t.observations.agg(F.max("us").alias("now")))  # one row
    return t.observations.join(now, c("now") - c("us") <= F.lit(15_000_000_000)).select("id")


@op(
    "f20_required_fields",
    "SELECT id, CASE WHEN user_id % 9 = 0 THEN 'missing user_id' WHEN camera_id = 0 THEN 'missing camera_id' END AS error, CASE WHEN user_id % 9 "
    "= 0 OR camera_id = 0 THEN false END AS retryable FROM observations",
)
def f20(t: Tables):
    error = F.when(F.nullif(c("user_id") % 9, F.lit(0)).isNull(), "missing user_id").when(F.nullif("camera_id", F.lit(0)).isNull(), "missing camera_id")
    return t.observations.select("id", error.alias("error"), F.when(error.isNotNull(), F.lit(False)).alias("retryable"))


@op(
    "v1_normalise",
    "SELECT id, round(list_sum(list_transform(embedding, lambda x: abs(x::DOUBLE))) / sqrt(list_sum(list_transform(embedding, lambda x: "
    "x::DOUBLE * x::DOUBLE))), 6) AS l1_of_unit FROM face_embeddings",
)
def v1(t: Tables):
    return t.face_embeddings.select("id", F.round(F.aggregate(K.normalised(c("embedding")), F.lit(0.0), lambda a, x: a + F.abs(x)), 6).alias("l1_of_unit"))


_dot = "list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: z[1]::DOUBLE * z[2]::DOUBLE))"


@op("v2_dot", f"SELECT a.id, round({_dot}, 6) AS dot FROM face_embeddings a JOIN face_embeddings b ON b.id = a.id + 1")
def v2(t: Tables):
    b = t.face_embeddings.select((c("id") - 1).alias("id"), c("embedding").alias("other"))
    return t.face_embeddings.join(b, "id").select("id", F.round(K.dot(c("embedding"), c("other")), 6).alias("dot"))


@op(
    "v3_similarity_matrix",
    f"SELECT a.id AS a, b.id AS b, round({_dot}, 6) AS dot FROM face_embeddings a JOIN face_embeddings b ON a.label = b.label AND a.id < b.id "
    "WHERE a.image_url_norm = b.image_url_norm",
)
def v3(t: Tables):
    """The matrix within a group (same label and image)."""
    e = t.face_embeddings
    a, b = e.select(c("id").alias("a"), "label", "image_url_norm", c("embedding").alias("x")), e.select(c("id").alias("b"), "label", "image_url_norm", c("embedding").alias("y"))
    return a.join(b, ["label", "image_url_norm"]).where("a < b").select("a", "b", F.round(K.dot(c("x"), c("y")), 6).alias("dot"))


@op("v4_parse_vector", "SELECT id, 2 * id + 1.5 AS total FROM users")
def v4(t: Tables):
    v = F.from_json(F.format_string("[%d,%d,0.5]", c("id"), c("id") + 1), "array<double>")
    return t.users.select("id", F.aggregate(v, F.lit(0.0), lambda a, x: a + x).alias("total"))


@op("v7_rescale", "SELECT frame_num, box, x1 * 1.5 AS x1, y1 * 0.75 AS y1, x2 * 1.5 AS x2, y2 * 0.75 AS y2 FROM boxes")
def v7(t: Tables):
    return t.boxes.select("frame_num", "box", *[(c(k) * s).alias(k) for k, s in (("x1", 1.5), ("y1", 0.75), ("x2", 1.5), ("y2", 0.75))])
