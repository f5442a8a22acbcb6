"""Scans (SC) and sinks (SK) as queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from trailmark.functions.columns import dead_letter_queue, normalised
from trailmark.operators.sequences import top_per_key, transition_guard
from trailmark.session import shared_folder
from trailmark.sources import messages
from trailmark.sources.tables import StoredTable

from .views import Tables, op

c = F.col


def stored(t: Tables, rows, name: str, key: str | None = None) -> StoredTable:
    """An empty table for such rows in the shared folder."""
    return StoredTable(t.spark, f"{shared_folder(t.spark)}/{name}-{uuid.uuid4().hex}", rows.schema, [key] if key else None, 16)


def appended(t: Tables, rows, name: str):
    """The rows as they are read back after an insert."""
    table = stored(t, rows, name)
    table.append(rows)
    return table.read()


BRANCH = "nation_3"
APPS = "array<string>"


def in_branch_or_free(people, branches, code: str):
    """a branch's rows and those without a branch."""
    b = branches.select(c("id").alias("_b"), c("code").alias("branch_code"))
    return people.join(b, c("branch_id") == c("_b"), "left").where((F.lower("branch_code") == code) | c("branch_id").isNull()).drop("_b")


def apps(application):
    """A JSON list, or a scalar as a list of one."""
    return F.coalesce(F.when(application.startswith("["), F.from_json(application, APPS)), F.array(application))


@op(
    "sc1_users",
    "SELECT u.id, full_name, employment_status, branch_id, code AS branch_code FROM users u LEFT JOIN branches b ON u.branch_id = b.id WHERE "
    f"lower(code) = '{BRANCH}' OR branch_id IS NULL ORDER BY full_name",
)
def sc1(t: Tables):
    return in_branch_or_free(t.users.drop("team"), t.branches, BRANCH).select("id", "full_name", "employment_status", "branch_id", "branch_code").orderBy("full_name")


@op("sc2_name_to_id", "SELECT full_name, min(id) AS id FROM users GROUP BY full_name")
def sc2(t: Tables):
    return t.users.groupBy("full_name").agg(F.min("id").alias("id"))


@op(
    "sc3_cameras",
    "SELECT c.id, name, camera_type FROM cameras c JOIN branches b ON c.branch_id = b.id WHERE lower(code) = 'nation_3' AND (application = "
    "'attendance' OR application LIKE '%\"attendance\"%')",
)
def sc3(t: Tables):
    b = F.broadcast(t.branches.where(F.lower("code") == "nation_3").select(c("id").alias("branch_id")))
    return t.cameras.join(b, "branch_id").where(F.array_contains(apps(c("application")), "attendance")).select("id", "name", "camera_type")


@op("sc4_branch_exists", "SELECT count(*) > 0 AS branch_exists FROM branches WHERE lower(code) = 'nation_7'")
def sc4(t: Tables):
    return t.branches.where(F.lower("code") == "nation_7").limit(1).agg((F.count("*") > 0).alias("branch_exists"))


_norm = "sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)))"


@op(
    "sc5_gallery",
    f"SELECT f.id, full_name, round(embedding[1]::DOUBLE / {_norm}, 6) AS first_of_unit, round(list_sum(list_transform(embedding, lambda x: abs(x::DOUBLE))) / {_norm}, 6) AS l1_of_unit "
    "FROM face_embeddings f JOIN users u ON f.user_id = u.id::VARCHAR LEFT JOIN branches b ON u.branch_id = b.id "
    f"WHERE employment_status = 'active' AND (lower(code) = '{BRANCH}' OR branch_id IS NULL) ORDER BY f.id",
)
def sc5(t: Tables):
    """Unit vectors of the active people of a branch and of those without one."""
    people = in_branch_or_free(t.users.where("employment_status = 'active'"), t.branches, BRANCH).select(c("id").cast("string").alias("user_id"), "full_name")
    rows = t.face_embeddings.join(people, "user_id").withColumn("unit", normalised(c("embedding")))
    l1 = F.aggregate("unit", F.lit(0.0), lambda a, x: a + F.abs(x))
    return rows.select("id", "full_name", F.round(F.get("unit", 0), 6).alias("first_of_unit"), F.round(l1, 6).alias("l1_of_unit")).orderBy("id")


@op("sc6_homography", "SELECT camera_id, min(id) AS map_id FROM observations WHERE value > 1 GROUP BY camera_id")
def sc6(t: Tables):
    return top_per_key(t.observations.where("value > 1"), ["camera_id"], [c("id")], 1).select("camera_id", c("id").alias("map_id"))


@op("sc7_calibration_frames", "SELECT frame_num, box, x1 FROM boxes WHERE camera_id = 3 ORDER BY frame_num, box, x1")
def sc7(t: Tables):
    return t.boxes.where("camera_id = 3").select("frame_num", "box", "x1").orderBy("frame_num", "box", "x1")


@op(
    "sc13_live_entries",
    "SELECT id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM observations WHERE (SELECT max(us) FROM observations) - us <= 86400000000 "
    "AND id % 11 <> 0",
)
def sc13(t: Tables):
    """Entries not older than a day, corrupt ones skipped (those divisible by 11 are cut short here)."""
    rows = t.observations.select("id", "us", F.when(c("id") % 11 == 0, F.substr("props", F.lit(1), F.lit(3))).otherwise(c("props")).alias("blob"))
    newest = F.broadcast(rows.agg(F.max("us").alias("now")))  # one row
    k = F.try_variant_get(F.try_parse_json("blob"), "$.k", "bigint")
    return rows.join(newest).where("now - us <= 86400000000L").select("id", k.alias("k")).where("k is not null")


DAY0, DAY1 = 1704412800000000, 1704499200000000


@op(
    "sc14_metrics_day",
    f"SELECT id, us, coalesce(CAST(json_extract(props, '$.missing') AS BIGINT), 0) AS v FROM observations WHERE us >= {DAY0} AND us < {DAY1} "
    "ORDER BY us",
)
def sc14(t: Tables):
    blob = F.coalesce(F.from_json("props", "k bigint, missing bigint")["missing"], F.lit(0)).cast("long")
    return t.observations.where(f"us >= {DAY0}L and us < {DAY1}L").select("id", "us", blob.alias("v")).orderBy("us")


@op(
    "sc15_labels_from_paths",
    "SELECT page_id, CASE WHEN regexp_matches(split_part(url, '/', 4), '^[a-z]{2}$') THEN split_part(url, '/', 4) ELSE 'none' END AS label FROM "
    "pages",
)
def sc15(t: Tables):
    folder = F.regexp_extract("url", r"^[a-z]+://[^/]+/([a-z]{2})(?:/|$)", 1)
    return t.pages.select("page_id", F.when(folder != "", folder).otherwise("none").alias("label"))


@op(
    "sc16_frame_handles",
    "SELECT a.id, a.camera_id FROM observations a JOIN (SELECT camera_id, max(id) AS id FROM observations GROUP BY camera_id) l ON a.camera_id = "
    "l.camera_id AND a.id = l.id",
)
def sc16(t: Tables):
    """Handles that still name the live (camera, sequence); stale ones drop out of the inner join."""
    live = t.observations.groupBy("camera_id").agg(F.max("id").alias("id"))
    return t.observations.select("id", "camera_id").join(live, ["camera_id", "id"]).select("id", "camera_id")


@op("sc17_cached_answers", "SELECT user_id, arg_max(value, id) AS value FROM observations WHERE event_type = 'click' GROUP BY user_id")
def sc17(t: Tables):
    return t.observations.where("event_type = 'click'").groupBy("user_id").agg(F.max_by("value", "id").alias("value"))


@op(
    "sk1_attendance_insert",
    "SELECT o.id, user_id, lower(status) AS status, coalesce(c.branch_id, u.branch_id) AS branch_id FROM (SELECT *, lag(lower(status)) OVER "
    "(PARTITION BY user_id ORDER BY id) AS before FROM observations) o LEFT JOIN cameras c ON o.camera_id = c.id LEFT JOIN users u ON o.user_id "
    "= u.id WHERE before IS NULL OR before <> lower(status)",
)
def sk1(t: Tables):
    rows = transition_guard(t.observations)
    cam, user = t.cameras.select(c("id").alias("camera_id"), c("branch_id").alias("cb")), t.users.select(c("id").alias("user_id"), c("branch_id").alias("ub"))
    return appended(t, rows.join(cam, "camera_id", "left").join(user, "user_id", "left").select("id", "user_id", F.lower("status").alias("status"), F.coalesce("cb", "ub").alias("branch_id")), "attendance")


@op(
    "sk2_unrecognized_insert",
    "SELECT o.id, nullif(concat_ws(chr(10), CASE WHEN c.name IS NOT NULL AND o.id % 3 <> 0 THEN 'Camera: ' || c.name END, nullif(CASE WHEN o.id "
    "% 2 = 0 THEN event_type ELSE '' END, '')), '') AS notes, 'pending' AS status FROM observations o LEFT JOIN cameras c ON o.camera_id = c.id "
    "WHERE event_type = 'error'",
)
def sk2(t: Tables):
    cams = t.cameras.select(c("id").alias("camera_id"), "name")
    rows = t.observations.where("event_type = 'error'").join(cams, "camera_id", "left")
    head = F.when(c("name").isNotNull() & (c("id") % 3 != 0), F.concat(F.lit("Camera: "), c("name")))
    own = F.when(c("id") % 2 == 0, c("event_type"))
    return appended(t, rows.select("id", F.nullif(F.concat_ws("\n", head, own), F.lit("")).alias("notes"), F.lit("pending").alias("status")), "unrecognized")


ACTIVITIES = {"click": "phone_usage", "view": "working", "purchase": "talking", "signup": "sleeping"}


@op(
    "sk3_activity_insert",
    "SELECT id, user_id, CASE event_type WHEN 'click' THEN 'phone_usage' WHEN 'view' THEN 'working' WHEN 'purchase' THEN 'talking' WHEN 'signup' "
    "THEN 'sleeping' END AS activity_type, value AS confidence FROM observations WHERE event_type <> 'error'",
)
def sk3(t: Tables):
    kind = F.create_map(*[F.lit(x) for pair in ACTIVITIES.items() for x in pair])
    return appended(t, t.observations.select("id", "user_id", F.try_element_at(kind, c("event_type")).alias("activity_type"), c("value").alias("confidence")).where("activity_type is not null"), "activities")


@op("sk4_current_activity", "SELECT user_id, arg_max(event_type, id) AS event_type, max(id) AS id FROM observations GROUP BY user_id")
def sk4(t: Tables):
    return upserted(t, t.observations.select("user_id", "event_type", "id"), "user_id", "current_activity")


def upserted(t: Tables, rows, key: str, name: str):
    """Two batches in order of ids, read back."""
    table = stored(t, rows, name, key)
    middle = rows.agg(F.max("id")).first()[0] // 2
    table.upsert(rows.where(c("id") <= middle), [key], "id")
    table.upsert(rows.where(c("id") > middle), [key], "id")
    return table.read()


@op("sk5_user_location", "SELECT user_id, arg_max(camera_id, id) AS camera_id, lower(arg_max(status, id)) AS status FROM observations GROUP BY user_id")
def sk5(t: Tables):
    return upserted(t, t.observations.select("user_id", "camera_id", F.lower("status").alias("status"), "id"), "user_id", "location").drop("id")


@op(
    "sk6_insert_ignore",
    "WITH old AS (SELECT * FROM face_embeddings WHERE id % 3 = 0), new AS (SELECT *, row_number() OVER (PARTITION BY user_id, image_url_norm "
    "ORDER BY id) AS n FROM face_embeddings WHERE id % 3 <> 0) SELECT id, user_id, image_url_norm FROM new WHERE n = 1 AND NOT EXISTS (SELECT 1 "
    "FROM old WHERE old.user_id = new.user_id AND old.image_url_norm = new.image_url_norm)",
)
def sk6(t: Tables):
    """What a second batch adds to the first."""
    rows, keys = t.face_embeddings.select("id", "user_id", "image_url_norm"), ["user_id", "image_url_norm"]
    table = stored(t, rows, "faces", "user_id")
    table.append(rows.where("id % 3 = 0"))
    table.insert_ignore(rows.where("id % 3 <> 0"), keys, "id")
    return table.read().where("id % 3 <> 0")


@op("sk7_delete_user", "SELECT count(*) FILTER (user_id = '7') AS deleted, count(*) FILTER (user_id <> '7') AS kept FROM face_embeddings")
def sk7(t: Tables):
    rows = t.face_embeddings.select("id", "user_id")
    table = stored(t, rows, "faces", "user_id")
    table.append(rows)
    deleted = table.delete(t.spark.createDataFrame([("7",)], "user_id string"))
    return table.read().agg(F.lit(deleted).cast("long").alias("deleted"), F.count("*").alias("kept"))


@op(
    "sk8_delete_image",
    "SELECT id FROM face_embeddings f WHERE NOT EXISTS (SELECT 1 FROM (SELECT user_id, image_url_norm FROM face_embeddings WHERE id % 50 = 0) d "
    "WHERE d.user_id = f.user_id AND d.image_url_norm = f.image_url_norm)",
)
def sk8(t: Tables):
    rows = t.face_embeddings.select("id", "user_id", "image_url_norm")
    table = stored(t, rows, "faces", "user_id")
    table.append(rows)
    table.delete(rows.where("id % 50 = 0").select("user_id", "image_url_norm").distinct())
    return table.read().select("id")


@op(
    "sk9_calibration_insert",
    "SELECT frame_num, box, b.camera_id, coalesce(c.name, '') AS organization FROM boxes b LEFT JOIN cameras c ON b.camera_id = c.id",
)
def sk9(t: Tables):
    known = t.cameras.select(c("id").alias("camera_id"), "name")
    return appended(t, t.boxes.join(known, "camera_id", "left").select("frame_num", "box", "camera_id", F.coalesce("name", F.lit("")).alias("organization")), "calibration")


#: Event types and the channels they go to.
CHANNELS = {"AttendanceRecorded": "events:attendance", "UnrecognizedFaceSaved": "events:unrecognized", "ActivityDetected": "events:activity", "UserLocationUpdated": "events:location", "SystemAlert": "events:metrics"}
TYPE_OF = {"click": "AttendanceRecorded", "error": "UnrecognizedFaceSaved", "view": "ActivityDetected", "purchase": "UserLocationUpdated", "signup": "SystemAlert"}
_case = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{{}}'" for k in TYPE_OF) + " END"


@op(
    "sk10_publish",
    f"SELECT id, {_case.format(*TYPE_OF.values())} AS event_type, {_case.format(*[CHANNELS[v] for v in TYPE_OF.values()])} AS channel, "
    f"'{{\"record_id\":' || id || ',\"user_id\":' || user_id || '}}' AS payload FROM observations",
)
def sk10(t: Tables):
    kinds = F.create_map(*[F.lit(x) for pair in TYPE_OF.items() for x in pair])
    channels = F.create_map(*[F.lit(x) for pair in CHANNELS.items() for x in pair])
    rows = t.observations.select("id", kinds[c("event_type")].alias("event_type"), F.to_json(F.struct(c("id").alias("record_id"), "user_id")).alias("payload"))
    return appended(t, rows.select("id", "event_type", channels[c("event_type")].alias("channel"), "payload"), "published")


@op(
    "sk11_upload_path",
    "SELECT id, strftime(make_timestamp(us), '%Y/%m/%d') || '/acme/unrecognized_faces/' || strftime(make_timestamp(us), '%H%M%S') || '_' || "
    "substr(sha1(id::VARCHAR), 1, 8) || '.jpg' AS path FROM observations",
)
def sk11(t: Tables):
    """The random part of the name is a digest of the id here, so a retried task writes the same path."""
    ts = F.timestamp_micros("us")
    return t.observations.select("id", F.concat(F.date_format(ts, "yyyy/MM/dd"), F.lit("/acme/unrecognized_faces/"), F.date_format(ts, "HHmmss"), F.lit("_"), F.substr(F.sha1(c("id").cast("string").cast("binary")), F.lit(1), F.lit(8)), F.lit(".jpg")).alias("path"))


@op(
    "sk13_retention",
    "SELECT camera_id, count(*) AS kept FROM observations WHERE us >= (SELECT max(us) FROM observations) - 10::BIGINT * 86400000000 GROUP BY "
    "camera_id",
)
def sk13(t: Tables):
    limit = F.broadcast(t.observations.agg((F.max("us") - F.lit(10 * 86_400_000_000)).alias("oldest")))  # one row
    return t.observations.join(limit, c("us") >= c("oldest")).groupBy("camera_id").agg(F.count("*").alias("kept"))


@op(
    "sk14_message_dead_letters",
    "SELECT doc_id, substr(text, 1, 5000) AS raw, CASE WHEN doc_id % 5 = 0 THEN 'PARSE_ERROR' ELSE 'HANDLER_ERROR' END AS error_type FROM documents",
)
def sk14(t: Tables):
    kind = F.when(c("doc_id") % 5 == 0, "PARSE_ERROR").otherwise("HANDLER_ERROR")
    return appended(t, t.documents.select("doc_id", F.substr("text", F.lit(1), F.lit(5000)).alias("raw"), kind.alias("error_type")), "dead_messages")


_task = "CASE id % 6 WHEN 0 THEN 'Embedding.sync' WHEN 1 THEN 'camera.process_embedding' WHEN 2 THEN 'camera.face' WHEN 3 THEN 'yolo.batch' WHEN 4 THEN 'face.embed_detection' ELSE 'other' END"


@op(
    "sk15_task_dead_letters",
    f"SELECT id, CASE WHEN lower({_task}) LIKE '%embedding%' THEN 'dlq:embeddings' WHEN lower({_task}) LIKE '%camera%' THEN 'dlq:camera_frames' "
    f"WHEN lower({_task}) LIKE '%yolo%' THEN 'dlq:yolo' WHEN lower({_task}) LIKE '%face%' THEN 'dlq:face' WHEN lower({_task}) LIKE '%detection%' "
    "THEN 'dlq:detections' ELSE 'dlq:unknown' END AS queue FROM observations",
)
def sk15(t: Tables):
    return appended(t, t.observations.select("id", dead_letter_queue(F.expr(_task)).alias("queue")), "dead_tasks")


@op(
    "sk16_published_values",
    "SELECT camera_id, arg_max(value, id) AS value FROM observations WHERE us >= (SELECT max(us) FROM observations) - 43200000000 GROUP BY "
    "camera_id",
)
def sk16(t: Tables):
    """The last value of each camera, unless it has expired when it is read."""
    newest = F.broadcast(t.observations.agg(F.max("us").alias("now")))
    return t.observations.join(newest, c("us") >= c("now") - F.lit(43_200_000_000)).groupBy("camera_id").agg(F.max_by("value", "id").alias("value"))


@op("sk18_summary_export", "SELECT to_json({camera_id: camera_id, n: count(*)})::VARCHAR AS line FROM observations GROUP BY camera_id")
def sk18(t: Tables):
    """JSON lines, read back as text."""
    path = f"{shared_folder(t.spark)}/summary-{uuid.uuid4().hex}"
    messages.export_json(t.observations.groupBy("camera_id").agg(F.count("*").alias("n")), path)
    return t.spark.read.text(path).select(c("value").alias("line"))
