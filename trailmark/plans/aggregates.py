"""Aggregations and evaluation (A) as queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from trailmark.operators.selection import nearest_rank, quantile

from .joins import _scores, variant_scores
from .views import Tables, op

c = F.col


@op("a1_urls_per_user", "SELECT user_id, array_to_string(list_sort(list(DISTINCT image_url_norm)), ',') AS urls FROM face_embeddings GROUP BY user_id")
def a1(t: Tables):
    return t.face_embeddings.groupBy("user_id").agg(F.array_join(F.sort_array(F.collect_set("image_url_norm")), ",").alias("urls"))


@op(
    "a2_batch_stats",
    "SELECT camera_id, round(sum(value) / count(*), 6) AS ms_per_call, round(sum(value) / nullif(sum(id % 9), 0), 6) AS ms_per_item FROM "
    "observations GROUP BY camera_id",
)
def a2(t: Tables):
    g = t.observations.groupBy("camera_id").agg(F.sum("value").alias("ms"), F.count("*").alias("calls"), F.sum(c("id") % 9).alias("items"))
    return g.select("camera_id", F.round(c("ms") / c("calls"), 6).alias("ms_per_call"), F.round(c("ms") / F.nullif("items", F.lit(0)), 6).alias("ms_per_item"))


@op(
    "a3_outcomes",
    "SELECT user_id, count(*) FILTER (event_type = 'click') AS ok, count(*) FILTER (event_type = 'error') AS error, count(*) FILTER (event_type "
    "= 'timeout') AS timeout FROM observations GROUP BY user_id",
)
def a3(t: Tables):
    count = lambda k: F.count_if(c("event_type") == k)
    return t.observations.groupBy("user_id").agg(count("click").alias("ok"), count("error").alias("error"), count("timeout").alias("timeout"))


@op("a4_fleet_totals", "SELECT event_type AS stage, round(sum(value), 4) AS total, count(*) AS n FROM observations GROUP BY event_type")
def a4(t: Tables):
    return t.observations.groupBy(c("event_type").alias("stage")).agg(F.round(F.sum("value"), 4).alias("total"), F.count("*").alias("n"))


@op(
    "a5_fleet_average",
    "SELECT round(sum(coalesce(v, 0)) / count(*), 4) AS fps FROM cameras k LEFT JOIN (SELECT camera_id, avg(value) AS v FROM observations WHERE "
    "event_type = 'signup' GROUP BY 1) o ON o.camera_id = k.id",
)
def a5(t: Tables):
    """Cameras without a value count as 0; the denominator is the configured cameras."""
    v = t.observations.where("event_type = 'signup'").groupBy(c("camera_id").alias("id")).agg(F.avg("value").alias("v"))
    return t.cameras.select("id").join(v, "id", "left").agg(F.round(F.sum(F.coalesce("v", F.lit(0.0))) / F.count("*"), 4).alias("fps"))


@op(
    "a6_register_stats",
    "SELECT count(*) AS tracks, sum(n)::BIGINT AS mappings, sum((n > 10)::INT)::BIGINT AS forced FROM (SELECT user_id, count(DISTINCT camera_id) "
    "AS n FROM observations GROUP BY 1)",
)
def a6(t: Tables):
    per = t.observations.groupBy("user_id").agg(F.size(F.collect_set("camera_id")).alias("n"))
    return per.agg(F.count("*").alias("tracks"), F.sum("n").alias("mappings"), F.sum((c("n") > 10).cast("long")).alias("forced"))


@op("a7_days", "SELECT DISTINCT strftime(make_timestamp(us), '%Y-%m-%d') AS day FROM observations ORDER BY day DESC")
def a7(t: Tables):
    return t.observations.select(F.date_format(F.timestamp_micros("us"), "yyyy-MM-dd").alias("day")).distinct().orderBy(F.desc("day"))


@op(
    "a8_bucket_means",
    "SELECT CASE WHEN n_chars < 500 THEN 'small' WHEN n_chars < 3000 THEN 'medium' ELSE 'large' END AS bucket, round(avg(n_chars), 4) AS mean "
    "FROM documents GROUP BY 1",
)
def a8(t: Tables):
    bucket = F.when(c("n_chars") < 500, "small").when(c("n_chars") < 3000, "medium").otherwise("large")
    return t.documents.groupBy(bucket.alias("bucket")).agg(F.round(F.avg("n_chars"), 4).alias("mean"))


_classes = ["working", "phone", "idle", "sleeping"]


@op(
    "a9_coverage",
    "SELECT k AS truth, count(p.truth) AS n, count(p.truth)::DOUBLE / (SELECT count(*) FROM predictions) AS share FROM (SELECT "
    "unnest(['working', 'phone', 'idle', 'sleeping']) AS k) LEFT JOIN predictions p ON p.truth = k GROUP BY k",
)
def a9(t: Tables):
    kinds = t.spark.createDataFrame([(k,) for k in _classes], "truth string")
    n = t.predictions.groupBy("truth").agg(F.count("*").alias("n"))
    return kinds.join(n, "truth", "left").select("truth", F.coalesce("n", F.lit(0)).alias("n")).crossJoin(F.broadcast(t.predictions.agg(F.count("*").alias("total")))).select("truth", "n", (c("n") / c("total")).alias("share"))


@op(
    "a10_variant_scores",
    "SELECT s.variant, round(accuracy, 9) AS accuracy, round(balanced, 9) AS balanced, round(latency, 9) AS latency, parse_failures::BIGINT AS "
    f"parse_failures, p95, predicted_classes FROM ({_scores}) s JOIN (SELECT variant, round(quantile_cont(latency_s, 0.95), 9) AS p95, "
    "count(DISTINCT pred) AS predicted_classes FROM predictions GROUP BY 1) q ON s.variant = q.variant",
)
def a10(t: Tables):
    kinds = t.predictions.groupBy("variant").agg(F.count_distinct("pred").alias("predicted_classes"))
    more = quantile(t.predictions, ["variant"], "latency_s", 0.95, "p95").withColumn("p95", F.round("p95", 9)).join(kinds, "variant")
    r = lambda x: F.round(x, 9).alias(x)
    return variant_scores(t.predictions).join(more, "variant").select("variant", r("accuracy"), r("balanced"), r("latency"), "parse_failures", "p95", "predicted_classes")


@op("a11_confusion", "SELECT variant, truth, coalesce(pred, '<no answer>') AS pred, count(*) AS n FROM predictions GROUP BY ALL")
def a11(t: Tables):
    return t.predictions.groupBy("variant", "truth", F.coalesce("pred", F.lit("<no answer>")).alias("pred")).agg(F.count("*").alias("n"))


@op(
    "a12_per_class",
    "SELECT variant, k AS class, coalesce(tp / nullif(p, 0), 0) AS precision, coalesce(tp / nullif(s, 0), 0) AS recall, coalesce(2 * tp / "
    "nullif(p + s, 0), 0) AS f1, s AS support FROM (SELECT variant, k, sum((truth = k AND pred = k)::INT)::DOUBLE AS tp, sum(coalesce(pred = k, "
    "false)::INT)::DOUBLE AS p, sum((truth = k)::INT)::BIGINT AS s FROM predictions, (SELECT unnest(['working', 'phone', 'idle']) AS k) GROUP BY "
    "ALL)",
)
def a12(t: Tables):
    """From the confusion counts: each row is a truth and, if answered, a prediction; empty denominators give 0."""
    counts = t.predictions.groupBy("variant", "truth", "pred").agg(F.count("*").alias("n"))
    sides = F.array(F.struct(c("truth").alias("class"), F.lit("s").alias("side")), F.struct(c("pred").alias("class"), F.lit("p").alias("side")))
    rows = counts.select("variant", "n", (c("truth") == c("pred")).alias("hit"), F.explode(sides).alias("x")).where("x.class is not null")
    total = lambda cond: F.sum(F.when(cond, c("n")).otherwise(F.lit(0)))
    g = rows.groupBy("variant", c("x.class").alias("class")).agg(total((c("x.side") == "s") & c("hit")).alias("tp"), total(c("x.side") == "p").alias("p"), total(c("x.side") == "s").alias("support"))
    ratio = lambda a, b: F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))
    return g.select("variant", "class", ratio(c("tp"), c("p")).alias("precision"), ratio(c("tp"), c("support")).alias("recall"), ratio(2 * c("tp"), c("p") + c("support")).alias("f1"), "support")


@op(
    "a13_confused_pairs",
    "SELECT truth, pred, count(*) AS n, count(DISTINCT variant) = 3 AS in_every_variant FROM predictions WHERE pred <> truth GROUP BY ALL ORDER "
    "BY n DESC, truth, pred LIMIT 12",
)
def a13(t: Tables):
    g = t.predictions.where("pred <> truth").groupBy("truth", "pred").agg(F.count("*").alias("n"), (F.count_distinct("variant") == 3).alias("in_every_variant"))
    return g.orderBy(F.desc("n"), "truth", "pred").limit(12)


@op(
    "a14_person_scores",
    "WITH d AS (SELECT DISTINCT crop_id % 50 AS person, truth = 'working' AS there, coalesce(pred = 'working', false) AS seen FROM predictions), "
    "s AS (SELECT sum((there AND seen)::INT)::DOUBLE AS tp, sum((NOT there AND seen)::INT)::DOUBLE AS fp, sum((there AND NOT seen)::INT)::DOUBLE "
    "AS fn FROM d) SELECT tp / (tp + fp) AS precision, tp / (tp + fn) AS recall, 2 * tp / (2 * tp + fp + fn) AS f1, tp / (tp + fp + fn) AS "
    "accuracy FROM s",
)
def a14(t: Tables):
    d = t.predictions.select((c("crop_id") % 50).alias("person"), (c("truth") == "working").alias("there"), F.coalesce(c("pred") == "working", F.lit(False)).alias("seen")).distinct()
    n = lambda cond: F.count_if(cond).cast("double")
    s = d.agg(n(c("there") & c("seen")).alias("tp"), n(~c("there") & c("seen")).alias("fp"), n(c("there") & ~c("seen")).alias("fn"))
    return s.selectExpr("tp / (tp + fp) AS precision", "tp / (tp + fn) AS recall", "2 * tp / (2 * tp + fp + fn) AS f1", "tp / (tp + fp + fn) AS accuracy")


#: Resamples; and fixed values: cumulative probabilities of the Poisson distribution with mean 1.
RESAMPLES, POISSON = 2000, (0.367879, 0.735759, 0.919699, 0.981012, 0.996340)
_draw = "('0x' || substr(md5(crop_id || ':' || resample), 1, 8))::BIGINT / 4294967296"
_weight = " + ".join(f"(u > {p})::INT" for p in POISSON)


@op(
    "a15_bootstrap",
    f"WITH r AS (SELECT variant, resample, (pred = truth) IS TRUE AS hit, {_draw} AS u FROM predictions, range({RESAMPLES}) AS x(resample)), "
    f"e AS (SELECT variant, resample, sum(CASE WHEN hit THEN w ELSE 0 END)::DOUBLE / sum(w) AS accuracy FROM (SELECT *, {_weight} AS w FROM r) GROUP BY ALL) "
    "SELECT e.variant, round(quantile_cont(e.accuracy, 0.025), 9) AS low, round(avg(e.accuracy), 9) AS mean, round(quantile_cont(e.accuracy, 0.975), 9) AS high, "
    "avg((e.accuracy > b.accuracy)::INT) AS beats_baseline FROM e JOIN e b ON b.variant = 0 AND b.resample = e.resample GROUP BY e.variant",
)
def a15(t: Tables):
    """2000 Poisson resamples of the accuracy with a 95 % interval, and the share in which a variant beats variant 0; a row's weight
    comes from a digest of its id, so it is reproducible, and each resample is a grouped sum, so nothing is gathered."""
    hit = F.coalesce(c("pred") == c("truth"), F.lit(False)).alias("hit")
    rows = t.predictions.select("variant", "crop_id", hit, F.explode(F.sequence(F.lit(0), F.lit(RESAMPLES - 1))).alias("resample"))
    digest = F.md5(F.concat_ws(":", c("crop_id").cast("string"), c("resample").cast("string")).cast("binary"))
    u = F.conv(F.substr(digest, F.lit(1), F.lit(8)), 16, 10).cast("long") / 4294967296
    rows = rows.withColumn("u", u)
    w = sum(((c("u") > p).cast("int") for p in POISSON), F.lit(0))
    each = rows.withColumn("w", w).groupBy("variant", "resample").agg((F.sum(F.when(c("hit"), c("w")).otherwise(0)).cast("double") / F.sum("w")).alias("accuracy"))
    base = each.where("variant = 0").select("resample", c("accuracy").alias("base"))
    ends = [F.round(F.percentile("accuracy", q), 9).alias(name) for q, name in ((0.025, "low"), (0.975, "high"))]
    return each.join(base, "resample").groupBy("variant").agg(*ends, F.round(F.avg("accuracy"), 9).alias("mean"), F.avg((c("accuracy") > c("base")).cast("int")).alias("beats_baseline"))


@op(
    "a16_nearest_rank",
    "SELECT camera_id, list_sort(list(value))[least(count(*), floor(0.95 * count(*))::BIGINT + 1)] AS p95 FROM observations GROUP BY camera_id",
)
def a16(t: Tables):
    """The value at place min(n - 1, int(q n)) of the sorted ones, found by counting in bins rather than by gathering or ranking a camera's rows."""
    return nearest_rank(t.observations, ["camera_id"], "value", 0.95, "p95")


@op("a17_histogram", "SELECT n, count(*) AS users FROM (SELECT user_id, count(*) AS n FROM observations GROUP BY 1) GROUP BY n")
def a17(t: Tables):
    return t.observations.groupBy("user_id").agg(F.count("*").alias("n")).groupBy("n").agg(F.count("*").alias("users"))


@op(
    "a18_instability",
    "SELECT camera_id, abs(a - b) / greatest(a, b) > 0.15 AS unstable FROM (SELECT camera_id, avg(value) FILTER (user_id % 2 = 0) AS a, avg(value) FILTER (user_id % 2 = 1) AS b FROM observations GROUP BY 1)",
)
def a18(t: Tables):
    """Two runs (here: rows of even and of odd users) whose means differ by more than 15 %; all rows are in one of them."""
    run = lambda k: F.avg(F.when(c("user_id") % 2 == k, c("value")))
    both = t.observations.groupBy("camera_id").agg(run(0).alias("a"), run(1).alias("b"))
    return both.select("camera_id", (F.abs(c("a") - c("b")) / F.greatest("a", "b") > 0.15).alias("unstable"))


@op("a19_distinct", "SELECT camera_id, count(DISTINCT user_id) AS users, count(DISTINCT event_type) AS types FROM observations GROUP BY 1")
def a19(t: Tables):
    return t.observations.groupBy("camera_id").agg(F.count_distinct("user_id").alias("users"), F.count_distinct("event_type").alias("types"))


@op(
    "a20_recall_gap",
    "SELECT variant, avg(CASE WHEN crop_id % 2 = 0 THEN coalesce(pred = truth, false)::INT END) - avg(CASE WHEN crop_id % 2 = 1 THEN "
    "coalesce(pred = truth, false)::INT END) AS gap FROM predictions WHERE truth = 'working' GROUP BY variant",
)
def a20(t: Tables):
    hit = F.coalesce(c("pred") == c("truth"), F.lit(False)).cast("int")
    part = lambda k: F.avg(F.when(c("crop_id") % 2 == k, hit))
    return t.predictions.where("truth = 'working'").groupBy("variant").agg((part(0) - part(1)).alias("gap"))


@op(
    "a21_baseline_summary",
    "SELECT count(*) AS tracks, round(avg(last - first) / 1e6, 6) AS mean_s, sum(seen)::DOUBLE / sum(n) AS visibility FROM (SELECT track_id, "
    "min(us) AS first, max(us) AS last, count(frontality) AS seen, count(*) AS n FROM crops GROUP BY 1)",
)
def a21(t: Tables):
    per = t.crops.groupBy("track_id").agg(F.min("us").alias("first"), F.max("us").alias("last"), F.count("frontality").alias("seen"), F.count("*").alias("n"))
    return per.agg(F.count("*").alias("tracks"), F.round(F.avg(c("last") - c("first")) / 1e6, 6).alias("mean_s"), (F.sum("seen") / F.sum("n")).alias("visibility"))


@op("a22_content_dedup", "SELECT min(doc_id) AS doc_id FROM documents GROUP BY sha1(text)")
def a22(t: Tables):
    return t.documents.groupBy(F.sha1(c("text").cast("binary")).alias("h")).agg(F.min("doc_id").alias("doc_id")).select("doc_id")
