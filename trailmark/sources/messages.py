"""Sources and sinks of messages and files: event streams, keyed commands, JSON exports, YAML-like settings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ENVELOPE = "event_type string, version string, data string"


def event_stream(spark: SparkSession, folder: str, event_types: list[str], schema: str = ENVELOPE) -> DataFrame:
    """SC10: JSON events as a stream, filtered by type; a broker's topic takes the place of the folder in production."""
    return spark.readStream.schema(schema).json(folder).where(F.col("event_type").isin(event_types))


def command_stream(spark: SparkSession, servers: str, topic: str, batch: int = 10) -> DataFrame:
    """SC9: a broker's topic with offsets in the checkpoint; needs Spark's Kafka package on the class path."""
    options = {"kafka.bootstrap.servers": servers, "subscribe": topic, "maxOffsetsPerTrigger": str(batch)}
    return spark.readStream.format("kafka").options(**options).load().select(F.col("key").cast("string"), F.col("value").cast("string"), "timestamp")


COMMAND = "id long, user_id long, event_type string, stream string"
#: Fixed value: the characters of a broken message that a dead letter keeps.
RAW_CHARS = 5000


def commands(raw: DataFrame, streams: list[str], schema: str = COMMAND) -> DataFrame:
    """SC9, ST7: JSON messages (``value``) as columns of ``schema``, with ``raw`` and ``error_type``.

    PARSE_ERROR where the text is no JSON object of that kind or lacks an id, UNKNOWN_STREAM where it names none of ``streams``, else null.
    """
    c = F.col
    rows = raw.select("*", F.from_json("value", schema, {"mode": "PERMISSIVE"}).alias("_m"))
    error = F.when(c("_m.id").isNull(), "PARSE_ERROR").when(~F.coalesce(c("_m.stream"), F.lit("")).isin(streams), "UNKNOWN_STREAM")
    return rows.select("_m.*", F.substr("value", F.lit(1), F.lit(RAW_CHARS)).alias("raw"), error.alias("error_type"))


def frame_handles(spark: SparkSession, rate: int = 10) -> DataFrame:
    """SC8: a paced source with a monotone sequence, standing in for a camera."""
    return spark.readStream.format("rate").option("rowsPerSecond", rate).load().select(F.col("value").alias("seq"), F.col("timestamp").alias("ts"))


def images(spark: SparkSession, folder: str) -> DataFrame:
    """SC11: references and sizes of images; contents are read only by who selects them."""
    return spark.read.format("binaryFile").load(folder)


def answers(spark: SparkSession, path: str, prompt_hash: str) -> DataFrame:
    """SC17: cached answers of the current prompt, the last per crop."""
    rows = spark.read.schema("crop_id string, prompt_hash string, answer string, at long").json(path)
    return rows.where(F.col("prompt_hash") == prompt_hash).groupBy("crop_id").agg(F.max_by("answer", "at").alias("answer"))


def settings(defaults: dict, *layers: dict) -> dict:
    """SC12: nested settings; later layers win, key by key."""
    out = dict(defaults)
    for layer in layers:
        for key, value in layer.items():
            out[key] = settings(out[key], value) if isinstance(value, dict) and isinstance(out.get(key), dict) else value
    return out


def export_json(rows: DataFrame, path: str) -> None:
    """SK18: JSON lines."""
    rows.write.mode("overwrite").json(path)
