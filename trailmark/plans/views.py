"""Domain views over the testbed tables, each with its SQL twin, so operators are checked on the same rows in both engines."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from trailmark.operators import registry
from trailmark.session import table

#: View -> table, expressions that both engines read alike; a pair where they differ (Spark, DuckDB).
VIEWS: dict[str, tuple[str, list[str | tuple[str, str]]]] = {
    "branches": ("nation", ["CAST(n_nationkey AS BIGINT) AS id", "CASE WHEN n_nationkey % 2 = 0 THEN n_name ELSE lower(n_name) END AS code"]),
    "users": ("customer", ["c_custkey AS id", "c_name AS full_name", "CASE WHEN c_acctbal >= 0 THEN 'active' ELSE 'inactive' END AS employment_status", "CAST(nullif(c_nationkey % 7, 0) AS BIGINT) AS branch_id", "c_mktsegment AS team", "CASE WHEN c_custkey < 5 OR c_custkey % 4 = 0 THEN NULL WHEN c_custkey % 3 = 0 THEN c_custkey - 2 ELSE c_custkey - 5 END AS into_id"]),
    "cameras": (
        "supplier",
        [
            "s_suppkey AS id", "s_name AS name", "CASE WHEN s_suppkey % 2 = 0 THEN 'in' ELSE 'out' END AS camera_type",
            "CASE s_suppkey % 4 WHEN 0 THEN '[\"attendance\",\"activity\"]' WHEN 1 THEN '[\"unrecognized\"]' WHEN 2 THEN 'attendance' ELSE NULL END AS application",
            "CASE s_suppkey % 3 WHEN 0 THEN NULL WHEN 1 THEN CAST(0 AS DOUBLE) ELSE CAST(0.45 AS DOUBLE) END AS matching_threshold",
            "CAST(nullif(s_nationkey % 5, 0) AS BIGINT) AS branch_id", "s_acctbal AS fps_raw",
        ],
    ),
    "observations": (
        "events",
        [
            "event_id AS id", "user_id", "event_id % 10 AS camera_id", "event_type", "value", "props", ("unix_micros(CAST(ts AS TIMESTAMP)) AS us", "epoch_us(ts) AS us"),
            "CASE WHEN event_type IN ('click', 'view') THEN CASE WHEN event_id % 3 = 0 THEN 'IN' ELSE 'in' END ELSE 'out' END AS status",
        ],
    ),
    "crops": (
        "events",
        [
            "event_id AS frame_num", "user_id AS track_id", "event_id % 10 AS camera_id", "CASE WHEN event_id % 13 = 0 THEN NULL ELSE (event_id * 37 % 101) / CAST(101 AS DOUBLE) END AS frontality", "(event_id * 53 % 97) / CAST(97 AS DOUBLE) AS pitch",
            "event_id * 17 % 250 AS sharpness", "100 + event_id * 29 % 250 AS height", "40 + event_id * 31 % 120 AS width", "value AS score", ("unix_micros(CAST(ts AS TIMESTAMP)) AS us", "epoch_us(ts) AS us"),
        ],
    ),
    "boxes": (
        "lineitem",
        [
            "l_orderkey AS frame_num", "CAST(l_linenumber AS BIGINT) AS box", "l_partkey", "l_suppkey % 10 AS camera_id", "CAST(l_suppkey % 3 AS INT) AS class_id", "CAST(l_partkey % 700 AS DOUBLE) - 20.5 AS x1", "CAST(l_suppkey * 7 % 500 AS DOUBLE) - 10.25 AS y1",
            "CAST(l_partkey % 700 AS DOUBLE) - 20.5 + l_quantity * 4 AS x2", "CAST(l_suppkey * 7 % 500 AS DOUBLE) - 10.25 + l_quantity * 9 AS y2", "CAST(1 AS DOUBLE) - l_tax * 8 AS confidence",
        ],
    ),
    "face_embeddings": ("embeddings", ["vec_id AS id", "CAST(vec_id % 211 AS VARCHAR(20)) AS user_id", "concat('https://store/img', CAST(vec_id % 53 AS VARCHAR(20)), '.jpg') AS image_url_norm", "label", "embedding"]),
    "predictions": (
        "labels",
        [
            "doc_id AS crop_id", "CAST(doc_id % 3 AS BIGINT) AS variant", "CASE WHEN quality = 1 THEN 'working' WHEN toxic = 1 THEN 'phone' ELSE 'idle' END AS truth",
            "CASE doc_id % 7 WHEN 0 THEN NULL WHEN 1 THEN 'phone' WHEN 2 THEN 'idle' ELSE 'working' END AS pred", "CAST(doc_id * 13 % 97 AS DOUBLE) / 64 AS latency_s", "doc_id % 7 = 0 AS failed", "doc_id % 14 = 0 AS parse_failure",
        ],
    ),
}


def select_list(name: str, engine: int) -> tuple[str, list[str]]:
    source, columns = VIEWS[name]
    return source, [c if isinstance(c, str) else c[engine] for c in columns]


class Tables:
    """Views and tables by attribute."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name in VIEWS:
            source, columns = select_list(name, 0)
            return table(self.spark, self.sf_dir, source).selectExpr(*columns)
        return table(self.spark, self.sf_dir, name)


def with_views(sql: str) -> str:
    """The SQL with the views that it mentions put before it."""
    used = [v for v in VIEWS if re.search(rf"\b{v}\b", sql)]
    ctes = []
    for v in used:
        source, columns = select_list(v, 1)
        ctes.append(f"{v} AS (SELECT {', '.join(columns)} FROM {source})")
    if not ctes:
        return sql
    head, recursive = "WITH ", sql.lstrip().upper().startswith("WITH RECURSIVE")
    body = re.sub(r"^\s*WITH\s+(RECURSIVE\s+)?", "", sql, flags=re.I) if sql.lstrip().upper().startswith("WITH") else None
    head += "RECURSIVE " if recursive else ""
    return head + ", ".join(ctes) + (", " + body if body is not None else " " + sql)


def op(name: str, sql: str | None = None) -> Callable:
    """Registers a query over the views, and its SQL where there is one."""

    def add(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        registry.QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            registry.ORACLES[name] = with_views(sql)
        return f

    return add
