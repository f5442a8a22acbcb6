"""Stored tables and the ways that sinks write to them: append, upsert, insert-ignore, delete."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, _parse_datatype_string

from trailmark.operators.sequences import latest_per_key

#: Buckets of a new table with keys. A table for 100 TB takes some tens of thousands.
BUCKETS = 64


class StoredTable:
    """A table of Parquet files in a folder that driver and executors share, in buckets by a hash of ``keys``.

    A manifest names the files of each bucket. A change reads and rewrites only the buckets that hold keys of the change; then a
    new manifest is written, which counts as soon as it is complete. So readers see the state before or after, files of
    other buckets stay as they are, and a job that is repeated after a failure starts from the state before. There is one writer
    at a time; ``foreachBatch`` of a stream is one. Without ``keys`` there is one bucket. What the driver holds is the manifest: a row
    for each file.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str | StructType, keys: list[str] | None = None, buckets: int = BUCKETS):
        self.spark, self.path, self.keys = spark, path.rstrip("/"), keys or []
        self.schema = _parse_datatype_string(schema) if isinstance(schema, str) else schema
        self.buckets = buckets if self.keys else 1

    def _listed(self, folder: str) -> list[str]:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
        files = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return [s.getPath().toString() for s in files.listStatus(path)] if files.exists(path) else []

    def _version(self) -> int:
        done = [v for v in self._listed(f"{self.path}/manifest") if any(x.endswith("/_SUCCESS") for x in self._listed(v))]
        return max((int(v.rsplit("=", 1)[1]) for v in done), default=0)

    def files(self) -> list[tuple[int, str]]:
        """(bucket, file) of the current manifest."""
        version = self._version()
        if not version:
            return []
        rows = self.spark.read.parquet(f"{self.path}/manifest/version={version}").collect()
        if any(r.buckets != self.buckets for r in rows):
            raise ValueError(f"{self.path} has other buckets than {self.buckets}")
        return sorted((r.bucket, r.file) for r in rows if r.file)

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int") if self.keys else F.lit(0)

    def _touched(self, rows: DataFrame) -> set[int] | None:
        """The buckets that may hold the rows' keys; None: any."""
        if not set(self.keys) <= set(rows.columns):
            return None
        return {r[0] for r in rows.select(self._bucket()).distinct().collect()}  # a row for each bucket at most

    def read(self, buckets: set[int] | None = None) -> DataFrame:
        files = [f for b, f in self.files() if buckets is None or b in buckets]
        return self.spark.read.schema(self.schema).parquet(*files) if files else self.spark.createDataFrame([], self.schema)

    def _write(self, rows: DataFrame, replaced: set[int]) -> None:
        """Writes rows as files of their buckets, in place of all files of ``replaced``; the manifest comes last."""
        place = f"{self.path}/data/{uuid.uuid4().hex}"
        # A rebalance splits a bucket that has very many rows.
        rows.select(*self.schema.names, self._bucket().alias("_bucket")).hint("rebalance", "_bucket").write.partitionBy("_bucket").parquet(place)
        new = [(int(d.rsplit("=", 1)[1]), f) for d in self._listed(place) if "/_bucket=" in d for f in self._listed(d) if f.endswith(".parquet")]
        manifest = [x for x in self.files() if x[0] not in replaced] + new
        entries = [(b, f, self.buckets) for b, f in manifest] or [(0, None, self.buckets)]
        table = self.spark.createDataFrame(entries, "bucket int, file string, buckets int").coalesce(1)
        table.write.mode("overwrite").parquet(f"{self.path}/manifest/version={self._version() + 1}")

    def append(self, rows: DataFrame) -> None:
        self._write(rows, set())

    def upsert(self, rows: DataFrame, keys: list[str], order: str) -> None:
        """Of stored and new rows the one with the largest ``order`` stays for each key."""
        touched = self._touched(rows.select(*keys))
        both = self.read(touched).unionByName(rows.select(*self.schema.names))
        self._write(latest_per_key(both, keys, order), set(range(self.buckets)) if touched is None else touched)

    def insert_ignore(self, rows: DataFrame, keys: list[str], order: str) -> None:
        """Adds the first new row (by ``order``) of each key that is not stored yet."""
        new = rows.join(self.read(self._touched(rows.select(*keys))).select(*keys), keys, "left_anti")
        rest = [x for x in rows.columns if x not in keys]
        first = new.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("_first"))
        self.append(first.select(*keys, *[F.col(f"_first.{x}").alias(x) for x in rest]))

    def delete(self, keys: DataFrame) -> int:
        """Removes the rows that agree with ``keys`` in all its columns; their number. Only buckets that hold such rows are rewritten."""
        now = self.read(self._touched(keys))
        hits = now.join(keys, keys.columns, "left_semi").groupBy(self._bucket().alias("b")).count().collect()  # a row for each bucket
        if hits:
            hit = {r["b"] for r in hits}
            self._write(self.read(hit).join(keys, keys.columns, "left_anti"), hit)
        return sum(r["count"] for r in hits)
