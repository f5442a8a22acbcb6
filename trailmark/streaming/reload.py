"""ST14: a static side that is replaced while a stream runs, with the last good version as fallback."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Versions:
    """Versions of a table in a shared folder: ``version=1``, ``version=2``, ...

    A version counts once it is complete and ``valid``. What a micro-batch has chosen is stored beside the versions, so a batch that is
    repeated after a failure uses the same version, also in a new process, and whatever was published in between.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, valid: Callable[[DataFrame], bool]):
        self.spark, self.path, self.schema, self.valid = spark, path.rstrip("/"), schema, valid

    def _files(self):
        place = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return place.getFileSystem(self.spark._jsc.hadoopConfiguration()), self.spark._jvm.org.apache.hadoop.fs.Path

    def _numbers(self, kind: str) -> list[int]:
        """Numbers of the complete folders of a kind, ascending."""
        files, path = self._files()
        if not files.exists(path(self.path)):
            return []
        names = [s.getPath().getName() for s in files.listStatus(path(self.path))]
        found = [n for n in names if n.startswith(f"{kind}=") and files.exists(path(f"{self.path}/{n}/_SUCCESS"))]
        return sorted(int(n.split("=")[1]) for n in found)

    def publish(self, rows: DataFrame) -> int:
        """Writes a new version; readers see it when it is complete."""
        number = max(self._numbers("version"), default=0) + 1
        rows.write.mode("overwrite").parquet(f"{self.path}/version={number}")
        return number

    def read(self, number: int) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/version={number}")

    def chosen(self, batch_id: int) -> int:
        """The version for a micro-batch: the one that it chose before, else the newest valid one."""
        place = f"{self.path}/batch={batch_id}"
        if batch_id in self._numbers("batch"):
            return int(self.spark.read.text(place).first()[0])
        for number in reversed(self._numbers("version")):
            if self.valid(self.read(number)):
                self.spark.createDataFrame([(str(number),)], "value string").coalesce(1).write.mode("overwrite").text(place)
                return number
        raise ValueError(f"{self.path} has no valid version")


def join_reloaded(rows: DataFrame, side: Versions, key: str, out: str, checkpoint: str) -> None:
    """Joins each micro-batch with the version that it chooses; ``version`` tells which. Writes a folder for each batch, so a repeated one replaces itself."""

    def join(batch: DataFrame, batch_id: int) -> None:
        number = side.chosen(batch_id)
        batch.join(side.read(number), key).withColumn("version", F.lit(number)).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    rows.writeStream.foreachBatch(join).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
