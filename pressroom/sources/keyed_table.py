"""A stored table with one row per key, of which an upsert rewrites only the buckets that it touches."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pressroom.operators.commands import upsert_latest
from pressroom.session import settle

BUCKETS = 64
_BUCKET = "_bucket"


@dataclass(frozen=True)
class KeyedTable:
    """Parquet under ``path``, in one folder for each of ``buckets`` hashes of ``key``.

    Choose the buckets for the size of the table, some hundred megabytes each, and keep the number: it is
    part of the layout. A NULL key is a key.
    """

    spark: SparkSession
    path: str
    key: str
    buckets: int = BUCKETS

    def _dealt(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn(_BUCKET, F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int"))

    def exists(self) -> bool:
        folders = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{_BUCKET}=*")
        return bool(folders.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(folders))

    def read(self) -> DataFrame:
        return self.spark.read.parquet(self.path).drop(_BUCKET)

    def read_keys(self, keys: DataFrame) -> DataFrame:
        """The stored rows of ``keys``, from their buckets only: the few folder numbers prune the scan."""
        rows = self.spark.read.parquet(self.path)
        wanted = self._dealt(keys.select(self.key).distinct())
        return rows.where(F.col(_BUCKET).isin(self._touched(wanted))).drop(_BUCKET).join(
            wanted.drop(_BUCKET), self.key, "left_semi"
        )

    def _touched(self, dealt: DataFrame) -> list[int]:
        return [row[0] for row in dealt.select(_BUCKET).distinct().collect()]  # at most ``buckets``

    def upsert(self, updates: DataFrame, order: str) -> None:
        """Of each key the row with the greatest ``order``, stored or new, stays. Other buckets are not opened.

        The new content of the touched buckets is complete in the shared folder before any of them is
        replaced, so a failed task costs nothing, and a run that fails while replacing can be repeated: the
        same updates give the same rows.
        """
        dealt = self._dealt(updates)
        if self.exists():
            stored = self.spark.read.parquet(self.path).where(F.col(_BUCKET).isin(self._touched(dealt)))
            merged = upsert_latest(stored.drop(_BUCKET), updates, self.key, order)
        else:
            merged = upsert_latest(updates.limit(0), updates, self.key, order)
        ready = settle(self._dealt(merged), "upsert")
        writer = ready.repartition(_BUCKET).write.mode("overwrite").partitionBy(_BUCKET)
        writer.option("partitionOverwriteMode", "dynamic").parquet(self.path)
