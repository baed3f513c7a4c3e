"""Tables of which only what changes is written.

A table is Parquet partitioned by a hash of its key. A change reads the buckets that hold one of its keys, stages their
new content and overwrites these partitions: the others keep their files. A change says what its keys hold afterwards, so
applying it again changes nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noticeloom.sources import store
from noticeloom.sources.staging import stage


class Buckets:
    """``schema``: DDL with the key among its columns; rows whose key is null are not kept."""

    def __init__(self, spark: SparkSession, folder: str, schema: str, key: str = "project_no", n: int = 64):
        self.spark, self.folder, self.schema, self.key, self.n = spark, folder, schema, key, n
        self.columns = spark.createDataFrame([], schema).columns

    def _bucket(self):
        return F.pmod(F.xxhash64(self.key), F.lit(self.n)).cast("int").alias("bucket")

    def _write(self, rows: DataFrame, buckets: list[int]) -> None:
        # a row without a key keeps the place of a bucket that has become empty
        empty = self.spark.createDataFrame([(b,) for b in buckets], "bucket int")
        rows = rows.select(*self.columns, self._bucket()).unionByName(empty, allowMissingColumns=True)
        rows.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(self.folder)

    def _all(self) -> DataFrame:
        return self.spark.read.schema(f"{self.schema}, bucket int").parquet(self.folder)

    def create(self, rows: DataFrame | None = None) -> None:
        rows = self.spark.createDataFrame([], self.schema) if rows is None else rows
        self._write(rows.where(F.col(self.key).isNotNull()), list(range(self.n)))

    def read(self) -> DataFrame:
        return self._all().where(F.col(self.key).isNotNull()).select(*self.columns)

    def _touched(self, keys: DataFrame) -> list[int]:
        return sorted(r.bucket for r in keys.where(F.col(self.key).isNotNull()).select(self._bucket()).distinct().collect())  # at most ``n``

    def holding(self, keys: DataFrame) -> DataFrame:
        """The rows of the keys; only their buckets are read."""
        found = self._all().where(F.col("bucket").isin(self._touched(keys))).where(F.col(self.key).isNotNull()).select(*self.columns)
        return found.join(keys.select(self.key).distinct(), self.key, "left_semi").select(*self.columns)

    def replace(self, keys: DataFrame, rows: DataFrame) -> list[int]:
        """The keys' rows go and ``rows``, of these keys, come. Both are stored tables, as they are read more than once.
        Gives the buckets written."""
        keys = keys.where(F.col(self.key).isNotNull()).select(self.key).distinct()
        buckets = self._touched(keys)
        if buckets:
            old = self._all().where(F.col("bucket").isin(buckets) & F.col(self.key).isNotNull()).join(keys, self.key, "left_anti")
            new = rows.select(*self.columns).join(keys, self.key, "left_semi")
            self._write(stage(old.select(*self.columns).unionByName(new.select(*self.columns))), buckets)
        return buckets

    def upsert(self, new: DataFrame, now: str) -> list[int]:
        """Notices by key: ``first_seen`` stays, ``last_seen`` is now, what ``new`` lacks stays as it is."""
        new = stage(new)
        return self.replace(new, store.upsert_notices(self.holding(new), new, now))
