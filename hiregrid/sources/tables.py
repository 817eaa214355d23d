"""Stored tables: appends, and snapshots replaced bucket by bucket.

A snapshot is parquet directories, one per bucket and version, plus a small
append-only version list. Data is written first and listed last, so a reader
sees a whole batch or none of it, what is being read is never overwritten, and
a batch that was listed already is not applied again.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from hiregrid.functions.dialect import strip
from hiregrid.session import folder_exists

VERSION_SCHEMA = "version bigint, batch_id string, bucket int, path string, high bigint"


def append(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Append rows. Partitioned rows are first brought together by partition.

    The rebalance hint keeps every task from writing a file into every
    partition, and splits a partition too large for one task.
    """
    if not partition_by:
        df.write.mode("append").parquet(path)
        return
    gathered = df.hint("rebalance", *[F.col(c) for c in partition_by])
    gathered.write.mode("append").partitionBy(*partition_by).parquet(path)


def hash_bucket(key: str, buckets: int) -> Column:
    """The partition of an integer key in a table kept in so many partitions, however many keys there are."""
    return F.pmod(F.xxhash64(F.col(key).cast("bigint")), F.lit(buckets)).cast("int")


def stored_or_empty(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """The parquet table at ``path``, or no rows if nothing was written there yet."""
    if folder_exists(spark, path):
        return spark.read.schema(schema).parquet(path)
    return spark.createDataFrame([], schema)


def balanced(scan: DataFrame, key: str) -> DataFrame:
    """Spread a small scan over all cores.

    Text extraction is bound by the processor, and a file of one row group is
    one task however large the cluster. Only scans of less than one
    wave of tasks are shuffled; larger ones fill the cluster and stay as they are.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores, key) if scan.rdd.getNumPartitions() < cores else scan


class SnapshotTable:
    """A table under ``path`` with ``schema``, empty until its first batch. One writer at a time.

    Rows are spread over ``buckets`` by the hash of ``key``. A batch writes new
    versions of the buckets its keys fall into and leaves the others alone, so a
    small batch does not rewrite a large table. ``number`` names a column of
    ids, whose highest one is kept in the version list.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str, buckets: int = 64, number: str | None = None):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema
        self.key, self.buckets, self.number = key, buckets, number

    def bucket(self, key: Column) -> Column:
        """Keys that differ in case or outer white space only are one key."""
        return F.pmod(F.xxhash64(strip(F.lower(key))), F.lit(self.buckets)).cast("int")

    def _versions(self) -> DataFrame:
        return stored_or_empty(self.spark, f"{self.path}/versions", VERSION_SCHEMA)

    def has_batch(self, batch_id: str) -> bool:
        return not self._versions().where(F.col("batch_id") == batch_id).isEmpty()

    def highest(self) -> int:
        """The highest id ever stored in ``number``, from the version list alone."""
        return self._versions().agg(F.coalesce(F.max("high"), F.lit(0))).first()[0]

    def _current(self) -> dict[int, str]:
        """Path of each bucket's latest version; at most ``buckets`` rows reach the driver."""
        latest = self._versions().where(F.col("bucket").isNotNull()).groupBy("bucket").agg(F.max_by("path", "version").alias("path"))
        return {row["bucket"]: row["path"] for row in latest.where("path IS NOT NULL").collect()}

    def read(self, buckets: set[int] | None = None) -> DataFrame:
        """The whole table, or the rows of some buckets."""
        paths = [path for bucket, path in self._current().items() if buckets is None or bucket in buckets]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*paths)

    def update(self, batch: DataFrame, key: str, change: Callable[[DataFrame], DataFrame], batch_id: str) -> None:
        """Apply a batch once: ``change`` maps the rows of its buckets to their next version.

        ``batch`` needs the ``key`` column only; null keys belong to no bucket.
        """
        if self.has_batch(batch_id):
            return
        keys = batch.select(self.bucket(F.col(key)).alias("bucket")).where(F.col(key).isNotNull())
        touched = {row["bucket"] for row in keys.distinct().collect()}
        version = self._versions().agg(F.coalesce(F.max("version"), F.lit(0)) + 1).first()[0]
        target = f"{self.path}/data/{version:08d}-{uuid.uuid4().hex}"
        rows = change(self.read(touched)).withColumn("bucket", self.bucket(F.col(self.key)))
        append(rows, target, partition_by=["bucket"])
        highest = F.max(self.number) if self.number else F.lit(None).cast("bigint")
        written = stored_or_empty(self.spark, target, rows.schema).groupBy("bucket").agg(highest.alias("high")).collect()
        high = {row["bucket"]: row["high"] for row in written}  # a bucket that lost its last row has no path
        listed = self.spark.createDataFrame(
            [(version, batch_id, bucket, f"{target}/bucket={bucket}" if bucket in high else None, high.get(bucket)) for bucket in sorted(touched)]
            or [(version, batch_id, None, None, None)], VERSION_SCHEMA
        )
        listed.coalesce(1).write.mode("append").parquet(f"{self.path}/versions")

    def fill(self, df: DataFrame, batch_id: str) -> None:
        """First content: ``df`` as the version of its buckets."""
        self.update(df, self.key, lambda _: df, batch_id)
