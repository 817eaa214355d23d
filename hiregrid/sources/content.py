"""Costly results, such as a model's answers, kept by the digest of what they were made from.

A store is an append-only parquet table, partitioned by the maker's version and the first bits of the digest. What is asked
for is anti-joined with it, so only contents that this version has never answered go to the maker, each once however many rows
hold it. They are made in waves, each written before the next begins: after a lost job a rerun repeats one wave at most, and
after a lost task Spark repeats that task alone. A wave that was written in part leaves whole rows only, which count; should
two writers answer one content, the least answer is read by everybody.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hiregrid.operators.joins import fits_broadcast, join_on_key
from hiregrid.session import intermediate_folder, materialize
from hiregrid.sources.tables import append, stored_or_empty

WAVE = 100_000  # contents made between two writes


def content_digest(content: Column) -> Column:
    """The key of a content; null for null."""
    return F.sha2(content.cast("binary"), 256)


class ContentStore:
    """Values of type ``value`` made by ``version`` of something, by the digest of their content.

    The number of ``buckets`` belongs to the stored table. ``wave`` bounds what a lost job has to make again.
    """

    def __init__(self, spark: SparkSession, path: str, version: str, value: T.DataType, buckets: int = 64, wave: int = WAVE):
        self.spark, self.path, self.version = spark, path.rstrip("/"), version
        self.value, self.buckets, self.wave = value, buckets, wave
        self.schema = (T.StructType().add("digest", T.StringType()).add("value", value).add("batch", T.StringType())
                       .add("version", T.StringType()).add("bucket", T.IntegerType()))

    def bucket(self, digest: Column) -> Column:
        return F.pmod(F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint"), F.lit(self.buckets)).cast("int")

    def _rows(self, wanted: DataFrame) -> DataFrame:
        """The stored rows of ``wanted(digest)``; only their buckets are read."""
        buckets = [row["bucket"] for row in wanted.select(self.bucket(F.col("digest")).alias("bucket")).distinct().collect()]
        rows = stored_or_empty(self.spark, self.path, self.schema).where((F.col("version") == self.version) & F.col("bucket").isin(buckets))
        asked = wanted.select("digest").distinct()
        return rows.join(F.broadcast(asked) if fits_broadcast(asked) else asked, "digest", "left_semi")

    def read(self, wanted: DataFrame) -> DataFrame:
        """(digest, value, batch) of those of ``wanted(digest)`` that have a value, one row each."""
        least = F.min(F.struct("value", "batch"))
        return self._rows(wanted).groupBy("digest").agg(least.alias("_kept")).select("digest", "_kept.value", "_kept.batch")

    def complete(self, contents: DataFrame, make: Callable[[DataFrame], DataFrame], batch: str) -> int:
        """Make what is not stored yet of ``contents(digest, content)``; returns how many were asked for.

        ``make`` maps (digest, content) to (digest, value). A null value is a failure: it is not stored, and asked for again next time.
        """
        asked = materialize(contents.where(F.col("digest").isNotNull()).groupBy("digest").agg(F.any_value("content").alias("content")), "asked")
        known = self._rows(asked).select("digest").distinct()
        unseen = materialize(asked.join(known, "digest", "left_anti"), "unseen")
        count = unseen.count()
        waves = math.ceil(count / self.wave)
        parts = f"{intermediate_folder(self.spark)}/waves-{uuid.uuid4().hex}"
        if waves > 1:  # laid out once, so that a wave reads its own contents and not those of all
            append(unseen.withColumn("wave", F.pmod(F.xxhash64("digest"), F.lit(waves)).cast("int")), parts, partition_by=["wave"])
        for wave in range(waves):
            part = stored_or_empty(self.spark, f"{parts}/wave={wave}", unseen.schema) if waves > 1 else unseen
            made = make(part.select("digest", "content")).where(F.col("value").isNotNull()).select(
                "digest", "value", F.lit(batch).alias("batch"), F.lit(self.version).alias("version"), self.bucket(F.col("digest")).alias("bucket"))
            append(made, self.path, partition_by=["version", "bucket"])
        return count

    def answered(self, rows: DataFrame, content: str, name: str, make: Callable[[DataFrame], DataFrame], batch: str) -> DataFrame:
        """``rows`` with the ``content`` column replaced by its value and, as ``<name>_batch``, the batch that made it.

        Both are null where the content is null or could not be made. Rows that share a content share its value.
        """
        keyed = materialize(rows.withColumns({"_digest": content_digest(F.col(content)), "_row": F.monotonically_increasing_id()}), "contents")
        contents = keyed.select(F.col("_digest").alias("digest"), F.col(content).alias("content"))
        self.complete(contents, make, batch)
        values = materialize(self.read(contents.select("digest").where(F.col("digest").isNotNull())), "values").select(
            F.col("digest").alias("_digest"), F.col("value").alias(name), F.col("batch").alias(f"{name}_batch"))
        # One content may be that of very many rows.
        return join_on_key(keyed.drop(content), values, "_digest", "left", row_key="_row").drop("_digest", "_row")
