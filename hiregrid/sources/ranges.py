"""Ids handed out to batches, from a small table of ranges instead of the numbered table."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from hiregrid.sources.tables import stored_or_empty

RANGE_SCHEMA = "batch bigint, first bigint, last bigint"
EARLIER = -1  # the batch of ids that were given before there were ranges


class IdRanges:
    """The ids of each batch, one row per batch under ``path``. One writer at a time.

    A range is written before the rows that use it, so a batch that is run again after it was lost gets the same ids.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _ranges(self):
        return stored_or_empty(self.spark, self.path, RANGE_SCHEMA)

    def _write(self, batch: int, first: int, last: int) -> None:
        self.spark.createDataFrame([(batch, first, last)], RANGE_SCHEMA).coalesce(1).write.mode("append").parquet(self.path)

    def start_after(self, highest: int) -> None:
        """Take ids up to ``highest`` as given; without effect if there are ranges already."""
        if self._ranges().isEmpty():
            self._write(EARLIER, 1, highest)

    def reserve(self, batch: int, count: int) -> int:
        """The first of ``count`` ids for ``batch``, following the highest id given so far."""
        ranges = self._ranges()
        held = ranges.where(F.col("batch") == batch).first()
        if held is not None:
            if held["last"] - held["first"] + 1 != count:
                raise ValueError(f"batch {batch} had {held['last'] - held['first'] + 1} ids and now asks for {count}")
            return held["first"]
        first = ranges.agg(F.coalesce(F.max("last"), F.lit(0))).first()[0] + 1
        self._write(batch, first, first + count - 1)
        return first
