"""Exact numbering of rows, safe for groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hiregrid.operators.joins import fits_broadcast
from hiregrid.session import materialize

WINDOW_ROWS = 1_000_000

# Fixed value: the summary of a job for which nothing was scored.
NO_SUMMARY = "No resumes scored for this job description."


def number_rows(
    df: DataFrame, by: list[str], order: list[Column], name: str, window_rows: int = WINDOW_ROWS, at_most: int | None = None
) -> DataFrame:
    """Number the rows of each ``by`` group 1, 2, … in ``order``, a total order.

    ``by`` columns are never null. While no group has more than ``window_rows``
    rows a window does it: the rows are shuffled once, and a task never holds
    more than a group. Beyond that, one global sort range-partitions the rows,
    so that a group of any size is cut into balanced ranges; each row gets its
    position in its range, and the sizes of the earlier ranges of its group are
    added. The input is written once, to count its largest group, unless groups
    are known to have ``at_most`` so few rows.
    """
    number = F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("bigint")
    if at_most is not None and at_most <= window_rows:
        return df.withColumn(name, number)
    stored = materialize(df, "unnumbered")
    if stored.count() <= window_rows or by and _largest_group(stored, by) <= window_rows:
        return stored.withColumn(name, number)

    # monotonically_increasing_id numbers each range consecutively; writing fixes it.
    ranges = materialize(
        stored.orderBy(*by, *order).select(
            "*", F.spark_partition_id().alias("_range"), F.monotonically_increasing_id().alias("_pos")
        ),
        "ranges",
    )
    spans = ranges.groupBy(*by, "_range").agg(F.min("_pos").alias("_first"), F.count("*").alias("_n"))
    # One row per group and range: groups + ranges rows in all.
    earlier = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = spans.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n")
    if fits_broadcast(offsets):
        offsets = F.broadcast(offsets)
    return (
        ranges.join(offsets, [*by, "_range"])
        .withColumn(name, F.col("_pos") - F.col("_first") + F.col("_before") + 1)
        .drop("_range", "_pos", "_first", "_before")
    )


def _largest_group(df: DataFrame, by: list[str]) -> int:
    return df.groupBy(*by).agg(F.count("*").alias("_n")).agg(F.coalesce(F.max("_n"), F.lit(0))).first()[0]


def rank_resumes(
    scored: DataFrame, window_rows: int = WINDOW_ROWS, by: tuple[str, ...] = ("jd_id",), at_most: int | None = None
) -> DataFrame:
    """Per job, or other ``by``: best final score first, null as 0, ties in path order."""
    best_first = F.coalesce(F.col("final_score"), F.lit(0.0)).desc()
    return number_rows(scored, [*by], [best_first, F.col("resume_path").asc()], "rank", window_rows, at_most)


def summarize(results: DataFrame, asked: DataFrame, by: tuple[str, ...] = ("jd_id",)) -> DataFrame:
    """Per job, or other ``by``: number of results and the first three fit summaries.

    ``asked`` lists the ``by`` values asked for, ``results`` are ranked rows
    with an optional ``fit_summary``.
    """
    counted = results.groupBy(*by).agg(F.count("*").alias("count"))
    summary = F.lit(None).cast("string")
    if "fit_summary" in results.columns:
        best = Window.partitionBy(*by).orderBy("rank")
        top = (
            results.where(F.col("fit_summary").isNotNull())
            .select(*by, "rank", "fit_summary")
            .withColumn("_n", F.row_number().over(best))
            .where(F.col("_n") <= 3)
        )
        texts = F.array_sort(F.collect_list(F.struct("_n", "fit_summary")))
        joined = top.groupBy(*by).agg(F.array_join(texts["fit_summary"], " | ").alias("summary"))
        counted = counted.join(joined, [*by], "left")
        summary = F.col("summary")
    return asked.select(*by).distinct().join(counted, [*by], "left").select(
        *by,
        F.coalesce("count", F.lit(0)).cast("bigint").alias("count"),
        F.coalesce(summary, F.lit(NO_SUMMARY)).alias("summary"),
    )
