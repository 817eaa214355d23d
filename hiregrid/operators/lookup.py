"""Lookups by key against the job, candidate and category tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hiregrid.functions.dialect import strip
from hiregrid.operators.joins import fits_broadcast, join_on_key
from hiregrid.operators.measured import write_measured
from hiregrid.operators.scoring import JOB_TEXTS
from hiregrid.sources.tables import append, hash_bucket


def email_key(email: Column) -> Column:
    """The key candidates are matched on; null for a blank address."""
    return F.nullif(strip(F.lower(email)), F.lit(""))


def lookup_job(jobs: DataFrame, jd_id: int) -> DataFrame:
    """One job by id, null texts as ''; no row if there is none. The filter reaches the scan."""
    texts = {c: F.coalesce(c, F.lit("")) for c in JOB_TEXTS}
    return jobs.where(F.col("jd_id") == jd_id).withColumns(texts)


def lookup_jobs(
    requests: DataFrame, jobs: DataFrame, request_id: str, columns: tuple[str, ...] = ("jd_text",), **options
) -> DataFrame:
    """Each request with its job, null texts as '', and whether the job exists.

    Of the job, ``columns`` come along besides its section texts; no others are read.
    """
    known = jobs.select("jd_id", *columns, *JOB_TEXTS, F.lit(True).alias("found"))
    joined = join_on_key(requests, known, "jd_id", "left", row_key=request_id, **options)
    return joined.withColumns({
        "found": F.coalesce("found", F.lit(False)),
        **{c: F.when(F.col("found"), F.coalesce(c, F.lit(""))) for c in JOB_TEXTS},
    })


def store_jobs(jobs: DataFrame, path: str, buckets: int) -> None:
    """Append ``jobs`` to the table at ``path``, which is partitioned by the hash bucket of the job id."""
    append(jobs.withColumn("bucket", hash_bucket("jd_id", buckets)), path, partition_by=["bucket"])


def asked_jobs(requests: DataFrame, stored: DataFrame, buckets: int) -> DataFrame:
    """The rows of a job table, as ``store_jobs`` keeps it, that ``requests`` name.

    The distinct ids asked for are measured as they are written. If they fit they are broadcast, and
    Spark leaves the buckets none of them falls into unread; else it is a plain semi-join.
    """
    ids = requests.where(F.col("jd_id").isNotNull()).select("jd_id", hash_bucket("jd_id", buckets).alias("bucket")).distinct()
    written = write_measured(ids, "asked")
    asked = written.table.where(F.col("bucket") >= 0)  # all of them: Spark prunes by a side with a comparison only
    return stored.join(F.broadcast(asked) if fits_broadcast(written) else asked, ["bucket", "jd_id"], "left_semi")


def lookup_candidates(
    rows: DataFrame, candidates: DataFrame, email: str, row_key: str, name: str = "candidate_id", **options
) -> DataFrame:
    """Adds the candidate id for each row's e-mail, null if unknown."""
    known = candidates.select(email_key(F.col("candidate_email")).alias("_key"), F.col("candidate_id").alias(name))
    # Null keys match nothing; a key of their own per row keeps them from piling up in one task.
    keyed = rows.withColumn("_key", F.coalesce(email_key(F.col(email)), F.concat(F.lit("\0"), F.col(row_key).cast("string"))))
    return join_on_key(keyed, known, "_key", "left", row_key=row_key, **options).drop("_key")


def resolve_candidates(
    results: DataFrame, before: DataFrame, upserted: DataFrame, row_key: str, **options
) -> DataFrame:
    """Candidate id of each result row.

    A row with e-mail and path takes the id its upsert gave; any other is looked
    up in the table as it was. Rows without a match keep a null id.
    """
    has_both = (F.coalesce("candidate_email", F.lit("")) != "") & (F.coalesce("resume_path", F.lit("")) != "")
    with_new = lookup_candidates(results, upserted, "candidate_email", row_key, "_upserted_id", **options)
    with_old = lookup_candidates(with_new, before, "candidate_email", row_key, "_known_id", **options)
    return with_old.withColumn(
        "candidate_id", F.when(has_both, F.col("_upserted_id")).otherwise(F.col("_known_id"))
    ).drop("_upserted_id", "_known_id")


def category_options(categories: DataFrame) -> DataFrame:
    """One row: all category names in id order, as offered to a model in one prompt."""
    return categories.agg(
        F.array_join(
            F.array_sort(F.collect_list(F.struct("category_id", "name")))["name"], ", "
        ).alias("category_options")
    )
