"""Upserts as snapshot in, next snapshot out.

Batches are reduced to one row per key before anything else, with map-side
combining, so both sides of every join are unique in the key and no key can be
hot. A batch small enough is broadcast to the snapshot, which is then not
shuffled. New ids continue the snapshot's highest id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hiregrid.operators.analysis import CATEGORY_SCHEMA, SCORE_FIELDS, category_score_rows
from hiregrid.operators.joins import fits_broadcast, join_on_key
from hiregrid.operators.lookup import email_key
from hiregrid.operators.measured import write_measured
from hiregrid.operators.ranking import WINDOW_ROWS, number_rows
from hiregrid.session import materialize
from hiregrid.sources.tables import SnapshotTable, hash_bucket, stored_or_empty

# Candidate column <- details field; the company has no producer and stays null.
CANDIDATE_VALUES = {
    "candidate_name": "name",
    "candidate_phone": "phone",
    "candidate_location": "current_location",
    "candidate_year": "years_of_experience",
    "candidate_job": "last_position_title",
    "candidate_resume": "resume_path",
    "candidate_company": None,
}
SCORE_VALUES = (*SCORE_FIELDS, "reason")
SCORE_BUCKETS = 256


def max_id(snapshot: DataFrame, column: str) -> int:
    return snapshot.agg(F.coalesce(F.max(column), F.lit(0))).first()[0]


def upsert_candidates(
    snapshot: DataFrame,
    batch: DataFrame,
    at: Column,
    window_rows: int = WINDOW_ROWS,
    last_id: int | None = None,
    first: str = "resume_path",
    last: str = "resume_path",
) -> tuple[DataFrame, DataFrame]:
    """(next candidate snapshot, batch rows refused for a blank e-mail).

    Of the rows of an e-mail the one with the greatest ``last`` wins. Known
    candidates have every listed column overwritten, with null too, and keep id
    and creation time; new ones are numbered by their least ``first``. Both are
    orderable columns without ties. ``last_id`` is given when ``snapshot`` holds
    only a part of the table.
    """
    keyed = batch.withColumn("_key", email_key(F.col("email")))
    refused = keyed.where(F.col("_key").isNull()).drop("_key")
    values = [
        (F.col(source) if source else F.lit(None).cast("string")).alias(target)
        for target, source in CANDIDATE_VALUES.items()
    ]
    written = write_measured(
        keyed.where(F.col("_key").isNotNull())
        .groupBy("_key")
        .agg(F.max_by(F.struct(*values), F.col(last)).alias("_new"), F.min(first).alias("_seq")),
        "latest",
    )
    latest = written.table
    columns = snapshot.columns
    known = snapshot.withColumn("_key", email_key(F.col("candidate_email")))

    unique = {"row_key": "candidate_id", "broadcast": fits_broadcast(written), "task_pairs": None}
    merged = join_on_key(known, latest, "_key", "left", **unique)
    touched = F.col("_new").isNotNull()
    updates = {c: F.when(touched, F.col(f"_new.{c}")).otherwise(F.col(c)) for c in CANDIDATE_VALUES}
    updates["candidate_updated_time"] = F.when(touched, at).otherwise(F.col("candidate_updated_time"))
    current = merged.select(*[updates.get(c, F.col(c)).alias(c) for c in columns])

    matched = join_on_key(known.select("_key"), latest.select("_key"), "_key", **unique)
    unknown = latest.join(matched, "_key", "left_anti")
    fresh = number_rows(unknown, [], [F.col("_seq")], "_n", window_rows, at_most=written.rows)
    if last_id is None:
        last_id = max_id(snapshot, "candidate_id")
    created = {
        "candidate_id": F.lit(last_id).cast("bigint") + F.col("_n"),
        "candidate_email": F.col("_key"),
        "created_at": at,
        "candidate_updated_time": at,
        **{c: F.col(f"_new.{c}") for c in CANDIDATE_VALUES},
    }
    return current.unionByName(fresh.select(*[created[c].alias(c) for c in columns])), refused


def get_or_create_categories(
    categories: DataFrame, incoming: DataFrame, window_rows: int = WINDOW_ROWS
) -> DataFrame:
    """The category table with the unknown names of ``incoming(name, type)`` added.

    A new name takes the lowest type it arrives with, and ids go in name order.
    """
    names = incoming.groupBy("name").agg(F.min("type").alias("type"))
    fresh = number_rows(
        names.join(categories, "name", "left_anti"), [], [F.col("name")], "_n", window_rows
    )
    start = max_id(categories, "category_id")
    return categories.select("category_id", "name", "type").unionByName(
        fresh.select((F.lit(start) + F.col("_n")).alias("category_id"), "name", "type")
    )


def upsert_scores(
    snapshot: DataFrame, batch: DataFrame, order: str = "resume_path", batch_id: str | None = None
) -> DataFrame:
    """The score table after ``batch``, keyed by (jd_id, candidate_id).

    The last row in ``order`` wins within the batch. Rows without a candidate
    have no key: they never match and are always added. With a ``batch_id`` both
    tables have a column of that name, and a batch applied again first takes
    away the keyless rows it added before. Only rows of jobs in the batch take
    part in the join; the others pass through unshuffled, and so do all keyless
    rows, which pile up without bound under one null key.
    """
    keys = ["jd_id", "candidate_id"]
    columns = snapshot.columns
    extra = [c for c in columns if c not in (*keys, *SCORE_VALUES)]
    has_key = F.col("candidate_id").isNotNull()
    latest = batch.where(has_key).groupBy(*keys).agg(
        F.max_by(F.struct(*SCORE_VALUES, *extra), F.col(order)).alias("_new")
    )
    if batch_id is not None:
        snapshot = snapshot.where(has_key | ~F.col("batch_id").eqNullSafe(F.lit(batch_id)))
    jobs = batch.select("jd_id").distinct().withColumn("_in_batch", F.lit(True))
    flagged = join_on_key(snapshot.where(has_key), jobs, "jd_id", "left", row_key="candidate_id")
    in_join = F.coalesce("_in_batch", F.lit(False))
    untouched = flagged.where(~in_join).select(*columns).unionByName(snapshot.where(~has_key))
    old = flagged.where(in_join).select(*keys, F.struct(*SCORE_VALUES, *extra).alias("_old"))
    merged = old.join(latest, keys, "full_outer").withColumn("_row", F.coalesce("_new", "_old"))
    keyed = merged.select(*keys, "_row.*").select(*columns)
    return untouched.unionByName(keyed).unionByName(batch.where(~has_key).select(*columns))


def merge_scores_into(
    path: str, batch: DataFrame, batch_id: str, order: str = "resume_path", buckets: int = SCORE_BUCKETS
) -> None:
    """Upsert ``batch`` into the stored score table, which is partitioned by ``buckets`` hashes of ``jd_id``.

    Only the buckets of the batch's jobs are read and replaced; they are a
    literal filter on the partition column. The number of buckets belongs to the
    stored table. Applying a batch again changes nothing.
    """
    batch = batch.withColumns({"batch_id": F.lit(batch_id), "bucket": hash_bucket("jd_id", buckets)})
    touched = [row["bucket"] for row in batch.select("bucket").distinct().collect()]  # at most ``buckets``
    # Written aside first: a path cannot be read and replaced at once.
    merged = materialize(upsert_scores(stored_scores(path, batch, touched), batch, order, batch_id), "scores")
    (
        merged.hint("rebalance", F.col("bucket"))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("bucket")
        .parquet(path)
    )


def stored_scores(path: str, like: DataFrame, buckets: list[int]) -> DataFrame:
    """The score rows of some buckets of the table at ``path``, in columns typed as in ``like``."""
    columns = ["jd_id", "candidate_id", *SCORE_VALUES, "batch_id", "bucket"]
    schema = T.StructType([T.StructField(c, like.schema[c].dataType) for c in columns])
    return stored_or_empty(like.sparkSession, path, schema).where(F.col("bucket").isin(buckets)).select(*columns)


def replace_children(snapshot: DataFrame, parents: DataFrame, children: DataFrame, key: str) -> DataFrame:
    """``snapshot`` with the rows of every ``key`` in ``parents`` replaced by those of ``children``; a parent without any loses its rows."""
    gone = parents.select(key).distinct()
    kept = snapshot.join(F.broadcast(gone) if fits_broadcast(gone) else gone, key, "left_anti")
    return kept.unionByName(children.select(*snapshot.columns))


def store_category_scores(table: SnapshotTable, responses: DataFrame, order: str, batch_id: str) -> None:
    """Keep the category scores of each candidate, from ``responses(candidate_id, response)``.

    The response that is last in ``order`` counts. Its rows replace all that the candidate had, so categories it does not
    name disappear; a response that is no array of scores, or has no candidate, changes nothing. ``table`` is keyed by candidate_id.
    """
    usable = F.col("candidate_id").isNotNull() & F.from_json("response", CATEGORY_SCHEMA).isNotNull()
    latest = materialize(
        responses.where(usable).groupBy("candidate_id").agg(F.max_by("response", order).alias("response")), "latest-responses")
    table.update(
        latest, "candidate_id",
        lambda rows: replace_children(rows, latest, category_score_rows(latest), "candidate_id"), batch_id)


def category_ids(categories: DataFrame, incoming: DataFrame) -> DataFrame:
    """``incoming`` with the id its name has in ``categories``, null if it has none."""
    known = categories.select("name", "category_id")
    if fits_broadcast(known):
        known = F.broadcast(known)
    return incoming.join(known, "name", "left")
