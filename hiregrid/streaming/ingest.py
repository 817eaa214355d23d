"""Arrival-driven ingest: each micro-batch runs the batch operators and lands exactly once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from hiregrid.operators.audit import unreadable_audit
from hiregrid.operators.details import candidate_details
from hiregrid.operators.lookup import email_key
from hiregrid.operators.ranking import number_rows
from hiregrid.operators.upsert import upsert_candidates
from hiregrid.plans.ingest import ingest_jobs, numbered_from
from hiregrid.session import materialize, run_folder
from hiregrid.sources.files import documents_of, read_pages
from hiregrid.sources.ranges import IdRanges
from hiregrid.sources.tables import SnapshotTable


def run_available(stream: DataFrame, checkpoint: str, on_batch: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Process what has arrived, batch by batch, then stop. Restarts resume at the checkpoint.

    A batch's intermediate tables are deleted when it is done, so a stream leaves nothing but its sinks.
    """

    def in_its_folder(batch: DataFrame, batch_id: int) -> None:
        with run_folder(batch.sparkSession):
            on_batch(batch, batch_id)

    return (
        stream.writeStream.foreachBatch(in_its_folder)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def stream_candidates(
    resumes: DataFrame, table: SnapshotTable, checkpoint: str, at: Callable[[int], Column]
) -> StreamingQuery:
    """Extract arriving résumés and upsert their candidates into ``table``, keyed by candidate_email and numbered by candidate_id.

    A batch that is run again finds its id in the table's version list and
    changes nothing. ``at`` gives the time stamped on a batch.
    """

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        listed = f"candidates-{batch_id}"
        if table.has_batch(listed):
            return
        details = candidate_details(batch, "resume_text").drop("resume_text")
        details = materialize(details.withColumn("_key", email_key(F.col("email"))), "details")
        last_id = table.highest()
        table.update(
            details, "_key", lambda rows: upsert_candidates(rows, details, at(batch_id), last_id=last_id)[0], listed
        )

    return run_available(resumes, checkpoint, on_batch)


def stream_jobs(
    uploads: DataFrame,
    responses: Callable[[DataFrame], DataFrame],
    jobs_path: str,
    audit_path: str,
    checkpoint: str,
    key: str,
    at: Callable[[int], Column],
    ids: IdRanges | None = None,
) -> StreamingQuery:
    """Ingest arriving job descriptions, ``responses`` supplying each batch's model output.

    Rows are written below one directory per batch, replaced when a batch is
    run again, so a retry never doubles them. Job ids follow those of the
    earlier batches, in ``key`` order; they come from ``ids``, which are kept
    beside the jobs unless given, so no earlier batch is read.
    """
    ids = ids or IdRanges(uploads.sparkSession, f"{jobs_path.rstrip('/')}-ids")

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        uploads_now = materialize(batch, "uploads")
        done = ingest_jobs(uploads_now, responses(uploads_now), key, at(batch_id))
        numbered = materialize(number_rows(done.jobs, [], [F.col(key)], "_n"), "numbered")
        first = ids.reserve(batch_id, numbered.count())
        numbered_from(numbered, first).write.mode("overwrite").parquet(f"{jobs_path}/batch={batch_id}")
        done.audit.write.mode("overwrite").parquet(f"{audit_path}/batch={batch_id}")

    return run_available(uploads, checkpoint, on_batch)


def stream_files(
    files: DataFrame, page_reader: Callable[[bytes], list[str]], documents_path: str, audit_path: str, checkpoint: str,
) -> StreamingQuery:
    """Read arriving ``files`` (see ``arriving_files``) to documents ``(path, text, error)`` and log those that can't be read.

    A file that breaks its reader is a document with an empty text, as it is to
    the intake gate, and an ERROR row with the reason. Both outputs have one
    directory per batch, replaced when a batch is run again.
    """

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        documents, target = documents_of(read_pages(batch, page_reader)), f"{documents_path}/batch={batch_id}"
        documents.write.mode("overwrite").parquet(target)
        # The log is made from what was written, so a file is read once.
        written = batch.sparkSession.read.schema(documents.schema).parquet(target)
        unreadable_audit(written).write.mode("overwrite").parquet(f"{audit_path}/batch={batch_id}")

    return run_available(files, checkpoint, on_batch)
