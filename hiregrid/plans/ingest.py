"""Job-description ingest: gate, analysis, job rows, audit."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hiregrid.functions.prompts import analysis_prompt
from hiregrid.operators.analysis import parse_analysis
from hiregrid.operators.audit import ERROR, INFO, JD_ANALYSIS, audit_rows, job_saved_message, union_audits, upload_audit
from hiregrid.operators.hook import Model, model_responses
from hiregrid.operators.intake import intake_gate
from hiregrid.operators.lookup import category_options
from hiregrid.operators.ranking import WINDOW_ROWS, number_rows
from hiregrid.session import materialize

NO_CATEGORY = "category is null"
# Fixed value: the start of the message about an upload that cannot be saved.
UNHANDLED = "Unhandled exception in /upload: "


@dataclass
class Ingest:
    replies: DataFrame  # upload key, categories, qualifications, requirements
    jobs: DataFrame  # rows for the job table, without an id
    failed: DataFrame  # accepted uploads whose analysis cannot be saved
    audit: DataFrame


def job_rows(analysed: DataFrame, at: Column, keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows to append to the job table."""
    return analysed.select(
        *keep, "jd_text", F.array_join("categories", ", ").alias("category_detected"),
        at.alias("uploaded_at"), "qualifications", "requirements",
    )


def number_jobs(jobs: DataFrame, rows: DataFrame, order: Column, window_rows: int = WINDOW_ROWS) -> DataFrame:
    """``rows`` with the ids that follow the highest ``jd_id`` of ``jobs``, in ``order``."""
    start = jobs.agg(F.coalesce(F.max("jd_id"), F.lit(0))).first()[0]
    return numbered_from(number_rows(rows, [], [order], "_n", window_rows), start + 1)


def numbered_from(rows: DataFrame, first: int) -> DataFrame:
    """``rows`` numbered by ``_n`` from 1 on, with ``jd_id`` from ``first`` on instead."""
    return rows.withColumn("jd_id", F.lit(first - 1).cast("bigint") + F.col("_n")).drop("_n")


def analysis_requests(accepted: DataFrame, categories: DataFrame, key: str) -> DataFrame:
    """``(key, prompt)``; the category options are one value, read by a scalar subquery."""
    options = category_options(categories).scalar()
    return accepted.select(key, analysis_prompt(options, F.col("jd_text")).alias("prompt"))


def analysis_responses(accepted: DataFrame, categories: DataFrame, key: str, model: Model) -> DataFrame:
    """``(key, response)`` of a user's model for ``accepted(key, jd_text)``."""
    return model_responses(analysis_requests(accepted, categories, key), "prompt", model)


def ingest_jobs(uploads: DataFrame, responses: DataFrame, key: str, at: Column) -> Ingest:
    """Ingest ``uploads(key, path, jd_text)`` given model ``responses(key, response)``.

    An upload without a response is analysed as an empty one. A null category
    cannot be saved, and is reported in ``failed``.
    """
    gated = intake_gate(uploads, "path", "jd_text")
    accepted = gated.where(F.col("reject_reason").isNull()).drop("reject_reason")
    answered = accepted.join(responses.select(key, "response"), key, "left").withColumn(
        "response", F.coalesce("response", F.lit(""))
    )
    # Four outputs are read from it: parse once.
    analysed = materialize(parse_analysis(answered).drop("response"), "analysed")
    unsavable = F.exists("categories", lambda c: c.isNull())
    saved, failed = analysed.where(~unsavable), analysed.where(unsavable)
    audit = union_audits(
        upload_audit(gated, (key,)),
        audit_rows(saved, INFO, JD_ANALYSIS, job_saved_message(), (key,)),
        audit_rows(failed, ERROR, JD_ANALYSIS, F.lit(UNHANDLED + NO_CATEGORY), (key,)),
    )
    return Ingest(
        replies=saved.select(key, "categories", "qualifications", "requirements"),
        jobs=job_rows(saved, at, (key,)),
        failed=failed.select(key, F.lit(NO_CATEGORY).alias("error")),
        audit=audit,
    )
