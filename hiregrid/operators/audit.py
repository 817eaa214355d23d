"""Audit rows: what was accepted, refused and failed, as a table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Log types and process names.
INFO, ERROR = "INFO", "ERROR"
JD_ANALYSIS = "JD_Analysis"
CANDIDATE_PARSING = "Candidate_Parsing"
SCORE_RECOMMENDATION = "Score_Recommendation"

# Log messages about files and candidates.
UNREADABLE = "PDF parsing failed: "
NOT_STORED = "Failed candidate upsert: "

COLUMNS = ("log_type", "process", "message")


def audit_rows(df: DataFrame, log_type: str, process: str, message: Column, keep: tuple[str, ...] = ()) -> DataFrame:
    return df.select(
        *keep, F.lit(log_type).alias("log_type"), F.lit(process).alias("process"), message.alias("message")
    )


def union_audits(*audits: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, audits)


def job_saved_message() -> Column:
    """Message of a saved job; needs categories, qualifications, requirements. Its wording is a fixed value."""
    return F.concat(
        F.lit("JD saved (detected='"), F.array_join("categories", ","),
        F.lit("', quals='"), F.coalesce("qualifications", F.lit("None")),
        F.lit("', reqs='"), F.coalesce("requirements", F.lit("None")), F.lit("')"),
    )


def unreadable_audit(documents: DataFrame, keep: tuple[str, ...] = ("path",)) -> DataFrame:
    """One ERROR row per file that could not be read, with the reason; needs ``error``."""
    broken = documents.where(F.col("error").isNotNull())
    return audit_rows(broken, ERROR, JD_ANALYSIS, F.concat(F.lit(UNREADABLE), "error"), keep)


def upload_audit(gated: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """One INFO row per upload received, one ERROR row per upload refused."""
    received = audit_rows(gated, INFO, JD_ANALYSIS, F.lit("JD upload received"), keep)
    refused = gated.where(F.col("reject_reason").isNotNull())
    return union_audits(received, audit_rows(refused, ERROR, JD_ANALYSIS, F.col("reject_reason"), keep))
