"""Selecting documents: folder scans over a manifest, the intake gate, failure split."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hiregrid.functions.dialect import is_blank
from hiregrid.functions.text import basename
from hiregrid.session import materialize

PDF_SUFFIX = ".pdf"

# The messages under which rejected uploads are logged.
NO_FILE = "No job description PDF provided"
NOT_PDF = "Only PDF files are accepted for job description"
NO_TEXT = "Job description PDF parsing returned no text"


def scan_folder(manifest: DataFrame, folder: str | None = None, path: str = "resume_path") -> DataFrame:
    """Files ``<folder>/*.pdf``: suffix case-sensitive, hidden files skipped.

    With no ``folder`` given, the rule is applied within every folder at once.
    """
    files = manifest.where(
        F.col(path).endswith(PDF_SUFFIX) & ~basename(F.col(path)).startswith(".")
    )
    return files if folder is None else files.where(F.col("folder") == folder)


def scan_recursive(manifest: DataFrame, path: str = "resume_path") -> DataFrame:
    """Files with the suffix in any case, at any depth."""
    return manifest.where(F.lower(path).endswith(PDF_SUFFIX))


def reject_reason(path: Column, text: Column) -> Column:
    """Why an upload is refused, null if it is accepted."""
    return (
        F.when(path.isNull(), NO_FILE)
        .when(~F.lower(path).endswith(PDF_SUFFIX), NOT_PDF)
        .when(text.isNull() | is_blank(text), NO_TEXT)
    )


def intake_gate(uploads: DataFrame, path: str, text: str) -> DataFrame:
    return uploads.withColumn("reject_reason", reject_reason(F.col(path), F.col(text)))


def nonblank(docs: DataFrame, text: str) -> DataFrame:
    return docs.where(~is_blank(F.col(text)))


def split_failures(df: DataFrame, error: str = "error") -> tuple[DataFrame, DataFrame]:
    """(rows without an error, rows with one): a bad document never stops the rest.

    ``df`` is written once, so that whatever found the errors runs once for both
    sides and the split is a pushed-down filter of the written table.
    """
    checked = materialize(df, "checked")
    return checked.where(F.col(error).isNull()).drop(error), checked.where(F.col(error).isNotNull())
