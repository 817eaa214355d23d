"""Candidate details: the rule pass and filling its gaps from model responses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hiregrid.functions.extract import FIELDS, detail_columns, missing_fields
from hiregrid.functions.responses import object_fields, parse_fenced

_CASTS = {"years_of_experience": "int"}


def candidate_details(docs: DataFrame, text: str) -> DataFrame:
    """``docs`` with the nine fields; one projection, no shuffle."""
    return docs.select("*", *detail_columns(F.col(text)))


def with_missing_fields(details: DataFrame) -> DataFrame:
    return details.withColumn("missing_fields", missing_fields())


def _offered(value: Column) -> Column:
    """A response value, null when it is null, '' or []."""
    return F.when(~value.isin("", "[]"), value)


def fill_gaps(answered: DataFrame) -> DataFrame:
    """Fill the missing fields, and only those, of details rows that carry a ``response``.

    A response that is no JSON leaves its row as it was and sets ``fill_error``.
    A null response was never asked for, and is no error.
    """
    parsed = (
        with_missing_fields(answered)
        .withColumn("_parsed", parse_fenced(F.col("response")))
        .withColumn("_answers", object_fields(F.col("_parsed.json"), FIELDS))
    )
    filled = []
    for field in FIELDS:
        value = _offered(F.col(f"_answers.{field}"))
        if field == "skills":
            items = F.coalesce(F.from_json(value, "array<string>"), F.array().cast("array<string>"))
            missing = F.array_contains("missing_fields", field) & value.isNotNull()
            column = F.when(missing, items).otherwise(F.col(field))
        else:
            column = F.coalesce(F.col(field), value.try_cast(_CASTS.get(field, "string")))
        filled.append(column.alias(field))
    others = [c for c in answered.columns if c not in (*FIELDS, "response")]
    error = (F.size("missing_fields") > 0) & F.col("response").isNotNull() & ~F.col("_parsed.ok")
    return parsed.select(*others, *filled, error.alias("fill_error"))


def fill_field(answered: DataFrame, column: str, field: str) -> DataFrame:
    """Fill ``column`` where it is null from ``field`` of the row's ``response``; ``fill_error`` is as for ``fill_gaps``."""
    parsed = answered.withColumn("_parsed", parse_fenced(F.col("response")))
    value = _offered(object_fields(F.col("_parsed.json"), (field,))[field])
    error = F.col(column).isNull() & F.col("response").isNotNull() & ~F.col("_parsed.ok")
    return parsed.withColumns({column: F.coalesce(column, value), "fill_error": error}).drop("response", "_parsed")


def fill_missing(details: DataFrame, responses: DataFrame, on: str) -> DataFrame:
    """Fill from a table of responses with at most one row per ``on``."""
    return fill_gaps(details.join(responses.select(on, "response"), on, "left"))
