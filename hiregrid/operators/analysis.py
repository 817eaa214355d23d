"""Parsing model responses into tables: job analysis, scores, per-category scores."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hiregrid.functions.responses import has_key, object_fields, parse_first_object, parse_widest_object

SCORE_FIELDS = ("category_score", "requirements_score", "qualifications_score", "final_score")
ANALYSIS_FIELDS = ("category", "qualifications", "requirements")
CATEGORY_SCHEMA = "array<struct<category:string,score:double,weight:double,justification:string>>"


def parse_analysis(responses: DataFrame) -> DataFrame:
    """Adds categories, qualifications and requirements; an unusable response gives [] and ''."""
    parsed = responses.withColumn("_json", parse_first_object(F.col("response"))["json"]).withColumn(
        "_fields", object_fields(F.col("_json"), ANALYSIS_FIELDS)
    )

    def value_or(key: str, wrap: Callable[[Column], Column], default: Column) -> Column:
        return F.when(has_key(F.col("_json"), key), wrap(F.col(f"_fields.{key}"))).otherwise(default)

    return parsed.withColumns({
        "categories": value_or("category", F.array, F.array().cast("array<string>")),
        "qualifications": value_or("qualifications", lambda v: v, F.lit("")),
        "requirements": value_or("requirements", lambda v: v, F.lit("")),
    }).drop("_json", "_fields")


def parse_scores(responses: DataFrame) -> DataFrame:
    """Adds the four scores, reason and ``error`` (null when the response is usable).

    Absent keys give null scores; a score that is not a number is an error.
    """
    parsed = responses.withColumn("_parsed", parse_widest_object(F.col("response"))).withColumn(
        "_fields", object_fields(F.col("_parsed.json"), (*SCORE_FIELDS, "reason"))
    )
    raw = {s: F.col(f"_fields.{s}") for s in SCORE_FIELDS}
    number = {s: raw[s].try_cast("double") for s in SCORE_FIELDS}
    not_number = F.lit(False)
    for s in SCORE_FIELDS:
        not_number = not_number | (raw[s].isNotNull() & number[s].isNull())
    error = (
        F.when(~F.col("_parsed.ok"), "no JSON in response")
        .when(~F.col("_parsed.is_object"), "response is not an object")
        .when(not_number, "score is not a number")
    )
    return parsed.withColumns(
        {**number, "reason": F.col("_fields.reason"), "error": error}
    ).drop("_parsed", "_fields")


def category_score_rows(responses: DataFrame) -> DataFrame:
    """One row per element of the nested score array, other columns kept."""
    elements = F.from_json("response", CATEGORY_SCHEMA)
    others = [c for c in responses.columns if c != "response"]
    return responses.select(*others, F.explode(elements).alias("_e")).select(
        *others, F.col("_e.category").alias("category_name"), "_e.score", "_e.weight", "_e.justification"
    )


def weighted_final(category_scores: DataFrame, by: list[str]) -> DataFrame:
    """Sum of score times weight over sum of weights, null if the weights sum to 0."""
    total = F.sum("weight")
    return category_scores.groupBy(*by).agg(
        F.when(total != 0, F.sum(F.col("score") * F.col("weight")) / total).alias("final_score")
    )
