"""A corpus pipeline of five operators: language, exact copies, near copies, benchmark leaks, mixing.

Each stage takes (spark, docs, sf_dir), works on all rows of ``docs`` and returns those that go on, with all their columns; the
last returns the mix. ``run`` writes what every stage returns and reads it again as the next one's documents.

Nulls, empty and very long texts, repeated rows, empty tables and extra columns are treated as the operators' modules say: rows
whose text has no letter (null and empty ones too) are rejected by the first stage, so later ones do not meet them here.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from hiregrid.llm import decontaminate, exact_dedup, language, mixing, near_dedup
from hiregrid.session import materialize

# One stage is not SQL: the rank-order profiles and the pivotal rounding are tested against plain Python instead.
ORACLE_SQL = None


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that have a language; profiles are learned from the labelled rows that are not held out."""
    return language.keep_identified(docs, language.learn_from_documents(docs))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup.keep_first(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each component of near copies."""
    return near_dedup.keep_first(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How often each document is taken, and the words that come of it."""
    return mixing.mix(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", identify_language),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("decontaminate", drop_leaks),
    ("mixing", mix_sources),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
