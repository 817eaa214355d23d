"""Pairing jobs with the résumés of their folder and scoring the pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hiregrid.functions.prompts import score_prompt
from hiregrid.functions.text import basename, display_name, full_resume_text, keyword_set
from hiregrid.operators.analysis import SCORE_FIELDS, parse_scores
from hiregrid.operators.hook import Model, model_responses
from hiregrid.operators.intake import split_failures
from hiregrid.operators.joins import join_on_key

NO_RESPONSE = "no response"
JOB_TEXTS = ("category_detected", "qualifications", "requirements")
RESULT_COLUMNS = (
    "candidate_email",
    "candidate_name",
    "resume_path",
    "resume_filename",
    *SCORE_FIELDS,
    "reason",
)
_SECTIONS = {
    "category_score": "category_detected",
    "requirements_score": "requirements",
    "qualifications_score": "qualifications",
}


def pair_jobs_with_resumes(jobs: DataFrame, resumes: DataFrame, **options) -> DataFrame:
    """Every résumé of a job's folder, once per job.

    ``resumes`` is the large side and stays where it is while the jobs can be
    broadcast; ``options`` go to :func:`join_on_key`.
    """
    return join_on_key(resumes, jobs, "folder", row_key="resume_path", **options)


def resume_keywords(skills: Column) -> Column:
    """The keywords of the extracted skills, which is all the text a résumé is scored by."""
    return keyword_set(F.array_join(skills, "\n"))


def score_by_keywords(jobs: DataFrame, resumes: DataFrame, **options) -> DataFrame:
    """Built-in score: the share of each job section's keywords found among the résumé's.

    Keywords are taken once per job and once per résumé, and intersected within
    the pair row, so that no join runs over keywords and pairs without overlap
    need no joining back. Sections are counted against the few keywords the pair
    shares.
    """
    wanted = [keyword_set(F.col(c)).alias(c) for c in JOB_TEXTS]
    asked = jobs.select("jd_id", "folder", *wanted).withColumn("_wanted", F.array_distinct(F.concat(*JOB_TEXTS)))
    offered = resumes.withColumn("_offered", resume_keywords(F.col("skills")))
    pairs = pair_jobs_with_resumes(asked, offered, **options).withColumn(
        "_shared", F.array_intersect("_wanted", "_offered")
    )

    # Hundredths, rounded half up in whole numbers: exact, and far cheaper than decimal rounding.
    def section_score(keywords: str) -> Column:
        hits, wanted = F.size(F.array_intersect(keywords, "_shared")), F.size(keywords)
        share = F.floor((F.lit(2000) * hits + wanted) / (F.lit(2) * wanted))
        return F.when((F.size("_shared") > 0) & (wanted > 0), share).otherwise(F.lit(0))

    hundredths = {f"_{score}": section_score(keywords) for score, keywords in _SECTIONS.items()}
    total = sum((F.col(score) for score in hundredths), F.lit(0))
    return pairs.withColumns(hundredths).withColumns({
        **{score: F.col(f"_{score}") / 100 for score in _SECTIONS},
        "final_score": F.floor((total * 2 + 3) / 6) / 100,
        "reason": F.array_join(F.array_sort("_shared"), ", "),
    }).drop(*JOB_TEXTS, *hundredths, "_wanted", "_offered", "_shared")


def score_from_responses(pairs: DataFrame, responses: DataFrame, on: list[str]) -> tuple[DataFrame, DataFrame]:
    """(scored pairs, failed pairs) from a table of model responses keyed by ``on``."""
    parsed = parse_scores(responses.select(*on, "response")).drop("response").withColumn("_answered", F.lit(True))
    joined = pairs.join(parsed, on, "left")
    error = F.when(F.col("_answered"), F.col("error")).otherwise(F.lit(NO_RESPONSE))
    return split_failures(joined.withColumn("error", error).drop("_answered"))


def score_by_model(
    jobs: DataFrame, resumes: DataFrame, model: Model, **options
) -> tuple[DataFrame, DataFrame]:
    """(scored pairs, failed pairs) from a user's model, asked once per pair.

    The résumé text sent is what extraction made of the sections, as for keywords.
    """
    asked = jobs.select("jd_id", "folder", *[F.coalesce(c, F.lit("")).alias(c) for c in JOB_TEXTS])
    offered = resumes.withColumn("_text", full_resume_text(resumes.schema))
    prompt = score_prompt(*[F.col(c) for c in ("category_detected", "requirements", "qualifications", "_text")])
    pairs = pair_jobs_with_resumes(asked, offered, **options).withColumn("_prompt", prompt)
    answered = model_responses(pairs.drop(*JOB_TEXTS, "_text"), "_prompt", model)
    return split_failures(parse_scores(answered).drop("response"))


def result_rows(scored: DataFrame) -> DataFrame:
    """The result projection: job, folder, rank and candidate id if any, and the nine result columns."""
    named = scored.withColumns({
        "candidate_email": F.col("email"),
        "candidate_name": display_name(F.col("name"), F.col("email")),
        "resume_filename": basename(F.col("resume_path")),
    })
    keys = [c for c in ("jd_id", "folder", "rank", "candidate_id") if c in scored.columns]
    return named.select(*keys, *RESULT_COLUMNS)
