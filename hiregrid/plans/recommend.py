"""Batch recommendation: every requested job against the résumés of its folder."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hiregrid.operators.analysis import SCORE_FIELDS
from hiregrid.operators.audit import (
    CANDIDATE_PARSING,
    ERROR,
    INFO,
    JD_ANALYSIS,
    NOT_STORED,
    SCORE_RECOMMENDATION,
    audit_rows,
    union_audits,
)
from hiregrid.operators.details import candidate_details
from hiregrid.operators.hook import Model, complete_details
from hiregrid.operators.intake import scan_folder
from hiregrid.operators.joins import fits_broadcast, join_on_key
from hiregrid.operators.lookup import email_key, lookup_candidates, lookup_jobs
from hiregrid.operators.measured import write_measured
from hiregrid.operators.ranking import rank_resumes, summarize
from hiregrid.operators.scoring import (
    pair_jobs_with_resumes,
    result_rows,
    score_by_keywords,
    score_by_model,
    score_from_responses,
)
from hiregrid.operators.upsert import upsert_candidates, upsert_scores
from hiregrid.session import materialize


REQUEST = ("jd_id", "folder")

# The messages of a recommendation.
NO_JOB_ID = "Missing jd_id parameter"
NO_FOLDER = "Missing resume_folder parameter"
COMPLETED = "Completed embedding recommendation for jd_id="
NOT_FOUND = ("Job description ", " not found")
LOAD_ERROR = "Resume load error: "
NO_EMAIL = "Cannot upsert candidate without an email."

FILL_FAILED = "The answer for missing fields could not be read: "


@dataclass
class Recommendation:
    results: DataFrame  # result rows with candidate_id, ranked within their request
    summary: DataFrame  # one row per request whose job exists
    not_found: DataFrame  # requests without a job
    refused: DataFrame  # requests without a job id or a folder, with reject_reason
    failed: DataFrame  # pairs whose response could not be used
    candidates: DataFrame  # next candidate snapshot
    scores: DataFrame | None  # next score snapshot
    score_batch: DataFrame  # the score rows to store, the later in _place winning: for merge_scores_into(…, order="_place")
    audit: DataFrame  # log rows with the jd_id and folder they are about


def gate_requests(requests: DataFrame) -> DataFrame:
    """``requests(jd_id, folder)`` with a ``reject_reason``, null for those that can be answered."""
    reason = F.when(F.col("jd_id").isNull(), F.lit(NO_JOB_ID)).when(
        F.coalesce("folder", F.lit("")) == "", F.lit(NO_FOLDER)
    )
    return requests.select(*REQUEST, reason.alias("reject_reason"))


def _audit(
    found: DataFrame, not_found: DataFrame, refused: DataFrame, failed: DataFrame, unfilled: DataFrame, nameless: DataFrame
) -> DataFrame:
    completed = F.concat(F.lit(COMPLETED), "jd_id")
    missing = F.concat(F.lit(NOT_FOUND[0]), F.col("jd_id"), F.lit(NOT_FOUND[1]))
    broken = F.concat(F.lit(LOAD_ERROR), F.col("error"))
    # A résumé is filled once, whichever jobs ask for it.
    gaps = unfilled.select(F.lit(None).cast(failed.schema["jd_id"].dataType).alias("jd_id"), "folder", "resume_path")
    return union_audits(
        audit_rows(found, INFO, SCORE_RECOMMENDATION, completed, REQUEST),
        audit_rows(not_found, ERROR, SCORE_RECOMMENDATION, missing, REQUEST),
        audit_rows(refused, ERROR, SCORE_RECOMMENDATION, F.col("reject_reason"), REQUEST),
        audit_rows(failed, ERROR, JD_ANALYSIS, broken, REQUEST),
        audit_rows(gaps, ERROR, CANDIDATE_PARSING, F.concat(F.lit(FILL_FAILED), "resume_path"), REQUEST),
        audit_rows(nameless, ERROR, SCORE_RECOMMENDATION, F.lit(NOT_STORED + NO_EMAIL), REQUEST),
    )


def _ordered(details: DataFrame, ranked: DataFrame) -> DataFrame:
    """The ``details`` of ranked résumés, with their first and last place in the order of storing.

    Results are stored request by request (by job id, then folder) and in ranked order within a request.
    """
    place = F.struct(*REQUEST, "rank")
    places = ranked.groupBy("resume_path").agg(F.min(place).alias("_first"), F.max(place).alias("_last"))
    return details.join(places, "resume_path")


def recommend(
    requests: DataFrame,
    jobs: DataFrame,
    resumes: DataFrame,
    candidates: DataFrame | Callable[[DataFrame], DataFrame],
    scores: DataFrame | None,
    at: Column,
    responses: DataFrame | None = None,
    model: Model | None = None,
    fill_model: Model | None = None,
) -> Recommendation:
    """Score, rank and store, request by request.

    ``requests(jd_id, folder)`` asks for a job's ranking of a folder; a request
    without either is refused, a repeated one is answered once. Résumés
    ``(resume_path, folder, resume_text)`` are read and extracted once: the
    extracted fields, without the texts, are written and feed both the scoring
    and the candidate upsert. ``fill_model`` is asked for fields the rules
    missed. Scores come from ``responses(jd_id, resume_path, response)`` or a
    user's ``model`` if given, else from keywords.

    Stored rows follow the order of storing: of two résumés of one candidate the
    lower-ranked one is stored last and stays, across requests the one of the
    later job id and folder. Instead of a snapshot, ``candidates`` may be a
    function that stores the reached résumés' details (with their first and last
    place as ``_first`` and ``_last``) and returns the table to find them in;
    without ``scores`` there is no next score snapshot, only the batch for it.
    """
    gated = materialize(gate_requests(requests), "requests")
    refused = gated.where(F.col("reject_reason").isNotNull())
    asked = gated.where(F.col("reject_reason").isNull()).select(*REQUEST).distinct()
    written = write_measured(lookup_jobs(asked, jobs.drop("folder"), "folder", columns=()), "looked-up")
    looked_up = written.table
    found = looked_up.where("found").drop("found")
    not_found = looked_up.where(~F.col("found")).select(*REQUEST)

    small = {"broadcast": fits_broadcast(written) or fits_broadcast(found)}
    folders = found.select("folder").distinct()
    few_folders = small["broadcast"] or fits_broadcast(folders)
    in_scope = scan_folder(resumes)
    # Texts are not shuffled: folders too many to broadcast meet the extracted fields, unless a model is paid by the text.
    early = few_folders or fill_model is not None
    if early:
        in_scope = join_on_key(in_scope, folders, "folder", row_key="resume_path", broadcast=few_folders)
    details = candidate_details(in_scope, "resume_text")
    if fill_model is not None:
        details = complete_details(details, "resume_text", fill_model)
    else:
        details = details.drop("resume_text").withColumn("fill_error", F.lit(False))
    if not early:
        details = join_on_key(details, folders, "folder", row_key="resume_path", broadcast=False)
    extracted = materialize(details, "details")
    details = extracted.drop("fill_error")

    if model is None and responses is None:
        scored = score_by_keywords(found, details, **small)
        failed = found.select(*REQUEST, F.lit("").alias("resume_path"), F.lit("").alias("error")).where(F.lit(False))
    elif model is not None:
        scored, failed = score_by_model(found, details, model, **small)
    else:
        pairs = pair_jobs_with_resumes(found.select(*REQUEST), details, **small)
        scored, failed = score_from_responses(pairs, responses, ["jd_id", "resume_path"])
    # A request is one group of the ranking: at most the résumés of its folder, once for each job of that id.
    jobs_of = found.groupBy(*REQUEST).agg(F.count("*").alias("_jobs")).groupBy("folder").agg(F.max("_jobs").alias("_jobs"))
    groups = jobs_of.join(extracted.groupBy("folder").agg(F.count("*").alias("_resumes")), "folder")
    at_most = groups.agg(F.coalesce(F.max(F.col("_jobs") * F.col("_resumes")), F.lit(0))).first()[0]
    # The only time that pairs are written: candidate ids are looked up by résumé and joined to them where they are read.
    ranked = materialize(rank_resumes(result_rows(scored), by=REQUEST, at_most=at_most), "ranked")

    # Only ranked résumés reach the candidate table; a result's candidate id is the one its upsert gave, as every result has a path.
    reached = materialize(_ordered(details, ranked), "reached")
    if callable(candidates):
        stored = candidates(reached)
    else:
        stored = materialize(upsert_candidates(candidates, reached, at, first="_first", last="_last")[0], "candidates")
    ids = write_measured(lookup_candidates(reached.select("resume_path", "email"), stored, "email", "resume_path").drop("email"), "ids")
    results = join_on_key(ranked, ids.table, "resume_path", "left", row_key="rank", broadcast=fits_broadcast(ids))

    place = F.struct("folder", "rank").alias("_place")
    batch = results.select("jd_id", "candidate_id", *SCORE_FIELDS, "reason", place)
    nameless = ranked.where((F.col("candidate_email") != "") & email_key(F.col("candidate_email")).isNull())
    return Recommendation(
        results=results,
        summary=summarize(results, found, REQUEST),
        not_found=not_found,
        refused=refused,
        failed=failed.select(*REQUEST, "resume_path", "error"),
        candidates=stored,
        scores=None if scores is None else upsert_scores(scores, batch, order="_place"),
        score_batch=batch,
        audit=_audit(found, not_found, refused, failed, extracted.where("fill_error"), nameless),
    )
