"""The registered queries: every operator over whole tables."""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable, Iterable
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from checks import fixtures as fx
from checks.columns import NULLABLE_INTEGERS
from hiregrid.functions import extract, responses, text
from hiregrid.functions.prompts import missing_fields_prompt, score_prompt
from hiregrid.operators import analysis, audit, details, hook, intake, lookup, ranking, scoring, similarity, upsert
from hiregrid.plans.ingest import Ingest, analysis_requests, ingest_jobs, job_rows, number_jobs
from hiregrid.plans.recommend import Recommendation, recommend
from hiregrid.session import local_path, materialize, shared_folder
from hiregrid.sources import files, tables
from hiregrid.sources.content import ContentStore
from hiregrid.sources.corpus import VectorCorpus
from hiregrid.sources.ranges import IdRanges
from hiregrid.streaming import ingest as streams
from hiregrid.streaming.ingest import stream_candidates
from hiregrid.streaming.recommend import RecommendationTables
from hiregrid.streaming.recommend import stream_recommend as answer_requests

if TYPE_CHECKING:
    import pyarrow as pa

# Folders of the files here: there may be some hundred thousand of them.
FILE_FOLDERS = 256
# Partitions of the score tables here: the tables have up to some ten million rows.
SCORE_TABLE_BUCKETS = 16

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def batch_time() -> F.Column:
    return F.lit("2024-06-01 00:00:00").cast("timestamp")


def query(run: Query) -> Query:
    QUERIES[run.__name__] = run
    return run


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def corpus(spark: SparkSession, sf: str) -> DataFrame:
    return tables.balanced(fx.load(spark, sf, fx.CORPUS), "resume_id")


def resumes(spark: SparkSession, sf: str) -> DataFrame:
    return tables.balanced(fx.load(spark, sf, fx.RESUMES), "resume_id")


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return tables.balanced(table(spark, sf, "documents").select("doc_id", "text"), "doc_id")


def jobs(spark: SparkSession, sf: str) -> DataFrame:
    return fx.load(spark, sf, fx.JOBS)


def responses_of(spark: SparkSession, sf: str, kind: str) -> DataFrame:
    return fx.load(spark, sf, fx.RESPONSES).where(F.col("kind") == kind).drop("kind")


def resume_details(spark: SparkSession, sf: str) -> DataFrame:
    return details.candidate_details(resumes(spark, sf), "resume_text")


def corpus_details(spark: SparkSession, sf: str) -> DataFrame:
    return details.candidate_details(corpus(spark, sf), "resume_text")


def skills_as_text() -> F.Column:
    return F.array_join("skills", "|").alias("skills")


def uploads(spark: SparkSession, sf: str) -> DataFrame:
    path = F.when(F.col("resume_id") % 29 != 28, F.col("resume_path"))
    return resumes(spark, sf).select("resume_id", path.alias("path"), F.col("resume_text").alias("jd_text"))


def new_folder(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


# --- sources, sinks, file selection ---


@query
def scan_folder(spark, sf):
    return intake.scan_folder(corpus(spark, sf)).select("resume_id", "folder", "resume_path")


@query
def scan_recursive(spark, sf):
    return intake.scan_recursive(corpus(spark, sf)).select("resume_id", "resume_path")


@query
def intake_gate(spark, sf):
    return intake.intake_gate(uploads(spark, sf), "path", "jd_text").select("resume_id", "reject_reason")


@query
def assemble_pages(spark, sf):
    return files.assemble_pages(table(spark, sf, "conversations"), "conv_id", "turn", "text")


@query
def load_categories(spark, sf):
    folder = new_folder(spark, "categories")
    fx.load(spark, sf, fx.CATEGORIES).write.csv(folder, sep=";", header=True, quoteAll=True)
    return files.load_categories(spark, folder)


@query
def jd_rows(spark, sf):
    texts = resumes(spark, sf).select("resume_id", F.col("resume_text").alias("jd_text"))
    analysed = analysis.parse_analysis(responses_of(spark, sf, "analysis")).join(texts, "resume_id")
    folder = new_folder(spark, "jobs")
    rows = number_jobs(jobs(spark, sf), job_rows(analysed, batch_time(), ("resume_id",)), F.col("resume_id"))
    tables.append(rows, folder)
    return spark.read.schema(rows.schema).parquet(folder).drop("uploaded_at")


@query
def audit_rows(spark, sf):
    gated = intake.intake_gate(uploads(spark, sf), "path", "jd_text")
    folder = new_folder(spark, "audit")
    rows = audit.upload_audit(gated, ("resume_id",))
    tables.append(rows, folder)
    return spark.read.schema(rows.schema).parquet(folder)


@query
def score_wide(spark, sf):
    rows = recommendation(spark, sf).results.select(
        "jd_id", "folder", "candidate_id", "candidate_email", "candidate_name", "category_score", "final_score",
        "qualifications_score", "requirements_score", "reason", "resume_filename", "resume_path",
    )
    folder = new_folder(spark, "score-wide")
    tables.append(rows.withColumn("bucket", tables.hash_bucket("jd_id", SCORE_TABLE_BUCKETS)), folder, partition_by=["bucket"])
    return spark.read.schema(rows.schema).parquet(folder).drop("bucket")


# --- filters and lookups ---


@query
def nonblank_docs(spark, sf):
    return intake.nonblank(corpus(spark, sf), "resume_text").select("resume_id")


@query
def jd_lookup(spark, sf):
    requests = table(spark, sf, "events").select("event_id", F.col("user_id").alias("jd_id"))
    found = lookup.lookup_jobs(requests, jobs(spark, sf), "event_id")
    return found.select(
        "event_id", "jd_id", "found", F.length("jd_text").cast("bigint").alias("jd_chars"),
        "category_detected", "qualifications", "requirements",
    )


@query
def jd_lookup_stored(spark, sf):
    """The same lookup against a job table kept in hash buckets, of which only those asked for are read."""
    folder = new_folder(spark, "jobs")
    lookup.store_jobs(jobs(spark, sf), folder, SCORE_TABLE_BUCKETS)
    requests = table(spark, sf, "events").select("event_id", F.col("user_id").alias("jd_id"))
    known = lookup.asked_jobs(requests, spark.read.parquet(folder), SCORE_TABLE_BUCKETS)
    found = lookup.lookup_jobs(requests, known, "event_id")
    return found.select(
        "event_id", "jd_id", "found", F.length("jd_text").cast("bigint").alias("jd_chars"),
        "category_detected", "qualifications", "requirements",
    )


@query
def candidate_lookup(spark, sf):
    known = fx.load(spark, sf, fx.CANDIDATES)
    rows = corpus(spark, sf).select("resume_id", extract.email(F.col("resume_text")).alias("email"))
    return lookup.lookup_candidates(rows, known, "email", "resume_id")


@query
def resolve_candidate(spark, sf):
    before = fx.load(spark, sf, fx.CANDIDATES)
    rows = resume_details(spark, sf)
    upserted = materialize(upsert.upsert_candidates(before, rows, batch_time())[0], "candidates")
    path = F.when(F.col("resume_id") % 6 != 5, F.col("resume_path"))
    results = rows.select("resume_id", F.col("email").alias("candidate_email"), path.alias("resume_path"))
    return lookup.resolve_candidates(results, before, upserted, "resume_id").select("resume_id", "candidate_id")


@query
def category_options(spark, sf):
    return lookup.category_options(fx.load(spark, sf, fx.CATEGORIES))


@query
def dead_letter(spark, sf):
    parsed = analysis.parse_scores(responses_of(spark, sf, "score")).drop("response")
    return intake.split_failures(parsed)[1].select("resume_id", "error")


# --- field extraction ---


def _extract_query(key: str, field: str) -> None:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        column = extract.RULES[field](F.col("resume_text"))
        if field == "skills":
            column = F.array_join(column, "|")
        return corpus(spark, sf).select("resume_id", column.alias(field))

    QUERIES[f"extract_{key}"] = run


for _key, _field in {
    "email": "email", "phone": "phone", "linkedin": "linkedin_url", "name": "name", "yoe": "years_of_experience",
    "education": "education_level", "title": "last_position_title", "location": "current_location", "skills": "skills",
}.items():
    _extract_query(_key, _field)


@query
def missing_fields(spark, sf):
    known = details.with_missing_fields(corpus_details(spark, sf))
    return known.select("resume_id", F.array_join("missing_fields", "|").alias("missing_fields"))


@query
def candidate_details(spark, sf):
    return corpus_details(spark, sf).select("resume_id", *extract.FIELDS[:-1], skills_as_text())


@query
def fill_missing(spark, sf):
    answers = responses_of(spark, sf, "details")
    filled = details.fill_missing(resume_details(spark, sf), answers, "resume_id")
    return filled.select("resume_id", *extract.FIELDS[:-1], skills_as_text(), "fill_error")


def filling_model(prompts):
    """Stands for a model: answers from the prompt alone, and fails on some."""

    def answer(prompt):
        resume = prompt.split("\nResume:\n", 1)[1]
        if len(resume) % 4 == 3:
            raise ValueError("no answer")
        return '{"current_location":"%d chars","skills":["asked"],"name":""}' % len(resume)

    return prompts.map(answer)


@query
def model_hook(spark, sf):
    filled = hook.complete_details(corpus_details(spark, sf), "resume_text", filling_model)
    return filled.select("resume_id", *extract.FIELDS[:-1], skills_as_text(), "fill_error")


@query
def model_store(spark, sf):
    """Two runs over the corpus, the second with a tenth more rows: which run asked for each row, and what it got."""
    store = ContentStore(spark, new_folder(spark, "responses"), "1", T.StringType(), 16)
    rows = details.with_missing_fields(corpus_details(spark, sf))
    asked = materialize(rows.select(
        "resume_id", missing_fields_prompt(F.col("missing_fields"), F.col("resume_text")).alias("prompt")), "prompts")
    first = hook.StoredModel(filling_model, store, "first").responses(asked.where("resume_id % 10 <> 9"), "prompt")
    second = hook.StoredModel(filling_model, store, "second").responses(asked, "prompt")
    again = first.select("resume_id", F.col("response").alias("earlier"))
    return second.join(again, "resume_id", "left").select("resume_id", "response", F.col("response_batch").alias("asked_in"), "earlier")


# --- text helpers ---


@query
def normalize_section(spark, sf):
    rows = resume_details(spark, sf)
    types = {f.name: f.dataType for f in rows.schema.fields}
    sections = {"skills_text": "skills", "title_text": "last_position_title", "years_text": "years_of_experience"}
    return rows.select("resume_id", *[
        text.normalize_section(F.col(c), types[c]).alias(name) for name, c in sections.items()
    ])


@query
def full_resume_text(spark, sf):
    rows = corpus_details(spark, sf)
    return rows.select("resume_id", text.full_resume_text(rows.schema).alias("full_text"))


@query
def extract_keywords(spark, sf):
    return documents(spark, sf).select(
        "doc_id", F.posexplode(text.keywords(F.col("text"))).alias("pos", "keyword")
    ).withColumn("pos", F.col("pos").cast("bigint"))


@query
def result_identity(spark, sf):
    return corpus_details(spark, sf).select(
        "resume_id",
        text.basename(F.col("resume_path")).alias("resume_filename"),
        text.display_name(F.col("name"), F.col("email")).alias("candidate_name"),
    )


@query
def prompt_missing(spark, sf):
    known = details.with_missing_fields(corpus_details(spark, sf))
    return known.select("resume_id", missing_fields_prompt(F.col("missing_fields"), F.col("resume_text")).alias("prompt"))


@query
def prompt_jd(spark, sf):
    texts = documents(spark, sf).select("doc_id", F.col("text").alias("jd_text"))
    return analysis_requests(texts, fx.load(spark, sf, fx.CATEGORIES), "doc_id")


@query
def prompt_score(spark, sf):
    rows = intake.scan_folder(resume_details(spark, sf))
    rows = rows.select("resume_id", "folder", "resume_path", text.full_resume_text(rows.schema).alias("full_text"))
    asked = jobs(spark, sf).select("jd_id", "folder", *[F.coalesce(c, F.lit("")).alias(c) for c in scoring.JOB_TEXTS])
    prompt = score_prompt(*[F.col(c) for c in ("category_detected", "requirements", "qualifications", "full_text")])
    return scoring.pair_jobs_with_resumes(asked, rows).select("jd_id", "resume_id", prompt.alias("prompt"))


# --- response parsing ---


@query
def parse_fenced(spark, sf):
    parsed = responses_of(spark, sf, "details").select("resume_id", responses.parse_fenced(F.col("response")).alias("p"))
    parsed = parsed.withColumn("f", responses.object_fields(F.col("p.json"), extract.FIELDS))
    return parsed.select("resume_id", "p.ok", "p.is_object", "f.name", F.col("f.years_of_experience").alias("years"))


@query
def parse_jd_response(spark, sf):
    return analysis.parse_analysis(responses_of(spark, sf, "analysis")).select(
        "resume_id", F.size("categories").alias("n_categories"), F.get("categories", F.lit(0)).alias("category"),
        "qualifications", "requirements",
    )


@query
def parse_score_response(spark, sf):
    return analysis.parse_scores(responses_of(spark, sf, "score")).drop("response")


# --- scoring, ranking, aggregation ---


def scored_by_keywords(spark, sf):
    known = intake.scan_folder(resume_details(spark, sf)).drop("resume_text")
    return scoring.score_by_keywords(jobs(spark, sf), known)


@query
def jd_resume_pairs(spark, sf):
    asked = jobs(spark, sf).select("jd_id", "folder")
    scanned = intake.scan_folder(resumes(spark, sf)).select("resume_id", "folder", "resume_path")
    return scoring.pair_jobs_with_resumes(asked, scanned).select("jd_id", "resume_id")


@query
def score_keyword(spark, sf):
    return scored_by_keywords(spark, sf).select("jd_id", "resume_id", *analysis.SCORE_FIELDS, "reason")


@query
def score_from_responses(spark, sf):
    scanned = intake.scan_folder(resumes(spark, sf)).select("resume_id", "folder", "resume_path")
    pairs = scoring.pair_jobs_with_resumes(jobs(spark, sf).select("jd_id", "folder"), scanned)
    scored, _ = scoring.score_from_responses(pairs, responses_of(spark, sf, "score"), ["resume_id"])
    return scored.select("jd_id", "resume_id", *analysis.SCORE_FIELDS, "reason")


def rating_model(prompts):
    """Stands for a model: rates by the length of the prompt, and fails on some."""

    def answer(prompt):
        if len(prompt) % 7 == 6:
            raise ValueError("no answer")
        return 'Rated: {"final_score":%d,"reason":"%d"}' % (len(prompt) % 11, len(prompt))

    return prompts.map(answer)


@query
def score_model(spark, sf):
    known = intake.scan_folder(resume_details(spark, sf)).drop("resume_text")
    scored, failed = scoring.score_by_model(jobs(spark, sf), known, rating_model)
    keys = ["jd_id", "resume_id", "final_score", "reason"]
    return scored.select(*keys, F.lit(None).cast("string").alias("error")).unionByName(failed.select(*keys, "error"))


@query
def rank_resumes(spark, sf):
    scored = scored_by_keywords(spark, sf).select("jd_id", "resume_id", "resume_path", "final_score")
    return ranking.rank_resumes(scored).drop("resume_path")


@query
def result_rows(spark, sf):
    return ranking.rank_resumes(scoring.result_rows(scored_by_keywords(spark, sf))).select(
        "jd_id", "rank", *scoring.RESULT_COLUMNS
    )


@query
def summary(spark, sf):
    scored = scored_by_keywords(spark, sf).select("jd_id", "resume_path", "final_score", "reason")
    ranked = ranking.rank_resumes(scored).withColumn("fit_summary", F.when(F.col("rank") % 2 == 1, F.col("reason")))
    return ranking.summarize(ranked, jobs(spark, sf))


@query
def category_score_rows(spark, sf):
    return analysis.category_score_rows(responses_of(spark, sf, "category_array"))


@query
def category_scores_store(spark, sf):
    """The category scores of candidates after two batches, the second without a category the first had."""
    batch = materialize(resume_details(spark, sf).drop("resume_text"), "details")
    known = materialize(upsert.upsert_candidates(fx.load(spark, sf, fx.CANDIDATES), batch, batch_time())[0], "candidates")
    told = lookup.lookup_candidates(batch.select("resume_id", "resume_path", "email"), known, "email", "resume_id").join(
        responses_of(spark, sf, "category_array"), "resume_id")
    schema = "candidate_id bigint, category_name string, score double, weight double, justification string"
    stored = tables.SnapshotTable(spark, new_folder(spark, "category-scores"), schema, "candidate_id", 16)
    upsert.store_category_scores(stored, told.where("resume_id % 10 <> 9"), "resume_path", "first")
    fewer = told.where("resume_id % 4 = 1").withColumn("response", F.regexp_replace("response", r',\{"category":"Spark".*$', "]"))
    upsert.store_category_scores(stored, fewer, "resume_path", "second")
    return stored.read()


@query
def weighted_final(spark, sf):
    rows = analysis.category_score_rows(responses_of(spark, sf, "category_array"))
    return analysis.weighted_final(rows, ["resume_id"]).withColumn("final_score", F.round("final_score", 6))


# --- vectors ---


def unit_vectors(spark, sf):
    return similarity.normalized(table(spark, sf, "embeddings"))[0]


def corpus_vectors(spark, sf):
    return unit_vectors(spark, sf).select("vec_id", F.col("embedding").alias("vector"))


def category_vectors(spark, sf):
    """The mean embedding of every label stands for a category's, or a job's, vector."""
    centres = similarity.centroids(table(spark, sf, "embeddings"), "label")
    return centres.select("label", F.col("embedding").alias("vector"))


@query
def l2_normalize(spark, sf):
    return unit_vectors(spark, sf).select("vec_id", F.posexplode("embedding").alias("pos", "x")).withColumn(
        "x", F.round("x", 6)
    )


@query
def embed_documents(spark, sf):
    def model(texts):
        # Stands for a model: letter counts, and a failure where there are none.
        def vector(text):
            counts = [float(text.count(letter)) for letter in "aeo"]
            if not any(counts):
                raise ValueError("nothing to embed")
            return counts

        return texts.map(vector)

    embedded = hook.embeddings(documents(spark, sf), "text", model)
    unit, _ = similarity.normalized(embedded)
    return unit.select("doc_id", F.posexplode("embedding").alias("pos", "x")).withColumn("x", F.round("x", 6))


@query
def corpus_refresh(spark, sf):
    """A stored corpus after texts came, changed and went: each document's vector, and the refresh that made it."""
    def model(texts):
        return texts.map(lambda text: [1.0, *(float(text.count(letter)) for letter in "aeo")])

    docs = documents(spark, sf).select(F.concat(F.lit("docs/"), "doc_id").alias("path"), "text", "doc_id")
    other = F.when(F.col("doc_id") % 7 == 3, F.concat("text", F.lit(" aeo"))).otherwise(F.col("text"))
    gone = F.when(F.col("doc_id") % 11 == 5, F.concat(F.lit("gone/"), "doc_id")).otherwise(F.col("path"))
    corpus = VectorCorpus(spark, new_folder(spark, "corpus"), "1", model, 16)
    corpus.refresh(docs.where("doc_id % 10 <> 9").select(gone.alias("path"), other.alias("text")), "first")
    corpus.refresh(docs.select("path", "text"), "second")
    unit, _ = similarity.normalized(corpus.read())
    return unit.select(
        F.substring_index("path", "/", -1).cast("bigint").alias("doc_id"), "batch", F.posexplode("embedding").alias("pos", "x"),
    ).withColumn("x", F.round("x", 6))


@query
def resume_topk(spark, sf):
    return similarity.inner_product_topk(category_vectors(spark, sf), corpus_vectors(spark, sf), "label", "vec_id", 5)


@query
def category_topk(spark, sf):
    return similarity.inner_product_topk(corpus_vectors(spark, sf), category_vectors(spark, sf), "vec_id", "label", 2)


@query
def resume_neighbours(spark, sf):
    """Every vector's ten nearest among all, by the way that leaves out cells by their bound."""
    return similarity.inner_product_topk(
        corpus_vectors(spark, sf).withColumnRenamed("vec_id", "asked_id"), corpus_vectors(spark, sf), "asked_id", "vec_id", 10,
        strategy="bounded")


@query
def category_columns(spark, sf):
    return similarity.category_columns(category_topk(spark, sf), "vec_id", "label")


@query
def term_vectors(spark, sf):
    vectors = similarity.term_vectors(documents(spark, sf), "doc_id", "text")
    return vectors.withColumn("weight", F.round("weight", 6))


@query
def text_topk(spark, sf):
    asked = similarity.term_arrays(table(spark, sf, "benchmark"), "item_id", "text")
    known = similarity.term_arrays(documents(spark, sf), "doc_id", "text")
    return similarity.inner_product_topk(asked, known, "item_id", "doc_id", 5)


@query
def recommend_by_similarity(spark, sf):
    hits = resume_topk(spark, sf).withColumnRenamed("vec_id", "resume_id")
    texts = resumes(spark, sf).drop("folder")
    found = similarity.recommend(hits, texts, "label", "resume_id", "resume_text")
    return found.select("label", F.col("candidate_email").alias("email"), "resume_path", "score", "rank")


@query
def recommend_by_similarity_filled(spark, sf):
    """Twenty hits a category; a model is asked for the addresses that no rule finds, and answers some in plain words."""
    def model(prompts):
        def answer(prompt):
            chars = len(prompt.split("Resume:\n", 1)[1])
            return "unknown" if chars % 3 == 0 else json.dumps({"email": f"chars{chars}@example.org"})

        return prompts.map(answer)

    hits = similarity.inner_product_topk(category_vectors(spark, sf), corpus_vectors(spark, sf), "label", "vec_id", 20)
    texts = resumes(spark, sf).drop("folder")
    found = similarity.recommend(
        hits.withColumnRenamed("vec_id", "resume_id"), texts, "label", "resume_id", "resume_text", fill_model=model)
    return found.select("label", F.col("candidate_email").alias("email"), "resume_path", "score", "rank", "fill_error")


# --- upserts and pipelines ---


def candidate_output(snapshot: DataFrame) -> DataFrame:
    day = {"created_on": "created_at", "updated_on": "candidate_updated_time"}
    return snapshot.select(
        "candidate_id", "candidate_email", *upsert.CANDIDATE_VALUES,
        *[F.date_format(c, "yyyy-MM-dd").alias(name) for name, c in day.items()],
    )


def recommendation(spark: SparkSession, sf: str) -> Recommendation:
    return recommend(
        requests=fx.load(spark, sf, fx.REQUESTS),
        jobs=jobs(spark, sf),
        resumes=resumes(spark, sf),
        candidates=fx.load(spark, sf, fx.CANDIDATES),
        scores=fx.load(spark, sf, fx.SCORES),
        at=batch_time(),
    )


@query
def candidate_upsert(spark, sf):
    batch = materialize(corpus_details(spark, sf).drop("resume_text"), "details")
    return candidate_output(upsert.upsert_candidates(fx.load(spark, sf, fx.CANDIDATES), batch, batch_time())[0])


@query
def category_get_or_create(spark, sf):
    return upsert.get_or_create_categories(
        fx.load(spark, sf, fx.CATEGORIES), fx.load(spark, sf, fx.INCOMING_CATEGORIES)
    )


@query
def category_ids(spark, sf):
    incoming = fx.load(spark, sf, fx.INCOMING_CATEGORIES)
    categories = upsert.get_or_create_categories(fx.load(spark, sf, fx.CATEGORIES), incoming)
    return upsert.category_ids(categories, incoming.select("name"))


@query
def score_merge(spark, sf):
    path, before = new_folder(spark, "score-table"), fx.load(spark, sf, fx.SCORES)
    upsert.merge_scores_into(path, before.withColumn("_place", F.lit(0)), "stored", "_place", SCORE_TABLE_BUCKETS)
    upsert.merge_scores_into(path, recommendation(spark, sf).score_batch, "recommended", "_place", SCORE_TABLE_BUCKETS)
    return spark.read.parquet(path).select(*before.columns)


@query
def score_upsert(spark, sf):
    return recommendation(spark, sf).scores


@query
def recommend_audit(spark, sf):
    rows = recommendation(spark, sf).audit
    # A request may lack its job id; as text, both sides give a null alike.
    return rows.withColumn("jd_id", F.col("jd_id").cast("string"))


@query
def recommend_candidates(spark, sf):
    return candidate_output(recommendation(spark, sf).candidates)


@query
def recommend_summary(spark, sf):
    return recommendation(spark, sf).summary


@query
def jd_ingest(spark, sf):
    done = ingest_jobs(uploads(spark, sf), responses_of(spark, sf, "analysis"), "resume_id", batch_time())
    return done.replies.withColumn("categories", F.array_join("categories", ", "))


def ingested(spark: SparkSession, sf: str) -> Ingest:
    return ingest_jobs(uploads(spark, sf), responses_of(spark, sf, "analysis"), "resume_id", batch_time())


@query
def jd_ingest_jobs(spark, sf):
    return ingested(spark, sf).jobs.withColumn("uploaded_at", F.date_format("uploaded_at", "yyyy-MM-dd"))


@query
def jd_ingest_failed(spark, sf):
    return ingested(spark, sf).failed


@query
def jd_ingest_audit(spark, sf):
    return ingested(spark, sf).audit


@query
def recommend_responses(spark, sf):
    """The recommendation from a table of model responses: results, and the pairs whose response could not be used."""
    requests = fx.load(spark, sf, fx.REQUESTS)
    scanned = intake.scan_folder(resumes(spark, sf)).select("resume_id", "folder", "resume_path")
    pairs = scoring.pair_jobs_with_resumes(requests.where("jd_id IS NOT NULL AND folder <> ''").distinct(), scanned)
    told = pairs.join(responses_of(spark, sf, "score"), "resume_id").select("jd_id", "resume_path", "response").distinct()
    done = recommend(
        requests=requests, jobs=jobs(spark, sf), resumes=resumes(spark, sf), candidates=fx.load(spark, sf, fx.CANDIDATES),
        scores=None, at=batch_time(), responses=told,
    )
    keys, none = ["jd_id", "folder", "resume_path"], F.lit(None)
    failed = done.failed.select(*keys, none.cast("double").alias("rank"), none.cast("double").alias("final_score"), "error")
    ranked = done.results.select(*keys, F.col("rank").cast("double").alias("rank"), "final_score", none.cast("string").alias("error"))
    return ranked.unionByName(failed)


@query
def recommend_model(spark, sf):
    """The recommendation from a user's model: results, and the pairs that it could not rate."""
    done = recommend(
        requests=fx.load(spark, sf, fx.REQUESTS), jobs=jobs(spark, sf), resumes=resumes(spark, sf),
        candidates=fx.load(spark, sf, fx.CANDIDATES), scores=None, at=batch_time(), model=rating_model,
    )
    keys, none = ["jd_id", "folder", "resume_path"], F.lit(None)
    failed = done.failed.select(
        *keys, none.cast("double").alias("rank"), none.cast("double").alias("final_score"), none.cast("string").alias("reason"), "error")
    ranked = done.results.select(
        *keys, F.col("rank").cast("double").alias("rank"), "final_score", "reason", none.cast("string").alias("error"))
    return ranked.unionByName(failed)


@query
def stream_ingest(spark, sf):
    schema = table(spark, sf, "customer").schema
    # As a glob, the path may be one file or a folder of them.
    spark.readStream.schema(schema).parquet(f"{sf}/customer.parque[t]").createOrReplaceTempView("arriving_customers")
    stream = spark.sql(fx.RESUMES.replace("FROM customer", "FROM arriving_customers"))
    before = fx.load(spark, sf, fx.CANDIDATES)
    folder = new_folder(spark, "stream")
    snapshot = tables.SnapshotTable(spark, f"{folder}/candidates", before._jdf.schema().toDDL(), "candidate_email", 16, number="candidate_id")
    snapshot.fill(before, "initial")
    stream_candidates(stream, snapshot, f"{folder}/checkpoint", lambda batch_id: batch_time()).awaitTermination()
    spark.catalog.dropTempView("arriving_customers")
    return candidate_output(snapshot.read())


@query
def stream_jobs(spark, sf):
    """Uploads that arrive in two batches; job ids go on where the job table ends."""
    rows, folder = uploads(spark, sf), new_folder(spark, "stream-jobs")
    middle = rows.agg(F.expr("percentile_approx(resume_id, 0.5)")).first()[0]
    for part in (rows.where(F.col("resume_id") <= middle), rows.where(F.col("resume_id") > middle)):
        part.coalesce(1).write.mode("append").parquet(f"{folder}/arriving")
    arriving = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/arriving")
    ids = IdRanges(spark, f"{folder}/ids")
    ids.start_after(jobs(spark, sf).agg(F.max("jd_id")).first()[0])

    def answers(batch):
        return responses_of(spark, sf, "analysis").join(batch.select("resume_id"), "resume_id", "left_semi")

    streams.stream_jobs(
        arriving, answers, f"{folder}/jobs", f"{folder}/audit", f"{folder}/checkpoint", "resume_id", lambda batch_id: batch_time(), ids
    ).awaitTermination()
    found = spark.read.parquet(f"{folder}/jobs")
    return found.select("resume_id", "jd_id", "category_detected", "qualifications", "requirements", F.col("batch").cast("int").alias("batch"))


def write_files(rows: DataFrame, folder: str) -> None:
    """A file ``conv_id=….pdf`` for each of ``rows(conv_id, content)``.

    On a local file system Spark's writers start a process or two for each file, to set its mode, so there the tasks write it
    themselves, some folders sharing the files; elsewhere Spark writes a folder for each. A file appears whole or not at all.
    """
    local = local_path(rows.sparkSession, folder)
    if local is None:
        rows.repartition("conv_id").write.partitionBy("conv_id").option("extension", "pdf").csv(folder)
        return

    def write(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            for conv_id, place, content in zip(*(column.to_pylist() for column in batch.columns)):
                os.makedirs(f"{local}/{place}", exist_ok=True)
                hidden = f"{local}/{place}/.{uuid.uuid4().hex}"
                with open(hidden, "w") as file:
                    file.write(f"{content}\n")
                os.replace(hidden, f"{local}/{place}/conv_id={conv_id}.pdf")
            yield batch.slice(0, 0)

    placed = rows.select("conv_id", F.pmod(F.xxhash64("conv_id"), F.lit(FILE_FOLDERS)).alias("place"), "content")
    placed.mapInArrow(write, placed.schema).write.format("noop").mode("overwrite").save()


@query
def stream_files(spark, sf):
    """Conversations as arriving files, one page a turn; every ninth can't be read."""
    folder = new_folder(spark, "stream-files")
    pages = F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda t: F.coalesce(t["text"], F.lit("")))
    content = F.hex(F.to_json(pages).cast("binary"))
    told = table(spark, sf, "conversations").groupBy("conv_id").agg(content.alias("content")).withColumn(
        "content", F.when(F.col("conv_id") % 9 == 4, F.lit("junk")).otherwise(F.col("content")))
    write_files(told, f"{folder}/files")

    def page_reader(content):
        text = content.decode().strip()
        if text == "junk":
            raise ValueError("not a document")
        return json.loads(bytes.fromhex(text))

    streams.stream_files(
        files.arriving_files(spark, f"{folder}/files", 400), page_reader, f"{folder}/documents", f"{folder}/audit", f"{folder}/checkpoint"
    ).awaitTermination()
    conv_id = F.regexp_extract("path", "conv_id=(-?[0-9]+)", 1).cast("bigint").alias("conv_id")
    log = spark.read.parquet(f"{folder}/audit").select(conv_id, "log_type", "message")
    return spark.read.parquet(f"{folder}/documents").select(conv_id, "text").join(log, "conv_id", "left")


@query
def stream_recommend(spark, sf):
    """The requests arriving in two batches, in the order in which a batch job stores them."""
    asked, folder = fx.load(spark, sf, fx.REQUESTS), new_folder(spark, "stream-requests")
    middle = asked.agg(F.expr("percentile_approx(jd_id, 0.5)")).first()[0]
    early = F.coalesce(F.col("jd_id") <= middle, F.lit(True))
    for part in (asked.where(early), asked.where(~early)):
        part.coalesce(1).write.mode("append").parquet(f"{folder}/requests")
    arriving = spark.readStream.schema(asked.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/requests")
    before = fx.load(spark, sf, fx.CANDIDATES)
    known = tables.SnapshotTable(spark, f"{folder}/candidates", before._jdf.schema().toDDL(), "candidate_email", 16, number="candidate_id")
    known.fill(before, "initial")
    state = RecommendationTables(spark, f"{folder}/state", known, SCORE_TABLE_BUCKETS)
    answer_requests(
        arriving, lambda: jobs(spark, sf), lambda: resumes(spark, sf), state, f"{folder}/checkpoint", lambda batch_id: batch_time(),
    ).awaitTermination()
    return state.read("results").drop("batch")


@query
def recommend_resumes(spark, sf):
    return recommendation(spark, sf).results


QUERIES["recommend"] = QUERIES.pop("recommend_resumes")


def _with_doubles(run: Query, columns: tuple[str, ...]) -> Query:
    return lambda spark, sf: run(spark, sf).withColumns({c: F.col(c).cast("double") for c in columns})


QUERIES.update({key: _with_doubles(QUERIES[key], columns) for key, columns in NULLABLE_INTEGERS.items()})
