"""Physical plans: what must not shuffle does not, and filters reach the scan."""

import re

import pytest
from pyspark.sql import functions as F

from checks import fixtures as fx
from hiregrid.operators import analysis, details, intake, lookup, scoring, similarity
from tests.conftest import SF


@pytest.fixture
def plan(capsys):
    def explained(df):
        capsys.readouterr()
        df.explain("formatted")
        return capsys.readouterr().out

    return explained


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    """Fixture views written as tables, as they would be on a cluster."""
    folder = tmp_path_factory.mktemp("stored")
    for name, sql in {"resumes": fx.RESUMES, "jobs": fx.JOBS, "responses": fx.RESPONSES}.items():
        fx.load(spark, SF, sql).write.parquet(f"{folder}/{name}")
    return lambda name: spark.read.parquet(f"{folder}/{name}")


def test_extraction_is_one_projection(plan, stored):
    text = plan(details.candidate_details(stored("resumes"), "resume_text").drop("folder"))
    assert "Exchange" not in text and "Python" not in text and "Generate" not in text
    assert "folder" not in re.search(r"ReadSchema: (.*)", text)[1]


def test_unused_fields_are_not_extracted(plan, stored):
    known = details.candidate_details(stored("resumes"), "resume_text").select("resume_id", "email")
    assert plan(known).count("regexp_extract") == 1


def test_parsing_does_not_shuffle(plan, stored):
    responses = stored("responses").where("kind = 'score'")
    text = plan(analysis.parse_scores(responses))
    assert "Exchange" not in text and "EqualTo(kind,score)" in text


def test_scan_filters_are_pushed_down(plan, stored):
    text = plan(intake.scan_folder(stored("resumes"), "f1"))
    assert "EqualTo(folder,f1)" in text and "StringEndsWith(resume_path,.pdf)" in text
    assert "EqualTo(jd_id,3)" in plan(lookup.lookup_job(stored("jobs"), 3))


def test_scoring_leaves_resumes_where_they_are(plan, stored):
    known = details.candidate_details(stored("resumes"), "resume_text").drop("resume_text")
    text = plan(scoring.score_by_keywords(stored("jobs"), known))
    assert "BroadcastHashJoin" in text and not re.search(r"^.* Exchange \(", text, flags=re.M)
    assert "jd_text" not in text.split("ReadSchema")[1] + text.split("ReadSchema")[2]


def test_term_vectors_do_not_shuffle(plan, spark):
    documents = spark.read.parquet(f"{SF}/documents.parquet")
    text = plan(similarity.term_vectors(documents, "doc_id", "text"))
    assert "Exchange" not in text and "Python" not in text
    assert re.search(r"ReadSchema: (.*)", text)[1] == "struct<doc_id:bigint,text:string>"


def test_topk_limits_before_the_shuffle(plan, spark):
    vectors = spark.read.parquet(f"{SF}/embeddings.parquet")
    corpus = vectors.select("vec_id", F.col("embedding").alias("vector"))
    queries = similarity.centroids(vectors, "label").select("label", F.col("embedding").alias("vector"))
    text = plan(similarity.inner_product_topk(queries, corpus, "label", "vec_id", 5, strategy="queries"))
    head = text.split("\n\n")[0]
    assert head.count("WindowGroupLimit") == 2 and head.count("Exchange") == 1
    assert "CartesianProduct" not in text and "NestedLoop" not in text


def test_lookup_prunes_the_stored_jobs(plan, spark, stored, tmp_path):
    known = stored("jobs")
    lookup.store_jobs(known, str(tmp_path), 8)
    wanted = [row["jd_id"] for row in known.select("jd_id").orderBy("jd_id").limit(2).collect()]
    requests = spark.createDataFrame([(n, jd) for n, jd in enumerate([*wanted, wanted[0], -5, None])], "request int, jd_id bigint")
    asked = lookup.asked_jobs(requests, spark.read.parquet(str(tmp_path)), 8)
    assert "dynamicpruning" in plan(asked).lower()
    assert sorted(row["jd_id"] for row in asked.collect()) == wanted
    found = lookup.lookup_jobs(requests, asked, "request").select("request", "found").collect()
    assert {r["request"]: r["found"] for r in found} == {0: True, 1: True, 2: True, 3: False, 4: False}
