"""Ranking, joins, scoring, lookups and upserts against brute force and by hand."""

import random
import re
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from hiregrid.operators import audit, intake, lookup, ranking, scoring, upsert
from hiregrid.operators.joins import fits_broadcast, join_on_key
from hiregrid.plans.ingest import ingest_jobs
from hiregrid.plans.recommend import recommend

T1, T2 = datetime(2020, 1, 1), datetime(2024, 6, 1)
CANDIDATE = (
    "candidate_id bigint, candidate_name string, candidate_email string, candidate_phone string, "
    "candidate_location string, candidate_year int, candidate_job string, candidate_resume string, "
    "created_at timestamp, candidate_updated_time timestamp, candidate_company string"
)
BATCH = (
    "email string, name string, phone string, current_location string, years_of_experience int, "
    "last_position_title string, resume_path string"
)
SCORE = (
    "jd_id bigint, candidate_id bigint, category_score double, qualifications_score double, "
    "requirements_score double, final_score double, reason string"
)


@pytest.mark.parametrize("window_rows", [1_000_000, 0])
def test_number_rows_both_ways(spark, window_rows):
    rng = random.Random(3)
    # Two thirds of the rows in one group, many ties on the score.
    rows = [(rng.choice([1, 1, 1, 1, 2, 3]), f"p{i:05d}", rng.choice([None, -1.0, 0.0, 5.0])) for i in range(6000)]
    frame = spark.createDataFrame(rows, "jd_id int, resume_path string, final_score double").repartition(7)
    expected, seen = {}, {}
    for jd, path, _ in sorted(rows, key=lambda r: (r[0], -(r[2] or 0.0), r[1])):
        seen[jd] = seen.get(jd, 0) + 1
        expected[jd, path] = seen[jd]
    found = {(r.jd_id, r.resume_path): r["rank"] for r in ranking.rank_resumes(frame, window_rows).collect()}
    assert found == expected


@pytest.mark.parametrize("window_rows", [1_000_000, 0])
def test_number_rows_without_groups(spark, window_rows):
    frame = spark.range(5000).withColumn("id", 5000 - F.col("id"))
    numbered = ranking.number_rows(frame, [], [F.col("id")], "n", window_rows)
    assert numbered.where("n = id").count() == 5000


@pytest.mark.parametrize("how", ["inner", "left"])
def test_salted_join_equals_plain_join(spark, how):
    left = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 40).alias("k"))
    left = left.unionByName(spark.createDataFrame([(9000, None)], "id bigint, k bigint"))
    right = spark.range(5, 30).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    plain = sorted(map(str, left.join(right, "k", how).collect()))
    for options in ({"broadcast": True}, {"broadcast": False, "task_pairs": 500}, {"broadcast": False, "task_pairs": 20}, {"broadcast": False, "task_pairs": None}):
        joined = join_on_key(left, right, "k", how, row_key="id", **options)
        assert sorted(map(str, joined.collect())) == plain


def test_fits_broadcast(spark):
    frame = spark.range(100)
    assert fits_broadcast(frame) and not fits_broadcast(frame, max_rows=99) and not fits_broadcast(frame, max_bytes=500)


def test_scans_and_gate(spark):
    paths = ["r/a/x.pdf", "r/a/x.PDF", "r/a/.x.pdf", "r/a/_x.pdf", "r/b/x.txt", "r/b/pdf"]
    frame = spark.createDataFrame([(p, p.split("/")[1]) for p in paths], "resume_path string, folder string")
    assert [r[0] for r in intake.scan_folder(frame, "a").collect()] == ["r/a/x.pdf", "r/a/_x.pdf"]
    assert intake.scan_recursive(frame).count() == 4
    uploads = spark.createDataFrame(
        [(None, "t"), ("a.doc", "t"), ("a.PDF", "  \n"), ("a.pdf", None), ("a.pdf", "x")], "path string, text string"
    )
    reasons = [r.reject_reason for r in intake.intake_gate(uploads, "path", "text").collect()]
    assert reasons == [intake.NO_FILE, intake.NOT_PDF, intake.NO_TEXT, intake.NO_TEXT, None]


def test_keyword_scores_in_both_join_forms(spark):
    jobs = spark.createDataFrame(
        [(1, "f", "SQL, Go", None, " spark | sql "), (2, "f", "", "", ""), (3, "g", "x", "x", "x")],
        "jd_id bigint, folder string, category_detected string, qualifications string, requirements string",
    )
    resumes = spark.createDataFrame(
        [("f/1.pdf", "f", ["SQL", "Spark"]), ("f/2.pdf", "f", [])], "resume_path string, folder string, skills array<string>"
    )
    for options in ({"broadcast": True}, {"broadcast": False, "task_pairs": 1}):
        rows = scoring.score_by_keywords(jobs, resumes, **options).orderBy("jd_id", "resume_path").collect()
        assert [(r.jd_id, r.resume_path, r.category_score, r.requirements_score, r.qualifications_score, r.final_score, r.reason)
                for r in rows] == [
            (1, "f/1.pdf", 5.0, 10.0, 0.0, 5.0, "spark, sql"),
            (1, "f/2.pdf", 0.0, 0.0, 0.0, 0.0, ""),
            (2, "f/1.pdf", 0.0, 0.0, 0.0, 0.0, ""),
            (2, "f/2.pdf", 0.0, 0.0, 0.0, 0.0, ""),
        ]


def test_summary(spark):
    ranked = spark.createDataFrame(
        [(1, 1, "a"), (1, 2, None), (1, 3, "b"), (1, 4, "c"), (1, 5, "d"), (2, 1, None)],
        "jd_id bigint, rank bigint, fit_summary string",
    )
    jobs = spark.createDataFrame([(1,), (2,), (3,)], "jd_id bigint")
    assert sorted(map(tuple, ranking.summarize(ranked, jobs).collect())) == [
        (1, 5, "a | b | c"), (2, 1, ranking.NO_SUMMARY), (3, 0, ranking.NO_SUMMARY),
    ]
    plain = ranking.summarize(ranked.drop("fit_summary"), jobs)
    assert {r["summary"] for r in plain.collect()} == {ranking.NO_SUMMARY}


def test_job_lookup(spark):
    jobs = spark.createDataFrame(
        [(1, "text", None, "q", None)],
        "jd_id bigint, jd_text string, category_detected string, qualifications string, requirements string",
    )
    requests = spark.createDataFrame([(10, 1), (11, 2)], "request bigint, jd_id bigint")
    rows = lookup.lookup_jobs(requests, jobs, "request").orderBy("request").collect()
    assert [(r.found, r.category_detected, r.qualifications) for r in rows] == [(True, "", "q"), (False, None, None)]


def test_resolve_candidates(spark):
    before = spark.createDataFrame([(1, "a@x.y"), (2, "b@x.y")], "candidate_id bigint, candidate_email string")
    after = spark.createDataFrame([(1, "a@x.y"), (3, "c@x.y")], "candidate_id bigint, candidate_email string")
    results = spark.createDataFrame(
        [(1, "A@X.Y", "p"), (2, "c@x.y", "p"), (3, "b@x.y", "p"), (4, "b@x.y", None), (5, "b@x.y", ""), (6, None, "p"), (7, "", "p")],
        "i int, candidate_email string, resume_path string",
    )
    resolved = lookup.resolve_candidates(results, before, after, "i").orderBy("i").collect()
    assert [r.candidate_id for r in resolved] == [1, 3, None, 2, 2, None, None]


@pytest.mark.parametrize("window_rows", [1_000_000, 0])
def test_candidate_upsert(spark, window_rows):
    snapshot = spark.createDataFrame(
        [(5, "Old", "a@x.y", "1", "L", 3, "J", "old.pdf", T1, T1, "Co"), (6, "Keep", "k@x.y", None, None, None, None, None, T1, T1, "Co")],
        CANDIDATE,
    )
    batch = spark.createDataFrame(
        [
            (" A@x.y ", "First", "2", "M", 4, "K", "1.pdf"),
            ("a@x.y", "Last", None, None, None, None, "2.pdf"),  # later path wins, nulls overwrite
            ("new@x.y", "New", "9", None, 1, None, "4.pdf"),
            ("early@x.y", "Early", None, None, None, None, "3.pdf"),
            ("new@x.y", "Newer", None, None, None, None, "5.pdf"),
            ("  ", "Blank", None, None, None, None, "6.pdf"),
            (None, "None", None, None, None, None, "7.pdf"),
        ],
        BATCH,
    )
    at = F.lit("2024-06-01 00:00:00").cast("timestamp")
    table, refused = upsert.upsert_candidates(snapshot, batch, at, window_rows)
    assert sorted(r.resume_path for r in refused.collect()) == ["6.pdf", "7.pdf"]
    rows = {r.candidate_id: r for r in table.collect()}
    assert sorted(rows) == [5, 6, 7, 8]
    assert tuple(rows[5]) == (5, "Last", "a@x.y", None, None, None, None, "2.pdf", T1, T2, None)
    assert rows[6].candidate_updated_time == T1 and rows[6].candidate_company == "Co"
    assert (rows[7].candidate_email, rows[8].candidate_email, rows[8].candidate_name) == ("early@x.y", "new@x.y", "Newer")
    again, _ = upsert.upsert_candidates(table, batch.repartition(3), at, window_rows)
    assert sorted(map(str, again.collect())) == sorted(map(str, table.collect()))


def test_score_upsert(spark):
    snapshot = spark.createDataFrame(
        [(1, 10, 1.0, 1.0, 1.0, 1.0, "old"), (1, 11, 2.0, 2.0, 2.0, 2.0, "kept"), (1, None, 0.0, 0.0, 0.0, 0.0, "null"), (9, 10, 3.0, 3.0, 3.0, 3.0, "other job")],
        SCORE,
    )
    batch = spark.createDataFrame(
        [(1, 10, 4.0, 4.0, 4.0, 4.0, "first", "a"), (1, 10, None, 5.0, 5.0, 5.0, None, "b"), (1, None, 6.0, 6.0, 6.0, 6.0, "null", "c"), (2, 10, 7.0, 7.0, 7.0, 7.0, "new", "d")],
        SCORE + ", resume_path string",
    )
    rows = sorted(map(tuple, upsert.upsert_scores(snapshot, batch).collect()), key=str)
    assert rows == sorted([
        (1, 10, None, 5.0, 5.0, 5.0, None),
        (1, 11, 2.0, 2.0, 2.0, 2.0, "kept"),
        (1, None, 0.0, 0.0, 0.0, 0.0, "null"),
        (1, None, 6.0, 6.0, 6.0, 6.0, "null"),
        (2, 10, 7.0, 7.0, 7.0, 7.0, "new"),
        (9, 10, 3.0, 3.0, 3.0, 3.0, "other job"),
    ], key=str)


def test_merge_scores_into_stored_partitions(spark, tmp_path):
    path = str(tmp_path / "scores")
    schema = SCORE + ", resume_path string"
    first = spark.createDataFrame(
        [(1, 10, 1.0, 1.0, 1.0, 1.0, "a", "p1"), (1, None, 2.0, 2.0, 2.0, 2.0, "b", "p2"), (2, 10, 3.0, 3.0, 3.0, 3.0, "c", "p3")], schema
    )
    second = spark.createDataFrame([(1, 10, 9.0, 9.0, 9.0, 9.0, "d", "p1"), (1, None, 8.0, 8.0, 8.0, 8.0, "e", "p2")], schema)
    upsert.merge_scores_into(path, first, "one")
    files = lambda: {str(f) for f in (tmp_path / "scores").glob("bucket=*/*.parquet")}
    before = files()
    for _ in range(2):  # the second time as after a failure
        upsert.merge_scores_into(path, second, "two")
    rows = sorted((r.jd_id, r.candidate_id, r.final_score, r.batch_id) for r in spark.read.parquet(path).where("candidate_id IS NOT NULL").collect())
    assert rows == [(1, 10, 9.0, "two"), (2, 10, 3.0, "one")]
    keyless = spark.read.parquet(path).where("candidate_id IS NULL").collect()
    assert sorted((r.jd_id, r.final_score, r.batch_id) for r in keyless) == [(1, 2.0, "one"), (1, 8.0, "two")]
    assert len(before) == 2 and len(before & files()) == 1  # the bucket of the other job is left alone
    like = second.withColumns({"batch_id": F.lit("two"), "bucket": F.lit(0)})
    plan = upsert.stored_scores(path, like, [3, 5])._jdf.queryExecution().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*bucket#\d+ IN \(3,5\)", plan)


@pytest.mark.parametrize("window_rows", [1_000_000, 0])
def test_categories(spark, window_rows):
    known = spark.createDataFrame([(3, "B", "category1")], "category_id bigint, name string, type string")
    incoming = spark.createDataFrame([("C", "t2"), ("A", "t1"), ("B", "t2"), ("C", "t1")], "name string, type string")
    table = upsert.get_or_create_categories(known, incoming, window_rows)
    assert sorted(map(tuple, table.collect())) == [(3, "B", "category1"), (4, "A", "t1"), (5, "C", "t1")]
    assert lookup.category_options(table).first()[0] == "B, A, C"


def test_ingest(spark):
    uploads = spark.createDataFrame(
        [(1, "a.pdf", "text"), (2, "b.pdf", "text"), (3, "c.txt", "text"), (4, "d.pdf", "text")], "id int, path string, jd_text string"
    )
    answers = spark.createDataFrame(
        [(1, '{"category":"A","qualifications":"q"}'), (2, '{"category":null}')], "id int, response string"
    )
    done = ingest_jobs(uploads, answers, "id", F.lit(T2))
    assert sorted(map(tuple, done.replies.collect())) == [(1, ["A"], "q", ""), (4, [], "", "")]
    jobs = {r.id: r for r in done.jobs.collect()}
    assert (jobs[1].category_detected, jobs[1].uploaded_at, jobs[4].category_detected) == ("A", T2, "")
    assert [r.id for r in done.failed.collect()] == [2]
    errors = done.audit.where(F.col("log_type") == audit.ERROR).collect()
    assert sorted(r.id for r in errors) == [2, 3]
    saved = done.audit.where("id = 1 AND message LIKE 'JD saved%'").first()
    assert saved.message == "JD saved (detected='A', quals='q', reqs='')"


def test_recommend_from_responses(spark):
    text = "Ada Lovelace\nada@x.y\nSkills\nSQL"
    resumes = spark.createDataFrame(
        [("f/1.pdf", "f", text), ("f/2.pdf", "f", "Bob Ross\nno mail"), ("f/3.pdf", "f", text), ("g/4.pdf", "g", text)],
        "resume_path string, folder string, resume_text string",
    )
    jobs = spark.createDataFrame(
        [(1, "jd", "SQL", None, None)],
        "jd_id bigint, jd_text string, category_detected string, qualifications string, requirements string",
    )
    answers = spark.createDataFrame(
        [(1, "f/1.pdf", '{"final_score":3}'), (1, "f/2.pdf", 'ok {"final_score":8} end'), (1, "f/3.pdf", "bad")],
        "jd_id bigint, resume_path string, response string",
    )
    requests = spark.createDataFrame([(1, "f"), (2, "f"), (1, "f")], "jd_id bigint, folder string")
    done = recommend(
        requests, jobs, resumes, spark.createDataFrame([], CANDIDATE), spark.createDataFrame([], SCORE), F.lit(T2), answers
    )
    rows = done.results.orderBy("rank").collect()
    assert [(r["rank"], r.resume_path, r.candidate_id, r.final_score) for r in rows] == [
        (1, "f/2.pdf", None, 8.0), (2, "f/1.pdf", 1, 3.0),
    ]
    assert [(r.resume_path, r.error) for r in done.failed.collect()] == [("f/3.pdf", "no JSON in response")]
    assert [r.jd_id for r in done.not_found.collect()] == [2]
    assert [tuple(r) for r in done.summary.collect()] == [(1, "f", 2, ranking.NO_SUMMARY)]
    assert done.candidates.first().candidate_resume == "f/1.pdf"
    assert done.scores.count() == 2
    assert sorted((r.jd_id, r.log_type, r.message) for r in done.audit.collect()) == [
        (1, "ERROR", "Resume load error: no JSON in response"),
        (1, "INFO", "Completed embedding recommendation for jd_id=1"),
        (2, "ERROR", "Job description 2 not found"),
    ]


def test_recommend_with_models(spark):
    resumes = spark.createDataFrame(
        [("f/1.pdf", "f", "Ada Lovelace"), ("f/2.pdf", "f", "Bob Ross\nbob@x.y\nSkills\nGo")],
        "resume_path string, folder string, resume_text string",
    )
    jobs = spark.createDataFrame(
        [(1, "jd", "SQL", None, None)],
        "jd_id bigint, jd_text string, category_detected string, qualifications string, requirements string",
    )

    def fill(prompts):
        return prompts.map(lambda p: '{"email":"Filled@x.y","skills":["SQL","Spark"]}')

    def rate(prompts):
        return prompts.map(lambda p: '{"final_score":%d}' % (9 if "SQL Spark" in p else 2))

    done = recommend(
        spark.createDataFrame([(1, "f")], "jd_id bigint, folder string"), jobs, resumes,
        spark.createDataFrame([], CANDIDATE), spark.createDataFrame([], SCORE), F.lit(T2), model=rate, fill_model=fill,
    )
    rows = done.results.orderBy("rank").collect()
    assert [(r.resume_path, r.final_score, r.candidate_email, r.candidate_id) for r in rows] == [
        ("f/1.pdf", 9.0, "Filled@x.y", 1), ("f/2.pdf", 2.0, "bob@x.y", 2),
    ]
    assert sorted(r.candidate_email for r in done.candidates.collect()) == ["bob@x.y", "filled@x.y"]


def test_recommend_per_request(spark):
    shared = "Ada Lovelace\nada@x.y\nSkills\n"
    resumes = spark.createDataFrame(
        [("f/1.pdf", "f", shared + "SQL, Go"), ("f/2.pdf", "f", shared + "Knitting"), ("g/3.pdf", "g", "Bob Ross\nbob@x.y\nSkills\nGo")],
        "resume_path string, folder string, resume_text string",
    )
    jobs = spark.createDataFrame(
        [(1, "jd", "Go", "", None), (2, "jd", "Knitting", "", None)],
        "jd_id bigint, jd_text string, category_detected string, qualifications string, requirements string",
    )
    asked = [(1, "f"), (1, "g"), (1, "f"), (2, "f"), (None, "f"), (1, None), (1, ""), (3, "g"), (2, "empty")]
    done = recommend(
        spark.createDataFrame(asked, "jd_id bigint, folder string"), jobs, resumes,
        spark.createDataFrame([], CANDIDATE), spark.createDataFrame([], SCORE), F.lit(T2),
    )
    assert sorted((r.jd_id, r.folder, r["rank"], r.resume_path, r.candidate_id) for r in done.results.collect()) == [
        (1, "f", 1, "f/1.pdf", 1), (1, "f", 2, "f/2.pdf", 1), (1, "g", 1, "g/3.pdf", 2),
        (2, "f", 1, "f/2.pdf", 1), (2, "f", 2, "f/1.pdf", 1),
    ]
    assert sorted((r.jd_id, r.folder, r["count"]) for r in done.summary.collect()) == [
        (1, "f", 2), (1, "g", 1), (2, "empty", 0), (2, "f", 2),
    ]
    # The lower-ranked of two résumés of a candidate is stored last, and the last request's stays.
    assert sorted((r.jd_id, r.candidate_id, r.category_score) for r in done.scores.collect()) == [(1, 1, 0.0), (1, 2, 10.0), (2, 1, 0.0)]
    assert sorted((r.candidate_id, r.candidate_resume) for r in done.candidates.collect()) == [(1, "f/1.pdf"), (2, "g/3.pdf")]
    errors = [(r.jd_id, r.folder, r.message) for r in done.audit.where("log_type = 'ERROR'").collect()]
    assert sorted(errors, key=str) == sorted([
        (None, "f", "Missing jd_id parameter"), (1, None, "Missing resume_folder parameter"),
        (1, "", "Missing resume_folder parameter"), (3, "g", "Job description 3 not found"),
    ], key=str)
    assert done.audit.where("log_type = 'INFO'").count() == 4
