"""Files, stored tables, streaming and the model hook."""

from pyspark.sql import functions as F

from checks import fixtures as fx
from checks.queries import candidate_output
from hiregrid.operators.details import candidate_details
from hiregrid.operators.hook import complete_details, model_responses
from hiregrid.operators.upsert import upsert_candidates
from hiregrid.sources import files, tables
from hiregrid.streaming.ingest import stream_candidates, stream_jobs
from tests.conftest import SF
from tests.test_operators import CANDIDATE


def test_file_scans_and_pages(spark, tmp_path):
    names = ["a.pdf", "b.PDF", "c.txt", ".d.pdf", "sub/e.pdf"]
    (tmp_path / "sub").mkdir()
    for name in names:
        (tmp_path / name).write_bytes(f"one|{name}|".encode())
    folder = str(tmp_path)
    ending = F.substring_index("path", "/", -1)
    assert [r[0] for r in files.folder_files(spark, folder).select(ending).collect()] == ["a.pdf"]
    tree = files.tree_files(spark, folder)
    assert sorted(r[0] for r in tree.select(ending).collect()) == ["a.pdf", "b.PDF", "e.pdf"]

    def reader(content):
        if b"b.PDF" in content:
            raise ValueError("broken")
        return content.decode().split("|")

    texts = files.assemble_pages(files.read_pages(tree, reader), "path", "page_no", "text")
    assert sorted(r.text for r in texts.collect()) == ["", "onea.pdf", "onesub/e.pdf"]


def test_pages_in_order(spark):
    pages = spark.createDataFrame(
        [("a", 10, "z"), ("a", 9, "y"), ("a", 1, None), ("b", 1, None)], "doc string, n int, text string"
    )
    found = files.assemble_pages(pages.repartition(4), "doc", "n", "text")
    assert sorted(map(tuple, found.collect())) == [("a", "yz"), ("b", "")]


def test_category_file(spark, tmp_path):
    path = tmp_path / "category.csv"
    path.write_text('"category_id";"name";"type"\n1;"Legal; Counsel";"category2"\n20;"R&D ""Lab""";"category1"\n')
    rows = [tuple(r) for r in files.load_categories(spark, str(path)).collect()]
    assert rows == [(1, "Legal; Counsel", "category2"), (20, 'R&D "Lab"', "category1")]


def test_snapshot_table(spark, tmp_path):
    table = tables.SnapshotTable(spark, str(tmp_path / "t"), "k string, n int", "k", buckets=8)
    assert table.read().count() == 0
    rows = lambda *pairs: spark.createDataFrame(list(pairs), "k string, n int")

    def add(batch, name):
        table.update(batch, "k", lambda old: old.join(batch, "k", "left_anti").unionByName(batch.dropna()), name)

    table.fill(rows(*[(f"k{i}", 0) for i in range(40)]), "first")
    before = {p for p in (tmp_path / "t" / "data").iterdir()}
    add(rows(("k3", 1), ("new", 2), (None, 3)), "one")
    add(rows(("k3", 9)), "one")  # the same batch id again
    assert table.read().count() == 41
    assert sorted(map(tuple, table.read().where("n > 0").collect())) == [("k3", 1), ("new", 2)]
    written = [p for d in (tmp_path / "t" / "data").iterdir() if d not in before for p in d.glob("bucket=*")]
    assert len(written) <= 2  # only the buckets of the batch
    add(rows((None, 1)), "nothing")
    assert table.has_batch("nothing") and table.read().count() == 41


def test_snapshot_keeps_the_highest_id_and_normalises_keys(spark, tmp_path):
    table = tables.SnapshotTable(spark, str(tmp_path / "t"), "k string, n bigint", "k", buckets=64, number="n")
    assert table.highest() == 0
    table.fill(spark.createDataFrame([("a", 7), ("b", 3)], "k string, n bigint"), "first")
    table.fill(spark.createDataFrame([("c", 5)], "k string, n bigint"), "second")
    assert table.highest() == 7
    keys = spark.createDataFrame([(" A@x.y ",), ("a@x.y",)], "k string")
    assert keys.select(table.bucket(F.col("k"))).distinct().count() == 1


def test_two_micro_batches_equal_one_batch(spark, tmp_path):
    resumes = fx.load(spark, SF, fx.RESUMES)
    at = lambda batch: F.lit("2024-06-01 00:00:00").cast("timestamp")
    source = tmp_path / "in"
    table = tables.SnapshotTable(spark, str(tmp_path / "candidates"), CANDIDATE, "candidate_email", buckets=5, number="candidate_id")
    before = fx.load(spark, SF, fx.CANDIDATES)
    table.fill(before, "initial")

    def arrive(part):
        part.coalesce(1).write.mode("append").parquet(str(source))
        stream = spark.readStream.schema(resumes.schema).parquet(str(source))
        stream_candidates(stream, table, str(tmp_path / "checkpoint"), at).awaitTermination()

    cut = resumes.approxQuantile("resume_id", [0.5], 0)[0]
    low, high = resumes.where(F.col("resume_path") < "resumes/f2"), resumes.where(F.col("resume_path") >= "resumes/f2")
    assert cut and low.count() and high.count()
    arrive(low)
    arrive(high)
    whole, _ = upsert_candidates(before, candidate_details(resumes, "resume_text"), at(0))
    assert sorted(map(str, candidate_output(table.read()).collect())) == sorted(map(str, candidate_output(whole).collect()))


def test_stream_jobs(spark, tmp_path):
    source, jobs, log = (str(tmp_path / n) for n in ("in", "jobs", "audit"))
    schema = "id bigint, path string, jd_text string"
    at = lambda batch: F.lit("2024-06-01 00:00:00").cast("timestamp")

    def answers(uploads):
        return uploads.select("id", F.lit('{"category":"A"}').alias("response"))

    for rows in ([(1, "a.pdf", "t"), (2, "b.doc", "t")], [(3, "c.pdf", "t")]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        stream_jobs(stream, answers, jobs, log, str(tmp_path / "checkpoint"), "id", at).awaitTermination()
    assert sorted((r.id, r.jd_id) for r in spark.read.parquet(jobs).collect()) == [(1, 1), (3, 2)]
    assert spark.read.parquet(log).count() == 6


def test_model_failures_stay_alone(spark):
    def model(prompts):
        if (prompts == "bad").any():
            raise ValueError("bad prompt")
        return prompts + "!"

    rows = spark.createDataFrame([(1, "a"), (2, "bad"), (3, "c"), (4, None)], "id int, prompt string").coalesce(1)
    found = model_responses(rows, "prompt", model)
    assert sorted(map(tuple, found.collect())) == [(1, "a!"), (2, ""), (3, "c!"), (4, None)]


def test_model_is_asked_once_for_equal_prompts_and_filters(spark, tmp_path):
    seen = str(tmp_path / "seen")

    def model(prompts):
        with open(seen, "a") as out:
            out.writelines(f"{p}\n" for p in prompts)
        return prompts + "!"

    rows = spark.createDataFrame([(i, f"p{i % 3}") for i in range(30)], "id int, prompt string").coalesce(1)
    found = model_responses(rows, "prompt", model).where("response = 'p1!'")
    assert found.count() == 10
    assert sorted(open(seen).read().split()) == ["p0", "p1", "p2"]


def test_model_sees_only_incomplete_rows(spark, tmp_path):
    whole = (
        "Ada Lovelace\na@b.co\n555-123-4567\nhttps://linkedin.com/in/ada\nAustin, TX\n5 years experience\nPhD\nlead\nSkills\nSQL\n"
    )
    rows = spark.createDataFrame([(1, whole), (2, "Bob Ross")], "id int, text string")
    seen = str(tmp_path / "seen")

    def model(prompts):
        with open(seen, "a") as out:
            out.writelines(f"{len(p)}\n" for p in prompts)
        return prompts.map(lambda p: '{"email":"x@y.z"}')

    filled = {r.id: r for r in complete_details(candidate_details(rows, "text"), "text", model).collect()}
    assert filled[1].email == "a@b.co" and filled[2].email == "x@y.z" and filled[2].name == "Bob Ross"
    assert len(open(seen).readlines()) == 1
