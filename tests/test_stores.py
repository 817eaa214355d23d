"""Content stores, the vector corpus, id ranges and arriving files and requests: each step once, also after failures."""

import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from checks import fixtures as fx
from checks.queries import candidate_output
from hiregrid.operators import hook
from hiregrid.plans.recommend import recommend
from hiregrid.sources import files
from hiregrid.sources.content import ContentStore
from hiregrid.sources.corpus import VectorCorpus
from hiregrid.sources.ranges import IdRanges
from hiregrid.sources.tables import SnapshotTable
from hiregrid.streaming import ingest, recommend as requests_stream
from hiregrid.streaming.recommend import RecommendationTables, stream_recommend
from tests.conftest import SF
from tests.test_operators import CANDIDATE, SCORE

AT = "2024-06-01 00:00:00"


def at(batch):
    return F.lit(AT).cast("timestamp")


class Counted:
    """A model that notes its prompts in a file, refuses some and breaks its worker on others."""

    def __init__(self, path, refuse=(), trap=None, fatal=None):
        self.path, self.refuse, self.trap, self.fatal = str(path), refuse, trap, fatal

    def __call__(self, prompts):
        if self.trap and os.path.exists(self.trap) and any(p == self.fatal for p in prompts):
            os._exit(1)  # the task is lost, not only its batch
        if any(p in self.refuse for p in prompts):
            raise ValueError("refused")
        with open(self.path, "a") as out:
            out.writelines(f"{p}\n" for p in prompts)
        return [f"{p}!" for p in prompts]

    def asked(self):
        return sorted(open(self.path).read().split()) if os.path.exists(self.path) else []


def prompts(spark, rows):
    return spark.createDataFrame(rows, "id int, prompt string")


def answers(found):
    return {r["id"]: r["response"] for r in found.collect()}


def test_stored_model_asks_once(spark, tmp_path):
    model = Counted(tmp_path / "seen", refuse={"bad"})
    store = ContentStore(spark, str(tmp_path / "store"), "1", T.StringType(), buckets=4, wave=2)
    stored = hook.StoredModel(model, store, "one")
    rows = [(1, "a"), (2, "b"), (3, "a"), (4, None), (5, "bad"), (6, ""), (7, "c")]
    first = hook.model_responses(prompts(spark, rows), "prompt", stored)
    assert first.columns == ["id", "response"]
    assert answers(first) == {1: "a!", 2: "b!", 3: "a!", 4: None, 5: "", 6: "!", 7: "c!"}
    assert sorted(open(model.path).read().split("\n")[:-1]) == ["", "a", "b", "c"]
    more = [*rows, (8, "d"), (9, "b")]
    model.refuse = ()
    second = hook.StoredModel(model, store, "two").responses(prompts(spark, more), "prompt")
    assert {r["id"]: (r["response"], r["response_batch"]) for r in second.collect()} == {
        1: ("a!", "one"), 2: ("b!", "one"), 3: ("a!", "one"), 4: (None, None), 5: ("bad!", "two"), 6: ("!", "one"), 7: ("c!", "one"),
        8: ("d!", "two"), 9: ("b!", "one")}
    assert sorted(open(model.path).read().split("\n")[:-1]) == ["", "a", "b", "bad", "c", "d"]
    other = ContentStore(spark, str(tmp_path / "store"), "2", T.StringType(), buckets=4)
    assert other.read(prompts(spark, rows).select(F.sha2("prompt", 256).alias("digest"))).count() == 0


def test_lost_task_repeats_a_wave_at_most(spark, tmp_path):
    """The job dies with a task; what earlier waves wrote is not asked again."""
    trap = tmp_path / "trap"
    trap.write_text("")
    store = ContentStore(spark, str(tmp_path / "store"), "1", T.StringType(), buckets=2, wave=8)
    rows = prompts(spark, [(n, f"p{n}") for n in range(24)])
    wave = F.pmod(F.xxhash64(F.sha2("prompt", 256)), F.lit(3))
    model = Counted(tmp_path / "seen", trap=str(trap), fatal=rows.orderBy(wave.desc(), "id").first()["prompt"])
    stored = hook.StoredModel(model, store, "run")
    with pytest.raises(Exception):
        hook.model_responses(rows, "prompt", stored).collect()
    known = store.read(rows.select(F.sha2("prompt", 256).alias("digest"))).count()
    before = model.asked()
    trap.unlink()
    assert answers(hook.model_responses(rows, "prompt", stored)) == {n: f"p{n}!" for n in range(24)}
    assert set(model.asked()) == {f"p{n}" for n in range(24)}
    assert len(model.asked()) - len(before) == 24 - known and 0 < known < 24
    asked = len(model.asked())
    hook.model_responses(rows, "prompt", stored).collect()
    assert len(model.asked()) == asked


def test_stored_model_in_a_recommendation(spark, tmp_path):
    """A rerun of a whole recommendation asks neither of its models again."""
    resumes = spark.createDataFrame(
        [("f/1.pdf", "f", "Ada Lovelace"), ("f/2.pdf", "f", "Bob Ross\nbob@x.y\nSkills\nGo")], "resume_path string, folder string, resume_text string")
    jobs = spark.createDataFrame([(1, "jd", "SQL", None, None)], "jd_id bigint, jd_text string, category_detected string, qualifications string, requirements string")

    def run(label):
        seen = tmp_path / label
        seen.mkdir()

        def fill(asked):
            (seen / "fill").write_text(str(len(asked)))
            return asked.map(lambda p: '{"email":"Filled@x.y"}')

        def rate(asked):
            (seen / "rate").write_text(str(len(asked)))
            return asked.map(lambda p: '{"final_score":%d}' % len(p))

        stored = {kind: hook.StoredModel(ask, ContentStore(spark, str(tmp_path / kind), "1", T.StringType(), 2), label)
                  for kind, ask in (("fill", fill), ("rate", rate))}
        done = recommend(
            spark.createDataFrame([(1, "f")], "jd_id bigint, folder string"), jobs, resumes, spark.createDataFrame([], CANDIDATE),
            spark.createDataFrame([], SCORE), at(0), model=stored["rate"], fill_model=stored["fill"])
        return sorted(map(str, done.results.collect())), {p.name for p in seen.iterdir()}

    first, asked = run("one")
    again, asked_again = run("two")
    assert first == again and asked == {"fill", "rate"} and asked_again == set()


def test_blank_address_of_a_model_is_logged(spark):
    resumes = spark.createDataFrame([("f/1.pdf", "f", "Ada Lovelace")], "resume_path string, folder string, resume_text string")
    jobs = spark.createDataFrame([(1, "jd", "SQL", None, None)], "jd_id bigint, jd_text string, category_detected string, qualifications string, requirements string")
    done = recommend(
        spark.createDataFrame([(1, "f")], "jd_id bigint, folder string"), jobs, resumes, spark.createDataFrame([], CANDIDATE),
        spark.createDataFrame([], SCORE), at(0), fill_model=lambda asked: asked.map(lambda p: '{"email":"  "}'))
    assert [r["message"] for r in done.audit.where("log_type = 'ERROR'").collect()] == [
        "Failed candidate upsert: Cannot upsert candidate without an email."]
    assert done.candidates.count() == 0 and done.results.first()["candidate_id"] is None


def test_vector_corpus(spark, tmp_path):
    model = Counted(tmp_path / "seen")

    def embed(texts):
        if any(t == "bad" for t in texts):
            raise ValueError("bad")
        model(texts)
        return [[float(len(t)), 1.0] for t in texts]

    corpus = VectorCorpus(spark, str(tmp_path / "corpus"), "1", embed, buckets=4)
    docs = lambda *rows: spark.createDataFrame(list(rows), "path string, text string")
    held = lambda: {r["path"]: (list(r["embedding"]), r["batch"]) for r in corpus.read().collect()}
    assert corpus.refresh(docs(), "none") == 0 and held() == {}
    assert corpus.refresh(docs(("a", "x"), ("b", "yy"), ("c", "x"), ("d", None), ("e", "bad")), "one") == 3
    assert held() == {"a": ([1.0, 1.0], "one"), "b": ([2.0, 1.0], "one"), "c": ([1.0, 1.0], "one")}
    # b changes, c goes, e is tried again and f comes with a text that was there.
    assert corpus.refresh(docs(("a", "x"), ("b", "zzz"), ("d", None), ("e", "bad"), ("f", "yy")), "two") == 1
    assert held() == {"a": ([1.0, 1.0], "one"), "b": ([3.0, 1.0], "two"), "f": ([2.0, 1.0], "one")}
    assert corpus.refresh(docs(("z", "never")), "two") == 0 and "z" not in held()
    assert model.asked() == ["x", "yy", "zzz"]


def test_id_ranges(spark, tmp_path):
    ids = IdRanges(spark, str(tmp_path / "ids"))
    ids.start_after(40)
    assert [ids.reserve(0, 3), ids.reserve(1, 0), ids.reserve(2, 2)] == [41, 44, 44]
    assert ids.reserve(0, 3) == 41  # run again
    ids.start_after(1000)
    assert ids.reserve(3, 1) == 46
    with pytest.raises(ValueError):
        ids.reserve(2, 5)


def test_stream_jobs_leaves_earlier_batches_unread(spark, tmp_path, monkeypatch):
    """Ids go on even where the jobs of earlier batches are gone; a batch that is lost after its ids were given gets the same."""
    source, jobs, log = (str(tmp_path / n) for n in ("in", "jobs", "audit"))
    schema = "id bigint, path string, jd_text string"

    def arrive(*rows):
        spark.createDataFrame(list(rows), schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        answers_to = lambda batch: batch.select("id", F.lit('{"category":"A"}').alias("response"))
        ingest.stream_jobs(stream, answers_to, jobs, log, str(tmp_path / "checkpoint"), "id", at).awaitTermination()

    arrive((1, "a.pdf", "t"), (2, "b.pdf", "t"))
    for part in (tmp_path / "jobs" / "batch=0").glob("*.parquet"):
        part.write_bytes(b"not parquet any more")
    real = ingest.numbered_from
    monkeypatch.setattr(ingest, "numbered_from", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(Exception):
        arrive((3, "c.pdf", "t"))
    monkeypatch.setattr(ingest, "numbered_from", real)
    arrive((4, "d.pdf", "t"))
    found = spark.read.parquet(f"{jobs}/batch=1", f"{jobs}/batch=2")
    assert sorted((r["id"], r["jd_id"]) for r in found.collect()) == [(3, 3), (4, 4)]


def test_stream_files(spark, tmp_path):
    folder = tmp_path / "files"
    (folder / "sub").mkdir(parents=True)

    def reader(content):
        if content == b"broken":
            raise ValueError("no pages in it")
        if content == b"odd":
            raise KeyError
        return content.decode().split("|") if content else []

    def arrive(**contents):
        for name, content in contents.items():
            (folder / f"{name.replace('_', '/')}.PDF").write_bytes(content)
        ingest.stream_files(files.arriving_files(spark, str(folder)), reader, str(tmp_path / "docs"), str(tmp_path / "log"), str(tmp_path / "cp")).awaitTermination()

    arrive(a=b"one|two", sub_b=b"broken")
    arrive(c=b"|", d=b"odd", e=b"")  # Spark's file sources pass over empty files
    name = F.substring_index("path", "/", -1)
    docs = spark.read.parquet(str(tmp_path / "docs")).select(name, "text", "error", "batch").collect()
    assert sorted(map(tuple, docs), key=str) == [
        ("a.PDF", "onetwo", None, 0), ("b.PDF", "", "no pages in it", 0), ("c.PDF", "", None, 1), ("d.PDF", "", "KeyError", 1)]
    log = spark.read.parquet(str(tmp_path / "log")).select(name, "log_type", "process", "message").collect()
    assert sorted(map(tuple, log)) == [
        ("b.PDF", "ERROR", "JD_Analysis", "PDF parsing failed: no pages in it"), ("d.PDF", "ERROR", "JD_Analysis", "PDF parsing failed: KeyError")]


@pytest.mark.parametrize("stop_after", ["candidates", "scores", "results", "audit"])
def test_requests_replayed_after_each_sink(spark, tmp_path, monkeypatch, stop_after):
    """Wherever a batch stops, running it again gives what one undisturbed run gives."""
    def stored(sql, name):
        fx.load(spark, SF, sql).write.parquet(f"{tmp_path}/{name}")
        return spark.read.parquet(f"{tmp_path}/{name}")

    jobs, resumes, asked = stored(fx.JOBS, "jobs"), stored(fx.RESUMES, "resumes"), fx.load(spark, SF, fx.REQUESTS)
    before = fx.load(spark, SF, fx.CANDIDATES)
    known = SnapshotTable(spark, f"{tmp_path}/candidates", CANDIDATE, "candidate_email", buckets=3, number="candidate_id")
    known.fill(before, "initial")
    asked.coalesce(1).write.parquet(f"{tmp_path}/requests")
    state = RecommendationTables(spark, f"{tmp_path}/state", known, buckets=2)

    def run():
        arriving = spark.readStream.schema(asked.schema).parquet(f"{tmp_path}/requests")
        stream_recommend(arriving, lambda: jobs, lambda: resumes, state, f"{tmp_path}/checkpoint", at).awaitTermination()

    def then_stop(real, when):
        def wrapped(*args, **kwargs):
            real(*args, **kwargs)
            if when(args):
                raise RuntimeError("stopped")
        return wrapped

    with monkeypatch.context() as patched:
        if stop_after == "candidates":
            patched.setattr(SnapshotTable, "update", then_stop(SnapshotTable.update, lambda a: True))
        elif stop_after == "scores":
            patched.setattr(requests_stream, "merge_scores_into", then_stop(requests_stream.merge_scores_into, lambda a: True))
        else:
            patched.setattr(RecommendationTables, "write", then_stop(RecommendationTables.write, lambda a: a[2] == stop_after))
        with pytest.raises(Exception):
            run()
    assert not state.is_committed(0)
    run()
    assert state.is_committed(0)
    run()  # nothing new
    whole = recommend(asked, jobs, resumes, before, fx.load(spark, SF, fx.SCORES).limit(0), at(0))
    rows = lambda df: sorted(map(str, df.select(*sorted(df.columns)).collect()))
    assert rows(state.read("results").drop("batch")) == rows(whole.results)
    assert rows(state.read("audit").drop("batch")) == rows(whole.audit)
    assert rows(candidate_output(known.read())) == rows(candidate_output(whole.candidates))
    assert rows(spark.read.parquet(state.scores).drop("batch_id", "bucket")) == rows(whole.scores)
