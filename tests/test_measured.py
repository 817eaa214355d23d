"""Sizes known from the write, folders of a run, and what the e-mail fallback asks."""

import os

import pytest
from pyspark.sql import functions as F

from checks import queries
from hiregrid.operators import similarity
from hiregrid.operators.joins import fits_broadcast
from hiregrid.operators.measured import write_measured
from hiregrid.session import materialize, run_folder, shared_folder
from tests.conftest import SF


def jobs_of(spark, name, run):
    """How many Spark jobs ``run`` starts."""
    spark.sparkContext.setJobGroup(name, name)
    try:
        run()
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))
    finally:
        spark.sparkContext._jsc.clearJobGroup()


def test_sizes_of_a_write(spark):
    rows = spark.createDataFrame(
        [(1, "ab", [1.0, 2.0], ["a", None, "bcd"], (None, "x"), {"k": [1]}), (None, None, None, None, None, None)],
        "n bigint, text string, numbers array<double>, words array<string>, pair struct<i: int, s: string>, map map<string, array<int>>",
    )
    written = write_measured(rows)
    # 8 for a number or a value's own; a text, besides, its bytes; nothing for null
    assert (written.rows, written.bytes) == (2, 8 + 10 + 16 + (9 + 11) + (8 + 9) + (9 + 8))
    assert written.table.collect() == rows.collect()
    empty = write_measured(rows.limit(0))
    assert (empty.rows, empty.bytes) == (0, 0)
    nothing = write_measured(spark.createDataFrame([], "n int"))
    assert (nothing.rows, nothing.table.count()) == (0, 0)


def test_a_measured_table_is_not_counted_again(spark):
    written = write_measured(spark.range(100))
    assert jobs_of(spark, "measured", lambda: fits_broadcast(written)) == 0
    assert jobs_of(spark, "counted", lambda: fits_broadcast(written.table)) > 0
    assert fits_broadcast(written, max_rows=100, max_bytes=800)
    assert not fits_broadcast(written, max_rows=99)
    assert not fits_broadcast(written, max_bytes=799)


def test_a_run_leaves_no_tables(spark):
    with run_folder(spark) as outer:
        kept = materialize(spark.range(3), "kept")
        with run_folder(spark) as inner:
            materialize(spark.range(3))
            write_measured(spark.range(3))
            assert len([f for f in os.listdir(inner) if f.startswith("stage-")]) == 2
        assert not os.path.exists(inner) and kept.count() == 3
    assert not os.path.exists(outer)
    with pytest.raises(ZeroDivisionError), run_folder(spark) as failed:
        materialize(spark.range(3))
        raise ZeroDivisionError
    assert not os.path.exists(failed)
    with run_folder(spark) as unused:
        pass
    assert not os.path.exists(unused)
    assert materialize(spark.range(3)).inputFiles()[0].replace("file://", "").startswith(shared_folder(spark))


def test_a_stream_leaves_no_intermediate_tables(spark):
    before = set(os.listdir(shared_folder(spark)))
    queries.stream_files(spark, SF)
    left = {name.split("-")[0] for name in set(os.listdir(shared_folder(spark))) - before}
    assert "documents" not in left and "run" not in left


def test_only_unknown_addresses_are_asked_for(spark, tmp_path):
    documents = spark.createDataFrame(
        [(1, "Ann, ann@x.org"), (2, "Bob"), (3, "Cy"), (4, ""), (5, "Dee"), (6, "never hit"), (7, None)], "doc int, text string")
    hits = spark.createDataFrame(
        [(q, doc, 0.5, doc) for q in (1, 2, 3) for doc in (1, 2, 3, 4, 5, 7, 9)], "q int, doc int, score double, rank bigint")
    seen = str(tmp_path / "seen")

    def model(prompts):
        answers = {"Bob": '```json\n{"email": "bob@x.org", "name": "no"}\n```', "Cy": "no idea", "Dee": '{"email": ""}', "": "{}"}
        texts = [p.split("Resume:\n")[1] for p in prompts]
        with open(seen, "a") as out:
            out.writelines(f"{t!r}\n" for t in texts)
        return [answers[t] for t in texts]

    found = similarity.recommend(hits, documents, "q", "doc", "text", fill_model=model).collect()
    expected = {1: ("ann@x.org", False), 2: ("bob@x.org", False), 3: (None, True), 4: (None, False), 5: (None, False), 7: (None, False)}
    assert {(r["q"], r["doc"]): (r["candidate_email"], r["fill_error"]) for r in found} == {
        (q, doc): value for q in (1, 2, 3) for doc, value in expected.items()}
    assert len(found) == 18
    asked = open(seen).read().splitlines()
    assert sorted(asked) == ["''", "'Bob'", "'Cy'", "'Dee'"]
