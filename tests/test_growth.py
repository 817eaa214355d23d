"""Steps whose cost must not grow with more than the input."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hiregrid.functions.responses import is_json, parse_widest_object
from hiregrid.operators import bounded, ranking, similarity
from hiregrid.sources.content import ContentStore, content_digest
from hiregrid.sources.files import arriving_files
from hiregrid.streaming import ingest


def test_many_small_groups_are_numbered_by_a_window(spark, monkeypatch):
    labels = []
    write = ranking.materialize
    monkeypatch.setattr(ranking, "materialize", lambda df, label: labels.append(label) or write(df, label))
    frame = spark.range(600).select((F.col("id") % 6).alias("jd_id"), F.col("id").alias("path"))
    found = ranking.number_rows(frame, ["jd_id"], [F.col("path").desc()], "n", window_rows=100).collect()
    assert {(r.jd_id, r.path): r.n for r in found} == {(i % 6, i): 100 - i // 6 for i in range(600)}
    assert labels == ["unnumbered"]


def test_larger_groups_are_still_numbered_by_ranges(spark, monkeypatch):
    labels = []
    write = ranking.materialize
    monkeypatch.setattr(ranking, "materialize", lambda df, label: labels.append(label) or write(df, label))
    frame = spark.range(600).select((F.col("id") % 6).alias("jd_id"), F.col("id").alias("path"))
    found = ranking.number_rows(frame, ["jd_id"], [F.col("path").desc()], "n", window_rows=99).collect()
    assert {(r.jd_id, r.path): r.n for r in found} == {(i % 6, i): 100 - i // 6 for i in range(600)}
    assert labels == ["unnumbered", "ranges"]


def test_a_response_is_parsed_once(spark):
    rows = spark.createDataFrame([("{}",)], "response string").select(parse_widest_object(F.col("response")).alias("p"))
    plan = rows.select("p.ok", "p.is_object", "p.json")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json") <= 2


@pytest.mark.parametrize("text,valid", [
    ("1", True), (" -2.5e3\n", True), ("NaN", True), ("Infinity", True), ("-INF", True), ("true", True), ("null", True), ('"a"', True),
    ("[1, {}]", True), ("\t{\"a\": [1]}\r\n", True), ("", False), (" ", False), ("Sure: {}", False), ("{} done", False), ("no", False),
    ("{}]", False), ("[}", False), ('"a', False), ("```json", False), ("1 2", False), ("{},{}", False), (None, False),
])
def test_text_that_may_be_json(spark, text, valid):
    row = spark.createDataFrame([(text,)], "t string").select(is_json(F.col("t")).alias("v")).first()
    assert row.v is valid


def test_arriving_files_are_written_once(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ingest, "materialize", None)
    files = tmp_path / "files"
    files.mkdir()
    for name, content in {"a": b"one", "b": b"junk"}.items():
        (files / f"{name}.pdf").write_bytes(content)

    def page_reader(content):
        if content == b"junk":
            raise ValueError("not a document")
        return [content.decode()]

    ingest.stream_files(
        arriving_files(spark, str(files)), page_reader, f"{tmp_path}/documents", f"{tmp_path}/audit", f"{tmp_path}/checkpoint"
    ).awaitTermination()
    documents = spark.read.parquet(f"{tmp_path}/documents").orderBy("path").collect()
    assert [(r.text, r.error) for r in documents] == [("one", None), ("", "not a document")]
    assert [r.message for r in spark.read.parquet(f"{tmp_path}/audit").collect()]


def test_a_query_is_copied_by_pack_not_by_cell(spark):
    rng = np.random.default_rng(5)
    vectors = [rng.normal(size=6).tolist() for _ in range(400)]
    known = spark.createDataFrame(list(enumerate(vectors)), "c bigint, vector array<double>")
    asked = known.withColumnRenamed("c", "q")
    cells = bounded.cut_into_cells(known, "c")
    packs = bounded.packed(cells, 100)
    assert len(cells.sizes) == 20 and packs.max() < 8  # two packs next to each other have more than 100 rows
    assert np.bincount(packs, weights=cells.sizes).sum() == 400
    floored = asked.withColumn("floor", F.lit(-1e9))
    seen = bounded.visits(asked, cells, 5, True, packs).unionByName(bounded.visits(floored, cells, 5, False, packs).drop("floor"))
    assert seen.count() <= 400 * (packs.max() + 1)
    assert seen.groupBy("q", "cell").count().where("count > 1").count() == 0
    found = similarity.inner_product_topk(asked, known, "q", "c", 5, strategy="bounded", cell_rows=100)
    plain = similarity.inner_product_topk(asked, known, "q", "c", 5, strategy="grid")
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, plain.collect()))


def test_a_wave_reads_its_own_contents_only(spark, tmp_path):
    store = ContentStore(spark, str(tmp_path / "store"), "1", T.StringType(), 4, wave=20)
    contents = spark.range(100).select(content_digest(F.col("id").cast("string")).alias("digest"), F.col("id").cast("string").alias("content"))
    read = []

    def make(part):
        read.append(set(part.inputFiles()))
        return part.select("digest", F.concat(F.lit("v"), "content").alias("value"))

    assert store.complete(contents, make, "first") == 100
    assert len(read) == 5 and sum(map(len, read)) == len(set().union(*read))
    assert {r.value for r in store.read(contents.select("digest")).collect()} == {f"v{i}" for i in range(100)}
