"""Streams over many small files: how they are listed, logged and made."""

import os
import re

import pytest
from pyspark.sql import functions as F

from checks import queries
from hiregrid.session import local_path, session_with
from hiregrid.sources import files
from hiregrid.streaming import ingest


def test_a_session_with_other_settings(spark):
    spark.range(3).createOrReplaceTempView("three")
    key = "spark.sql.shuffle.partitions"
    before = spark.conf.get(key)
    other = session_with(spark, {key: "77"})
    assert other.conf.get(key) == "77" and spark.conf.get(key) == before
    assert other.conf.get("spark.checkpoint.dir") == spark.conf.get("spark.checkpoint.dir")
    assert other.table("three").count() == 3
    spark.catalog.dropTempView("three")


@pytest.mark.parametrize("per_batch,interval", [(10_000, "10"), (5_000, "20"), (400, "100"), (1, "100"), (1_000_000, "10")])
def test_settings_of_the_listing(spark, per_batch, interval):
    """The log is rewritten less often the smaller the batches; what the session asks for is kept if it goes further."""
    def settings(session):
        conf = files._for_many_files(session, per_batch).conf
        return conf.get(files.LOG_INTERVAL), conf.get(files.LISTING_TASKS), conf.get(files.OPEN_COST)

    assert settings(spark) == (interval, "32", str(files.SMALL_FILE))
    assert spark.conf.get(files.LOG_INTERVAL) == "10"
    assert settings(session_with(spark, {files.LOG_INTERVAL: "500", files.LISTING_TASKS: "3", files.OPEN_COST: "1k"})) == ("500", "3", "1024")


def test_the_log_of_small_batches(spark, tmp_path):
    """Twelve batches, with a restart between them; the stream is one of the session it was asked from."""
    (tmp_path / "files").mkdir()
    for first in (0, 11):
        for i in range(first, 12 if first else 11):
            (tmp_path / "files" / f"{i}.pdf").write_text(f"text {i}")
        arriving = files.arriving_files(spark, str(tmp_path / "files"), 1)
        assert arriving.sparkSession._jsparkSession.equals(spark._jsparkSession)
        query = ingest.stream_files(arriving, lambda b: [b.decode()], f"{tmp_path}/docs", f"{tmp_path}/log", f"{tmp_path}/cp")
        query.awaitTermination()
    docs = spark.read.parquet(f"{tmp_path}/docs").collect()
    assert sorted(r["text"] for r in docs) == sorted(f"text {i}" for i in range(12))
    assert {r["batch"] for r in docs} == set(range(12))
    assert not [name for name in os.listdir(tmp_path / "cp" / "sources" / "0") if name.endswith(".compact")]


def test_paths_share_listing_tasks(spark, tmp_path):
    """Of 90 folders with a file each: neither the folders nor the files of a batch have a task each."""
    for i in range(90):
        (tmp_path / "files" / f"d{i}").mkdir(parents=True)
        (tmp_path / "files" / f"d{i}" / f"{i}.pdf").write_text(f"text {i}")
    context = spark.sparkContext
    tracker = context.statusTracker()

    def tasks_of(group):
        stages = [s for j in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(j).stageIds]
        return [info.numTasks for info in map(tracker.getStageInfo, stages) if info]

    context.setJobGroup("listing", "listing")
    try:
        arriving = files.arriving_files(spark, str(tmp_path / "files"), 45)
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
        context.setLocalProperty("spark.job.description", None)
    query = ingest.stream_files(arriving, lambda b: [b.decode()], f"{tmp_path}/docs", f"{tmp_path}/log", f"{tmp_path}/cp")
    query.awaitTermination()
    docs = spark.read.parquet(f"{tmp_path}/docs").withColumn("name", F.substring_index("path", "/", -1)).collect()
    assert {(r["name"], r["text"]) for r in docs} == {(f"{i}.pdf", f"text {i}") for i in range(90)}
    assert sorted(r["batch"] for r in docs) == [0] * 45 + [1] * 45
    listed, streamed = tasks_of("listing"), tasks_of(str(query.runId))
    assert listed and max(listed) <= files.MIN_LISTING_TASKS
    assert streamed and max(streamed) <= files.MIN_LISTING_TASKS


def written(folder):
    """The content of each file by its id."""
    found = {}
    for place, _, names in os.walk(folder):
        for name in names:
            if name.endswith(".pdf"):
                (key,) = re.findall(r"conv_id=([^/.]+)", f"{place}/{name}"[len(str(folder)):])
                assert key not in found
                found[key] = open(f"{place}/{name}").read()
    return found


def test_files_are_those_that_spark_writes(spark, tmp_path, monkeypatch):
    rows = spark.createDataFrame(
        [(i, f"5B{i % 7}5D") for i in range(-20, 400)] + [(2**40, "junk")], "conv_id bigint, content string")
    queries.write_files(rows, str(tmp_path / "own"))
    queries.write_files(rows, str(tmp_path / "own"))  # as after a lost task
    own = written(tmp_path / "own")
    assert own == {str(r.conv_id): f"{r.content}\n" for r in rows.collect()}
    assert sum(len(names) for _, _, names in os.walk(tmp_path / "own")) == len(own)  # nothing half written
    assert len(os.listdir(tmp_path / "own")) <= queries.FILE_FOLDERS < len(own)
    monkeypatch.setattr(queries, "local_path", lambda spark, folder: None)
    queries.write_files(rows, str(tmp_path / "spark"))
    assert written(tmp_path / "spark") == own


def test_local_paths(spark, tmp_path):
    assert local_path(spark, "/a b/c") == local_path(spark, "file:///a b/c") == local_path(spark, "file:/a b/c") == "/a b/c"
    assert local_path(spark, "http://nowhere/a") is None
