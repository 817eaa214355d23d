"""Session construction and durable intermediate tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_RUN: ContextVar[str | None] = ContextVar("run folder", default=None)


def build_session(app_name: str = "hiregrid", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings every plan here assumes.

    ``master`` is only given for local runs; on a cluster it comes from
    spark-submit, together with the shuffle partition count and the checkpoint
    folder.
    """
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def session_with(spark: SparkSession, conf: dict[str, str]) -> SparkSession:
    """A session like ``spark``, with its settings and views, in which ``conf`` holds besides; ``spark`` itself stays as it is."""
    other = type(spark)(spark.sparkContext, spark._jsparkSession.cloneSession())
    for key, value in conf.items():
        other.conf.set(key, value)
    return other


def in_session(spark: SparkSession, df: DataFrame) -> DataFrame:
    """``df`` of another session as one of ``spark``; what reads its sources keeps the settings that it was made with."""
    dataset = spark._jvm.org.apache.spark.sql.classic.Dataset
    return DataFrame(dataset.ofRows(spark._jsparkSession, df._jdf.logicalPlan()), spark)


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate tables: ``spark.checkpoint.dir`` of the session.

    Only a local master may fall back to a folder of its own; on a cluster a
    machine-local folder would be lost with its executor, so that is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    folder = tempfile.mkdtemp(prefix="hiregrid-")
    spark.sparkContext.setCheckpointDir(folder)
    return shared_folder(spark)


def _file_system(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), path


def folder_exists(spark: SparkSession, folder: str) -> bool:
    files, path = _file_system(spark, folder)
    return files.exists(path)


def local_path(spark: SparkSession, folder: str) -> str | None:
    """``folder`` as a path of this machine's file system; None if it lies in another."""
    files, path = _file_system(spark, folder)
    uri = files.makeQualified(path).toUri()
    return uri.getPath() if uri.getScheme() == "file" else None


def intermediate_folder(spark: SparkSession) -> str:
    """Where intermediate tables go: the folder of the run, if there is one, else the shared folder."""
    return _RUN.get() or shared_folder(spark)


@contextmanager
def run_folder(spark: SparkSession) -> Iterator[str]:
    """Intermediate tables made inside lie in one folder, which is deleted at the end, also after an error.

    Everything that reads them must be written inside; frames made here can't be read afterwards. Of runs inside one
    another each has its own folder.
    """
    folder = f"{shared_folder(spark)}/run-{uuid.uuid4().hex}"
    token = _RUN.set(folder)
    try:
        yield folder
    finally:
        _RUN.reset(token)
        files, path = _file_system(spark, folder)
        files.delete(path, True)


def materialize(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write ``df`` once under the shared folder and return the written table.

    Cuts lineage durably: the result survives executor loss, its row count is
    parquet metadata, and expensive columns (text extraction) are computed once
    however many consumers follow.
    """
    spark = df.sparkSession
    path = f"{intermediate_folder(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
