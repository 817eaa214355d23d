"""Documents on a file system."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hiregrid.session import in_session, session_with

if TYPE_CHECKING:
    import pyarrow as pa

FILE_SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"
CATEGORY_SCHEMA = "category_id int, name string, type string"

LISTING_TASKS = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
MIN_LISTING_TASKS = 32
OPEN_COST = "spark.sql.files.openCostInBytes"
SMALL_FILE = 256 * 1024  # bytes that a task could read while it opens a file
LOG_INTERVAL = "spark.sql.streaming.fileSource.log.compactInterval"
MAX_LOG_INTERVAL = 100  # batches
LOGGED_FILES = 100_000  # about so many files are logged, and held by the driver, before the log is compacted


def folder_files(spark: SparkSession, folder: str) -> DataFrame:
    """``(path, modificationTime, length, content)`` of ``<folder>/*.pdf``, not below.

    Contents are read only if selected. Names starting with ``.`` or ``_`` are skipped.
    """
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(folder)


def tree_files(spark: SparkSession, folder: str) -> DataFrame:
    """The same at any depth, with the suffix in any case."""
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*.[pP][dD][fF]")
        .load(folder)
    )


def read_pages(files: DataFrame, page_reader: Callable[[bytes], list[str]]) -> DataFrame:
    """``(path, page_no, text, error)`` by a user's reader of one file's bytes.

    An unreadable file gives one page with text null and the reader's message
    as ``error``, which is null everywhere else; a file without pages gives one
    page with text null. One Arrow batch comes out for each that goes in.
    """

    def read(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        import pyarrow as pa

        for batch in batches:
            rows: list[tuple] = []
            for path, content in zip(batch.column(0), batch.column(1)):
                try:
                    texts, error = list(page_reader(content.as_py())) or [None], None
                except Exception as failure:
                    texts, error = [None], str(failure) or type(failure).__name__
                rows += [(path.as_py(), n, text, error) for n, text in enumerate(texts)]
            kinds = (pa.string(), pa.int64(), pa.string(), pa.string())
            columns = zip(*rows) if rows else [()] * len(kinds)
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(c), k) for c, k in zip(columns, kinds)], names=["path", "page_no", "text", "error"])

    return files.select("path", "content").mapInArrow(read, "path string, page_no bigint, text string, error string")


def documents_of(pages: DataFrame) -> DataFrame:
    """``(path, text, error)`` of what ``read_pages`` gives: one document per file, an unreadable one with '' and its error."""
    ordered = F.array_sort(F.collect_list(F.struct("page_no", F.coalesce("text", F.lit("")).alias("_t"))))
    return pages.groupBy("path").agg(F.array_join(ordered["_t"], "").alias("text"), F.max("error").alias("error"))


def _for_many_files(spark: SparkSession, files_per_batch: int) -> SparkSession:
    """A session to list a stream of many files in small batches.

    Spark lists the folders, and again the files of each batch, with a task for each path up to 10,000 of them, which costs far
    more than the listing; here it is some tasks for each core. A task reads few small files, since opening one counts as 4 MB;
    here it may read more, but no more bytes. Every few batches Spark rewrites its log of all files seen; the smaller the
    batches, the more of them lie between.
    """
    tasks = max(MIN_LISTING_TASKS, 2 * spark.sparkContext.defaultParallelism)
    interval = min(MAX_LOG_INTERVAL, LOGGED_FILES // max(1, files_per_batch))
    return session_with(spark, {
        LISTING_TASKS: str(min(tasks, int(spark.conf.get(LISTING_TASKS)))),
        OPEN_COST: str(min(SMALL_FILE, spark._jsparkSession.sessionState().conf().filesOpenCostInBytes())),
        LOG_INTERVAL: str(max(interval, int(spark.conf.get(LOG_INTERVAL)))),
    })


def arriving_files(spark: SparkSession, folder: str, files_per_batch: int = 10_000) -> DataFrame:
    """The files of ``tree_files`` as a stream: new files once each, so many in a micro-batch at most.

    Spark's file sources, here and above, pass over files of no bytes.
    """
    stream = (
        _for_many_files(spark, files_per_batch).readStream.format("binaryFile")
        .schema(FILE_SCHEMA)
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*.[pP][dD][fF]")
        .option("maxFilesPerTrigger", files_per_batch)
        .load(folder)
    )
    return in_session(spark, stream)  # whose queries and listeners are those of ``spark``


def assemble_pages(pages: DataFrame, doc: str, page_no: str, text: str, name: str = "text") -> DataFrame:
    """One text per document: pages in order, nothing between them, null pages as ''.

    A group is one document, whose text has to fit one row in any case.
    """
    ordered = F.array_sort(F.collect_list(F.struct(F.col(page_no), F.coalesce(text, F.lit("")).alias("_t"))))
    return pages.groupBy(doc).agg(F.array_join(ordered["_t"], "").alias(name))


def load_categories(spark: SparkSession, path: str) -> DataFrame:
    """The category file: ``;``-separated, quoted, with a header."""
    return spark.read.csv(path, sep=";", header=True, quote='"', escape='"', schema=CATEGORY_SCHEMA)
