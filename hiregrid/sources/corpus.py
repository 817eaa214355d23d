"""A stored vector corpus: which texts there are, and one vector for each distinct text."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hiregrid.operators.hook import embeddings
from hiregrid.operators.joins import fits_broadcast, join_on_key
from hiregrid.session import materialize
from hiregrid.sources.content import ContentStore, content_digest
from hiregrid.sources.tables import SnapshotTable

if TYPE_CHECKING:
    import pandas as pd

LISTING = "path string, digest string"


class VectorCorpus:
    """Documents by path, with the vectors that ``version`` of ``model`` gives their texts.

    The listing (path and text digest) is a snapshot, whose buckets change only where paths come, go or change their text; the
    vectors are kept by digest. A refresh hashes the texts where they are read, compares digests by path, and sends to the
    model each text that it has not seen under any path. Vectors of texts that are gone stay in the store and are used again
    should the text return.
    """

    def __init__(
        self, spark: SparkSession, folder: str, version: str, model: Callable[[pd.Series], Iterable[Sequence[float]]],
        buckets: int = 64, wave: int | None = None,
    ):
        limits = {"wave": wave} if wave else {}
        self.model = model
        self.vectors = ContentStore(spark, f"{folder}/vectors", version, T.ArrayType(T.FloatType()), buckets, **limits)
        self.listing = SnapshotTable(spark, f"{folder}/listing", LISTING, "path", buckets)

    def refresh(self, docs: DataFrame, batch: str) -> int:
        """Make the corpus that of ``docs(path, text)``, whose paths differ; returns how many texts the model was asked for.

        A null text has no vector. A batch that stopped halfway can be run again; one that was finished changes nothing.
        """
        if self.listing.has_batch(batch):
            return 0
        now = docs.select("path", content_digest(F.col("text")).alias("digest")).where("digest IS NOT NULL")
        before = self.listing.read().withColumnRenamed("digest", "_before")
        changes = materialize(
            now.join(before, "path", "full_outer").where(~F.col("digest").eqNullSafe(F.col("_before"))).drop("_before"), "changes")
        arrived = changes.where("digest IS NOT NULL")
        # Of unchanged paths no text is read again.
        narrow = arrived.select("path", "digest")
        texts = docs.select("path", F.col("text").alias("content")).join(F.broadcast(narrow) if fits_broadcast(narrow) else narrow, "path")

        def make(unseen: DataFrame) -> DataFrame:
            return embeddings(unseen, "content", self.model).withColumnRenamed("embedding", "value")

        asked = self.vectors.complete(texts.select("digest", "content"), make, batch)
        self.listing.update(
            changes, "path", lambda rows: rows.join(changes.select("path"), "path", "left_anti").unionByName(arrived), batch)
        return asked

    def read(self) -> DataFrame:
        """``(path, embedding, batch)`` of all documents that have a vector; ``batch`` is the refresh that made it."""
        listed = self.listing.read()
        vectors = materialize(self.vectors.read(listed.select("digest")), "vectors").withColumnRenamed("value", "embedding")
        # One text may be that of very many paths.
        return join_on_key(listed, vectors, "digest", row_key="path").drop("digest")
