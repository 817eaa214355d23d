"""Recommendations for arriving requests: several tables change together, once for each micro-batch."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from hiregrid.operators.lookup import email_key
from hiregrid.operators.upsert import SCORE_BUCKETS, merge_scores_into, upsert_candidates
from hiregrid.plans.recommend import recommend
from hiregrid.session import materialize
from hiregrid.sources.tables import SnapshotTable, stored_or_empty
from hiregrid.streaming.ingest import run_available

COMMIT_SCHEMA = "batch bigint"


@dataclass
class RecommendationTables:
    """Where a stream of requests keeps its state, below ``folder``, and the candidate table it maintains."""

    spark: SparkSession
    folder: str
    candidates: SnapshotTable
    buckets: int = SCORE_BUCKETS  # of the score table

    @property
    def scores(self) -> str:
        return f"{self.folder}/scores"

    def is_committed(self, batch: int) -> bool:
        return not self._commits().where(F.col("batch") == batch).isEmpty()

    def commit(self, batch: int) -> None:
        self.spark.createDataFrame([(batch,)], COMMIT_SCHEMA).coalesce(1).write.mode("append").parquet(f"{self.folder}/commits")

    def _commits(self) -> DataFrame:
        return stored_or_empty(self.spark, f"{self.folder}/commits", COMMIT_SCHEMA)

    def write(self, df: DataFrame, name: str, batch: int) -> None:
        """One directory per batch, replaced when the batch is run again."""
        df.write.mode("overwrite").parquet(f"{self.folder}/{name}/batch={batch}")

    def read(self, name: str) -> DataFrame:
        """The rows of ``name`` that belong to committed batches; a batch that is being written is not seen."""
        rows = self.spark.read.parquet(f"{self.folder}/{name}")
        return rows.join(F.broadcast(self._commits().distinct()), "batch", "left_semi")


def stream_recommend(
    requests: DataFrame,
    jobs: Callable[[], DataFrame],
    resumes: Callable[[], DataFrame],
    tables: RecommendationTables,
    checkpoint: str,
    at: Callable[[int], Column],
    **options,
) -> StreamingQuery:
    """Answer arriving ``requests(jd_id, folder)``: candidates, scores, results and audit rows, as ``recommend`` gives them.

    Every sink knows the batch it got: the candidate table lists it, score rows carry it, results and audit rows lie in
    its directory. The commit record is written last. A batch that stopped anywhere before is run again, finds the sinks that
    have it and completes the others; candidates keep the ids of the first try, so the rows are the same. A batch with a
    commit record changes nothing. ``jobs`` and ``resumes`` give the tables as they are when a batch begins; ``options``
    (responses, model, fill_model) go to ``recommend``; a model that is a ``StoredModel`` is not asked again by a replay.
    """

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        if tables.is_committed(batch_id):
            return
        label = f"requests-{batch_id}"

        def store(reached: DataFrame) -> DataFrame:
            keyed = materialize(reached.withColumn("_key", email_key(F.col("email"))), "reached")
            last_id = tables.candidates.highest()
            tables.candidates.update(
                keyed, "_key",
                lambda rows: upsert_candidates(rows, keyed, at(batch_id), last_id=last_id, first="_first", last="_last")[0], label,
            )
            return tables.candidates.read()

        done = recommend(materialize(batch, "requests"), jobs(), resumes(), store, None, at(batch_id), **options)
        merge_scores_into(tables.scores, done.score_batch, label, order="_place", buckets=tables.buckets)
        tables.write(done.results, "results", batch_id)
        tables.write(done.audit, "audit", batch_id)
        tables.commit(batch_id)

    return run_available(requests, checkpoint, on_batch)
