"""The plug point for a user's model: batches of prompts in, responses out."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hiregrid.functions.extract import missing_fields
from hiregrid.functions.prompts import missing_fields_prompt
from hiregrid.operators.details import fill_gaps
from hiregrid.sources.content import ContentStore

@dataclass
class StoredModel:
    """A model whose responses are kept in ``store``: no run asks again what one has answered.

    It can stand wherever a model can. ``batch`` names the run in the store.
    """

    ask: Callable[["pd.Series"], Iterable[str]]
    store: ContentStore
    batch: str

    def responses(self, rows: DataFrame, prompt: str) -> DataFrame:
        """``rows`` with ``prompt`` replaced by ``response`` and ``response_batch``, the run that asked."""

        def make(unseen: DataFrame) -> DataFrame:
            answered = model_responses(unseen, "content", self.ask, failed=None)
            return answered.withColumnRenamed("response", "value")

        asked = rows.withColumn("_asked", F.col(prompt).isNotNull())
        answered = self.store.answered(asked, prompt, "response", make, self.batch)
        return answered.withColumn("response", F.when(F.col("_asked"), F.coalesce("response", F.lit("")))).drop("_asked")


Model = Callable[["pd.Series"], Iterable[str]] | StoredModel


def model_responses(rows: DataFrame, prompt: str, model: Model, failed: str | None = "") -> DataFrame:
    """``rows`` with the ``prompt`` column replaced by the model's ``response``.

    Only prompts go to Python; the other columns stay in the JVM. ``model`` gets
    the distinct prompts of one Arrow batch at a time, without null, whose
    response is null. If it fails, its prompts are halved and tried again, so
    one bad prompt of a thousand costs some twenty calls; only those that fail
    alone get ``failed`` for a response. Calls of a plain function repeat when a
    task is retried or the query is run again; a ``StoredModel`` is asked once
    for each prompt.
    """
    if isinstance(model, StoredModel):
        return model.responses(rows, prompt).drop("response_batch")

    def answers(prompts: pd.Series) -> list[str | None]:
        try:
            return list(model(prompts))
        except Exception:
            half = len(prompts) // 2
            return [*answers(prompts.iloc[:half]), *answers(prompts.iloc[half:])] if half else [failed]

    def ask(prompts: pa.Array) -> pa.Array:
        asked = prompts.drop_null().unique().to_pandas()
        responses = dict(zip(asked, answers(asked))) if len(asked) else {}
        return pa.array([responses.get(p) for p in prompts.to_pylist()], pa.string())

    return _replaced(rows, prompt, "response", ask, T.StringType())


def embeddings(rows: DataFrame, text: str, model: Callable[[pd.Series], Iterable[Sequence[float]]]) -> DataFrame:
    """``rows`` with the ``text`` column replaced by the model's ``embedding``.

    A text the model fails on gets null; ``similarity.normalized`` splits those off.
    """

    def vectors(texts: pd.Series) -> list:
        try:
            return list(model(texts))
        except Exception:
            half = len(texts) // 2
            return [*vectors(texts.iloc[:half]), *vectors(texts.iloc[half:])] if half else [None]

    def embed(texts: pa.Array) -> pa.Array:
        return pa.array(vectors(texts.to_pandas()) if len(texts) else [], pa.list_(pa.float32()))

    return _replaced(rows, text, "embedding", embed, T.ArrayType(T.FloatType()))


def _replaced(rows: DataFrame, column: str, name: str, run: Callable[[pa.Array], pa.Array], returned: T.DataType) -> DataFrame:
    """``rows`` with ``column`` replaced by what ``run`` makes of it.

    Declared nondeterministic, so that no filter or second use of the result calls a model twice.
    """
    call = F.arrow_udf(run, returned).asNondeterministic()
    return rows.select(*[c for c in rows.columns if c != column], call(F.col(column)).alias(name))


def complete_details(details: DataFrame, text: str, model: Model) -> DataFrame:
    """Ask ``model`` for the fields the rules missed, of the rows that miss any.

    One pass: complete rows go along with a null prompt, because a filter would
    be pushed below the extraction and run it a second time, and joining the
    answers back would shuffle. The text column is dropped.
    """
    prompts = details.withColumn("_prompt", missing_fields_prompt(missing_fields(), F.col(text)))
    return fill_gaps(model_responses(prompts.drop(text), "_prompt", model))
