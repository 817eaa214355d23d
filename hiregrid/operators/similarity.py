"""Exact inner-product top-k, dense (embeddings) and sparse (term vectors).

Corpus tables have ``(id, vector)`` or ``(id, tokens, weights)``. No pair of
query and corpus row is ever shuffled: a task scores a batch against a block of
queries with numpy and keeps only the k best per query.
"""

from __future__ import annotations

from collections.abc import Iterable
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hiregrid.functions.extract import email
from hiregrid.functions.prompts import missing_fields_prompt
from hiregrid.functions.text import run_lengths, run_starts, sorted_tokens
from hiregrid.functions.vectors import to_unit
from hiregrid.operators.bounded import bounded_hits
from hiregrid.operators.details import fill_field
from hiregrid.operators.hook import Model, model_responses
from hiregrid.operators.joins import fits_broadcast, join_on_key
from hiregrid.operators.measured import write_measured

if TYPE_CHECKING:
    import pyarrow as pa

BLOCK_ROWS = 4096  # vectors of the side that is shipped whole to a task
BLOCK_VALUES = 4_000_000  # numbers in those vectors
CELL_ROWS = 16_384  # corpus vectors per task of the grid
CELL_VALUES = 16_000_000  # numbers in those vectors
SLICE_SCORES = 4_000_000  # scores a task holds at a time


def normalized(vectors: DataFrame, vector: str = "embedding") -> tuple[DataFrame, DataFrame]:
    """(rows with a unit vector, rows whose vector is null or empty)."""
    usable = F.coalesce(F.size(vector) > 0, F.lit(False))
    return vectors.where(usable).withColumn(vector, to_unit(F.col(vector))), vectors.where(~usable)


def term_arrays(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``(doc_id, tokens, weights)``: distinct tokens with unit-length term frequencies.

    Counting happens inside the row, over the sorted tokens, so building the
    vectors of any corpus takes no shuffle.
    """
    counted = (
        docs.select(doc_id, sorted_tokens(F.col(text)).alias("_sorted"))
        .withColumn("_starts", run_starts(F.col("_sorted")))
        .withColumn("_tf", run_lengths(F.col("_starts"), F.size("_sorted")))
    )
    return counted.select(
        doc_id,
        F.transform("_starts", lambda i: F.get("_sorted", i)).alias("tokens"),
        F.coalesce(to_unit(F.col("_tf")), F.array().cast("array<double>")).alias("weights"),
    )


def term_vectors(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Long form ``(doc_id, token, weight)``."""
    pairs = F.explode(F.arrays_zip("tokens", "weights")).alias("_p")
    return term_arrays(docs, doc_id, text).select(doc_id, pairs).select(
        doc_id, F.col("_p.tokens").alias("token"), F.col("_p.weights").alias("weight")
    )


def centroids(vectors: DataFrame, by: str, vector: str = "embedding") -> DataFrame:
    """Unit mean vector per group, summed element-wise with map-side combining."""
    elements = vectors.select(by, F.posexplode(vector).alias("_i", "_x"))
    means = elements.groupBy(by, "_i").agg(F.avg(F.col("_x").cast("double")).alias("_x"))
    ordered = F.array_sort(F.collect_list(F.struct("_i", "_x")))
    grouped = means.groupBy(by).agg(ordered.alias("_v")).select(by, F.col("_v._x").alias(vector))
    return normalized(grouped, vector)[0]


def _fits_block(df: DataFrame, column: str) -> bool:
    """Counts rows first, which needs no vectors, and their numbers only if the rows are few."""
    if df.count() > BLOCK_ROWS:
        return False
    return df.agg(F.coalesce(F.sum(F.size(column)), F.lit(0))).first()[0] <= BLOCK_VALUES


def _parts(df: DataFrame, column: str, rows: int, values: int) -> int:
    """Into how many parts to cut ``df`` so that they have about so many rows and numbers."""
    n, total = df.agg(F.count("*"), F.coalesce(F.sum(F.size(column)), F.lit(0))).first()
    return max(1, -(-n // rows), -(-total // values))


def _width(df: DataFrame) -> int:
    """Numbers in a dense vector of ``df``; 0 if it has no rows."""
    row = df.select(F.size("vector").alias("n")).first()
    return row["n"] if row else 0


def _lists():
    """Arrow list columns as numpy: (length of each list, flat Arrow values)."""

    def lists(table: pa.Table, column: str):
        chunks = table.column(column)
        array = chunks.combine_chunks() if hasattr(chunks, "combine_chunks") else chunks
        return array.value_lengths().to_numpy(zero_copy_only=False), array.flatten()

    return lists


def _dense_scorer():
    lists = _lists()

    def stacked(table: pa.Table):
        lengths, values = lists(table, "vector")
        return values.to_numpy(zero_copy_only=False).astype("float64").reshape(len(lengths), -1)

    def scorer(block: pa.Table):
        import numpy as np

        matrix = stacked(block) if len(block) else None

        def score(batch: pa.Table):
            if matrix is None or not len(batch):
                return np.zeros((len(batch), len(block)))
            return stacked(batch) @ matrix.T

        return score

    return scorer


def _sparse_scorer(products: int = SLICE_SCORES):
    lists = _lists()

    def scorer(block: pa.Table):
        import numpy as np
        import pyarrow.compute as pc

        # Postings of the block by token: which of its vectors hold it, with what weight.
        lengths, tokens = lists(block, "tokens")
        vocabulary = pc.unique(tokens)
        codes = pc.index_in(tokens, value_set=vocabulary).to_numpy(zero_copy_only=False)
        by_token = np.argsort(codes, kind="stable")
        owners = np.repeat(np.arange(len(block)), lengths)[by_token]
        weights = lists(block, "weights")[1].to_numpy(zero_copy_only=False)[by_token]
        starts = np.searchsorted(codes[by_token], np.arange(len(vocabulary) + 1))

        def score(batch: pa.Table):
            lengths, tokens = lists(batch, "tokens")
            known = pc.fill_null(pc.index_in(tokens, value_set=vocabulary), -1).to_numpy(zero_copy_only=False)
            held = known >= 0
            known = known[held]
            values = lists(batch, "weights")[1].to_numpy(zero_copy_only=False)[held]
            cells = np.repeat(np.arange(len(batch)), lengths)[held] * len(block)
            first, counts = starts[known], starts[known + 1] - starts[known]
            done = np.concatenate(([0], np.cumsum(counts)))
            scores = np.zeros(len(batch) * len(block))
            start = 0
            while start < len(counts):  # a bounded number of products at a time
                stop = max(start + 1, int(np.searchsorted(done, done[start] + products, side="right")) - 1)
                part = slice(start, stop)
                repeat = counts[part]
                at = np.repeat(first[part] - done[part] + done[start], repeat) + np.arange(repeat.sum())
                scores += np.bincount(
                    np.repeat(cells[part], repeat) + owners[at],
                    weights=np.repeat(values[part], repeat) * weights[at],
                    minlength=len(scores),
                )
                start = stop
            return scores.reshape(len(batch), len(block))

        return score

    return scorer


def _selector(k: int):
    """``(best, merge)`` over parallel arrays (query position, corpus id, score)."""

    def first_k(query, ids, value):
        import numpy as np

        order = np.lexsort((ids, -value, query))
        query, ids, value = query[order], ids[order], value[order]
        keep = np.arange(len(query)) - np.searchsorted(query, query) < k
        return query[keep], ids[keep], value[keep]

    def best(scores, ids):
        """The k best of ``scores`` (one row per corpus id, one column per query)."""
        import numpy as np

        scores = np.round(scores, 6) + 0.0
        n = len(scores)
        if n > k:
            threshold = np.partition(scores, n - k, axis=0)[n - k]
            chosen = scores >= threshold
            if chosen.sum() > 2 * k * scores.shape[1]:
                # Many ties at the threshold, as of score 0: only the k least ids among them can be among the best.
                by_id = np.argsort(ids, kind="stable")
                tied = (scores == threshold)[by_id]
                chosen[by_id] &= ~tied | (np.cumsum(tied, axis=0) <= k)
            query, row = np.nonzero(chosen.T)
        else:
            query, row = np.nonzero(np.ones(scores.T.shape, dtype=bool))
        return first_k(query, ids[row], scores[row, query])

    def merge(one, other):
        import numpy as np

        return other if one is None else first_k(*[np.concatenate(pair) for pair in zip(one, other)])

    return best, merge


def _slicer(limit: int = SLICE_SCORES):
    """Cuts a table into row slices whose scores against ``width`` vectors stay below ``limit``."""

    def slices(table: pa.Table, width: int):
        step = max(1, limit // max(1, width))
        for start in range(0, len(table), step):
            yield table.slice(start, step)

    return slices


def inner_product_topk(
    queries: DataFrame,
    corpus: DataFrame,
    query_id: str,
    corpus_id: str,
    k: int,
    strategy: str | None = None,
    block_rows: int = BLOCK_ROWS,
    cell_rows: int = CELL_ROWS,
) -> DataFrame:
    """``(query_id, corpus_id, score, rank)``: the k best corpus rows of every query.

    Scores are rounded to 6 digits before ranking; ties go to the lower id; a
    corpus of n < k rows gives n. The plan depends on measured sizes:

    * ``corpus``: the corpus fits a block; each query row is settled where it is.
    * ``queries``: the queries fit a block; one pass over the corpus, each task
      emitting at most k rows per query.
    * ``grid``: neither fits; both sides are hashed into blocks, and each pair of
      blocks is scored by one task that emits at most k rows per query.
    * ``bounded``: only if asked for, dense vectors; each query visits those cells of
      the corpus that may hold one of its best (see ``bounded``). It pays where
      vectors lie in clusters; where they don't, every cell is visited.
    """
    dense = "tokens" not in corpus.columns
    columns = ["vector"] if dense else ["tokens", "weights"]
    queries, corpus = queries.select(query_id, *columns), corpus.select(corpus_id, *columns)
    if strategy is None:
        if _fits_block(corpus, columns[0]):
            strategy = "corpus"
        elif _fits_block(queries, columns[0]):
            strategy = "queries"
        else:
            strategy = "grid"

    scorer = _dense_scorer() if dense else _sparse_scorer()
    best, merge = _selector(k)
    slices = _slicer()
    schema = (
        f"{query_id} {queries.schema[query_id].dataType.simpleString()}, "
        f"{corpus_id} {corpus.schema[corpus_id].dataType.simpleString()}, score double"
    )

    def np_ids(table: pa.Table):
        return table.column(corpus_id).to_numpy()

    def hits_table(block: pa.Table, cell: pa.Table, hits):
        import pyarrow as pa

        query, ids, value = hits
        return pa.table({
            query_id: block.column(query_id).take(pa.array(query, pa.int64())),
            corpus_id: pa.array(ids, cell.schema.field(corpus_id).type),
            "score": pa.array(value, pa.float64()),
        })

    def score_cell(block: pa.Table, cell: pa.Table) -> pa.Table:
        import numpy as np

        hits = (np.empty(0, "int64"), np_ids(cell.slice(0, 0)), np.empty(0))
        if len(block) and len(cell):
            score = scorer(block)
            for part in slices(cell, len(block)):
                hits = merge(hits, best(score(part), np_ids(part)))
        return hits_table(block, cell, hits)

    if strategy == "corpus":
        block = corpus.toArrow()  # at most BLOCK_ROWS rows, counted above

        def against_corpus(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
            import pyarrow as pa

            score, ids = scorer(block), np_ids(block)
            for batch in batches:
                for part in slices(pa.Table.from_batches([batch]), len(block)):
                    yield from hits_table(part, block, best(score(part).T, ids)).to_batches()

        found = queries.mapInArrow(against_corpus, schema)
    elif strategy == "queries":
        block = queries.toArrow()  # at most BLOCK_ROWS rows, counted above

        def against_queries(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
            import pyarrow as pa

            score, hits, part = scorer(block), None, None
            for batch in batches:
                for part in slices(pa.Table.from_batches([batch]), len(block)):
                    hits = merge(hits, best(score(part), np_ids(part)))
            if hits is not None:
                yield from hits_table(block, part, hits).to_batches()

        found = corpus.mapInArrow(against_queries, schema)
    elif strategy == "bounded":
        cell_rows = max(1, min(cell_rows, CELL_VALUES // max(1, _width(corpus))))
        block_rows = max(1, min(block_rows, BLOCK_VALUES // max(1, _width(corpus))))
        found = bounded_hits(queries, corpus, query_id, corpus_id, k, score_cell, schema, block_rows, cell_rows)
    else:
        blocks = _parts(queries, columns[0], block_rows, BLOCK_VALUES)
        cells = _parts(corpus, columns[0], cell_rows, CELL_VALUES)

        def spread(df: DataFrame, key: str, own: str, n: int, other: str, copies: int) -> DataFrame:
            # Both sides need the same key types to meet in the same partition.
            return df.withColumn(own, F.pmod(F.xxhash64(key), F.lit(n)).cast("int")).withColumn(
                other, F.explode(F.sequence(F.lit(0), F.lit(copies - 1)))
            )

        left = spread(queries, query_id, "_block", blocks, "_cell", cells).groupBy("_block", "_cell")
        right = spread(corpus, corpus_id, "_cell", cells, "_block", blocks).groupBy("_block", "_cell")
        found = left.cogroup(right).applyInArrow(lambda block, cell: score_cell(block, cell), schema)

    best_first = Window.partitionBy(query_id).orderBy(F.col("score").desc(), F.col(corpus_id))
    return found.withColumn("rank", F.row_number().over(best_first).cast("bigint")).where(F.col("rank") <= k)


def category_columns(topk: DataFrame, query_id: str, corpus_id: str, k: int = 2) -> DataFrame:
    """``(query_id, category1_id, category2_id, …)`` from ranked hits, null where there are fewer."""
    ranked = [
        F.max(F.when(F.col("rank") == n, F.col(corpus_id))).alias(f"category{n}_id") for n in range(1, k + 1)
    ]
    return topk.groupBy(query_id).agg(*ranked)


def recommend(
    topk: DataFrame, documents: DataFrame, query_id: str, corpus_id: str, text: str, fill_model: Model | None = None
) -> DataFrame:
    """Ranked hits with the candidate e-mail of each document.

    Only the documents that were hit are extracted. A blank text has no e-mail and
    stays; hits whose document is absent drop out after ranking. ``fill_model`` is
    asked for the e-mail of each document that shows none, once however often it
    was hit, but not about a null text; a response that is no JSON leaves it null and sets ``fill_error``.
    """
    written = write_measured(topk, "topk")
    topk, small = written.table, fits_broadcast(written)
    address = email(F.col(text))
    if fill_model is None:
        if small:
            hits = documents.join(F.broadcast(topk), corpus_id)
        else:
            # One document may be a hit of very many queries.
            hits = join_on_key(topk, documents, corpus_id, row_key=query_id, broadcast=False)
        return hits.withColumn("candidate_email", address).drop(text)

    wanted = topk.select(corpus_id).distinct()
    reached = documents.join(F.broadcast(wanted) if small else wanted, corpus_id, "left_semi").withColumn("candidate_email", address)
    unknown = F.when(F.col("candidate_email").isNull() & F.col(text).isNotNull(), F.array(F.lit("email")))
    asked = reached.withColumn("_prompt", missing_fields_prompt(unknown, F.col(text))).drop(text)
    answered = fill_field(model_responses(asked, "_prompt", fill_model), "candidate_email", "email")
    known = write_measured(answered, "emails")  # a model's answers are not computed twice
    return join_on_key(topk, known.table, corpus_id, row_key=query_id, broadcast=fits_broadcast(known))
