"""Ranked lexical search: hybrid term-at-a-time and document-at-a-time over inverted lists.

Documents are ranked for each query by a weighted sum over its terms, in whole numbers (see ``impacts``). Two passes read the
texts in place. The first counts documents, terms and, for the terms of the queries, the documents that hold them. In the
second each task inverts a run of documents of bounded size at a time, keeping the lists of query terms only, and answers all queries
on it:

* Lists that are short in the run are read a term at a time and summed into accumulators. Sorted by document they are one
  iterator more, with the greatest accumulator as its bound.
* The long lists and that iterator are walked a document at a time, in blocks of neighbouring documents. Every list has its
  greatest impact in each block. A block whose greatest impacts together stay below the query's threshold, the least score
  among the best so far, is skipped in all lists; the others are summed up for their documents, and raise the threshold.

Thresholds live on from run to run of a task. A task returns at most ``top`` rows for each query, and two windows (first within
salts, then whole) merge them, so no task holds more than a bounded share of them. Texts are never shuffled, no
document is left out, and equal scores are settled by doc_id, so ties cost no more than other rows.

Queries come to the tasks in blocks of bounded size, one unless they are very many; each further block is two passes more, and
what was sent for a block is freed before the next.

Defined results: null or empty text has no term, and such a document is not counted; a query without terms has no row, nor has
one whose terms no document holds. Rows of one item_id (null too) are one query of the terms of its distinct texts. Rows that
repeat a doc_id are documents of their own; a null doc_id comes after others of equal score. Empty tables give no rows; other
columns are not read. Terms are compared by 64-bit hashes; sums are 64-bit integers.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hiregrid.llm.hashing import Words
from hiregrid.llm.support import blocks, word_table
from hiregrid.session import materialize

TOP = 20
RUN_DOCS, RUN_POSTINGS = 8192, 4_000_000  # a run of documents ends at the first of them
BLOCK = 64  # documents of a block
SHORT = 32  # a list is short in a run if it holds less than one in so many documents
SALTS = 64
#: Terms are [^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+ of the text in lower case.
TABLE = word_table(bytes([*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]))
# Fixed values of the score: documents of average length have a length of 100, of which 25 parts in 100 vary.
PARTS, VARYING = 100, 25
DOCUMENTS, TERMS = -1, -2  # numbers of the two sums among the counts of terms
LAST = (1 << 63) - 1


def terms(text: bytes | None) -> np.ndarray:
    return Words(text, TABLE).hashes.view(np.int64) if text else np.zeros(0, np.int64)


@F.arrow_udf(T.ArrayType(T.LongType()))
def term_arrays(texts: pa.Array) -> pa.Array:
    return pa.array([terms(t) for t in texts.cast(pa.binary()).to_pylist()], pa.list_(pa.int64()))


def queries_of(items: DataFrame) -> DataFrame:
    """``items(item_id, text)`` to one row per item with a term: item_id, terms and how often each is asked for."""
    asked = items.select("item_id", "text").distinct().select("item_id", F.explode(term_arrays(F.col("text"))).alias("term"))
    counted = asked.groupBy("item_id", "term").agg(F.count("*").alias("times"))
    return counted.groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct("term", "times"))).alias("asked")).select(
        "item_id", F.col("asked.term").alias("terms"), F.col("asked.times").alias("times"))


@dataclass
class Queries:
    """A block of queries as arrays: the distinct terms, and for each query (item, numbers of its terms, how often)."""

    known: np.ndarray
    asked: list[tuple[int | None, np.ndarray, np.ndarray]]
    weights: np.ndarray | None = None
    documents: int = 0
    words: int = 0

    @staticmethod
    def of(rows: list[Row]) -> Queries:
        known = np.unique(np.concatenate([np.array(r["terms"], np.int64) for r in rows]))
        return Queries(known, [(r["item_id"], np.searchsorted(known, np.array(r["terms"], np.int64)), np.array(r["times"], np.int64)) for r in rows])

    def numbers(self, found: np.ndarray) -> np.ndarray:
        """The numbers of the query terms among terms."""
        at = np.minimum(np.searchsorted(self.known, found), len(self.known) - 1)
        return at[self.known[at] == found]

    def weigh(self, counts: dict[int, int]) -> Queries:
        """With the weights that come of the counts of documents."""
        documents, words = counts.get(DOCUMENTS, 0), counts.get(TERMS, 0)
        weights = [math.floor(1000 * math.log((2 * documents + 2) / (2 * counts.get(t, 0) + 1))) for t in range(len(self.known))]
        return Queries(self.known, self.asked, np.array(weights, np.int64), documents, words)


def count_terms(held) -> object:
    """Counts of a task's texts: documents with terms, terms, and documents with each query term."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = held.value
        holding, sums = np.zeros(len(queries.known), np.int64), np.zeros(2, np.int64)
        for batch in batches:
            for text in batch.column(0).cast(pa.binary()):
                found = terms(text.as_py())
                if len(found):
                    sums += (1, len(found))
                    holding[np.unique(queries.numbers(found))] += 1
        met = np.flatnonzero(holding)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate(([DOCUMENTS, TERMS], met))), pa.array(np.concatenate((sums, holding[met])))], names=["term", "n"])

    return count


def impacts(times: np.ndarray, lengths: np.ndarray, queries: Queries) -> np.ndarray:
    """What a term adds that stands ``times`` in documents of ``lengths`` terms, before its weight."""
    parts = PARTS - VARYING + (VARYING * lengths * queries.documents) // queries.words
    return (1_000_000_000 * times) // (1000 * times + 12 * parts)


@dataclass
class Best:
    """The best documents of a query so far, as a heap with the worst on top."""

    top: int
    held: list[tuple[int, int, int | None]] = field(default_factory=list)

    @property
    def threshold(self) -> int:
        """The least score that may still enter."""
        return max(self.held[0][0], 1) if len(self.held) == self.top else 1

    def offer(self, score: int, doc: int | None) -> None:
        entry = (score, -(LAST if doc is None else doc), doc)
        if len(self.held) < self.top:
            heapq.heappush(self.held, entry)
        elif entry[:2] > self.held[0][:2]:
            heapq.heapreplace(self.held, entry)


class Run:
    """The inverted lists of a run of documents, for the terms of the queries."""

    def __init__(self, docs: list[int | None], lengths: list[int], found: list[np.ndarray], queries: Queries):
        self.docs, self.queries = docs, queries
        self.blocks = -(-len(docs) // BLOCK)
        sizes = np.array([len(f) for f in found])
        # One number for each term and document; equal ones are counted.
        every = np.concatenate(found) * len(docs) + np.repeat(np.arange(len(docs)), sizes)
        pairs, times = np.unique(every, return_counts=True)
        numbers, self.places = pairs // len(docs), pairs % len(docs)
        self.impacts = impacts(times, np.array(lengths, np.int64)[self.places], queries) * queries.weights[numbers]
        self.starts = np.searchsorted(numbers, np.arange(len(queries.known) + 1))
        self.peaks: dict[int, np.ndarray] = {}
        self.cuts: dict[int, np.ndarray] = {}

    def size(self, term: int) -> int:
        return int(self.starts[term + 1] - self.starts[term])

    def blocks_of(self, term: int) -> tuple[np.ndarray, np.ndarray]:
        """Of a long list, where each block begins, and the greatest impact of each block."""
        if term not in self.peaks:
            first, last = self.starts[term], self.starts[term + 1]
            cuts = first + np.searchsorted(self.places[first:last], np.arange(self.blocks + 1) * BLOCK)
            peaks = np.zeros(self.blocks, np.int64)
            full = np.flatnonzero(cuts[1:] > cuts[:-1])
            peaks[full] = np.maximum.reduceat(self.impacts[first:last], cuts[full] - first)
            self.cuts[term], self.peaks[term] = cuts, peaks
        return self.cuts[term], self.peaks[term]

    def accumulate(self, short: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
        """Term at a time: the documents of the short lists in order, and their sums."""
        if not short:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        lists = [slice(self.starts[term], self.starts[term + 1]) for term, _ in short]
        every = np.concatenate([self.places[part] for part in lists])
        added = np.concatenate([self.impacts[part] * times for part, (_, times) in zip(lists, short)])
        order = np.argsort(every, kind="stable")
        every, added = every[order], added[order]
        first = np.flatnonzero(np.concatenate(([True], every[1:] != every[:-1])))
        return every[first], np.add.reduceat(added, first)

    def answer(self, numbers: np.ndarray, times: np.ndarray, best: Best) -> int:
        """Offer the documents of the run that may be among the best; returns how many blocks were not skipped."""
        asked = [(int(t), int(k)) for t, k in zip(numbers, times) if self.starts[t + 1] > self.starts[t]]
        if not asked:
            return 0
        short = [a for a in asked if self.size(a[0]) * SHORT < len(self.docs)]
        long = [a for a in asked if self.size(a[0]) * SHORT >= len(self.docs)]
        summed, sums = self.accumulate(short)
        cuts = np.searchsorted(summed, np.arange(self.blocks + 1) * BLOCK)
        bounds = np.zeros(self.blocks, np.int64)
        full = np.flatnonzero(cuts[1:] > cuts[:-1])
        if len(full):
            bounds[full] = np.maximum.reduceat(sums, cuts[full])
        for term, k in long:
            bounds += self.blocks_of(term)[1] * k
        walked, at, span = 0, 0, 1
        scores = np.zeros(self.blocks * BLOCK, np.int64)
        while at < self.blocks:
            open_blocks = at + np.flatnonzero(bounds[at:] >= best.threshold)
            if not len(open_blocks):
                break
            taken = open_blocks[:span]
            walked += len(taken)
            # Neighbouring blocks are walked together; a walk grows longer while the threshold rises less.
            for first, last in joined(taken):
                scores[summed[cuts[first]:cuts[last]]] += sums[cuts[first]:cuts[last]]
                for term, k in long:
                    edges = self.cuts[term]
                    part = slice(edges[first], edges[last])
                    scores[self.places[part]] += self.impacts[part] * k
                found = scores[first * BLOCK:last * BLOCK]
                least = best.threshold
                places = np.flatnonzero(found >= least)
                if len(places) > best.top:  # only the best of them, and their equals, can stay
                    least = max(least, int(np.partition(found[places], -best.top)[-best.top]))
                    places = places[found[places] >= least]
                for place in places.tolist():
                    best.offer(int(found[place]), self.docs[first * BLOCK + place])
            at, span = int(taken[-1]) + 1, span * 2
        return walked


def joined(taken: np.ndarray) -> list[tuple[int, int]]:
    """Ranges (first, end) of neighbouring numbers."""
    breaks = np.flatnonzero(np.diff(taken) > 1)
    return list(zip(taken[np.concatenate(([0], breaks + 1))].tolist(), (taken[np.concatenate((breaks, [len(taken) - 1]))] + 1).tolist()))


def runs(batches: Iterator[pa.RecordBatch], queries: Queries, docs: int, postings: int) -> Iterator[Run]:
    """A task's documents as runs of at most ``docs`` documents, and not much more than ``postings`` words of queries."""
    ids: list[int | None] = []
    lengths: list[int] = []
    found: list[np.ndarray] = []
    held = 0
    for batch in batches:
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())):
            words = terms(text.as_py())
            numbers = queries.numbers(words)
            if not len(numbers):
                continue
            ids.append(doc)
            lengths.append(len(words))
            found.append(numbers)
            held += len(numbers)
            if len(ids) == docs or held >= postings:
                yield Run(ids, lengths, found, queries)
                ids, lengths, found, held = [], [], [], 0
    if ids:
        yield Run(ids, lengths, found, queries)


def search_runs(held, top: int, docs: int, postings: int) -> object:
    """The best documents of a task for each query: (query, doc_id, score)."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = held.value
        best = [Best(top) for _ in queries.asked]
        for run in runs(batches, queries, docs, postings):
            for (_, numbers, times), found in zip(queries.asked, best):
                run.answer(numbers, times, found)
        rows = [(n, doc, score) for n, found in enumerate(best) for score, _, doc in found.held]
        columns = zip(*rows) if rows else ([], [], [])
        yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in columns], names=["query", "doc_id", "score"])

    return search


def search_documents(
    docs: DataFrame, items: DataFrame, top: int = TOP, run_docs: int = RUN_DOCS, run_postings: int = RUN_POSTINGS, block_items: int | None = None,
) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``top`` documents of ``docs(doc_id, text)`` for each of ``items(item_id, text)``."""
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    item_type = items.schema["item_id"].dataType
    parts: list[DataFrame] = []
    limits = {"rows": block_items} if block_items else {}
    for rows in blocks(queries_of(items), 32 + 16 * F.size("terms"), **limits):
        if not rows:
            continue
        queries = Queries.of(rows)
        sent = spark.sparkContext.broadcast(queries)
        counts = texts.select("text").mapInArrow(count_terms(sent), "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n"))
        weighed = queries.weigh({r["term"]: r["n"] for r in counts.collect()})
        sent.destroy()
        if not weighed.words:
            continue
        sent = spark.sparkContext.broadcast(weighed)
        found = texts.mapInArrow(search_runs(sent, top, run_docs, run_postings), "query bigint, doc_id bigint, score bigint")
        stored = materialize(found, "found")
        sent.destroy()
        names = spark.createDataFrame([(n, item) for n, (item, _, _) in enumerate(weighed.asked)],
                                      T.StructType().add("query", T.LongType()).add("item_id", item_type))
        parts.append(best_rows(stored, top).join(F.broadcast(names), "query").select("item_id", "rank", "doc_id", "score"))
    if not parts:
        return spark.createDataFrame([], T.StructType().add("item_id", item_type).add("rank", T.IntegerType()).add("doc_id", T.LongType()).add("score", T.LongType()))
    merged = parts[0]
    for part in parts[1:]:
        merged = merged.unionByName(part)
    return merged


def best_rows(found: DataFrame, top: int) -> DataFrame:
    """The ``top`` rows of each query, ranked; first within salts, so that no task reads all rows of a query."""
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    salted = found.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)))
    for by in (["query", "salt"], ["query"]):
        salted = salted.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= top)
    return salted.drop("salt")
