"""Benchmark decontamination by Wu-Manber multi-pattern search.

Test items are cut into windows of ten words (an item of fewer is one window). Texts and windows are written the same way, in
lower case, words between single spaces, so that an occurrence of a window is an occurrence of its string. The strings are
sorted into classes by length; each class has a shift table over blocks of its shortest length, which tells how far a scan may
jump, and buckets of strings by their suffix block, which are compared directly where the table says zero.

The windows come to the tasks in blocks of bounded size (see ``support.blocks``), one block unless the test set is very large;
further blocks scan the same texts after one another within the task. Documents are scanned where they are read, with no
shuffle; a row is judged on its own, so hot sources and groups of copies need nothing special.

Defined results: null has no words; a document without words has no hits; test items without words are no patterns; items
are told apart by item_id, null written as an empty string, so repeated rows of an item count once; other columns pass through.
"""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hiregrid.llm.support import blocks, fresh, word_table

WORDS = 10  # words of a window
#: Words are [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ of the text in lower case.
TABLE = word_table(bytes([*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]))
HITS = "struct<n_words:bigint,spans:array<struct<first:bigint,last:bigint>>,items:array<string>>"
HITS_ARROW = pa.struct([
    ("n_words", pa.int64()), ("spans", pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))),
    ("items", pa.list_(pa.string())),
])


def words(text: bytes | None) -> list[bytes]:
    return text.translate(TABLE).split() if text else []


def windows(found: list[bytes], size: int = WORDS) -> set[bytes]:
    """The strings to look for: every run of ``size`` words, or all words if they are fewer."""
    return {b" " + b" ".join(found[i:i + size]) + b" " for i in range(max(1, len(found) - size + 1))} if found else set()


class WuManber:
    """Search for strings of similar length: all of one class share the length that the tables look at."""

    def __init__(self, strings: list[bytes]):
        self.length = min(map(len, strings))
        self.block = min(self.length, 8 if self.length >= 24 else 3)
        self.shifts: dict[bytes, int] = {}
        self.buckets: dict[bytes, list[bytes]] = {}
        for string in strings:
            for end in range(self.block, self.length + 1):
                part = string[end - self.block:end]
                self.shifts[part] = min(self.shifts.get(part, self.length), self.length - end)
            self.buckets.setdefault(string[self.length - self.block:self.length], []).append(string)
        self.jump = self.length - self.block + 1

    def search(self, text: bytes) -> list[tuple[int, bytes]]:
        """All (position, string) that occur in ``text``, overlapping ones too, by position."""
        found, at, end, block, jump = [], self.length, len(text), self.block, self.jump
        shift, buckets, length = self.shifts.get, self.buckets, self.length
        while at <= end:
            part = text[at - block:at]
            skip = shift(part, jump)
            if skip:
                at += skip
                continue
            for string in buckets[part]:
                if text.startswith(string, at - length):
                    found.append((at - length, string))
            at += 1
        return found


def searchers(strings: list[bytes]) -> list[WuManber]:
    """One searcher per class of lengths, a class reaching to twice its least length."""
    classes: dict[int, list[bytes]] = {}
    for string in strings:
        classes.setdefault(len(string).bit_length(), []).append(string)
    return [WuManber(c) for c in classes.values()]


def hit_words(text: bytes, found: list[tuple[int, bytes]]) -> list[tuple[int, int]]:
    """Ranges of word numbers that the occurrences cover, merged."""
    spans: list[tuple[int, int]] = []
    at, number = 0, 0
    for position, string in sorted(found):
        number += text.count(b" ", at, position)
        at = position
        last = number + string.count(b" ") - 2
        if spans and number <= spans[-1][1] + 1:
            spans[-1] = (spans[-1][0], max(spans[-1][1], last))
        else:
            spans.append((number, last))
    return spans


def merged(a: list[tuple[int, int]], b: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for first, last in sorted(a + b):
        if out and first <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(out[-1][1], last))
        else:
            out.append((first, last))
    return out


def finder(spark, rows: list):
    """An Arrow UDF from (text, earlier hits) to hits, for one block of windows."""
    held = spark.sparkContext.broadcast([(bytes(r["string"]), r["items"]) for r in rows])
    label = uuid.uuid4().hex

    @F.arrow_udf(HITS)
    def find(texts: pa.Array, before: pa.Array) -> pa.Array:
        tables = prepared(label, held)
        out = []
        for text, earlier in zip(texts.cast(pa.binary()), before):
            out.append(hits_of(text.as_py(), earlier.as_py(), *tables))
        return pa.array(out, HITS_ARROW)

    return find


PREPARED: dict[str, tuple] = {}


def prepared(label: str, held) -> tuple[list[WuManber], dict[bytes, list[str]]]:
    """The tables of a broadcast block; a Python worker keeps those of the last block it used."""
    if label not in PREPARED:
        PREPARED.clear()
        items = dict(held.value)
        PREPARED[label] = (searchers(list(items)), items)
    return PREPARED[label]


def hits_of(text: bytes | None, earlier: dict | None, tables: list[WuManber], items: dict[bytes, list[str]]) -> dict:
    found_words = words(text)
    line = b" " + b" ".join(found_words) + b" "
    found = [hit for table in tables for hit in table.search(line)] if found_words else []
    spans = hit_words(line, found)
    names = {name for _, string in found for name in items[string]}
    if earlier:
        spans = merged(spans, [(s["first"], s["last"]) for s in earlier["spans"]])
        names |= set(earlier["items"])
    return {"n_words": len(found_words), "spans": [{"first": a, "last": b} for a, b in spans], "items": sorted(names)}


@F.arrow_udf(T.ArrayType(T.BinaryType()))
def item_windows(texts: pa.Array) -> pa.Array:
    return pa.array([sorted(windows(words(t))) for t in texts.cast(pa.binary()).to_pylist()], pa.list_(pa.binary()))


def patterns(benchmark: DataFrame) -> DataFrame:
    """``benchmark(item_id, text)`` to one row per distinct window: string, items."""
    item = F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item")
    return benchmark.select(item, F.explode(item_windows(F.col("text"))).alias("string")).groupBy("string").agg(
        F.sort_array(F.collect_set("item")).alias("items")
    )


def find_leaks(docs: DataFrame, benchmark: DataFrame, name: str, text: str = "text") -> DataFrame:
    """``docs`` with a column ``name``: n_words, the spans of hit words (first and last, merged) and the items found."""
    spark = docs.sparkSession
    hits: Column = F.lit(None).cast(HITS)
    size = F.length("string") + F.aggregate("items", F.lit(0), lambda n, i: n + F.length(i) + 64)
    for rows in blocks(patterns(benchmark), size):
        hits = finder(spark, rows)(F.col(text), hits)
    return docs.withColumn(name, hits)


def n_hit(hits: str) -> Column:
    """The number of hit words in a column of ``find_leaks``."""
    return F.aggregate(f"{hits}.spans", F.lit(0).cast("bigint"), lambda n, s: n + s["last"] - s["first"] + 1)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the rows that hold a window of the benchmark, all columns kept."""
    name = fresh("hits", docs)
    return find_leaks(docs, benchmark, name).where(F.size(f"{name}.spans") == 0).drop(name)
