"""Language identification by rank-order profiles.

A profile is the list of the most frequent n-grams (one to three letters, words closed by blanks) in order of frequency. A text
gets the language whose profile is nearest by out-of-place distance: the differences of ranks, summed over the text's own most
frequent n-grams, with the greatest difference for n-grams that a profile lacks.

Profiles count every n-gram of every training row: each task counts its batch by language, Spark adds up and ranks. Profiles
come to the tasks in blocks of languages of bounded size. Texts are read in place and never shuffled; counts of a language that
a third of all rows have are added up before the shuffle, and the ranking of one language is cut to its first rows within each
task before they meet.

Defined results: null text, or text without a letter, is ``und`` with score 0, and so is every text if nothing was learned.
Equal counts rank in order of the n-grams' numbers, equal distances go to the first language in code point order. Rows are
judged one by one, so repeated rows get equal results; other columns pass through.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hiregrid.llm.support import blocks, fresh

TOP = 300  # n-grams of a profile
BATCH_CHARS = 2_000_000  # characters counted at once
UNKNOWN = "und"
JUDGED = "struct<lang:string,score:double>"
JUDGED_ARROW = pa.struct([("lang", pa.string()), ("score", pa.float64())])
STATE: dict[str, object] = {}


def letters() -> np.ndarray:
    """By code point: the lower-case letter, or 0 for what is no letter; made once per worker."""
    if "letters" not in STATE:
        table = np.zeros(sys.maxunicode + 1, np.int64)
        for code in range(sys.maxunicode + 1):
            char = chr(code)
            if unicodedata.category(char)[0] == "L":
                low = char.lower()
                table[code] = ord(low) if len(low) == 1 else code
        STATE["letters"] = table
    return STATE["letters"]


def ngrams(text: str) -> np.ndarray:
    """The n-grams of a text as numbers, 21 bits per letter, a blank between words being 0; empty without a letter."""
    codes = letters()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    codes = np.concatenate(([0], codes, [0]))
    codes = codes[(codes != 0) | np.concatenate(([True], codes[:-1] != 0))]  # one blank between words
    if not codes.any():
        return codes[:0]
    # The middle of a trigram is a letter; single letters have blanks there, and bigrams are negative.
    one = codes[codes != 0] << 42
    two = -((codes[:-1] << 21) | codes[1:])
    three = ((codes[:-2] << 42) | (codes[1:-1] << 21) | codes[2:])[codes[1:-1] != 0]
    return np.concatenate((one, two, three))


def ranked(numbers: np.ndarray, top: int) -> np.ndarray:
    """The distinct numbers, most frequent first, then in their own order."""
    keys, counts = np.unique(numbers, return_counts=True)
    return keys[np.lexsort((keys, -counts))[:top]]


def count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of n-grams by language, for batches of (lang, text)."""
    for batch in batches:
        held: dict[str, list[str]] = {}
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            held.setdefault(lang, []).append(text)
        for lang, texts in held.items():
            at = 0
            while at < len(texts):
                end, chars = at, 0
                while end < len(texts) and (end == at or chars < BATCH_CHARS):
                    chars += len(texts[end])
                    end += 1
                keys, counts = np.unique(ngrams(" ".join(texts[at:end])), return_counts=True)
                at = end
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(keys), pa.string()), pa.array(keys), pa.array(counts, pa.int64())],
                    names=["lang", "gram", "n"],
                )


def learn(rows: DataFrame, top: int = TOP) -> DataFrame:
    """``rows(lang, text)`` to profiles: one row per language, with its n-grams in order of rank."""
    labelled = rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text")
    counts = labelled.mapInArrow(count_batches, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.col("n").desc(), "gram")
    best = counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    grams = F.array_sort(F.collect_list(F.struct("rank", "gram")))["gram"]
    return best.groupBy("lang").agg(grams.alias("grams"))


class Profiles:
    """Profiles as one sorted table of n-grams, with the rank in each language."""

    def __init__(self, profiles: list[tuple[str, list[int]]]):
        profiles = sorted(profiles)
        self.langs = [lang for lang, _ in profiles]
        self.grams = np.unique(np.concatenate([np.array(g, np.int64) for _, g in profiles])) if profiles else np.zeros(0, np.int64)
        self.ranks = np.full((len(profiles), len(self.grams)), -1, np.int32)
        for row, (_, grams) in enumerate(profiles):
            self.ranks[row, np.searchsorted(self.grams, np.array(grams, np.int64))] = np.arange(len(grams))

    def judge(self, text: str | None, top: int) -> tuple[str, float]:
        """The nearest language, and 1 less its distance over the greatest one."""
        own = ranked(ngrams(text), top) if text else ()
        if not len(own) or not self.langs:
            return UNKNOWN, 0.0
        at = np.searchsorted(self.grams, own)
        held = at < len(self.grams)
        held[held] = self.grams[at[held]] == own[held]
        ranks = self.ranks[:, at[held]]
        apart = np.where(ranks < 0, top, np.minimum(np.abs(ranks - np.flatnonzero(held)), top))
        distance = apart.sum(axis=1) + top * (len(own) - held.sum())
        best = int(distance.argmin())
        return self.langs[best], 1.0 - float(distance[best]) / (top * len(own))


def judge_by(spark, rows: list, top: int):
    """An Arrow UDF from a text to its nearest language in a block of profiles."""
    held = spark.sparkContext.broadcast([(r["lang"], list(r["grams"])) for r in rows])

    @F.arrow_udf(JUDGED)
    def judge(texts: pa.Array) -> pa.Array:
        profiles = Profiles(held.value)
        judged = [profiles.judge(t.as_py(), top) for t in texts]
        return pa.array([{"lang": lang, "score": score} for lang, score in judged], JUDGED_ARROW)

    return judge


def identify(docs: DataFrame, profiles: DataFrame, name: str, text: str = "text", top: int = TOP) -> DataFrame:
    """``docs`` with a column ``name``: lang and score (0 to 1)."""
    parts = [judge_by(docs.sparkSession, rows, top)(F.col(text)) for rows in blocks(profiles, F.length("lang") + 8 * F.size("grams"))]
    best: Column = parts[0]
    if len(parts) > 1:  # the greatest score; of equal ones the first language
        best = F.reduce(F.array(*parts), parts[0], lambda a, b: F.when(
            (b["score"] > a["score"]) | ((b["score"] == a["score"]) & (b["lang"] < a["lang"])), b).otherwise(a))
    return docs.withColumn(name, best)


def held_out(doc_id: Column) -> Column:
    """Rows that nothing is learned from: crc32 of the id as text leaves 2 when divided by 4; a null id is learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learn_from_documents(docs: DataFrame) -> DataFrame:
    return learn(docs.where(~held_out(F.col("doc_id"))))


def keep_identified(docs: DataFrame, profiles: DataFrame) -> DataFrame:
    """``docs`` without the rows that have no language, all columns kept."""
    name = fresh("judged", docs)
    return identify(docs, profiles, name).where(F.col(f"{name}.lang") != UNKNOWN).drop(name)
