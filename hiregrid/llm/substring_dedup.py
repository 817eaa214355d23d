"""Substring dedup by level-wise doubling.

A word goes if it is covered by a window of ``WINDOW`` words that also starts in a document with a smaller doc_id. Windows are
compared level by level: at the first level by runs of an eighth of their words, then by runs of twice that length, up to the
whole window. Only windows whose run is repeated in another document go on to the next level; documents without any are
finished, until no candidate survives.

At a level of length L a window is represented by the least hash among its runs of L words. Equal windows have equal runs, so
no repeat is lost; and neighbouring windows mostly share their least run, so that a stretch of windows is one row (hash of the
run, hash of the whole stretch, doc_id, first, last): about one row per twenty windows at the first level. Three things can
become of a stretch whose run is repeated elsewhere:

* a smaller doc_id has the same run and the same stretch: all its windows are repeats, it is settled and goes;
* all stretches with the run are equal and this is the first: nothing of it goes, and it is settled;
* else its windows go on to the next level; the last level has one row per window.

The first document of a window is never in a settled stretch of the first kind, so what goes on is enough to find it. Nothing
is sampled or capped.

A level reduces its rows by hash with map-side combining (smallest and greatest doc_id), so that a passage shared by a third of
all documents does not meet in one task; the join back to the rows has one row per hash on one side, and adaptive execution can
split it. Texts are shuffled by document to meet their surviving windows; what is finished leaves, and what goes on is written
under ``spark.checkpoint.dir``.

Hashes have 64 bits; a repeat is only believed if two of them, of run and stretch, are equal.

Defined results: null text has no words; a document of fewer than ``WINDOW`` words is kept whole; repeats inside one document,
or between rows of the same doc_id, remove nothing; a null doc_id counts as greater than all others; rows that repeat a doc_id
and text get equal results, rows of one doc_id with different texts their own. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hiregrid.llm.hashing import Words, running_minimum, span_hashes, window_hashes
from hiregrid.llm.support import WHITE
from hiregrid.session import materialize

WINDOW = 50
TABLE = bytes(32 if byte in WHITE else byte for byte in range(256))
LAST_ID = (1 << 63) - 1
ROWS = "hash bigint, hash2 bigint, id bigint, part bigint, first int, last int"
ROWS_ARROW = pa.schema([("hash", pa.int64()), ("hash2", pa.int64()), ("id", pa.int64()), ("part", pa.int64()),
                        ("first", pa.int32()), ("last", pa.int32())])
RANGES = "array<struct<first:int,last:int>>"


def levels(window: int, least: int = 6) -> list[int]:
    """The lengths to compare, each at most twice the one before: 7, 13, 25, 50 for a window of 50."""
    out = [window]
    while out[0] // 2 >= least:
        out.insert(0, (out[0] + 1) // 2)
    return out


def runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last index of every stretch of equal values."""
    firsts = np.concatenate(([0], np.flatnonzero(values[1:] != values[:-1]) + 1)) if len(values) else np.zeros(0, np.int64)
    return firsts, np.concatenate((firsts[1:], [len(values)]))[: len(firsts)] - 1


def candidates(text: bytes, ranges: list | None, length: int, window: int) -> list[tuple]:
    """Columns (hash, hash2, first, last) of the windows in ``ranges``, all windows if None."""
    words = Words(text, TABLE)
    n = len(words) - window + 1
    if n <= 0:
        return []
    hashes = running_minimum(window_hashes(words.hashes, length), window - length + 1)
    out = []
    for a, b in [(0, n - 1)] if ranges is None else ranges:
        if length == window:
            first = last = np.arange(a, b + 1)
        else:
            first, last = (index + a for index in runs(hashes[a:b + 1]))
        out.append((hashes[first], span_hashes(words.hashes, first, last + window, seed=7), first, last))
    return out


def level_rows(length: int, window: int) -> Callable:
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Batches of (id, part, text, ranges) to rows of candidates."""
        for batch in batches:
            held, ids, parts = [], [], []
            texts = batch.column(2).cast(pa.binary())
            for i in range(batch.num_rows):
                ranges = batch.column(3)[i].as_py() if batch.num_columns > 3 else None
                ranges = None if ranges is None else merge([(r["first"], r["last"]) for r in ranges])
                for hashes, second, first, last in candidates(texts[i].as_py(), ranges, length, window):
                    held.append((hashes, second, first, last))
                    ids.append(np.full(len(first), batch.column(0)[i].as_py(), np.int64))
                    parts.append(np.full(len(first), batch.column(1)[i].as_py(), np.int64))
            if held:
                hashes, second, first, last = (np.concatenate(x) for x in zip(*held))
                yield pa.RecordBatch.from_arrays([
                    pa.array(hashes.view(np.int64)), pa.array(second.view(np.int64)), pa.array(np.concatenate(ids)),
                    pa.array(np.concatenate(parts)), pa.array(first.astype(np.int32)), pa.array(last.astype(np.int32)),
                ], schema=ROWS_ARROW)
    return emit


def merge(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for first, last in sorted(ranges):
        if out and first <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(out[-1][1], last))
        else:
            out.append((first, last))
    return out


def removed_words(ranges: list[tuple[int, int]], window: int) -> list[tuple[int, int]]:
    """The words that windows starting in ``ranges`` cover."""
    return merge([(first, last + window - 1) for first, last in ranges])


def finish(text: bytes | None, ranges: list[tuple[int, int]], window: int) -> tuple[int, int, bytes]:
    found = (text or b"").translate(TABLE).split()
    gone, kept, at = 0, [], 0
    for first, last in removed_words(ranges, window):
        kept += found[at:first]
        gone += last - first + 1
        at = last + 1
    kept += found[at:]
    return len(found), gone, b" ".join(kept)


def finisher(window: int, digest: bool):
    @F.arrow_udf("struct<n_words:bigint,n_removed:bigint,kept:string>")
    def finished(texts: pa.Array, ranges: pa.Array) -> pa.Array:
        out = []
        for text, found in zip(texts.cast(pa.binary()), ranges):
            spans = [(r["first"], r["last"]) for r in found.as_py() or ()]
            n, gone, kept = finish(text.as_py(), spans, window)
            out.append({"n_words": n, "n_removed": gone, "kept": hashlib.sha256(kept).hexdigest() if digest else kept})
        return pa.array(out, pa.struct([("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string())]))
    return finished


def judge(rows: DataFrame, last_level: bool) -> DataFrame:
    """Per document: ``gone``, the windows found to be repeats, and ``ranges``, those that go on."""
    rows = materialize(rows, "windows")  # both sides of the join read it
    runs_ = rows.groupBy("hash").agg(
        F.min("id").alias("least"), F.max("id").alias("most"), (F.min("hash2") != F.max("hash2")).alias("mixed")
    ).where(F.col("least") < F.col("most")).select("hash", "mixed")
    # Written, so that the joins read two shuffles and a run that very many rows have can be split.
    kept = materialize(rows.join(materialize(runs_, "runs"), "hash"), "repeated")
    stretches = materialize(kept.groupBy("hash", "hash2").agg(F.min("id").alias("first_id")), "stretches")
    repeat = F.col("id") > F.col("first_id")
    goes_on = F.lit(False) if last_level else ~repeat & F.col("mixed")
    span = F.struct("first", "last")
    return kept.join(stretches, ["hash", "hash2"]).where(repeat | goes_on).groupBy("id", "part").agg(
        F.collect_list(F.when(repeat, span)).alias("gone"), F.collect_list(F.when(goes_on, span)).alias("ranges")
    )


def remove_repeats(docs: DataFrame, window: int = WINDOW, digest: bool = False) -> DataFrame:
    """``docs(doc_id, text)`` to doc_id, n_words, n_removed and kept: the words left, joined by one space.

    With ``digest``, kept is the SHA-256 of that text in hex, so that texts of finished documents need not be stored.
    """
    # part tells rows of one doc_id apart.
    none = F.array().cast(RANGES)
    open_docs = docs.select(
        "doc_id", F.coalesce("doc_id", F.lit(LAST_ID)).alias("id"), F.xxhash64("text").alias("part"), "text", none.alias("before"),
    )
    finished, done = [], finisher(window, digest)
    for length in levels(window):
        columns = ["id", "part", "text"] + (["ranges"] if "ranges" in open_docs.columns else [])
        found = judge(
            open_docs.where(F.col("text").isNotNull()).select(*columns).mapInArrow(level_rows(length, window), ROWS), length == window
        )
        joined = open_docs.drop("ranges").join(found, ["id", "part"], "left").select(
            "doc_id", "id", "part", "text", F.concat("before", F.coalesce("gone", none)).alias("before"),
            F.coalesce("ranges", none).alias("ranges"),
        )
        over = F.size("ranges") == 0
        if length == window:
            finished.append(joined.select("doc_id", done(F.col("text"), F.col("before")).alias("done")))
        else:
            # What has no candidate left needs no text any more.
            joined = materialize(joined.select(
                "doc_id", "id", "part", F.when(~over, F.col("text")).alias("text"), F.when(~over, F.col("before")).alias("before"),
                "ranges", F.when(over, done(F.when(over, F.col("text")), F.when(over, F.col("before")))).alias("done"),
            ), "level")
            finished.append(joined.where(over).select("doc_id", "done"))
            open_docs = joined.where(~over).drop("done")
    out = finished[0]
    for part in finished[1:]:
        out = out.unionByName(part)
    return out.select("doc_id", "done.*")
