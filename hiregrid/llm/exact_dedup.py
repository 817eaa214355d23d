"""Exact dedup: an index of live text digests, cut into shards that each hold a cuckoo filter and bucketed content.

Texts are equal when they are after deleting white space; the SHA-256 of what is left is the digest. Of equal texts the row
with the most code points stays, then the smallest doc_id (null last).

The index is a table: per shard one row with the filter, and one row per live digest with its bucket. ``insert`` and
``delete`` bring a batch of digests to their shards. A digest the filter misses is new. A hit may be false, so it is compared
with the content of its two buckets before it counts as known. A full filter is made anew at twice the size from the stored
keys. Digests are hashes, so shards are even; before the shuffle a batch is reduced, with map-side combining, to at most
``ARRIVALS`` rows per digest, so a text that a third of all rows share brings no more rows to its shard than any other.

``dedup`` reads texts once and never shuffles them. The digest table is written under ``spark.checkpoint.dir``; the rest is computed from
it and can be computed again when executors are lost.

Defined results: null text counts as empty; empty texts are equal to each other; repeated rows (same doc_id, same text) are
members of their group of which at most the first stays; an empty table gives no row; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from hiregrid.session import materialize

SHARD_DIGESTS = 100_000  # digests per shard that a new index is made for
ARRIVALS = 16  # rows at most that one batch brings per digest
INDEX = ("shard int, filter binary, bucket int, digest binary, group_size bigint, "
         "keep_chars bigint, keep_null boolean, keep_id bigint, keep_copy int")
BATCH = "shard int, digest binary, group_size bigint, keep_chars bigint, keep_null boolean, keep_id bigint, keep_copy int"
FIELDS = ["digest", "group_size", "keep_chars", "keep_null", "keep_id", "keep_copy"]
SLOTS, MAX_KICKS = 4, 200


class CuckooFilter:
    """A set of digests, approximately: 16-bit fingerprints, four to a bucket, each in one of two buckets."""

    def __init__(self, buckets: int, table: np.ndarray | None = None):
        self.buckets = buckets  # a power of two
        self.table = np.zeros((buckets, SLOTS), np.uint16) if table is None else table
        self.seed = 1

    @classmethod
    def sized(cls, keys: int) -> CuckooFilter:
        return cls(1 << max(4, math.ceil(math.log2(max(1, keys) / (SLOTS * 0.9)))))

    @classmethod
    def loaded(cls, state: bytes) -> CuckooFilter:
        table = np.frombuffer(state, np.uint16).reshape(-1, SLOTS).copy()
        return cls(len(table), table)

    def state(self) -> bytes:
        return self.table.tobytes()

    def places(self, digest: bytes) -> tuple[int, int, int]:
        mark = int.from_bytes(digest[8:10], "little") or 1
        first = int.from_bytes(digest[10:18], "little") & (self.buckets - 1)
        return mark, first, self.other(first, mark)

    def other(self, bucket: int, mark: int) -> int:
        return bucket ^ ((mark * 0x9E3779B1) & (self.buckets - 1))

    def __contains__(self, digest: bytes) -> bool:
        mark, first, second = self.places(digest)
        return mark in self.table[first].tolist() or mark in self.table[second].tolist()

    def put(self, mark: int, bucket: int) -> bool:
        free = np.flatnonzero(self.table[bucket] == 0)
        if len(free):
            self.table[bucket, free[0]] = mark
        return len(free) > 0

    def add(self, digest: bytes) -> bool:
        """False if no place was found; the filter must then be made anew from the keys."""
        mark, first, second = self.places(digest)
        if self.put(mark, first) or self.put(mark, second):
            return True
        bucket = second
        for _ in range(MAX_KICKS):
            self.seed = (self.seed * 1103515245 + 12345) & 0x7FFFFFFF
            slot = (self.seed >> 16) % SLOTS
            mark, self.table[bucket, slot] = int(self.table[bucket, slot]), mark
            bucket = self.other(bucket, mark)
            if self.put(mark, bucket):
                return True
        return False

    def remove(self, digest: bytes) -> None:
        mark, first, second = self.places(digest)
        for bucket in (first, second):
            held = np.flatnonzero(self.table[bucket] == mark)
            if len(held):
                self.table[bucket, held[0]] = 0
                return


class Shard:
    """One shard in memory: the filter, and the live digests by bucket."""

    def __init__(self, rows: pd.DataFrame):
        state = rows["filter"].dropna()
        self.content: dict[int, dict[bytes, list]] = {}
        self.size = 0
        live = rows[rows["digest"].notna()]
        self.filter = CuckooFilter.loaded(state.iloc[0]) if len(state) else CuckooFilter.sized(1)
        for row in live[FIELDS].itertuples(index=False):
            self.bucket(row.digest)[row.digest] = list(row[1:])
            self.size += 1

    def bucket(self, digest: bytes) -> dict[bytes, list]:
        return self.content.setdefault(self.filter.places(digest)[1], {})

    def known(self, digest: bytes) -> bool:
        return digest in self.filter and digest in self.bucket(digest)

    def insert(self, digest: bytes, values: list) -> None:
        if self.known(digest):
            held = self.bucket(digest)[digest]
            total = held[0] + values[0]
            best = min(held, values, key=lambda v: (-v[1], v[2], v[3] if not v[2] else 0, v[4]))
            self.bucket(digest)[digest] = [total, *best[1:]]
            return
        self.bucket(digest)[digest] = values
        self.size += 1
        if not self.filter.add(digest):
            self.resize(self.filter.buckets * 2)

    def delete(self, digest: bytes) -> None:
        if self.known(digest):
            del self.bucket(digest)[digest]
            self.filter.remove(digest)
            self.size -= 1

    def resize(self, buckets: int) -> None:
        keys = [(d, v) for held in self.content.values() for d, v in held.items()]
        while True:
            self.filter, self.content = CuckooFilter(buckets), {}
            for digest, values in keys:
                self.bucket(digest)[digest] = values
            if all(self.filter.add(digest) for digest, _ in keys):
                return
            buckets *= 2

    def rows(self, shard: int) -> pd.DataFrame:
        out = [(shard, self.filter.state(), None, None, None, None, None, None, None)]
        out += [(shard, None, b, d, *v) for b, held in self.content.items() for d, v in held.items()]
        frame = pd.DataFrame(out, columns=["shard", "filter", "bucket", *FIELDS])
        return frame.astype({"bucket": "Int32", "group_size": "Int64", "keep_chars": "Int64", "keep_null": "boolean",
                             "keep_id": "Int64", "keep_copy": "Int32"})


def normalized(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", "")


def row_hash(docs: DataFrame) -> Column:
    """A hash of whole rows; nulls, which hashes skip, are told apart by flags."""
    values = [F.to_json(F.struct(f"`{f.name}`")) if "map<" in f.dataType.simpleString() else F.col(f"`{f.name}`") for f in docs.schema]
    return F.xxhash64(*values, *[F.col(f"`{c}`").isNull() for c in docs.columns])


def digests(docs: DataFrame, *ties: Column) -> DataFrame:
    """Written once: doc_id, digest, n_chars, and copy, which numbers repeated rows: the longest first, then by ``ties``."""
    rows = docs.select(
        "doc_id", F.unhex(F.sha2(normalized(F.col("text")), 256)).alias("digest"),
        F.length(F.coalesce("text", F.lit(""))).cast("bigint").alias("n_chars"), *ties,
    )
    again = Window.partitionBy("doc_id", "digest").orderBy(F.col("n_chars").desc(), *rows.columns[3:])
    return materialize(rows.withColumn("copy", F.row_number().over(again)), "digests")


def arrivals(rows: DataFrame, shards: int) -> DataFrame:
    """The rows of a batch, reduced to at most ``ARRIVALS`` per digest, with the best row of each."""
    best = F.struct((-F.col("n_chars")).alias("less"), F.col("doc_id").isNull().alias("keep_null"),
                    F.col("doc_id").alias("keep_id"), F.col("copy").alias("keep_copy"))
    return rows.groupBy("digest", F.pmod(F.xxhash64("doc_id", "copy"), F.lit(ARRIVALS)).alias("lot")).agg(
        F.count("*").alias("group_size"), F.min(best).alias("best")
    ).select(
        F.pmod(F.xxhash64("digest"), F.lit(shards)).cast("int").alias("shard"), "digest", "group_size",
        (-F.col("best.less")).alias("keep_chars"), "best.keep_null", "best.keep_id", "best.keep_copy",
    )


def shards_for(rows: DataFrame) -> int:
    return max(1, math.ceil(rows.count() / SHARD_DIGESTS))


def values_of(batch: pd.DataFrame) -> Iterable[tuple[bytes, list]]:
    for digest, size, chars, null, keep, copy in batch[FIELDS].itertuples(index=False, name=None):
        yield digest, [int(size), int(chars), bool(null), None if null else int(keep), int(copy)]


def insert(batch: DataFrame, index: DataFrame | None = None) -> DataFrame:
    """The index with a batch of ``arrivals`` put in; a new index if there is none."""
    if index is None:
        index = batch.sparkSession.createDataFrame([], INDEX)

    def put(key, held: pd.DataFrame, new: pd.DataFrame) -> pd.DataFrame:
        shard = Shard(held)
        for digest, values in values_of(new):
            shard.insert(digest, values)
        return shard.rows(int(key[0]))

    return index.groupBy("shard").cogroup(batch.groupBy("shard")).applyInPandas(put, INDEX)


def delete(batch: DataFrame, index: DataFrame) -> DataFrame:
    """The index without the digests of a batch of ``arrivals``."""
    def drop(key, held: pd.DataFrame, gone: pd.DataFrame) -> pd.DataFrame:
        shard = Shard(held)
        for digest in gone["digest"].unique():
            shard.delete(digest)
        return shard.rows(int(key[0]))

    return index.groupBy("shard").cogroup(batch.groupBy("shard")).applyInPandas(drop, INDEX)


def live(index: DataFrame) -> DataFrame:
    """The digests in the index: size of the group and the row that stays."""
    return index.where(F.col("digest").isNotNull()).select("digest", "group_size", "keep_id", "keep_copy")


def judged(rows: DataFrame) -> DataFrame:
    """``digests`` with keep_id, group_size and kept."""
    index = insert(arrivals(rows, shards_for(rows)))
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == F.col("keep_copy"))
    return rows.join(live(index), "digest").withColumn("kept", kept)


def dedup(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: keep_id, group_size, kept and the digest."""
    return judged(digests(docs)).select(
        "doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"),
    )


def keep_first(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows that ``dedup`` drops, all columns kept.

    Rows of one doc_id and length that differ elsewhere are taken in the order of their hashes, so that a retry keeps the same one;
    only rows that agree in every column are left to choose from. All of this is settled on keys. The texts are shuffled here, to
    join them by doc_id and hashes, so a large group of copies is spread over all tasks.
    """
    from hiregrid.llm.support import fresh

    stay = judged(digests(docs, row_hash(docs).alias("row"))).where("kept").select(
        F.col("doc_id").alias("_keep_id"), F.col("digest").alias("_keep_digest"), F.col("row").alias("_keep_row"))
    mark, row = fresh("digest", docs), fresh("row", docs)
    marked = docs.withColumns({mark: F.unhex(F.sha2(normalized(F.col("text")), 256)), row: row_hash(docs)})
    same = (marked["doc_id"].eqNullSafe(stay["_keep_id"]) & (marked[mark] == stay["_keep_digest"])
            & (marked[row] == stay["_keep_row"]))
    return marked.join(stay, same, "left_semi").dropDuplicates(["doc_id", mark, row]).drop(mark, row)
