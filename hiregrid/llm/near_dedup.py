"""MinHash near-dedup with tensored banding.

A document's set holds the hashes of its distinct five-word shingles. Two small collections of ``TABLES`` sub-hashes are
computed, each sub-hash over ``ROWS`` minima. A table key is a pair of one sub-hash of each collection, so that 2 * TABLES
sub-hashes give TABLES * TABLES keys of 2 * ROWS minima each, and only a square root of the minima is computed. A sub-hash
that no other text has can be part of no shared key; pairs are formed of the shared ones only.

Texts with equal sets are one class. Two classes are candidates if they share a key, and linked if, besides, their full sets are
similar enough: both follow from the pair alone, however large a group it is part of. Components of the links are the duplicates;
the smallest doc_id of each stays. Comparing goes in two steps, since of a group of many copies most links settle nothing new:

* Every class is compared with the least of the classes it shares a key with. Those links make components.
* Keys that hold classes of several components are still open. Their classes are compared, only where components differ. A group
  connected by open keys that is small enough (by the work of comparing it) is one unit, a larger one is cut into a grid of blocks
  with a unit for each two; one too large for that has a unit for each left sub-hash, cut in the same way where it is hot. A pair
  agrees in sub-hashes of both collections exactly if it shares a key. By sub-hash it is compared in the unit of the first left one
  it agrees in, so once in any case. A unit returns a forest over its links.

Two sets of similarity 0.75 share no key with a chance of 4e-6 (0.4375^16 for each collection), of 0.8 with 2e-7; everything
after the keys is exact, on 64-bit hashes of shingles. Nothing is capped or sampled, and ``work`` and ``total`` decide only where pairs
are compared.

Defined results: null or empty text has an empty set, is linked with nothing and its own component; fewer than five words are
one shingle; rows that repeat a doc_id are one node of the graph; a null doc_id has a null component and stays. An empty
table gives no row. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hiregrid.llm.components import connected_components
from hiregrid.llm.hashing import Words, mix, window_hashes
from hiregrid.llm.support import WHITE, fresh, word_table
from hiregrid.session import materialize

SHINGLE = 5
PERCENT = 75
TABLES, ROWS = 16, 2
# Work of a unit: members times shingles in all, and shingles in all (8 bytes each).
UNIT_WORK, UNIT_SHINGLES = 20_000_000, 4_000_000
GROUP_BLOCKS = 16  # blocks that a group is cut into before it is taken apart by sub-hash; as many as there are left sub-hashes
TABLE = word_table(WHITE)
LONGS = T.ArrayType(T.LongType())
SKETCH = (T.StructType().add("n", T.LongType()).add("low", T.LongType()).add("high", T.LongType()).add("left", LONGS).add("right", LONGS))
SKETCH_ARROW = pa.struct([("n", pa.int64()), ("low", pa.int64()), ("high", pa.int64()),
                          ("left", pa.list_(pa.int64())), ("right", pa.list_(pa.int64()))])
SEEDS = 2 * TABLES * ROWS


def shingles(text: bytes | None) -> np.ndarray:
    """The distinct shingles of a text as sorted hashes."""
    if not text:
        return np.zeros(0, np.uint64)
    words = Words(text, TABLE).hashes
    return np.unique(window_hashes(words, min(SHINGLE, len(words)))) if len(words) else words


def minima(hashes: np.ndarray) -> np.ndarray:
    """The least value of a set under each of ``SEEDS`` hash functions, a block of the set at a time."""
    multipliers = mix(np.arange(1, SEEDS + 1, dtype=np.uint64), 3) | np.uint64(1)
    least = np.full(SEEDS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 4096):
        part = hashes[at:at + 4096]
        folded = part[None, :] * multipliers[:, None]
        folded ^= folded >> np.uint64(29)
        folded *= np.uint64(0xBF58476D1CE4E5B9)
        np.minimum(least, folded.min(axis=1), out=least)
    return least


def sketch(text: bytes | None) -> dict:
    held = shingles(text)
    if not len(held):
        return {"n": 0, "low": 0, "high": 0, "left": [], "right": []}
    least = mix(minima(held)).reshape(2, TABLES, ROWS)
    weights = mix(np.arange(11, 11 + ROWS, dtype=np.uint64)) | np.uint64(1)
    sub = mix((least * weights).sum(axis=2, dtype=np.uint64)).view(np.int64)
    digest = [int(mix(held, seed).sum(dtype=np.uint64).view(np.int64)) for seed in (21, 22)]
    return {"n": len(held), "low": digest[0], "high": digest[1], "left": sub[0].tolist(), "right": sub[1].tolist()}


@F.arrow_udf(SKETCH)
def sketches(texts: pa.Array) -> pa.Array:
    return pa.array([sketch(t.as_py()) for t in texts.cast(pa.binary())], SKETCH_ARROW)


@F.arrow_udf(LONGS)
def shingle_sets(texts: pa.Array) -> pa.Array:
    held = [shingles(t.as_py()).view(np.int64) for t in texts.cast(pa.binary())]
    offsets = np.concatenate(([0], np.cumsum([len(h) for h in held]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(held) if held else np.zeros(0, np.int64)))


class Forest:
    """Union-find over the members of a unit."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        self.up[max(x, y)] = min(x, y)
        return x != y


def links(
    sets: list[np.ndarray], sides: np.ndarray, left: np.ndarray, right: np.ndarray, labels: np.ndarray, place: int,
) -> Iterator[tuple[int, int]]:
    """Links between members of different labels that share a key and whose sets are similar enough, until all that can be are joined.

    Members that are joined already, through others too, are not compared. Of blocks 0 and 1 of a grid pairs are formed only
    across; with a ``place`` only those whose first equal left sub-hash is there.
    """
    forest = Forest(len(sets))
    heads: dict[int, int] = {}
    for x, label in enumerate(labels.tolist()):
        forest.join(heads.setdefault(label, x), x)
    across = sides.min() != sides.max()
    for x in range(len(sets) - 1):
        equal = left[x + 1:] == left[x]
        candidate = equal.any(axis=1) & (right[x + 1:] == right[x]).any(axis=1) & (labels[x + 1:] != labels[x])
        if place >= 0:
            candidate &= equal.argmax(axis=1) == place
        if across:
            candidate &= sides[x + 1:] != sides[x]
        for y in (x + 1 + np.flatnonzero(candidate)).tolist():
            if forest.root(x) == forest.root(y):
                continue
            n, m = len(sets[x]), len(sets[y])
            if 100 * min(n, m) < PERCENT * max(n, m):
                continue
            shared = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
            if 100 * shared >= PERCENT * (n + m - shared):
                forest.join(x, y)
                yield x, y


def unit_links(members: pd.DataFrame) -> pd.DataFrame:
    members = members.sort_values("id")
    sets = [np.asarray(s, np.int64) for s in members["shingles"]]
    ids = members["id"].to_numpy()
    left, right = (np.array(members[c].tolist(), np.int64).reshape(len(ids), -1) for c in ("left", "right"))
    place = members["unit"].iloc[0]["place"]
    found = links(sets, members["side"].to_numpy(), left, right, members["label"].to_numpy(), place)
    return pd.DataFrame([(ids[x], ids[y]) for x, y in found], columns=["a", "b"], dtype=np.int64)


def shared_keys(rows: DataFrame, key: list[str]) -> DataFrame:
    """Of ``rows(key…, id)`` those whose key another id has, with the least id of the key as ``first``."""
    keys = rows.groupBy(*key).agg(F.min("id").alias("first"), F.max("id").alias("_most")).where(F.col("first") < F.col("_most"))
    # Written, so that the join reads two shuffles and a key that very many rows have can be split.
    return rows.join(materialize(keys.drop("_most"), "shared-keys"), key)


def table_keys(classes: DataFrame) -> DataFrame:
    """``classes(id, left, right)`` to rows (key, id, first) of the table keys that several classes share."""
    sub = classes.select("id", F.explode(F.concat(
        F.transform("left", lambda h, i: F.struct(F.lit(0).alias("side"), i.alias("place"), h.alias("hash"))),
        F.transform("right", lambda h, i: F.struct(F.lit(1).alias("side"), i.alias("place"), h.alias("hash"))),
    )).alias("s")).select("id", F.xxhash64("s.side", "s.place", "s.hash").alias("sub"), "s.side")
    kept = shared_keys(sub, ["sub"]).groupBy("id").agg(
        F.collect_list(F.when(F.col("side") == 0, F.col("sub"))).alias("left"),
        F.collect_list(F.when(F.col("side") == 1, F.col("sub"))).alias("right"),
    )
    pairs = F.flatten(F.transform("left", lambda a: F.transform("right", lambda b: F.xxhash64(a, b))))
    return materialize(shared_keys(kept.select("id", F.explode(pairs).alias("key")), ["key"]), "table-keys")


def candidate_links(keys: DataFrame) -> DataFrame:
    """Links (a, b) with the components of ``keys(key, id, first)``, where an id is linked with the first of each of its keys.

    An id has up to TABLES * TABLES firsts. All of them, and the id, are linked with its least first instead: the ids of a
    group mostly agree on that one, so the distinct links are about one for each id and each first, not one for each of their pairs.
    """
    firsts = keys.groupBy("id").agg(F.min("first").alias("b"), F.collect_set("first").alias("firsts"))
    return firsts.select(F.explode(F.array_append("firsts", F.col("id"))).alias("a"), "b").where("a <> b").distinct()


def star_links(keys: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) between each id and the least ``first`` of its keys, if their sets are similar enough."""
    star = keys.groupBy("id").agg(F.min("first").alias("b")).where("id <> b").withColumnRenamed("id", "a")
    ours, theirs = (sets.select(F.col("id").alias(c), F.col("shingles").alias(f"{c}_set")) for c in ("a", "b"))
    shared = F.size(F.array_intersect("a_set", "b_set"))
    alike = 100 * F.col("shared") >= PERCENT * (F.size("a_set") + F.size("b_set") - F.col("shared"))
    # One class may be the least of very many: both sides of its join are shuffles, which are split where they are skewed.
    return materialize(star.join(ours, "a").join(theirs, "b").withColumn("shared", shared).where(alike).select("a", "b"), "star-links")


def open_keys(keys: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows (key, id, first, label) of the keys whose ids have different labels; the label of an unlinked id is itself."""
    rows = keys.select("key", "id").join(labels.select(F.col("node").alias("id"), "component"), "id", "left").select(
        "key", "id", F.coalesce("component", "id").alias("label"))
    still = rows.groupBy("key").agg(F.min("id").alias("first"), F.min("label").alias("_least"), F.max("label").alias("_most"))
    return materialize(rows.join(materialize(still.where("_least < _most").select("key", "first"), "still-open"), "key"), "open-keys")


def units(rows: DataFrame, classes: DataFrame, work: int, total: int) -> DataFrame:
    """Where the candidates in ``rows(key, id, first, label)`` are compared: (unit, side, id, label, left, right).

    A group is cut into blocks so that two of them are within the limits, and each pair of blocks is a unit; a group within the
    limits is one block. Of a group of more than ``GROUP_BLOCKS`` every left sub-hash that ids of several labels have is cut
    in this way instead.
    """
    groups = connected_components(candidate_links(rows))
    members = materialize(groups.withColumnRenamed("node", "id").join(rows.select("id", "label").distinct(), "id").join(
        classes.select("id", F.col("n").alias("size"), "left", "right"), "id"), "members")
    cost = F.col("n") * F.col("all")
    within = (cost <= work) & (F.col("all") <= total)
    parts = F.least(F.ceil(F.greatest(2 * F.sqrt(cost / work), 2 * F.col("all") / total, F.lit(1.0))), F.col("n")).cast("int")
    measure = (F.count("*").alias("n"), F.sum("size").alias("all"))
    parted = F.when(within, 1).otherwise(parts).alias("parts")
    measured = materialize(members.groupBy("component").agg(*measure).select("component", parted), "measured")
    by_group = members.join(measured.where(F.col("parts") <= GROUP_BLOCKS), "component").select(
        F.lit(-1).alias("place"), F.col("component").alias("hash"), "parts", "id", "label", "left", "right")
    hashes = members.join(measured.where(F.col("parts") > GROUP_BLOCKS).select("component"), "component").select(
        "id", "size", "label", "left", "right", F.posexplode("left").alias("place", "hash"))
    open_hashes = hashes.groupBy("place", "hash").agg(*measure, F.min("label").alias("_least"), F.max("label").alias("_most")).where(
        "_least < _most").select("place", "hash", parted)
    by_hash = hashes.join(materialize(open_hashes, "open-hashes"), ["place", "hash"]).select(*by_group.columns)
    cut = by_group.unionByName(by_hash).withColumn("block", F.pmod(F.xxhash64("id", "hash"), F.col("parts")).cast("int"))
    return cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(
        F.struct("place", F.col("hash").alias("key"), F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y")).alias("unit"),
        (F.col("block") > F.col("other")).cast("int").alias("side"), "id", "label", "left", "right",
    )


def near_links(docs: DataFrame, classes: DataFrame, work: int = UNIT_WORK, total: int = UNIT_SHINGLES) -> DataFrame:
    """Links (a, b) between ``classes(id, part, n, left, right)`` whose sets are similar enough; enough of them to give all components."""
    keys = table_keys(classes.where("n > 0").select("id", "left", "right"))
    wanted = keys.select("id").distinct().join(classes.select("id", "part"), "id").withColumnRenamed("part", "_part")
    texts = docs.join(wanted, (docs["doc_id"] == wanted["id"]) & (docs["part"] == wanted["_part"])).select(
        "id", shingle_sets(F.col("text")).alias("shingles"))
    # Rows that repeat a doc_id and its text are one class.
    sets = materialize(texts.groupBy("id").agg(F.any_value("shingles").alias("shingles")), "shingles")
    star = star_links(keys, sets)
    rest = open_keys(keys, connected_components(star))
    if rest.isEmpty():
        return star
    where = materialize(units(rest, classes, work, total), "units")
    found = where.join(sets, "id").groupBy("unit").applyInPandas(unit_links, "a bigint, b bigint")
    return materialize(star.unionByName(found), "near-links")


def components(docs: DataFrame, work: int = UNIT_WORK, total: int = UNIT_SHINGLES) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: n_shingles, component_id and kept."""
    texts = docs.select("doc_id", F.xxhash64("text").alias("part"), "text")
    rows = materialize(texts.select("doc_id", "part", sketches(F.col("text")).alias("s")).select("doc_id", "part", "s.*"), "sketches")
    # A class is named by its smallest doc_id; part tells rows of one doc_id apart.
    named = rows.where(F.col("doc_id").isNotNull() & (F.col("n") > 0))
    classes = materialize(named.groupBy("low", "high", "n").agg(
        F.min(F.struct("doc_id", "part")).alias("first"), F.any_value("left").alias("left"), F.any_value("right").alias("right"),
    ).select("low", "high", "n", F.col("first.doc_id").alias("id"), F.col("first.part").alias("part"), "left", "right"), "classes")
    near = near_links(texts, classes, work, total)
    # Copies of a class, and rows that share a doc_id, are linked through their smallest doc_id.
    copies = named.join(classes.select("low", "high", "n", "id"), ["low", "high", "n"]).where("doc_id <> id").select(
        F.col("id").alias("a"), F.col("doc_id").alias("b"))
    found = connected_components(near.unionByName(copies))
    component = F.coalesce("component", "doc_id")
    return rows.join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"),
    )


def keep_first(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows whose component has a smaller doc_id, all columns kept."""
    name = fresh("gone", docs)
    gone = components(docs).where(~F.col("kept")).select(F.col("doc_id").alias(name)).distinct()
    return docs.join(gone, F.col("doc_id") == F.col(name), "left_anti")
