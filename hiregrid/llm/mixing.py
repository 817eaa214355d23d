"""Mixing sources to target weights by pivotal dependent rounding.

Every source gets a target of words; the target over the source's size is the number of copies a document should have. Whole
copies are taken as they are. Of what is left, a fraction between 0 and 1 per document, two documents at a time play for their
sum: if it is below 1 one of them takes all and the other nothing, else one gets a whole copy and the other the rest, each with
the chance that keeps its expectation. One of the two is then settled, so the sum of copies of a source never moves by more
than the last residual.

The games run as a reduction tree. Leaves are put into blocks by source, size class and hash; a block plays its games in one
fold over a bounded array and hands one residual up; each level joins ``FAN_IN`` blocks of the level below, until one residual
per source is left, which a coin settles. Since blocks hold documents of similar size, mass moves between similar sizes and
the words taken come near the target. A source that holds a third of all rows is many blocks. Coins are hashes of doc_id and
seed, so reruns agree. Everything is DataFrame expressions; each level is written under ``spark.checkpoint.dir``.

Defined results: null or empty text has size 0; a source of size 0 has target 0; a null source is a source of its own, last in
order; rows with equal doc_id, source and size are one unit of the tree, whose copies are dealt out evenly over its rows; an
empty table gives no row; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hiregrid.operators.ranking import number_rows
from hiregrid.session import materialize

FAN_IN = 64  # residuals that meet in one block
BLOCK = 32  # leaves per block on average
CLASSES = 8  # size classes per doubling of the size
EPSILON = 1e-9
MAX_COPIES = 2


def count_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint")


def targets(sizes: DataFrame, share: float, weights: tuple[int, ...], most: int = MAX_COPIES) -> DataFrame:
    """``sizes(source, source_size)`` with the target of each source.

    ``share`` of all words by weight, no target above ``most`` times its source; what is above goes to the others by weight.
    The level at which sources fill up is found from sums alone, a few rounds over the table of sources.
    """
    ordered = number_rows(
        sizes.withColumns({"_all": F.lit(1), "_last": F.col("source").isNull()}), ["_all"],
        [F.col("_last").asc(), F.col("source").asc()], "_n",
    )
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("_n") - 1, F.lit(len(weights))) + 1).cast("int"))
    table = materialize(ordered.select("source", "source_size", weight.cast("bigint").alias("weight")), "sources")
    cap = most * F.col("source_size")
    total = share * (table.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0])
    level, full = 0.0, -1
    while True:
        over = F.lit(level) * F.col("weight") > cap
        capped, n, rest = table.agg(
            F.coalesce(F.sum(F.when(over, cap)), F.lit(0)), F.count(F.when(over, 1)),
            F.coalesce(F.sum(F.when(~over, F.col("weight"))), F.lit(0)),
        ).first()
        if n == full or not rest:
            break
        level, full = (total - capped) / rest, n
    return table.select(
        "source", "source_size", F.least(F.lit(float(level)) * F.col("weight"), cap.cast("double")).alias("target")
    )


def coin(*columns: Column | str) -> Column:
    """A number in [0, 1) that the columns fix."""
    return F.shiftrightunsigned(F.xxhash64(*columns), 11).cast("double") / F.lit(float(1 << 53))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def tidy(part: Column) -> Column:
    return F.when(part < EPSILON, 0.0).when(part > 1 - EPSILON, 1.0).otherwise(part)


def duel(a: Column, b: Column, seed: int) -> Column:
    """Two units with fractions in (0, 1): the settled one (with bit) and the one that carries the rest."""
    def result(won: Column) -> Column:
        # Below 1 the winner carries the sum and the loser gets nothing; else the winner gets a copy and the loser carries the rest.
        below = won["both"] < 1
        a_settled = won["first"] != below
        return F.struct(
            F.when(a_settled, a).otherwise(b).alias("unit"), F.when(below, 0).otherwise(1).alias("bit"),
            F.when(a_settled, b).otherwise(a).withField("part", tidy(F.when(below, won["both"]).otherwise(won["both"] - 1))).alias("carry"),
        )

    def decided(game: Column) -> Column:
        both, u = game["both"], game["u"]
        first = F.when(both < 1, u * both < a["part"]).otherwise(u * (2 - both) < 1 - b["part"])
        return let(F.struct(both.alias("both"), first.alias("first")), result)

    return let(F.struct((a["part"] + b["part"]).alias("both"), coin(F.lit(seed), a["unit"], b["unit"]).alias("u")), decided)


def play(units: Column, seed: int) -> Column:
    """All games of a block: the settled units with their bits, and the one left over."""
    def step(state: Column, unit: Column) -> Column:
        # A carried fraction that became whole is settled by itself.
        carry = state["carry"]
        whole = (carry["part"] <= 0) | (carry["part"] >= 1)
        alone = F.struct(carry.alias("unit"), F.round(carry["part"]).cast("int").alias("bit"), unit.alias("carry"))
        return let(F.when(whole, alone).otherwise(duel(carry, unit, seed)), lambda game: F.struct(
            F.concat(state["settled"], F.array(F.struct(game["unit"].alias("unit"), game["bit"].alias("bit")))).alias("settled"),
            game["carry"].alias("carry"),
        ))

    first = F.get(units, F.lit(0))
    none = F.filter(F.array(F.struct(first.alias("unit"), F.lit(0).alias("bit"))), lambda s: F.lit(False))
    start = F.struct(none.alias("settled"), first.alias("carry"))
    return F.aggregate(F.slice(units, F.lit(2), F.size(units)), start, step)


def round_copies(leaves: DataFrame, seed: int = 17) -> DataFrame:
    """``leaves(group, size, unit, part, …)`` with bit 0 or 1 for each.

    ``unit`` names a leaf and fixes its coins; ``part`` is its fraction in [0, 1]. Per group the bits add up to the parts, but
    for the last residual.
    """
    rest = [c for c in leaves.columns if c not in ("group", "part")]
    leaf = F.struct(*[c for c in rest], "part")
    stored = materialize(leaves.select(
        "group", F.floor(F.log2(F.col("size") + 1) * CLASSES).cast("int").alias("class"), leaf.alias("leaf")
    ), "leaves")
    whole = (F.col("leaf.part") <= EPSILON) | (F.col("leaf.part") >= 1 - EPSILON)
    settled = [stored.where(whole).select("group", "leaf", F.round("leaf.part").cast("int").alias("bit"))]
    bits = max(0, math.ceil(math.log2(max(1, stored.count() / BLOCK))))
    block = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "leaf.unit"), 64 - bits) if bits else F.lit(0).cast("bigint")
    level = stored.where(~whole).withColumn("block", block)
    step = int(math.log2(FAN_IN))
    keys, round_no = ["group", "class", "block"], 0
    while True:
        last = "class" not in keys
        units = F.array_sort(F.collect_list(F.struct(F.col("leaf.size").alias("_order"), F.col("leaf"))))["leaf"]
        played = level.groupBy(*keys).agg(units.alias("units")).select(*keys, play(F.col("units"), seed + round_no).alias("p"))
        played = materialize(played, "games")
        settled.append(played.select("group", F.inline("p.settled")).select("group", F.col("unit").alias("leaf"), "bit"))
        left = played.select(*keys, F.col("p.carry").alias("leaf"))
        if last:
            part = F.col("leaf.part")
            settled.append(left.select("group", "leaf", (coin(F.lit(seed - 1), "leaf.unit") < part).cast("int").alias("bit")))
            break
        bits, round_no = max(0, bits - step), round_no + 1
        if played.where(F.col("block") > 0).isEmpty():
            keys = ["group"]  # one residual per size class: they meet last
            level = left.select("group", "leaf")
        else:
            level = left.withColumn("block", F.shiftright("block", step))
    out = settled[0]
    for part in settled[1:]:
        out = out.unionByName(part)
    return out.select("group", *[F.col(f"leaf.{c}").alias(c) for c in rest], "bit")


def mix(docs: DataFrame, share: float = 1.5, weights: tuple[int, ...] = (5, 2, 1), seed: int = 17) -> DataFrame:
    """One row per row of ``docs(doc_id, text, source)``: size, source_size, target, copies and words taken."""
    units = materialize(
        docs.select("doc_id", "source", count_words(F.col("text")).alias("size")).groupBy("doc_id", "source", "size").agg(
            F.count("*").alias("rows")), "units",
    )
    sizes = units.groupBy("source").agg(F.sum(F.col("size") * F.col("rows")).alias("source_size"))
    aims = targets(sizes, share, weights).withColumnRenamed("source", "_source")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    wanted = units.join(aims, units["source"].eqNullSafe(aims["_source"])).drop("_source").withColumn("_wanted", F.col("rows") * rate)
    base = F.floor(F.col("_wanted") + EPSILON)
    leaves = wanted.select(
        F.col("source").alias("group"), "size", F.xxhash64("doc_id", "size").alias("unit"),
        F.greatest(F.col("_wanted") - base, F.lit(0.0)).alias("part"),
        "doc_id", "rows", "source_size", "target", base.cast("bigint").alias("base"),
    )
    done = round_copies(leaves, seed).withColumn("_copies", F.col("base") + F.col("bit"))
    # The copies of a unit of several equal rows, dealt out over them.
    row = F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("rows")))
    return done.withColumn("_row", row).select(
        "doc_id", F.col("group").alias("source"), "size", "source_size", "target",
        (F.floor(F.col("_copies") / F.col("rows")) + (F.col("_row") <= F.pmod("_copies", "rows")).cast("int"))
        .cast("bigint").alias("copies"),
    ).withColumn("taken", F.col("copies") * F.col("size"))
