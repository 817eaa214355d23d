"""Joins whose strategy follows measured sizes and key frequencies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hiregrid.operators.measured import Written, write_measured

BROADCAST_ROWS = 1_000_000
BROADCAST_BYTES = 64 << 20
TASK_PAIRS = 2_000_000
NULL_SALTS = 64


def fits_broadcast(df: DataFrame | Written, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> bool:
    """Whether ``df`` is small enough for every executor, by counting it.

    What was measured when it was written is not counted again. Of anything else
    rows come first, which for a stored table is metadata; only few rows are then
    measured, text form standing in for the in-memory size.
    """
    if isinstance(df, Written):
        return df.rows <= max_rows and df.bytes <= max_bytes
    if df.count() > max_rows:
        return False
    size = F.coalesce(F.sum(F.length(F.to_json(F.struct("*")))), F.lit(0))
    return df.agg(size).first()[0] <= max_bytes


def join_on_key(
    left: DataFrame,
    right: DataFrame,
    on: str,
    how: str = "inner",
    *,
    row_key: str,
    broadcast: bool | None = None,
    task_pairs: int | None = TASK_PAIRS,
) -> DataFrame:
    """Equi-join of a large ``left``, whose keys may repeat without limit, with ``right``.

    A small ``right`` is broadcast, so ``left`` is not shuffled. Otherwise a key
    with more than ``task_pairs`` pairs, rows of ``left`` times rows of
    ``right``, is spread by ``row_key`` over as many tasks as bring each below
    that, and only its rows in ``right`` are copied; null keys of ``left`` match
    nothing and are spread too. ``task_pairs`` is None when the keys of ``left``
    are known to be unique. ``how`` is 'inner' or 'left'.
    """
    if fits_broadcast(right) if broadcast is None else broadcast:
        return left.join(F.broadcast(right), on, how)
    if task_pairs is None:
        return left.join(right, on, how)

    rows, partners = left.groupBy(on).agg(F.count("*").alias("_n")), right.groupBy(on).agg(F.count("*").alias("_m"))
    pairs = F.col("_n").cast("double") * F.coalesce("_m", F.lit(1))
    salts = F.least(F.ceil(pairs / task_pairs), F.col("_n")).cast("int").alias("_salts")
    written = write_measured(rows.join(partners, on, "left").where(pairs > task_pairs).select(on, salts), "hot-keys")
    hot = F.broadcast(written.table) if fits_broadcast(written) else written.table
    spread = F.when(F.col(on).isNull(), F.lit(NULL_SALTS)).otherwise(F.coalesce("_salts", F.lit(1)))
    salted_left = left.join(hot, on, "left").withColumn("_salt", F.pmod(F.xxhash64(row_key), spread).cast("int")).drop("_salts")
    every = F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1)
    salted_right = right.join(hot, on, "left").withColumn("_salt", F.explode(every)).drop("_salts")
    return salted_left.join(salted_right, [on, "_salt"], how).drop("_salt")
