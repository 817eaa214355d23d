"""What several operators need: free column names, bounded blocks of a side input, byte tables."""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from hiregrid.session import materialize

# A side input is brought to every task in blocks of at most so many rows and bytes.
BLOCK_ROWS = 500_000
BLOCK_BYTES = 32 << 20

UPPER, LOWER = bytes(range(65, 91)), bytes(range(97, 123))
WHITE = b" \t\n\x0b\x0c\r"


def fresh(name: str, *frames: DataFrame) -> str:
    """``name``, with underscores in front until no frame has such a column."""
    taken = {column.lower() for frame in frames for column in frame.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def blocks(side: DataFrame, size: Column, rows: int = BLOCK_ROWS, size_limit: int = BLOCK_BYTES) -> Iterator[list[Row]]:
    """The rows of ``side`` on the driver, block after block, none much beyond the limits.

    The side is written once and measured by one aggregate; every row comes in exactly one block.
    """
    side = materialize(side, "side")
    n, total = side.agg(F.count("*"), F.coalesce(F.sum(size), F.lit(0))).first()
    parts = max(math.ceil(n / rows), math.ceil(total / size_limit), 1)
    if parts == 1:
        yield side.collect()
        return
    key = F.pmod(F.xxhash64(*side.columns), F.lit(parts))
    for part in range(parts):
        yield side.where(key == part).collect()


def word_table(separators: bytes) -> bytes:
    """A table for ``bytes.translate``: separators to a space, A-Z to lower case."""
    table = bytearray(range(256))
    for upper, lower in zip(UPPER, LOWER):
        table[upper] = lower
    for byte in separators:
        table[byte] = 32
    return bytes(table)
