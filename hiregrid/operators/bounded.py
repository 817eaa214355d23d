"""Exact dense top-k that leaves out what can't be among the best.

Rows of the corpus, some square root of their number, serve as pivots; every row belongs to the cell of its nearest one. For a
query q, a pivot c and a row x of its cell, q·x = q·c + q·(x - c) is at most q·c + |q| r, with r the cell's greatest distance
|x - c|. A query first visits the cell whose pivot suits it best; the k-th score found there is a floor, and of the other cells
it visits those whose bound reaches it. Neighbouring cells travel in packs: a query goes once to each pack in which it visits a
cell and is scored against the whole pack, so its copies grow with the packs, not with the cells. Packs without a visitor stay
where they are, and a cell of many rows, as of equal vectors, is cut into parts.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hiregrid.session import materialize

if TYPE_CHECKING:
    import numpy as np
    import pyarrow as pa

PIVOTS = 4096  # at most, and
PIVOT_VALUES = 4_000_000  # so many numbers in them: they are copied to every task
SLICE_SCORES = 4_000_000  # scores a task holds at a time
STEP = 1e-6  # scores are rounded to 6 digits before they are ranked


@dataclass(frozen=True)
class Cells:
    """A corpus ``rows(id, vector, cell)`` cut around ``pivots``, with the size and radius of each cell."""

    rows: DataFrame
    pivots: np.ndarray
    sizes: np.ndarray
    radii: np.ndarray


def _arrays():
    """Helpers for tasks: the matrix of a list column, and bounded slices of batches."""

    def matrix(table):
        column = table.column("vector")
        array = column.combine_chunks() if hasattr(column, "combine_chunks") else column
        return array.flatten().to_numpy(zero_copy_only=False).astype("float64").reshape(len(array), -1)

    def slices(batches, width: int, limit: int = SLICE_SCORES):
        step = max(1, limit // max(1, width))
        for batch in batches:
            for start in range(0, batch.num_rows, step):
                yield batch.slice(start, step)

    return matrix, slices


def cut_into_cells(corpus: DataFrame, corpus_id: str, pivots: int | None = None) -> Cells | None:
    """``corpus(id, vector)`` in cells; None if it has no rows. Vectors have one length and no nulls.

    The pivots are the rows of the least hashes of their ids. They decide how much is left out, never what is found.
    """
    import numpy as np

    matrix, slices = _arrays()
    n = corpus.count()
    if not n:
        return None
    width = max(1, corpus.select(F.size("vector")).first()[0])
    wanted = max(1, min(pivots or math.isqrt(n - 1) + 1, PIVOTS, PIVOT_VALUES // width))
    chosen = matrix(corpus.orderBy(F.xxhash64(corpus_id), corpus_id).select("vector").limit(wanted).toArrow())
    half_squares = (chosen**2).sum(axis=1) / 2

    def nearest(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        import numpy as np
        import pyarrow as pa

        for part in slices(batches, max(chosen.shape)):
            x = matrix(part)
            cell = np.argmax(x @ chosen.T - half_squares, axis=1)
            distance = np.linalg.norm(x - chosen[cell], axis=1)
            yield pa.RecordBatch.from_arrays(
                [*part.columns, pa.array(cell, pa.int32()), pa.array(distance, pa.float64())], [*part.schema.names, "cell", "distance"])

    kept = corpus.select(corpus_id, "vector")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept.schema)
    rows = materialize(kept.mapInArrow(nearest, f"{schema}, cell int, distance double"), "cells")
    sizes, radii = np.zeros(len(chosen), dtype="int64"), np.zeros(len(chosen))
    for row in rows.groupBy("cell").agg(F.count("*").alias("n"), F.max("distance").alias("r")).collect():  # one row a pivot
        sizes[row["cell"]], radii[row["cell"]] = row["n"], row["r"]
    return Cells(rows.drop("distance"), chosen, sizes, radii)


def packed(cells: Cells, rows: int) -> np.ndarray:
    """The pack of each cell: neighbours together, of about ``rows`` rows unless one cell alone has more."""
    import numpy as np

    packs = max(1, -(-int(cells.sizes.sum()) // rows))
    heads = cells.pivots[:packs]
    near = np.argmax(cells.pivots @ heads.T - (heads**2).sum(axis=1) / 2, axis=1)
    pack_of, pack, held = np.zeros(len(cells.sizes), dtype="int64"), 0, 0
    for cell in np.argsort(near, kind="stable"):  # at most a step for each pivot
        if held and held + cells.sizes[cell] > rows:
            pack, held = pack + 1, 0
        pack_of[cell], held = pack, held + cells.sizes[cell]
    return pack_of


def visits(queries: DataFrame, cells: Cells, k: int, first: bool, pack_of: np.ndarray | None = None) -> DataFrame:
    """``queries(id, vector, …)`` once for each ``cell`` to visit, or for each pack that has such a cell.

    ``first`` asks for the one cell whose pivot has the best score, or for its whole pack. Otherwise it is the other cells whose bound reaches
    the floor: the query's ``floor``, null if it has none, or its k-th score among the pivots, which are rows too.
    """
    matrix, slices = _arrays()
    pivots, sizes, radii = cells.pivots, cells.sizes, cells.radii

    def choose(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        import numpy as np
        import pyarrow as pa

        reach = np.linalg.norm(pivots, axis=1) + radii
        for part in slices(batches, max(pivots.shape)):
            q = matrix(part)
            dots = q @ pivots.T
            best = np.argmax(np.where(sizes > 0, dots, -np.inf), axis=1)
            if first:
                query, cell = np.arange(len(q)), best
            else:
                floor = part.column("floor").to_numpy(zero_copy_only=False).astype("float64")
                floor = np.where(np.isnan(floor), -np.inf, floor)
                if len(pivots) >= k:
                    floor = np.maximum(floor, np.partition(dots, len(pivots) - k, axis=1)[:, len(pivots) - k])
                lengths = np.linalg.norm(q, axis=1)[:, None]
                # What rounding of scores and of the bound itself may add.
                bound = dots + lengths * radii + STEP + 1e-9 * lengths * reach
                open_ = (bound >= floor[:, None]) & (sizes > 0)
                open_[np.arange(len(q)), best] = False
                query, cell = np.nonzero(open_)
            if pack_of is not None:
                packs = int(pack_of.max()) + 1
                query, cell = np.divmod(np.unique(query * packs + pack_of[cell]), packs)
                if not first:  # the pack of the best cell was visited as a whole
                    other = cell != pack_of[best[query]]
                    query, cell = query[other], cell[other]
            for start in range(0, len(query), 10_000):
                taken = part.take(pa.array(query[start : start + 10_000], pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [*taken.columns, pa.array(cell[start : start + 10_000], pa.int32())], [*part.schema.names, "cell"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in queries.schema)
    return queries.mapInArrow(choose, f"{schema}, cell int")


def _visit(
    visiting: DataFrame, cells: Cells, pack_of: np.ndarray, query_id: str, corpus_id: str, score_cell: Callable, schema: str,
    block_rows: int, cell_rows: int,
) -> DataFrame:
    """The hits of ``visiting(id, vector, cell)``, whose cells are packs: parts of a pack meet groups of its visitors.

    Visitors are counted without being written: choosing them again is cheaper than their vectors, once for each pack.
    """
    import numpy as np

    spark = visiting.sparkSession
    sizes = np.bincount(pack_of, weights=cells.sizes)
    loads = [  # at most a row for each pack
        (row["cell"], max(1, -(-int(sizes[row["cell"]]) // cell_rows)), max(1, -(-row["n"] // block_rows)))
        for row in visiting.groupBy("cell").agg(F.count("*").alias("n")).collect()
    ]
    plan = F.broadcast(spark.createDataFrame(loads, "cell int, _parts int, _groups int"))
    packs = F.broadcast(spark.createDataFrame(list(enumerate(pack_of.tolist())), "cell int, _pack int"))
    held = cells.rows.join(packs, "cell").drop("cell").withColumnRenamed("_pack", "cell")

    def spread(df: DataFrame, key: str, own: str, n: str, other: str, copies: str) -> DataFrame:
        placed = df.join(plan, "cell").withColumn(own, F.pmod(F.xxhash64(key), F.col(n)).cast("int"))
        return placed.withColumn(other, F.explode(F.sequence(F.lit(0), F.col(copies) - 1))).drop("_parts", "_groups")

    left = spread(visiting.select(query_id, "vector", "cell"), query_id, "_group", "_groups", "_part", "_parts")
    right = spread(held, corpus_id, "_part", "_parts", "_group", "_groups")
    place = ["cell", "_part", "_group"]
    return left.groupBy(*place).cogroup(right.groupBy(*place)).applyInArrow(lambda block, cell: score_cell(block, cell), schema)


def bounded_hits(
    queries: DataFrame, corpus: DataFrame, query_id: str, corpus_id: str, k: int, score_cell: Callable, schema: str,
    block_rows: int, cell_rows: int, pivots: int | None = None,
) -> DataFrame:
    """``(query_id, corpus_id, score)`` that hold the k best of every query, and few others.

    ``score_cell`` maps a table of queries and one of corpus rows to the k best of each query among them.
    """
    cells = cut_into_cells(corpus, corpus_id, pivots)
    if cells is None:
        return queries.sparkSession.createDataFrame([], schema)
    # A query goes once to each pack of cells that it visits, not once to each cell, and brings back its k best of a pack.
    pack_of = packed(cells, cell_rows)
    options = (cells, pack_of, query_id, corpus_id, score_cell, schema, block_rows, cell_rows)
    best_first = Window.partitionBy(query_id).orderBy(F.col("score").desc(), F.col(corpus_id))
    found = _visit(visits(queries, cells, k, True, pack_of), *options)
    near = materialize(found.withColumn("_rank", F.row_number().over(best_first)).where(F.col("_rank") <= k), "near")
    floors = near.where(F.col("_rank") == k).select(query_id, F.col("score").alias("floor"))
    asked = queries.join(floors, query_id, "left")
    return near.drop("_rank").unionByName(_visit(visits(asked, cells, k, False, pack_of), *options))
