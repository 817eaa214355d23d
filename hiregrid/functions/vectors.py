"""Vector arithmetic on array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_unit(vector: Column) -> Column:
    """``vector`` divided by its Euclidean length, as doubles.

    The length is the accumulator handed to the final step, so it is computed
    once per row; as a column of its own the optimizer would inline it into the
    per-element function. A zero vector stays as it is. Null and empty vectors
    give null: they are errors, to be split off by the caller.
    """

    def scaled(squares: Column) -> Column:
        divisor = F.when(squares == 0, F.lit(1.0)).otherwise(F.sqrt(squares))
        return F.transform(vector, lambda x: x.cast("double") / divisor)

    def add_square(total: Column, x: Column) -> Column:
        return total + x.cast("double") * x.cast("double")

    return F.when(F.size(vector) > 0, F.aggregate(vector, F.lit(0.0), add_square, scaled))
