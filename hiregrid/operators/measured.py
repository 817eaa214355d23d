"""Intermediate tables whose size is known from the write itself."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hiregrid.session import intermediate_folder

FIXED_BYTES = 8  # of a number, and the least of any value


@dataclass(frozen=True)
class Written:
    """A written table with its rows and about the bytes of its values in memory.

    A stage that ran again counts twice, so both are upper bounds after a lost executor.
    """

    table: DataFrame
    rows: int
    bytes: int


def value_bytes(value: Column, kind: T.DataType) -> Column:
    """About the bytes of a value in memory; 0 for null. Texts are not turned into anything to be measured."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        size = F.octet_length(value) + FIXED_BYTES
    elif isinstance(kind, T.ArrayType) and isinstance(kind.elementType, (T.NumericType, T.BooleanType, T.DatetimeType)):
        size = F.size(value) * FIXED_BYTES
    elif isinstance(kind, T.ArrayType):
        size = F.aggregate(value, F.lit(0).cast("bigint"), lambda total, x: total + value_bytes(x, kind.elementType))
    elif isinstance(kind, T.MapType):
        size = value_bytes(F.map_keys(value), T.ArrayType(kind.keyType)) + value_bytes(F.map_values(value), T.ArrayType(kind.valueType))
    elif isinstance(kind, T.StructType):
        size = sum((value_bytes(value.getField(f.name), f.dataType) for f in kind), F.lit(FIXED_BYTES))
    else:
        size = F.lit(FIXED_BYTES)
    return F.when(value.isNull(), F.lit(0)).otherwise(size).cast("bigint")


def write_measured(df: DataFrame, label: str = "stage") -> Written:
    """Write ``df`` once, as ``materialize`` does, and count its rows and bytes while they are written."""
    path = f"{intermediate_folder(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    size = sum((value_bytes(df[f.name], f.dataType) for f in df.schema), F.lit(0).cast("bigint"))
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes")).write.parquet(path)
    return Written(df.sparkSession.read.schema(df.schema).parquet(path), seen.get["rows"], seen.get["bytes"])
