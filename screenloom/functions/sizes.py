"""Broadcast only what has been measured."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

#: Bytes of a table that may go to every task.
BROADCAST_BYTES = 16 << 20


def _bytes(column: Column, kind: T.DataType) -> Column:
    """Rough size of one value, as it lies in memory."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(column), F.lit(0)) + F.lit(16)
    if isinstance(kind, T.ArrayType):
        if isinstance(kind.elementType, (T.StringType, T.BinaryType, T.ArrayType, T.StructType)):
            inner = F.transform(column, lambda x: _bytes(x, kind.elementType).cast("bigint"))
            return F.coalesce(F.aggregate(inner, F.lit(0).cast("bigint"), lambda a, b: a + b), F.lit(0)) + F.lit(24)
        return F.greatest(F.size(column), F.lit(0)) * F.lit(8) + F.lit(24)
    if isinstance(kind, T.StructType):
        return reduce(lambda a, b: a + b, [_bytes(column[f.name], f.dataType) for f in kind.fields], F.lit(8))
    return F.lit(8)


def measured_bytes(df: DataFrame) -> int:
    """Size of all rows; one distributed sum, no row leaves its task."""
    each = reduce(lambda a, b: a + b, [_bytes(F.col(f"`{f.name}`"), f.dataType).cast("bigint") for f in df.schema.fields])
    return int(df.agg(F.coalesce(F.sum(each), F.lit(0))).first()[0])


def small(df: DataFrame, most: int = BROADCAST_BYTES) -> bool:
    """True when the rows of ``df`` take at most ``most`` bytes."""
    return measured_bytes(df) <= most


def broadcast_if_small(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast for a measured small side; otherwise leave the join to shuffle."""
    return F.broadcast(df) if small(df, most) else df
