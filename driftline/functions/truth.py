"""Truth and null rules over columns: number not 0, string and container not empty, not null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def truthy(c: Column, kind: T.DataType) -> Column:
    """Never null."""
    if isinstance(kind, T.BooleanType):
        test = c
    elif isinstance(kind, T.NumericType):
        test = c != 0
    elif isinstance(kind, T.StringType | T.BinaryType):
        test = F.length(c) > 0
    elif isinstance(kind, T.ArrayType | T.MapType):
        test = F.size(c) > 0
    elif isinstance(kind, T.NullType):
        return F.lit(False)
    else:  # structs, dates, timestamps
        test = c.isNotNull()
    return F.coalesce(test, F.lit(False))


def modulo(a: Column, b: Column) -> Column:
    """Remainder with the divisor's sign; a zero divisor raises under ANSI rules."""
    rest = a % b
    return F.when((rest != 0) & ((rest < 0) != (b < 0)), rest + b).otherwise(rest)


def divide(a: Column, b: Column) -> Column:
    return a.cast("double") / b.cast("double")
