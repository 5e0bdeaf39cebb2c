"""Lazy column expressions of one frame."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import ColumnDoesNotExist, InvalidOperation
from .truth import divide, modulo, truthy


class Series:
    """A column of a frame. Operators follow the rules of the record language; see ``functions.truth``.

    ``&`` and ``|`` give an operand, as the language's ``and`` and ``or`` do; comparisons with null other than
    equality give null, which filters drop. A series takes part only in expressions of the frame it is from.
    """

    def __init__(self, frame: Any, column: Column, kind: T.DataType):
        self.frame, self.column, self.kind = frame, column, kind

    def _other(self, other: Any) -> tuple[Column, T.DataType]:
        if isinstance(other, Series):
            if other.frame.stream_id != self.frame.stream_id:
                raise InvalidOperation("columns of different frames")
            return other.column, other.kind
        if isinstance(other, Column):
            return other, self.frame.kind_of(other)
        column = F.lit(other)
        return column, self.frame.kind_of(column)

    def _new(self, column: Column) -> Series:
        return Series(self.frame, column, self.frame.kind_of(column))

    def __add__(self, other: Any) -> Series:
        c, kind = self._other(other)
        texts = isinstance(self.kind, T.StringType | T.ArrayType) or isinstance(kind, T.StringType | T.ArrayType)
        return self._new(F.concat(self.column, c) if texts else self.column + c)

    def __sub__(self, other: Any) -> Series:
        return self._new(self.column - self._other(other)[0])

    def __mul__(self, other: Any) -> Series:
        return self._new(self.column * self._other(other)[0])

    def __truediv__(self, other: Any) -> Series:
        return self._new(divide(self.column, self._other(other)[0]))

    def __mod__(self, other: Any) -> Series:
        return self._new(modulo(self.column, self._other(other)[0]))

    def __eq__(self, other: Any) -> Series:  # type: ignore[override]
        return self._new(self.column.eqNullSafe(self._other(other)[0]))

    def __ne__(self, other: Any) -> Series:  # type: ignore[override]
        return self._new(~self.column.eqNullSafe(self._other(other)[0]))

    def __lt__(self, other: Any) -> Series:
        return self._new(self.column < self._other(other)[0])

    def __le__(self, other: Any) -> Series:
        return self._new(self.column <= self._other(other)[0])

    def __gt__(self, other: Any) -> Series:
        return self._new(self.column > self._other(other)[0])

    def __ge__(self, other: Any) -> Series:
        return self._new(self.column >= self._other(other)[0])

    def __and__(self, other: Any) -> Series:
        c, kind = self._other(other)
        both = isinstance(self.kind, T.BooleanType) and isinstance(kind, T.BooleanType)
        mine, c = self._alike(c, kind)
        return self._new(F.coalesce(mine, F.lit(False)) & c if both else F.when(self.truth(), c).otherwise(mine))

    def __or__(self, other: Any) -> Series:
        c, kind = self._other(other)
        both = isinstance(self.kind, T.BooleanType) and isinstance(kind, T.BooleanType)
        mine, c = self._alike(c, kind)
        return self._new(F.coalesce(mine, F.lit(False)) | c if both else F.when(self.truth(), mine).otherwise(c))

    def _alike(self, c: Column, kind: T.DataType) -> tuple[Column, Column]:
        """Both operands of one type: a column has one, so text and another type meet as text."""
        if isinstance(kind, T.StringType) != isinstance(self.kind, T.StringType):
            return self.column.cast("string"), c.cast("string")
        return self.column, c

    def __invert__(self) -> Series:
        return self._new(~truthy(self.column, self.kind))

    def __getitem__(self, item: int | str) -> Series:
        if isinstance(item, str):
            if isinstance(self.kind, T.StructType) and item not in self.kind.names:
                raise ColumnDoesNotExist(item)
            return self._new(self.column.getField(item) if isinstance(self.kind, T.StructType) else self.column.getItem(item))
        if isinstance(self.kind, T.StringType):
            return self._new(F.substring(self.column, item + 1 if item >= 0 else item, 1))
        return self._new(F.element_at(self.column, item + 1 if item >= 0 else item))

    def isin(self, container: Iterable | Series) -> Series:
        if isinstance(container, Series):
            return self._new(F.array_contains(container.column, self.column))
        values = list(container)
        found = F.coalesce(self.column.isin([v for v in values if v is not None]), F.lit(False))
        return self._new(found | self.column.isNull() if None in values else found)

    def contains(self, other: Any) -> Series:
        c, _ = self._other(other)
        if isinstance(self.kind, T.StructType):
            return self._new(F.lit(other in self.kind.names))
        if isinstance(self.kind, T.MapType):
            return self._new(F.map_contains_key(self.column, c))
        return self._new(F.array_contains(self.column, c) if isinstance(self.kind, T.ArrayType) else F.contains(self.column, c))

    def is_(self, other: Any) -> Series:
        return self == other

    def isnot(self, other: Any) -> Series:
        return self != other

    def isnull(self) -> Series:
        return self._new(self.column.isNull())

    def notnull(self) -> Series:
        return self._new(self.column.isNotNull())

    def abs(self) -> Series:
        return self._new(F.abs(self.column))

    def apply(self, func: Callable, returns: str | T.DataType | None = None) -> Series:
        """``func`` of the column: a Column function, or with ``returns`` a Python function of one value (by Arrow)."""
        if returns is None:
            return self._new(func(self.column))
        return self._new(F.udf(func, returns, useArrow=True)(self.column))

    def truth(self) -> Column:
        return truthy(self.column, self.kind)

    def __bool__(self) -> bool:
        raise InvalidOperation("a column has no truth value of its own; use &, | and ~")

    __hash__ = None  # type: ignore[assignment]
