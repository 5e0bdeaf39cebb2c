"""Aggregators and collectors as three-phase expressions: partial, merge, result.

A partial is an aggregate over records, a merge an aggregate over partials; so one definition serves plain groups,
panes that several windows share, and running values.
"""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Callable
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Record:
    """The columns an aggregator may read: the whole value or one column of it, time (ms) and arrival order."""

    def __init__(self, whole: Column, columns: dict[str, Column], kinds: dict[str | None, T.DataType], time: Column, order: Column):
        self.whole, self.columns, self.kinds, self.time, self.order = whole, columns, kinds, time, order

    def value(self, column: str | None) -> Column:
        if column is None:
            return self.whole
        return self.columns.get(column, F.lit(None))  # an absent column counts as null


class BaseAggregator(ABC):
    """``column`` None is the whole value. Nulls are skipped."""

    collects = False

    def __init__(self, column: str | None = None):
        self.column = column

    @abstractmethod
    def partial(self, r: Record) -> Column: ...

    @abstractmethod
    def merge(self, p: Column) -> Column: ...

    def result(self, p: Column) -> Column:
        return p


class Count(BaseAggregator):
    def partial(self, r: Record) -> Column:
        return F.count(r.value(self.column))

    def merge(self, p: Column) -> Column:
        return F.sum(p)


class Sum(BaseAggregator):
    """0 if there is nothing to add."""

    def partial(self, r: Record) -> Column:
        return F.sum(r.value(self.column))

    def merge(self, p: Column) -> Column:
        return F.sum(p)

    def result(self, p: Column) -> Column:
        return F.coalesce(p, F.lit(0))


class Mean(BaseAggregator):
    """Null if there is nothing to average."""

    def partial(self, r: Record) -> Column:
        v = r.value(self.column)
        return F.struct(F.sum(v.cast("double")).alias("s"), F.count(v).alias("n"))

    def merge(self, p: Column) -> Column:
        return F.struct(F.sum(p["s"]).alias("s"), F.sum(p["n"]).alias("n"))

    def result(self, p: Column) -> Column:
        return F.when(p["n"] > 0, p["s"] / p["n"])


class Max(BaseAggregator):
    def partial(self, r: Record) -> Column:
        return F.max(r.value(self.column))

    def merge(self, p: Column) -> Column:
        return F.max(p)


class Min(BaseAggregator):
    def partial(self, r: Record) -> Column:
        return F.min(r.value(self.column))

    def merge(self, p: Column) -> Column:
        return F.min(p)


class _Placed(BaseAggregator):
    """The value at the least or greatest place among records whose value is not null."""

    pick: Callable[[Column], Column]

    def place(self, r: Record) -> list[Column]:
        return [r.time.alias("t"), r.order.alias("o")]

    def partial(self, r: Record) -> Column:
        v = r.value(self.column)
        return type(self).pick(F.when(v.isNotNull(), F.struct(*self.place(r), v.alias("v"))))

    def merge(self, p: Column) -> Column:
        return type(self).pick(p)

    def result(self, p: Column) -> Column:
        return p["v"]


class Earliest(_Placed):
    """Smallest time; of equals the first to arrive."""

    pick = staticmethod(F.min)


class Latest(_Placed):
    """Largest time; of equals the last to arrive."""

    pick = staticmethod(F.max)


class First(_Placed):
    """First to arrive."""

    pick = staticmethod(F.min)

    def place(self, r: Record) -> list[Column]:
        return [r.order.alias("o")]


class Last(_Placed):
    """Last to arrive."""

    pick = staticmethod(F.max)

    def place(self, r: Record) -> list[Column]:
        return [r.order.alias("o")]


class _Listed(BaseAggregator):
    """All records, nulls included, as an array in order of place."""

    def place(self, r: Record) -> list[Column]:
        return [r.time.alias("t"), r.order.alias("o")]

    def partial(self, r: Record) -> Column:
        return F.collect_list(F.struct(*self.place(r), r.value(self.column).alias("v")))

    def merge(self, p: Column) -> Column:
        return F.flatten(F.collect_list(p))

    def items(self, p: Column) -> Column:
        return F.transform(F.array_sort(p), lambda x: x["v"])

    def result(self, p: Column) -> Column:
        return self.items(p)


class Collect(_Listed):
    """Values by time, then arrival; count windows pass ``by_time=False``."""

    collects = True

    def __init__(self, column: str | None = None, by_time: bool = True):
        super().__init__(column)
        self.by_time = by_time

    def place(self, r: Record) -> list[Column]:
        return super().place(r) if self.by_time else [r.order.alias("o")]


class Reduce(_Listed):
    """Left fold in arrival order of Column functions; starts anew after a null."""

    def __init__(self, reducer: Callable[[Column, Column], Column], initializer: Callable[[Column], Column], column: str | None = None):
        super().__init__(column)
        self.reducer, self.initializer = reducer, initializer

    def place(self, r: Record) -> list[Column]:
        return [r.order.alias("o")]

    def result(self, p: Column) -> Column:
        items = self.items(p)
        step = lambda acc, v: F.when(acc.isNull(), self.initializer(v)).otherwise(self.reducer(acc, v))
        return F.aggregate(F.slice(items, 2, F.greatest(F.size(items) - 1, F.lit(0))), self.initializer(F.get(items, 0)), step)


class Aggregator(_Listed):
    """Base of custom aggregators: ``initialize``, ``agg(old, new, timestamp)`` and ``finish`` in Python, in arrival order.

    ``returns`` is the SQL type of ``finish``; the fold runs on Arrow batches.
    """

    returns = "double"

    @abstractmethod
    def initialize(self) -> Any: ...

    @abstractmethod
    def agg(self, old: Any, new: Any, timestamp: int) -> Any: ...

    def finish(self, value: Any) -> Any:
        return value

    def place(self, r: Record) -> list[Column]:
        return [r.order.alias("o"), r.time.alias("t")]

    def result(self, p: Column) -> Column:
        def fold(lists: pd.Series) -> pd.Series:
            out = []
            for items in lists:
                state = self.initialize()
                for x in items:
                    if x["v"] is not None:
                        state = self.agg(state, x["v"], x["t"])
                out.append(self.finish(state))
            return pd.Series(out)

        fold.__annotations__ = {"lists": pd.Series, "return": pd.Series}
        return F.pandas_udf(fold, self.returns)(F.array_sort(p))


class Collector(_Listed):
    """Base of custom collectors: ``finish(items)`` in Python over the collected values; ``returns`` is its SQL type."""

    collects = True
    returns = "double"

    @abstractmethod
    def finish(self, items: list) -> Any: ...

    def result(self, p: Column) -> Column:
        def run(lists: pd.Series) -> pd.Series:
            return pd.Series([self.finish(list(items)) for items in lists])

        run.__annotations__ = {"lists": pd.Series, "return": pd.Series}
        return F.pandas_udf(run, self.returns)(self.items(p))
