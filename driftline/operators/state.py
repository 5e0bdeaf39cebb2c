"""Keyed state for record functions, with expiry by event time; in batch a replay of each key by (time, arrival)."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import PandasUDFType

from .windows import to_ms


class State:
    """Values of one key by name. A value set with ``ttl`` is gone from ``ttl`` ms of event time after it was set."""

    def __init__(self, values: dict[str, tuple[Any, int | None]] | None = None):
        self.values, self.now = values or {}, 0

    def advance(self, time: int) -> None:
        self.now = max(self.now, time)

    def get(self, key: str, default: Any = None) -> Any:
        value, until = self.values.get(key, (default, None))
        return default if until is not None and until <= self.now else value

    def set(self, key: str, value: Any, ttl: Any = None) -> None:
        if ttl is not None and to_ms(ttl, "ttl") <= 0:
            raise ValueError("ttl is positive")
        self.values[key] = (value, None if ttl is None else self.now + to_ms(ttl, "ttl"))

    def delete(self, key: str) -> None:
        self.values.pop(key, None)

    def exists(self, key: str) -> bool:
        missing = object()
        return self.get(key, missing) is not missing

    def get_bytes(self, key: str, default: bytes | None = None) -> bytes | None:
        value = self.get(key)
        return default if value is None else bytes.fromhex(value)

    def set_bytes(self, key: str, value: bytes, ttl: Any = None) -> None:
        self.set(key, value.hex(), ttl)

    def evict(self) -> None:
        self.values = {k: v for k, v in self.values.items() if v[1] is None or v[1] > self.now}

    def dump(self) -> str:
        self.evict()
        return json.dumps([self.now, self.values])

    @classmethod
    def load(cls, text: str | None) -> State:
        if not text:
            return cls()
        now, values = json.loads(text)
        out = cls({k: tuple(v) for k, v in values.items()})
        out.now = now
        return out


def plain(value: Any) -> Any:
    """A pandas cell as a Python value; missing ones are None."""
    if hasattr(value, "tolist"):
        return [plain(x) for x in value.tolist()] if getattr(value, "ndim", 0) else plain(value.item())
    if isinstance(value, float) and value != value or value is pd.NaT:
        return None
    return value


def each(pdf: pd.DataFrame, columns: list[str], scalar: bool, order: tuple[str, ...] = ("_timestamp", "_offset")) -> Iterator[tuple[Any, tuple]]:
    """(value, reserved cells) of the rows, by ``order`` (none: as they come)."""
    if order:
        pdf = pdf.sort_values(list(order), kind="stable")
    lists = {c: [plain(x) for x in pdf[c].tolist()] for c in pdf.columns}
    heads = zip(*(lists[c] for c in ("_key", "_timestamp", "_headers", "_offset")), strict=True)
    if scalar:
        yield from zip(lists["value"], heads, strict=True)
    else:
        for cells, head in zip(zip(*(lists[c] for c in columns), strict=True), heads, strict=True):
            yield dict(zip(columns, cells, strict=True)), head


def python_column(func: Callable, returns: str, value: Column, metadata: bool, on_error: Callable[[Exception, Any], bool] | None = None) -> Column:
    """A Python function of records as a column, in Arrow batches; null where ``on_error`` swallows an exception."""
    kind = T._parse_datatype_string(returns)

    def run(values, *rest):  # noqa: ANN001, ANN002, ANN202
        if isinstance(values, pd.DataFrame):
            records = [dict(zip(values.columns, map(plain, r), strict=True)) for r in values.itertuples(index=False, name=None)]
        else:
            records = [plain(x) for x in values.tolist()]
        out = []
        for record, *head in zip(records, *([plain(x) for x in c.tolist()] for c in rest), strict=True):
            try:
                out.append(func(record, *head))
            except Exception as e:
                if on_error is None or not on_error(e, record):
                    raise
                out.append(None)
        if isinstance(kind, T.StructType):
            return pd.DataFrame([[(r or {}).get(n) for n in kind.names] for r in out], columns=kind.names, dtype=object)
        return pd.Series(out, dtype=object)

    return F.pandas_udf(run, kind, PandasUDFType.SCALAR)(value, *([F.col("_key"), F.col("_timestamp"), F.col("_headers")] if metadata else []))


Step = Callable[[Any, tuple, Any], list[tuple]]


def stepper(func: Callable, how: str, out_columns: list[str], metadata: bool, stateful: bool, expand: bool, on_error: Callable[[Exception, Any], bool] | None = None) -> Step:
    """Runs a user function on a record: (value, reserved cells, state) to output rows, reserved cells first.

    An exception leaves the record out if ``on_error`` says so.
    """

    def step(value: Any, head: tuple, state: State) -> list[tuple]:
        if stateful:
            state.advance(head[1])
        try:
            got = func(value, *(head[:3] if metadata else ()), *((state,) if stateful else ()))
        except Exception as e:
            if on_error is None or not on_error(e, value):
                raise
            return []
        if how == "filter":
            results = [value] if got else []
        elif how == "update":
            results = [value]
        else:
            results = got if expand else [got]
        if out_columns == ["value"]:
            return [(*head, r) for r in results]
        return [(*head, *(r.get(c) if isinstance(r, dict) else None for c in out_columns)) for r in results]

    return step


def replay(df: DataFrame, step: Step, fresh: Callable[[], Any], columns: list[str], scalar: bool, schema: T.StructType, order: tuple[str, ...] = ("_timestamp", "_offset")) -> DataFrame:
    """Records of each key in order through ``step``, with a state that ``fresh`` makes for each key.

    Rows are dealt and sorted by Spark and pass by in batches, so a key of any length needs the memory of its state
    only; records without a key are left out.
    """
    names = list(schema.names)

    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, state = None, None
        for pdf in pdfs:
            out: list[tuple] = []
            for value, head in each(pdf, columns, scalar, ()):
                if state is None or head[0] != last:
                    last, state = head[0], fresh()
                out += step(value, head, state)
            yield pd.DataFrame(out, columns=names, dtype=object)

    dealt = df.where(F.col("_key").isNotNull()).repartition("_key").sortWithinPartitions("_key", *order)
    return dealt.mapInPandas(run, schema)
