"""The event frame: a DataFrame of records with key, time, headers and arrival order.

Reserved columns are ``_key``, ``_timestamp`` (ms), ``_headers`` and ``_offset``; the others are the value. A value that
is not a record of columns is one column named ``value``. The same calls build batch and streaming plans.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator
from datetime import timedelta
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .errors import ColumnDoesNotExist, InvalidOperation
from .functions.series import Series
from .functions.truth import truthy
from .operators import joins
from .operators.aggregations import Record
from .operators.state import State, each, python_column, replay, stepper
from .operators.windows import HEADERS, KEY, ORDER, TIME, Definition, to_ms
from .plans.running import STRETCH

RESERVED = (KEY, TIME, HEADERS, ORDER)
HEADER_TYPE = "array<struct<key:string,value:binary>>"
_ids = itertools.count(1)


class Value:
    """The record as a function of columns sees it: ``v["a"]`` is a Column, ``v.column`` the whole."""

    def __init__(self, frame: EventFrame):
        self.frame, self.column = frame, frame.whole

    def __getitem__(self, name: str) -> Column:
        return self.frame[name].column


class Made:
    """A value as it was made by ``apply``, over the columns of the frame before."""

    def __init__(self, column: Column):
        self.column = column

    def __getitem__(self, name: str) -> Column:
        return self.column[name]


class EventFrame:
    header_type = HEADER_TYPE

    def __init__(self, df: DataFrame, stream_id: int | None = None, origins: frozenset[int] | None = None, ordered: bool = False, stretch: int = STRETCH):
        if missing := [c for c in RESERVED if c not in df.columns]:
            raise InvalidOperation(f"reserved columns are missing: {', '.join(missing)}")
        self.df = df
        self.stream_id = stream_id or next(_ids)
        self.origins = origins or frozenset((self.stream_id,))
        #: No record is older than an earlier one of its key: windows need no running clocks.
        self.ordered = ordered
        #: Offsets of a stretch of arrival order, the unit in which a hot key is spread over tasks.
        self.stretch = stretch
        #: Topics or sinks that records go to on the way, with the records as they were there.
        self.outputs: list[tuple[Any, DataFrame]] = []
        #: Told of an exception in a Python function, with the value; if it answers true, the record is left out.
        self.on_error: Callable[[Exception, Any], bool] | None = None
        # of a frame made by ``apply`` alone: the rows that it was made of, each with its value as a column of them
        self._bases: list[tuple[DataFrame, Callable[[], Column]]] = []
        self._made = df

    @classmethod
    def of(cls, df: DataFrame, key: str | Column | None, timestamp: str | Column, offset: str | Column | None = None, headers: str | Column | None = None, ordered: bool = False, stretch: int = STRETCH) -> EventFrame:
        """A frame of a table; ``timestamp`` is ms or a timestamp, ``offset`` the order of arrival (time if absent)."""
        col = lambda c: F.col(c) if isinstance(c, str) else c
        time = col(timestamp)
        kind = df.select(time).schema[0].dataType
        if isinstance(kind, T.TimestampNTZType | T.TimestampType | T.DateType):
            time = F.unix_millis(time.cast("timestamp"))
        out = df.withColumns({KEY: F.lit(None).cast("string") if key is None else col(key), TIME: time.cast("long")})
        out = out.withColumns({HEADERS: F.lit(None).cast(HEADER_TYPE) if headers is None else col(headers), ORDER: F.col(TIME) if offset is None else col(offset).cast("long")})
        return cls(out, ordered=ordered, stretch=stretch)

    @classmethod
    def records(cls, spark: SparkSession, records: list[tuple], schema: str, key: str = "string", ordered: bool = False) -> EventFrame:
        """A frame of (value, key, timestamp[, headers]) tuples in order of arrival; ``schema`` is the value's DDL."""
        kind = T._parse_datatype_string(schema)
        names = kind.names if isinstance(kind, T.StructType) else ["value"]
        rows = []
        for i, (value, key_, time, *rest) in enumerate(records):
            cells = [value.get(n) if value else None for n in names] if isinstance(kind, T.StructType) else [value]
            rows.append((*cells, key_, time, rest[0] if rest else None, i))
        fields = [f"{f.name} {f.dataType.simpleString()}" for f in kind] if isinstance(kind, T.StructType) else [f"value {schema}"]
        return cls(spark.createDataFrame(rows, ", ".join([*fields, f"{KEY} {key}", f"{TIME} bigint", f"{HEADERS} {HEADER_TYPE}", f"{ORDER} bigint"])), ordered=ordered)

    # what it holds

    @property
    def value_columns(self) -> list[str]:
        return [c for c in self.df.columns if c not in RESERVED]

    @property
    def scalar(self) -> bool:
        return self.value_columns == ["value"]

    @property
    def whole(self) -> Column:
        """The value as one column; a record of nulls alone is null."""
        if self.scalar:
            return F.col("value")
        names = [F.col(c) for c in self.value_columns]
        return F.when(F.coalesce(*[F.when(c.isNotNull(), F.lit(True)) for c in names]), F.struct(*names)) if names else F.lit(None)

    def kind_of(self, column: Column) -> T.DataType:
        return self.df.select(column).schema[0].dataType

    def record(self) -> Record:
        return Record(self.whole, {c: F.col(c) for c in self.value_columns}, {}, F.col(TIME), F.col(ORDER))

    def _derived(self, df: DataFrame, origins: frozenset[int] | None = None, ordered: bool | None = None, fresh: bool = False) -> EventFrame:
        origins = origins or self.origins
        out = EventFrame(df, next(_ids) if fresh or origins != self.origins else self.stream_id, origins, self.ordered if ordered is None else ordered, self.stretch)
        out.on_error, out.outputs = self.on_error, list(self.outputs)
        return out

    def _column_of(self, other: EventFrame) -> Column:
        """The value of a frame that ``apply`` made of this one, as a column of this one."""
        found = [expression for df, expression in other._bases if df is self.df and other.df is other._made]
        if not found or other.stream_id != self.stream_id:
            raise InvalidOperation("only a frame made of this one by apply, as it is now, is a mask or a value")
        return found[0]()

    def __bool__(self) -> bool:
        raise InvalidOperation("a frame has no truth value")

    # columns

    def __getitem__(self, item: str | list[str] | Series | Column | EventFrame) -> Any:
        if isinstance(item, str):
            if item not in self.df.columns:
                raise ColumnDoesNotExist(item)
            return Series(self, F.col(item), self.df.schema[item].dataType)
        if isinstance(item, list):
            if missing := [c for c in item if c not in self.value_columns]:
                raise ColumnDoesNotExist(", ".join(missing))
            return self._derived(self.df.select(*item, *RESERVED))
        return self.filter(self._column_of(item) if isinstance(item, EventFrame) else item)

    def __setitem__(self, name: str, item: Any) -> None:
        """In place."""
        if isinstance(item, Series):
            if item.frame.stream_id != self.stream_id:
                raise InvalidOperation("a column of another frame")
            item = item.column
        elif isinstance(item, EventFrame):
            item = self._column_of(item)
        self.df = self.df.withColumn(name, item if isinstance(item, Column) else F.lit(item))

    def contains(self, keys: str | list[str]) -> Series:
        keys = [keys] if isinstance(keys, str) else keys
        return Series(self, F.lit(all(k in self.value_columns for k in keys)), T.BooleanType())

    def fill(self, *columns: str, **mapping: Any) -> EventFrame:
        """In place: absent columns are added, nulls replaced (by null for ``columns``)."""
        if not columns and not mapping:
            raise ValueError("nothing to fill")
        for name, value in ({c: None for c in columns} | mapping).items():
            own = F.lit(value)
            self.df = self.df.withColumn(name, F.coalesce(F.col(name), own) if name in self.df.columns else own)
        return self

    def drop(self, columns: str | list[str], errors: str = "raise") -> EventFrame:
        """In place."""
        names = [columns] if isinstance(columns, str) else columns
        if not isinstance(names, list) or not all(isinstance(c, str) for c in names):
            raise TypeError("columns are a name or a list of names")
        if errors not in ("raise", "ignore"):
            raise ValueError("errors is raise or ignore")
        if errors == "raise" and (missing := [c for c in names if c not in self.value_columns]):
            raise ColumnDoesNotExist(", ".join(missing))
        self.df = self.df.drop(*[c for c in names if c not in RESERVED])
        return self

    # records

    def _columns_of(self, got: Any) -> list[tuple[str, Column]]:
        if isinstance(got, dict):
            return [(k, v.column if isinstance(v, Series) else v if isinstance(v, Column) else F.lit(v)) for k, v in got.items()]
        got = got.column if isinstance(got, Series) else got
        kind = self.kind_of(got)
        return [(n, got[n]) for n in kind.names] if isinstance(kind, T.StructType) else [("value", got)]

    @staticmethod
    def _whole_of(got: Any) -> Column:
        if isinstance(got, dict):
            return F.struct(*[(v.column if isinstance(v, Series) else v if isinstance(v, Column) else F.lit(v)).alias(k) for k, v in got.items()])
        return got.column if isinstance(got, Series) else got

    def _call(self, func: Callable, metadata: bool) -> Any:
        return func(Value(self), *([F.col(KEY), F.col(TIME), F.col(HEADERS)] if metadata else []))

    def _python(self, func: Callable, how: str, returns: str | None, metadata: bool, stateful: bool, expand: bool) -> EventFrame:
        """A Python function over records, in Arrow batches; with state, over the records of each key in order."""
        names, scalar = self.value_columns, self.scalar
        if how == "apply":
            kind = T._parse_datatype_string(returns)
            fields = list(kind) if isinstance(kind, T.StructType) else [T.StructField("value", kind)]
        else:
            fields = [self.df.schema[c] for c in names]
        head = [self.df.schema[c] for c in (KEY, TIME, HEADERS, ORDER)]
        schema = T.StructType([T.StructField(f.name, f.dataType) for f in [*head, *fields]])
        out_columns = [f.name for f in fields]
        step = stepper(func, how, out_columns, metadata, stateful, expand, self.on_error)
        columns = list(schema.names)
        if not stateful:

            def batch(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
                for pdf in pdfs:
                    rows = [r for value, head in each(pdf, names, scalar, ()) for r in step(value, head, None)]
                    yield pd.DataFrame(rows, columns=columns, dtype=object)

            return self._derived(self.df.mapInPandas(batch, schema))
        if self.df.isStreaming:
            from .streaming.state import stream_state

            return self._derived(stream_state(self.df, step, names, scalar, schema))
        return self._derived(replay(self.df, step, State, names, scalar, schema))

    def apply(self, func: Callable, returns: str | None = None, *, stateful: bool = False, expand: bool = False, metadata: bool = False) -> EventFrame:
        """Another value for each record, or with ``expand`` one for each item.

        Without ``returns``, ``func`` maps columns: it gets the value (and key, timestamp, headers) as columns and
        gives a column, a struct or a dict of columns (an array to expand). With ``returns`` (DDL) it is a Python
        function of the value, and with ``stateful`` of the key's state.
        """
        if returns is not None:
            out = self._python(func, "apply", returns, metadata, stateful, expand)
            if not stateful and not expand:
                self._trace(out, lambda value: python_column(func, returns, value.column, metadata, self.on_error))
            return out
        if stateful:
            raise InvalidOperation("a stateful function is a Python function and needs returns")
        got = self._call(func, metadata)
        if not expand:
            out = self._derived(self.df.select(*[c.alias(n) for n, c in self._columns_of(got)], *RESERVED))
            self._trace(out, lambda value: self._whole_of(func(value, *([F.col(KEY), F.col(TIME), F.col(HEADERS)] if metadata else []))))
            return out
        got = got.column if isinstance(got, Series) else got
        opened = self.df.select(F.explode(got).alias("item__"), *RESERVED)
        kind = opened.schema["item__"].dataType
        items = [F.col("item__")[n].alias(n) for n in kind.names] if isinstance(kind, T.StructType) else [F.col("item__").alias("value")]
        return self._derived(opened.select(*items, *RESERVED))

    def _trace(self, out: EventFrame, of: Callable[[Value | Made], Column]) -> None:
        """``out`` was made of this frame by ``of``, and so of what this one was made of."""
        before = self._bases if self.df is self._made else []
        out._bases = [(self.df, lambda: of(Value(self))), *((df, lambda e=e: of(Made(e()))) for df, e in before)]

    def update(self, func: Callable, *, python: bool = False, stateful: bool = False, metadata: bool = False) -> EventFrame:
        """In place: columns that ``func`` gives are added or replaced; a Python function changes the record itself."""
        if python or stateful:
            self.df = self._python(func, "update", None, metadata, stateful, False).df
            return self
        self.df = self.df.withColumns(dict(self._columns_of(self._call(func, metadata) or {})))
        return self

    def filter(self, func: Any, *, python: bool = False, stateful: bool = False, metadata: bool = False) -> EventFrame:
        """Records whose value is truthy under ``func`` (a column, a series or a function of either kind)."""
        if python or stateful:
            return self._python(func, "filter", None, metadata, stateful, False)
        got = func if isinstance(func, Column | Series) else self._call(func, metadata)
        if isinstance(got, Series):
            if got.frame.stream_id != self.stream_id:
                raise InvalidOperation("a column of another frame")
            return self._derived(self.df.where(got.truth()))
        return self._derived(self.df.where(truthy(got, self.kind_of(got))))

    def set_timestamp(self, func: Callable) -> EventFrame:
        return self._derived(self.df.withColumn(TIME, self._call(func, True).cast("long")), ordered=False)

    def set_headers(self, func: Callable) -> EventFrame:
        return self._derived(self.df.withColumn(HEADERS, self._call(func, True).cast(HEADER_TYPE)))

    def group_by(self, key: str | Callable, name: str | None = None) -> EventFrame:
        """Another key; the next keyed operator shuffles by it."""
        if callable(key):
            if not name:
                raise ValueError("a name is needed for a key function")
            column = key(Value(self))
            column = column.column if isinstance(column, Series) else column
        else:
            column = self[key].column
        return self._derived(self.df.withColumn(KEY, column))

    def concat(self, other: EventFrame) -> EventFrame:
        return joins.concat(self, other)

    # windows

    def tumbling_window(self, duration_ms: int | timedelta, grace_ms: int | timedelta = 0, name: str | None = None, on_late: Callable | None = None, before_update: Callable | None = None, after_update: Callable | None = None) -> Definition:
        d = to_ms(duration_ms, "duration_ms")
        return Definition(self, "tumbling", name, {"on_late": on_late, "before_update": before_update, "after_update": after_update}, duration=d, step=d, grace=to_ms(grace_ms, "grace_ms"))

    def hopping_window(self, duration_ms: int | timedelta, step_ms: int | timedelta, grace_ms: int | timedelta = 0, name: str | None = None, on_late: Callable | None = None, before_update: Callable | None = None, after_update: Callable | None = None) -> Definition:
        return Definition(self, "hopping", name, {"on_late": on_late, "before_update": before_update, "after_update": after_update}, duration=to_ms(duration_ms, "duration_ms"), step=to_ms(step_ms, "step_ms"), grace=to_ms(grace_ms, "grace_ms"))

    def sliding_window(self, duration_ms: int | timedelta, grace_ms: int | timedelta = 0, name: str | None = None, on_late: Callable | None = None) -> Definition:
        return Definition(self, "sliding", name, {"on_late": on_late}, duration=to_ms(duration_ms, "duration_ms"), grace=to_ms(grace_ms, "grace_ms"))

    def tumbling_count_window(self, count: int, name: str | None = None) -> Definition:
        return Definition(self, "count", name, {}, count=count, step=count)

    def hopping_count_window(self, count: int, step: int, name: str | None = None) -> Definition:
        return Definition(self, "count", name, {}, count=count, step=step)

    def sliding_count_window(self, count: int, name: str | None = None) -> Definition:
        return Definition(self, "count", name, {}, count=count, step=1)

    # joins

    def join_asof(self, right: EventFrame, how: str = "inner", on_merge: joins.Merge = "raise", grace_ms: int | timedelta = timedelta(days=7), name: str | None = None, split_ms: int | timedelta = timedelta(days=7), by_arrival: bool = False) -> EventFrame:
        """With the last right record of the key; ``by_arrival``: of those that came before by ``_offset`` (see ``joins``)."""
        if self.df.isStreaming or right.df.isStreaming:
            from .streaming.joins import stream_asof

            return stream_asof(self, right, how, on_merge, to_ms(grace_ms, "grace_ms"))
        return joins.asof(self, right, how, on_merge, grace_ms, split_ms, by_arrival)

    def join_interval(self, right: EventFrame, how: str = "inner", on_merge: joins.Merge = "raise", grace_ms: int | timedelta = timedelta(days=7), name: str | None = None, backward_ms: int | timedelta = 0, forward_ms: int | timedelta = 0, by_arrival: bool = False) -> EventFrame:
        if self.df.isStreaming or right.df.isStreaming:
            from .streaming.joins import stream_interval

            return stream_interval(self, right, how, on_merge, to_ms(grace_ms, "grace_ms"), to_ms(backward_ms, "backward_ms"), to_ms(forward_ms, "forward_ms"))
        return joins.interval(self, right, how, on_merge, grace_ms, backward_ms, forward_ms, by_arrival)

    def join_lookup(self, lookup: Any, fields: dict[str, Any], on: str | Callable | Column | None = None) -> EventFrame:
        """In place: fields of a reference table, as the columns named."""
        self.df = lookup.join(self, fields, on)
        return self

    # ends

    def to_topic(self, topic: Any, key: Callable | None = None) -> EventFrame:
        """In place: the records as they are now also go to ``topic`` (or to the topic that a function of columns names)."""
        df = self.df if key is None else self.df.withColumn(KEY, key(Value(self)))
        self.outputs.append((topic, df.withColumn("_topic", topic(Value(self))) if callable(topic) else df))
        return self

    def sink(self, sink: Any, **options: Any) -> Any:
        """The end: batch frames are written, streaming ones give a started query."""
        return sink.run(self, **options)

    def run(self, count: int = 0, timeout: float = 0.0, collect: bool = True, metadata: bool = False, checkpoint: str | None = None) -> list[dict]:
        """For tests: records until there are ``count`` of them or none came for ``timeout`` seconds (0: no limit).

        A batch frame, or a stream without either limit, runs to its end. Gives the records, or with
        ``collect=False`` nothing.
        """
        from .streaming.limits import run

        return run(self, count, timeout, collect, metadata, checkpoint)

    def print(self, pretty: bool = True, metadata: bool = False, n: int = 20) -> EventFrame:
        """In place; shows the first records of a batch frame, or those of each micro-batch once the frame has a sink."""
        shown = self.df if metadata else self.df.select(*self.value_columns)
        return self._show(lambda df: df.show(n, truncate=not pretty, vertical=pretty), shown)

    def print_table(self, size: int = 5, title: str | None = None, metadata: bool = True, columns: list[str] | None = None) -> EventFrame:
        """In place; the newest records as a table, of a stream those of each micro-batch."""
        names = columns or [*(RESERVED[:2] if metadata else ()), *self.value_columns]

        def table(df: DataFrame) -> None:
            if title:
                print(title)
            df.orderBy(F.desc(ORDER)).select(*names).show(size, truncate=False)

        return self._show(table, self.df)

    def _show(self, show: Callable[[DataFrame], None], df: DataFrame) -> EventFrame:
        if self.df.isStreaming:
            from .sinks.writers import ShowSink

            self.outputs.append((ShowSink(show), df))
        else:
            show(df)
        return self


def try_pipeline(spark: SparkSession, build: Callable[[EventFrame], EventFrame], value: Any, schema: str, key: Any = "key", timestamp: int = 0, headers: Any = None) -> list[dict]:
    """Rows that ``build`` makes of one record, as dicts with reserved columns."""
    out = build(EventFrame.records(spark, [(value, key, timestamp, headers)], schema))
    return [r.asDict(recursive=True) for r in out.df.collect()]
