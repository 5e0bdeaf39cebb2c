"""Windows in streams: native watermark aggregation for partition closing, a processor for key closing.

The native path closes by a global watermark that follows a micro-batch behind; the processor closes by each key's
own clock and takes the key's rows of a micro-batch in order of arrival.
"""

from __future__ import annotations

from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import aggregations as A
from ..operators.state import each, replay
from ..operators.windows import HEADERS, KEY, ORDER, TIME, Definition
from .engine import Engine
from .processors import KeyProcessor, keyed

def _engine(d: Definition, named: dict[str, A.BaseAggregator], current: bool, columns: list[str]) -> Engine:
    return Engine(d.kind, d.size, named, columns == ["start", "end", "value"], current, **{k: d.triggers.get(k) for k in ("before_update", "after_update", "on_late")})


def _schema(d: Definition, named: dict[str, A.BaseAggregator], columns: list[str]) -> T.StructType:
    """Types of the results, from the batch plan over no rows."""
    from ..frame import EventFrame

    empty = d.frame.df.sparkSession.createDataFrame([], d.frame.df.schema)
    again = Definition(EventFrame(empty), d.kind, d.name, {}, **d.size).agg(**named).final().df.schema
    head = [d.frame.df.schema[KEY], T.StructField(TIME, T.LongType()), d.frame.df.schema[HEADERS], T.StructField(ORDER, T.LongType())]
    return T.StructType([T.StructField(f.name, f.dataType) for f in [*head, *(again[c] for c in columns)]])


def _step(engine: Engine, columns: list[str]) -> Any:
    def step(value: Any, head: tuple, state: dict) -> list[tuple]:
        key, time, headers, order = head
        out = []
        for start, end, results in engine.process(state, value, key, time, headers, order):
            cells = results | {"start": start, "end": end}
            out.append((key, start, None, order, *(cells[c] for c in columns)))
        return out

    return step


class WindowProcessor(KeyProcessor):
    def __init__(self, engine: Engine, names: list[str], scalar: bool, columns: list[str], schema_names: list[str]):
        super().__init__(schema_names)
        self.engine, self.names, self.scalar, self.own = engine, names, scalar, columns

    def run(self, key: Any, pdf: pd.DataFrame, state: Any) -> tuple[list[tuple], Any]:
        state = state or self.engine.fresh()
        step = _step(self.engine, self.own)
        return [r for value, head in each(pdf, self.names, self.scalar, (ORDER,)) for r in step(value, head, state)], state


def stream_windows(d: Definition, named: dict[str, A.BaseAggregator], closing: str, current: bool, columns: list[str]) -> DataFrame:
    if closing == "partition":
        return _native(d, named, current, columns)
    schema = _schema(d, named, columns)
    frame = d.frame
    return keyed(frame.df, WindowProcessor(_engine(d, named, current, columns), frame.value_columns, frame.scalar, columns, list(schema.names)), schema)


def _native(d: Definition, named: dict[str, A.BaseAggregator], current: bool, columns: list[str]) -> DataFrame:
    if d.kind not in ("tumbling", "hopping"):
        raise ValueError("partition closing is for tumbling and hopping windows")
    size, r = d.size, d.frame.record()
    ms = lambda n: f"{n} milliseconds"
    rows = d.frame.df.where(F.col(KEY).isNotNull()).withColumn("time__", F.timestamp_millis(TIME)).withWatermark("time__", ms(size["grace"]))
    grouped = rows.groupBy(KEY, F.window("time__", ms(size["duration"]), ms(size["step"])).alias("w__")).agg(*[a.partial(r).alias(f"{n}__p") for n, a in named.items()], F.max(ORDER).alias(ORDER))
    out = grouped.withColumns({"start": F.unix_millis("w__.start"), "end": F.unix_millis("w__.end")}).where("start >= 0")
    out = out.withColumns({n: a.result(F.col(f"{n}__p")) for n, a in named.items()})
    return out.select(KEY, F.col("start").alias(TIME), F.lit(None).cast(d.frame.header_type).alias(HEADERS), ORDER, *columns)


def replay_windows(d: Definition, named: dict[str, A.BaseAggregator], current: bool, columns: list[str]) -> DataFrame:
    """Batch windows with triggers: a replay of each key, as triggers depend on all that came before."""
    schema, frame = _schema(d, named, columns), d.frame
    engine = _engine(d, named, current, columns)
    return replay(frame.df, _step(engine, columns), engine.fresh, frame.value_columns, frame.scalar, schema, (ORDER,))
