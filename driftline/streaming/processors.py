"""State processors: each keeps one binary value for a key, and sees a micro-batch of the key in replay order."""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.state import State, each, plain


class KeyProcessor(StatefulProcessor):
    """Base: ``run(key, pdf, state) -> (rows, state)`` over all rows of the key in the micro-batch."""

    def __init__(self, columns: list[str]):
        self.columns = columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.store = handle.getValueState("state", "blob binary")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        parts = [named(pdf, self.input) for pdf in rows]
        pdf = pd.concat(parts) if len(parts) > 1 else parts[0]
        state = pickle.loads(bytes(self.store.get()[0])) if self.store.exists() else None
        out, state = self.run(plain(key[0]), pdf, state)
        self.store.update((pickle.dumps(state),))
        yield pd.DataFrame(out, columns=self.columns, dtype=object)

    def run(self, key: Any, pdf: pd.DataFrame, state: Any) -> tuple[list[tuple], Any]:
        raise NotImplementedError

    def close(self) -> None:
        pass


def named(pdf: pd.DataFrame, columns: list[str]) -> pd.DataFrame:
    """Spark hands rows over as named tuples, which lose names that begin with an underscore."""
    return pdf.set_axis(columns, axis=1)


def keyed(df: DataFrame, processor: StatefulProcessor, schema: T.StructType, time_mode: str = "None") -> DataFrame:
    """``df`` by ``_key`` (null keys are left out) through a processor, in append mode."""
    processor.input = df.columns
    return df.where(F.col("_key").isNotNull()).groupBy("_key").transformWithStateInPandas(statefulProcessor=processor, outputStructType=schema, outputMode="append", timeMode=time_mode)


class UserState(KeyProcessor):
    """User functions with keyed state; see ``operators.state``."""

    def __init__(self, step: Any, names: list[str], scalar: bool, columns: list[str]):
        super().__init__(columns)
        self.step, self.names, self.scalar = step, names, scalar

    def run(self, key: Any, pdf: pd.DataFrame, state: Any) -> tuple[list[tuple], Any]:
        values = State.load(state)
        return [r for value, head in each(pdf, self.names, self.scalar) for r in self.step(value, head, values)], values.dump()


class Silence(StatefulProcessor):
    """Tells once when a key has been silent for ``timeout`` ms of wall-clock time; a new record arms it again."""

    def __init__(self, timeout: int):
        self.timeout = timeout

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "at bigint, time bigint")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        newest = max(int(named(pdf, self.input)["_timestamp"].max()) for pdf in rows)
        for old in self.handle.listTimers():
            self.handle.deleteTimer(old)
        now = timerValues.getCurrentProcessingTimeInMs()
        self.last.update((now, newest))
        self.handle.registerTimer(now + self.timeout)
        yield pd.DataFrame({"_key": [], "last_timestamp": [], "silent_ms": []}, dtype=object)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        if self.last.exists():
            at, time = self.last.get()
            self.last.clear()
            yield pd.DataFrame({"_key": [key[0]], "last_timestamp": [time], "silent_ms": [timerValues.getCurrentProcessingTimeInMs() - at]})

    def close(self) -> None:
        pass


def silent_keys(df: DataFrame, timeout_ms: int) -> DataFrame:
    """``_key, last_timestamp, silent_ms`` of each silence in a streaming frame's records."""
    kind = df.schema["_key"].dataType.simpleString()
    schema = T._parse_datatype_string(f"_key {kind}, last_timestamp bigint, silent_ms bigint")
    return keyed(df, Silence(timeout_ms), schema, "ProcessingTime")
