"""Time and count windows over batch frames, as they close in a replay in arrival order.

Tumbling and hopping windows group by (key, window); partial aggregates come before the shuffle, and hopping windows
share panes where no record can be late. Sliding windows are range frames over stretches of time, count windows are
groups of running numbers, both spread over tasks for a hot key (``plans.running``).
"""

from __future__ import annotations

import math
from collections.abc import Callable
from datetime import timedelta
from typing import TYPE_CHECKING, Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.running import running, with_halo
from . import aggregations as A

if TYPE_CHECKING:
    from ..frame import EventFrame

KEY, TIME, HEADERS, ORDER = "_key", "_timestamp", "_headers", "_offset"


def to_ms(value: int | timedelta, name: str) -> int:
    if isinstance(value, timedelta):
        return round(value.total_seconds() * 1000)
    if not isinstance(value, int) or isinstance(value, bool):
        raise TypeError(f"{name} is an integer of milliseconds or a timedelta")
    return value


def window_ranges(time: int, duration: int, step: int) -> list[tuple[int, int]]:
    """Windows of a hopping definition that hold ``time``; none starts before 0."""
    first = max(0, (time - duration) // step + 1)
    return [(s * step, s * step + duration) for s in range(first, time // step + 1)]


def starts(time: Column, duration: int, step: int) -> Column:
    """The same as an array column; for tumbling windows of one."""
    if duration == step:
        return F.array(time - F.pmod(time, F.lit(step)))
    first = F.greatest(F.lit(0), F.floor((time - duration) / step) + 1)
    return F.when(time >= 0, F.transform(F.sequence(first, F.floor(time / step)), lambda s: s * step)).otherwise(F.array().cast("array<bigint>"))


class Definition:
    """What kind of window; ``agg`` or a shortcut makes it a window that can be emitted."""

    def __init__(self, frame: EventFrame, kind: str, name: str | None, triggers: dict[str, Any], **size: int):
        self.frame, self.kind, self.name, self.size, self.triggers = frame, kind, name, size, triggers
        by_time = kind in ("tumbling", "hopping", "sliding")
        if by_time:
            if size["duration"] < 1:
                raise ValueError("a duration is 1 ms at least")
            if size["grace"] < 0:
                raise ValueError("grace is not negative")
            if kind == "hopping" and not 0 < size["step"] < size["duration"]:
                raise ValueError("a step is positive and less than the duration")
            if kind == "sliding" and (triggers.get("before_update") or triggers.get("after_update")):
                raise ValueError("sliding windows have no triggers")
        else:
            if size["count"] < 2:
                raise ValueError("a count is 2 at least")
            if size["step"] < 1:
                raise ValueError("a step is 1 at least")

    def agg(self, **named: A.BaseAggregator) -> Windows:
        if not named:
            raise ValueError("no aggregation")
        if {"start", "end"} & set(named):
            raise ValueError("start and end are the window's own columns")
        return Windows(self, named, single=False)

    def _one(self, aggregator: A.BaseAggregator) -> Windows:
        return Windows(self, {"value": aggregator}, single=True)

    def sum(self) -> Windows:
        return self._one(A.Sum())

    def count(self) -> Windows:
        return self._one(A.Count())

    def mean(self) -> Windows:
        return self._one(A.Mean())

    def max(self) -> Windows:
        return self._one(A.Max())

    def min(self) -> Windows:
        return self._one(A.Min())

    def collect(self) -> Windows:
        return self._one(A.Collect())

    def reduce(self, reducer: Callable, initializer: Callable) -> Windows:
        return self._one(A.Reduce(reducer, initializer))


class Windows:
    """Windows with aggregations: ``final`` emits closed ones, ``current`` every update."""

    def __init__(self, definition: Definition, named: dict[str, A.BaseAggregator], single: bool):
        self.definition, self.named, self.single = definition, named, single

    def final(self, closing_strategy: str = "key") -> EventFrame:
        return self._emit(closing_strategy, False)

    def current(self, closing_strategy: str = "key") -> EventFrame:
        if any(a.collects for a in self.named.values()):
            raise ValueError("collectors are emitted by final only")
        return self._emit(closing_strategy, True)

    def late(self) -> DataFrame:
        """Records with the window they came too late for (``start``, ``end``, ``late_by_ms``), under key closing."""
        d = self.definition
        if d.kind not in ("tumbling", "hopping"):
            raise ValueError("late records are told for tumbling and hopping windows")
        found = self._dealt().where("late__")
        closed = F.col("running__") - d.size["grace"]
        return found.select(*d.frame.df.columns, F.col("start__").alias("start"), (F.col("start__") + d.size["duration"]).alias("end"), (closed - F.col(TIME)).alias("late_by_ms"))

    # plans

    def _emit(self, closing: str, current: bool) -> EventFrame:
        d = self.definition
        if closing not in ("key", "partition"):
            raise ValueError("closing strategies are key and partition")
        if d.frame.df.isStreaming:
            from ..streaming.windows import stream_windows

            return d.frame._derived(stream_windows(d, self.named, closing, current, self._columns()), ordered=False)
        if d.triggers.get("before_update") or d.triggers.get("after_update"):
            from ..streaming.windows import replay_windows

            return d.frame._derived(replay_windows(d, self.named, current, self._columns()), ordered=False)
        if d.kind == "sliding" and closing != "key":
            raise ValueError("sliding windows close by key")
        rows = {"tumbling": self._timed, "hopping": self._timed, "sliding": self._sliding, "count": self._counted}[d.kind](closing, current)
        out = rows.select(KEY, F.col("start").cast("long").alias(TIME), F.lit(None).cast(d.frame.header_type).alias(HEADERS), F.col("order__").alias(ORDER), *self._columns())
        return d.frame._derived(out, ordered=not current)

    def _columns(self) -> list[str]:
        if self.single:
            return ["start", "end", "value"]
        plain = [n for n, a in self.named.items() if not a.collects]
        return [*plain, *(n for n, a in self.named.items() if a.collects), "start", "end"]

    def _partials(self) -> list[Column]:
        r = self.definition.frame.record()
        return [a.partial(r).alias(f"{n}__p") for n, a in self.named.items()]

    def _results(self, df: DataFrame) -> DataFrame:
        return df.withColumns({n: a.result(F.col(f"{n}__p")) for n, a in self.named.items()})

    def _rows(self) -> DataFrame:
        return self.definition.frame.df.where(F.col(KEY).isNotNull())

    def _dealt(self) -> DataFrame:
        """A row for each record and window, with ``late__``: closed for its key before the record came."""
        d = self.definition
        duration, step = d.size["duration"], d.size["step"]
        rows = self._rows()
        if d.frame.ordered:
            rows = rows.withColumn("running__", F.col(TIME))
        else:
            rows = running(rows, KEY, ORDER, {"running__": (F.col(TIME), "max")}, d.frame.stretch)
        rows = rows.withColumn("start__", F.explode(starts(F.col(TIME), duration, step)))
        return rows.withColumn("late__", F.col("start__") <= F.col("running__") - d.size["grace"] - duration)

    def _timed(self, closing: str, current: bool) -> DataFrame:
        d = self.definition
        duration, step, grace = (d.size[x] for x in ("duration", "step", "grace"))
        frame = d.frame
        if current:
            line = W.partitionBy(KEY, "start__").orderBy(ORDER).rowsBetween(W.unboundedPreceding, 0)
            rows = self._dealt().where("not late__")
            rows = rows.select("*", *[p.over(line).alias(f"{n}__p") for n, p in zip(self.named, (a.partial(frame.record()) for a in self.named.values()), strict=True)])
            rows = self._results(rows).withColumns({"start": F.col("start__"), "end": F.col("start__") + duration, "order__": F.col(ORDER)})
            return rows
        times = [F.max(TIME).alias("last__"), F.max(ORDER).alias("order__")]
        if frame.ordered and duration != step:
            pane = math.gcd(duration, step)
            panes = self._rows().groupBy(KEY, (F.col(TIME) - F.pmod(TIME, F.lit(pane))).alias("pane__")).agg(*self._partials(), *times)
            first = F.greatest(F.lit(0), F.floor((F.col("pane__") + pane - duration - 1) / step) + 1)
            windows = panes.where("pane__ >= 0").withColumn("start__", F.explode(F.transform(F.sequence(first, F.floor(F.col("pane__") / step)), lambda s: s * step)))
            windows = windows.where(F.col("pane__") < F.col("start__") + duration)
            grouped = windows.groupBy(KEY, "start__").agg(*[a.merge(F.col(f"{n}__p")).alias(f"{n}__p") for n, a in self.named.items()], F.max("last__").alias("last__"), F.max("order__").alias("order__"))
        elif frame.ordered:
            grouped = self._rows().groupBy(KEY, (F.col(TIME) - F.pmod(TIME, F.lit(step))).alias("start__")).agg(*self._partials(), *times)
        else:
            grouped = self._dealt().where("not late__").groupBy(KEY, "start__").agg(*self._partials(), *times)
        if closing == "key":
            clock = grouped.withColumn("clock__", F.max("last__").over(W.partitionBy(KEY))) if frame.ordered else self._clock(grouped)
            closed = clock.where(F.col("start__") <= F.col("clock__") - grace - duration)
        else:
            newest = self._rows().agg(F.max(TIME).alias("clock__"))  # one row
            clock = grouped.crossJoin(F.broadcast(newest))
            closed = clock.where(F.col("start__") + duration <= F.floor((F.col("clock__") - grace) / step) * step)
        return self._results(closed).withColumns({"start": F.col("start__"), "end": F.col("start__") + duration})

    def _clock(self, grouped: DataFrame) -> DataFrame:
        """Largest time of each key over all its records, late ones included."""
        newest = self._rows().groupBy(F.col(KEY).alias("key__")).agg(F.max(TIME).alias("clock__"))
        return grouped.join(newest, F.col(KEY) == F.col("key__")).drop("key__")

    def _sliding(self, closing: str, current: bool) -> DataFrame:
        d = self.definition
        duration, grace = d.size["duration"], d.size["grace"]
        rows = self._rows()
        if not d.frame.ordered:
            rows = running(rows, KEY, ORDER, {"running__": (F.col(TIME), "max")}, d.frame.stretch)
            rows = rows.where(F.col(TIME) > F.col("running__") - grace - 1 - duration)
        dealt = with_halo(rows, F.col(TIME), duration)
        span = W.partitionBy(KEY, "stretch__").orderBy(TIME).rangeBetween(-duration, 0)
        r = d.frame.record()
        found = dealt.select("*", *[a.partial(r).over(span).alias(f"{n}__p") for n, a in self.named.items()]).where("own__")
        order = W.partitionBy(KEY, "stretch__", TIME).orderBy(ORDER)
        found = found.withColumns({"first__": F.row_number().over(order), "order__": F.col(ORDER)})
        if not current:
            found = found.where("first__ = 1")
        found = found.withColumns({"start": F.greatest(F.lit(0), F.col(TIME) - duration), "end": F.col(TIME)})
        if not current:
            newest = self._rows().groupBy(F.col(KEY).alias("key__")).agg(F.max(TIME).alias("clock__"))
            found = found.join(newest, F.col(KEY) == F.col("key__")).where(F.col("start") <= F.col("clock__") - grace - 1 - duration)
        return self._results(found)

    def _counted(self, closing: str, current: bool) -> DataFrame:
        d = self.definition
        count, step = d.size["count"], min(d.size["step"], d.size["count"])
        rows = running(self._rows(), KEY, ORDER, {"number__": (F.lit(1), "count")}, d.frame.stretch).withColumn("number__", F.col("number__") - 1)
        n = F.col("number__")
        record = d.frame.record()
        by_order = {name: A.Collect(a.column, by_time=False) if type(a) is A.Collect else a for name, a in self.named.items()}
        extra = [F.min(TIME).alias("start"), F.max(TIME).alias("end"), F.count(F.lit(1)).alias("members__"), F.max(ORDER).alias("order__")]
        if step == 1 and not current:
            dealt = with_halo(rows, n, count)
            span = W.partitionBy(KEY, "stretch__").orderBy("number__").rowsBetween(1 - count, 0)
            found = dealt.select("*", *[a.partial(record).over(span).alias(f"{name}__p") for name, a in by_order.items()], F.min(TIME).over(span).alias("start"), F.max(TIME).over(span).alias("end"), F.col(ORDER).alias("order__"))
            found = found.where(F.col("own__") & (n >= count - 1))
        else:
            first, last = F.greatest(F.lit(0), F.ceil((n - count + 1) / step)), F.floor(n / step)
            dealt = rows.withColumn("window__", F.explode(F.sequence(first, last)) if step < count else F.floor(n / count))
            if current:
                line = W.partitionBy(KEY, "window__").orderBy(ORDER).rowsBetween(W.unboundedPreceding, 0)
                found = dealt.select("*", *[a.partial(record).over(line).alias(f"{name}__p") for name, a in by_order.items()], F.min(TIME).over(line).alias("start"), F.max(TIME).over(line).alias("end"), F.col(ORDER).alias("order__"))
            else:
                found = dealt.groupBy(KEY, "window__").agg(*[a.partial(record).alias(f"{name}__p") for name, a in by_order.items()], *extra).where(F.col("members__") == count)
        return found.withColumns({name: a.result(F.col(f"{name}__p")) for name, a in by_order.items()})
