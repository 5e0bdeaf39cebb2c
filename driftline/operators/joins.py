"""As-of, interval and lookup joins over batch frames, as in a replay by (time, right before left, arrival).

With ``by_arrival`` the replay is by ``_offset`` instead, one order of arrival for both sides (records of one log): a
record meets only what arrived before it, and may come late.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Callable, Iterator
from typing import TYPE_CHECKING, Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..errors import ColumnOverlap, InvalidOperation
from .windows import HEADERS, KEY, ORDER, TIME, to_ms

if TYPE_CHECKING:
    from ..frame import EventFrame

Merge = str | Callable[[Column, Column], Column]


def check(left: EventFrame, right: EventFrame, how: str, hows: tuple[str, ...], on_merge: Merge) -> None:
    if how not in hows:
        raise ValueError(f"how is one of {', '.join(hows)}")
    if left.stream_id == right.stream_id or left.origins & right.origins:
        raise ValueError("a stream does not join with itself")
    if not callable(on_merge) and on_merge not in ("raise", "keep-left", "keep-right"):
        raise ValueError("merge policies are raise, keep-left, keep-right or a function")


def merged(left: EventFrame, right: EventFrame, on_merge: Merge, l: str = "l__", r: str = "r__") -> list[Column]:  # noqa: E741
    """Value columns of a joined row with the structs ``l`` and ``r`` (null where a side is missing)."""
    ours, theirs = left.value_columns, right.value_columns
    if callable(on_merge):
        return [on_merge(F.col(l), F.col(r)).alias("value")]
    both = sorted(set(ours) & set(theirs))
    if on_merge == "raise" and both:
        raise ColumnOverlap(f"columns on both sides: {', '.join(both)}")
    out = {c: F.col(l)[c] for c in ours} | {c: F.col(r)[c] for c in theirs if c not in both}
    for c in both:  # the losing side stands where the winner is missing
        win, lose, ours_win = (l, r, True) if on_merge == "keep-left" else (r, l, False)
        out[c] = F.when(F.col(win).isNotNull(), F.col(win)[c]).otherwise(F.col(lose)[c])
    return [v.alias(c) for c, v in out.items()]


def _side(frame: EventFrame, name: str) -> DataFrame:
    return frame.df.select(KEY, TIME, ORDER, HEADERS, F.struct(*[F.col(c) for c in frame.value_columns]).alias(name))


def _holds_something(struct: Column, frame: EventFrame) -> Column:
    """A record of nulls alone is falsy, as an empty or null one."""
    any_ = F.lit(False)
    for c in frame.value_columns:
        any_ = any_ | struct[c].isNotNull()
    return any_


def carried(rows: DataFrame, steps: DataFrame, key: str, at: str, order: list[str], split: int, value: str) -> DataFrame:
    """``rows`` with ``value`` of the last of ``steps`` of their key at or before their time; keys are not null.

    ``steps`` has ``key, at, order..., value``. One union and one window instead of a range join. Keys are cut into
    stretches of ``split`` of time, and a row for each stretch carries over what came before it, so a key with most
    of the rows is spread over its stretches.
    """
    names = rows.columns
    low = steps.select(key, at, *order, value, F.lit(0).alias("side__"))
    both = rows.withColumn("side__", F.lit(1)).unionByName(low, allowMissingColumns=True).withColumn("stretch__", F.floor(F.col(at) / split))
    line = W.partitionBy(key, "stretch__").orderBy(at, "side__", *order).rowsBetween(W.unboundedPreceding, 0)
    found = both.withColumn(value, F.last(value, ignorenulls=True).over(line)).where("side__ = 1")
    ends = low.groupBy(F.col(key).alias("key__"), F.floor(F.col(at) / split).alias("from__")).agg(F.max_by(value, F.struct(at, *order)).alias("end__"))
    # the last end before each stretch that has rows: those stretches and the ends in one line, one row each
    asked = rows.select(F.col(key).alias("key__"), F.floor(F.col(at) / split).alias("from__")).distinct().withColumn("asks__", F.lit(True))
    over = W.partitionBy("key__").orderBy("from__").rowsBetween(W.unboundedPreceding, -1)
    before = ends.join(asked, ["key__", "from__"], "full").withColumn("before__", F.last("end__", ignorenulls=True).over(over)).where("asks__").select("key__", "from__", "before__")
    joined = found.join(before, (F.col(key) == F.col("key__")) & (F.col("stretch__") == F.col("from__")), "left")
    return joined.withColumn(value, F.coalesce(value, "before__")).select(*names, value)


def asof(left: EventFrame, right: EventFrame, how: str = "inner", on_merge: Merge = "raise", grace_ms: Any = 7 * 86_400_000, split_ms: Any = 7 * 86_400_000, by_arrival: bool = False) -> EventFrame:
    """Each left record with the last right record of its key at or before its time (``carried``).

    In a replay in time order the grace period never hides the newest right record, so it is checked and not used.
    By arrival, of the right records that came before, those more than ``grace_ms`` older than the newest are gone,
    and a right record takes the place of an earlier one of its time. Left records without a key match nothing.
    """
    check(left, right, how, ("inner", "left"), on_merge)
    grace = to_ms(grace_ms, "grace_ms")
    columns = merged(left, right, on_merge)
    a, b = _side(left, "l__"), _side(right, "r__").where(F.col(KEY).isNotNull())
    if by_arrival:
        found = _asof_by_arrival(a, b, grace)
    else:
        found = carried(a.where(F.col(KEY).isNotNull()), b, KEY, TIME, [ORDER], to_ms(split_ms, "split_ms"), "r__")
    found = found.withColumn("r__", F.when(_holds_something(F.col("r__"), right), F.col("r__")))
    if how == "inner":
        found = found.where("r__ is not null")
    else:
        found = found.unionByName(a.where(F.col(KEY).isNull()).withColumn("r__", F.lit(None).cast(b.schema["r__"].dataType)))
    return left._derived(found.select(KEY, TIME, HEADERS, ORDER, *columns), origins=left.origins | right.origins)


def _asof_by_arrival(a: DataFrame, b: DataFrame, grace: int) -> DataFrame:
    """A replay of each key's times alone finds the partner's place; the records are then joined by place."""
    slim = a.where(F.col(KEY).isNotNull()).select(KEY, TIME, ORDER, F.lit(1).alias("side__"))
    both = slim.unionByName(b.select(KEY, TIME, ORDER, F.lit(0).alias("side__")))

    def find(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, times, places, newest = None, [], {}, 0
        for pdf in pdfs:
            out = []
            for key, time, order, side in zip(*(pdf[c].tolist() for c in (KEY, TIME, ORDER, "side__")), strict=True):
                if key != last:
                    last, times, places, newest = key, [], {}, 0
                if side == 0:
                    if time not in places:
                        insort(times, time)
                    places[time] = order
                    newest = max(newest, time)
                    gone = bisect_left(times, newest - grace)
                    if gone > 1024:  # what no record can meet any more
                        for t in times[:gone]:
                            del places[t]
                        del times[:gone]
                    continue
                k = bisect_right(times, time)
                if k and times[k - 1] >= newest - grace:
                    out.append((key, time, order, times[k - 1], places[times[k - 1]]))
            yield pd.DataFrame(out, columns=["key__", "at__", "order__", "time__", "place__"])

    kind = a.schema[KEY].dataType.simpleString()
    dealt = both.repartition(KEY).sortWithinPartitions(KEY, ORDER, "side__")
    found = dealt.mapInPandas(find, f"key__ {kind}, at__ bigint, order__ bigint, time__ bigint, place__ bigint")
    partner = b.select(F.col(KEY).alias("rk__"), F.col(TIME).alias("time__"), F.col(ORDER).alias("place__"), "r__")
    met = found.join(partner, (F.col("key__") == F.col("rk__")) & (found["time__"] == partner["time__"]) & (found["place__"] == partner["place__"])).select("key__", "at__", "order__", "r__")
    rows = a.where(F.col(KEY).isNotNull())
    return rows.join(met, (F.col(KEY) == F.col("key__")) & (F.col(TIME) == F.col("at__")) & (F.col(ORDER) == F.col("order__")), "left").select(*a.columns, "r__")


def interval(left: EventFrame, right: EventFrame, how: str = "inner", on_merge: Merge = "raise", grace_ms: Any = 7 * 86_400_000, backward_ms: Any = 0, forward_ms: Any = 0, by_arrival: bool = False) -> EventFrame:
    """Pairs with the right time from ``backward`` before to ``forward`` after the left one, as they meet.

    Unmatched records come out when they arrive, even if a match comes later: left records with no right one in the
    backward range, right records with no earlier left one in the forward range (of equal times the right comes
    first). By arrival, a pair is one whose later arrival is not older. Time buckets as wide as the range are part
    of the join key, so a key's records spread over tasks and a record meets only those near it.
    """
    check(left, right, how, ("inner", "left", "right", "outer"), on_merge)
    grace, back, ahead = to_ms(grace_ms, "grace_ms"), to_ms(backward_ms, "backward_ms"), to_ms(forward_ms, "forward_ms")
    if back > grace:
        raise ValueError("backward_ms is not more than grace_ms")
    if min(back, ahead, grace) < 0:
        raise ValueError("ranges are not negative")
    columns = merged(left, right, on_merge)
    width = max(1, back + ahead)
    bucket = lambda c: F.floor(c / width)
    a = _side(left, "l__").withColumnsRenamed({KEY: "lk__", TIME: "lt__", ORDER: "lo__", HEADERS: "lh__"})
    b = _side(right, "r__").withColumnsRenamed({KEY: "rk__", TIME: "rt__", ORDER: "ro__", HEADERS: "rh__"})
    near = a.withColumn("at__", F.explode(F.sequence(bucket(F.col("lt__") - back), bucket(F.col("lt__") + ahead))))
    placed = b.withColumn("at__", bucket(F.col("rt__")))
    same = (F.col("lk__") == F.col("rk__")) & (near["at__"] == placed["at__"])
    pairs = near.join(placed, same & F.col("rt__").between(F.col("lt__") - back, F.col("lt__") + ahead))
    right_first = F.col("rt__") <= F.col("lt__")
    if by_arrival:
        right_first = F.col("ro__") < F.col("lo__")
        pairs = pairs.where(F.when(right_first, F.col("rt__") <= F.col("lt__")).otherwise(F.col("rt__") >= F.col("lt__")))
    key = lambda side: F.col(f"{side}k__").alias(KEY)
    no_headers = F.lit(None).cast(left.header_type).alias(HEADERS)
    out = pairs.select(key("l"), F.greatest("lt__", "rt__").alias(TIME), no_headers, F.when(right_first, F.col("lo__")).otherwise(F.col("ro__")).alias(ORDER), *columns)

    def alone(rows: DataFrame, side: str, first: Column) -> DataFrame:
        """Records of a side that met nothing that came first; the pairs' exchanges serve again."""
        mine = [f"{side}{x}__" for x in "kto"]
        hits = pairs.where(first).select(*[F.col(c).alias(f"h{c}") for c in mine]).distinct()
        k, t, o = mine
        return rows.join(hits, F.col(k).eqNullSafe(F.col(f"h{k}")) & (F.col(t) == F.col(f"h{t}")) & F.col(o).eqNullSafe(F.col(f"h{o}")), "left_anti")

    if how in ("left", "outer"):
        rest = alone(a, "l", right_first).withColumn("r__", F.lit(None).cast(b.schema["r__"].dataType))
        out = out.unionByName(rest.select(key("l"), F.col("lt__").alias(TIME), no_headers, F.col("lo__").alias(ORDER), *columns))
    if how in ("right", "outer"):
        rest = alone(b, "r", ~right_first).withColumn("l__", F.lit(None).cast(a.schema["l__"].dataType))
        out = out.unionByName(rest.select(key("r"), F.col("rt__").alias(TIME), no_headers, F.col("ro__").alias(ORDER), *columns))
    return left._derived(out, origins=left.origins | right.origins, ordered=False)


class LookupField:
    """Columns of a reference table found by key: the first match as a struct, or all as an array of structs.

    ``on`` is the table's key column; ``order_by`` (ascending, or with ``descending``) says which match is first;
    ``default`` is what no match gives (null if not set; an empty array for all).
    """

    def __init__(self, table: str, columns: list[str], on: str, order_by: str | None = None, descending: bool = False, default: Any = None, first_match_only: bool = True):
        if not columns:
            raise ValueError("no columns")
        self.table, self.columns, self.on = table, columns, on
        self.order_by, self.descending, self.default, self.first_match_only = order_by, descending, default, first_match_only


class QueryField:
    """Rows of a SQL query over the tables; ``on`` is the result column that the key is matched with."""

    def __init__(self, query: str, on: str, default: Any = None, first_match_only: bool = True):
        self.query, self.on, self.default, self.first_match_only = query, on, default, first_match_only


class TableLookup:
    """Reference tables by name: DataFrames, or a function of the name that gives one (a JDBC read, say).

    In a streaming frame the tables are read again for each micro-batch, which is the refresh.
    """

    def __init__(self, tables: dict[str, DataFrame] | Callable[[str], DataFrame]):
        self.table = tables.__getitem__ if isinstance(tables, dict) else tables

    @classmethod
    def jdbc(cls, spark: Any, url: str, **options: str) -> TableLookup:
        return cls(lambda name: spark.read.format("jdbc").options(url=url, dbtable=name, **options).load())

    def join(self, frame: EventFrame, fields: dict[str, LookupField | QueryField], on: str | Callable | Column | None) -> DataFrame:
        df = frame.df
        key = F.col(KEY) if on is None else F.col(on) if isinstance(on, str) else on if isinstance(on, Column) else on(F.struct(*[F.col(c) for c in frame.value_columns]), F.col(KEY))
        df = df.withColumn("on__", key)
        for name, field in fields.items():
            if isinstance(field, QueryField):
                rows = df.sparkSession.sql(field.query)
                found = rows.select(F.col(field.on).alias("key__"), F.struct(*[F.col(c) for c in rows.columns]).alias("found__"), F.lit(0).alias("order__"))
            else:
                rows = self.table(field.table)
                order = F.col(field.order_by) if field.order_by else F.lit(0)
                found = rows.select(F.col(field.on).alias("key__"), F.struct(*[F.col(c) for c in field.columns]).alias("found__"), order.alias("order__"))
            descending = isinstance(field, LookupField) and field.descending
            if field.first_match_only:
                pick = F.max_by if descending else F.min_by
                one = found.groupBy("key__").agg(pick("found__", F.struct(F.col("order__"))).alias(name))
            else:
                listed = F.sort_array(F.collect_list(F.struct("order__", "found__")), asc=not descending)
                one = found.groupBy("key__").agg(F.transform(listed, lambda x: x["found__"]).alias(name))
            df = df.drop(name).join(one, F.col("on__") == F.col("key__"), "left").drop("key__")  # Spark broadcasts it if its size allows
            if field.first_match_only and field.default is not None:
                df = df.withColumn(name, F.coalesce(name, F.struct(*[F.lit(field.default.get(c)).cast(t.dataType).alias(c) for c, t in zip(one.schema[name].dataType.names, one.schema[name].dataType.fields, strict=True)])))
            if not field.first_match_only:
                df = df.withColumn(name, F.coalesce(name, F.array().cast(one.schema[name].dataType)))
        return df.drop("on__")


class JSONField:
    """A value at ``jsonpath`` in the content of a configuration of ``type``; ``default`` if there is none."""

    def __init__(self, type: str, jsonpath: str = "$", default: Any = None):  # noqa: A002
        self.type, self.jsonpath, self.default = type, jsonpath, default


class BytesField:
    """The content of a configuration of ``type`` as it is."""

    def __init__(self, type: str, default: bytes | None = None):  # noqa: A002
        self.type, self.default = type, default


class ConfigurationLookup:
    """Versioned configurations: ``type, target_key, version, valid_from, event, content``.

    For a record, the highest version of its key (or else of target ``*``) whose ``valid_from`` is null or at or
    before the record's time; configurations deleted later in the event log (same type, key and version) are out.
    """

    def __init__(self, events: DataFrame):
        gone = events.where("event = 'deleted'").select("type", "target_key", "version").distinct()
        live = events.where("event <> 'deleted'").join(gone, ["type", "target_key", "version"], "left_anti")
        self.versions = live.groupBy("type", "target_key", "version").agg(F.max(F.struct(F.coalesce("valid_from", F.lit(0)).alias("valid_from"), "content")).alias("v"))
        self.versions = self.versions.select("type", "target_key", "version", "v.valid_from", "v.content")

    def join(self, frame: EventFrame, fields: dict[str, JSONField | BytesField], on: str | Callable | Column | None) -> DataFrame:
        df = frame.df
        key = F.col(KEY) if on is None else F.col(on) if isinstance(on, str) else on if isinstance(on, Column) else on(F.struct(*[F.col(c) for c in frame.value_columns]), F.col(KEY))
        df = df.withColumn("on__", key.cast("string"))
        for kind in dict.fromkeys(f.type for f in fields.values()):
            own = self.versions.where(F.col("type") == kind)
            # versions of a key in order of validity, each with the highest version so far: a step function of time
            line = W.partitionBy("target_key").orderBy("valid_from", "version").rowsBetween(W.unboundedPreceding, 0)
            best = own.withColumn("best", F.max(F.struct("version", "content")).over(line))
            steps = best.select(F.col("target_key").alias("on__"), F.col("valid_from").alias(TIME), "version", F.struct(F.col("best.content").alias("content")).alias("found__"))
            df = self._with_any(self._with_own(df, steps), steps)
            for name, f in fields.items():
                if f.type == kind:
                    value = F.get_json_object(F.col("content__"), f.jsonpath) if isinstance(f, JSONField) else F.col("content__").cast("binary")
                    df = df.withColumn(name, F.coalesce(value, F.lit(f.default)) if f.default is not None else value)
            df = df.drop("content__", "found__")
        return df.drop("on__")

    def _with_own(self, df: DataFrame, steps: DataFrame) -> DataFrame:
        """``found__``: the step of the record's key; as-of in a batch, from the key's list of steps in a stream."""
        if not df.isStreaming:
            known = df.where(F.col("on__").isNotNull())
            out = carried(known, steps, "on__", TIME, ["version"], 7 * 86_400_000, "found__")
            return out.unionByName(df.where(F.col("on__").isNull()), allowMissingColumns=True)
        listed = steps.groupBy(F.col("on__").alias("key__")).agg(_steps().alias("steps__"))
        return df.join(listed, F.col("on__") == F.col("key__"), "left").withColumn("found__", _step_at("steps__")).drop("key__", "steps__")

    def _with_any(self, df: DataFrame, steps: DataFrame) -> DataFrame:
        """``content__``: of the step found, or of target ``*``, whose steps are one row that goes everywhere."""
        any_ = steps.where("on__ = '*'")
        if (n := any_.count()) > 100_000:
            raise InvalidOperation(f"{n} versions for target * are too many to send everywhere")
        if not n:
            return df.withColumn("content__", F.col("found__.content"))
        row = F.broadcast(any_.agg(_steps().alias("steps__")))
        return df.join(row).withColumn("content__", F.when(F.col("found__").isNotNull(), F.col("found__.content")).otherwise(_step_at("steps__")["content"])).drop("steps__")


def _steps() -> Column:
    return F.sort_array(F.collect_list(F.struct(F.col(TIME).alias("t"), "version", "found__")))


def _step_at(steps: str) -> Column:
    past = F.filter(steps, lambda s: s["t"] <= F.col(TIME))
    return F.when(F.size(past) > 0, F.element_at(past, -1)["found__"])


def concat(left: EventFrame, right: EventFrame) -> EventFrame:
    if left.stream_id == right.stream_id:
        raise InvalidOperation("a frame is not added to itself")
    out = left.df.unionByName(right.df, allowMissingColumns=True)
    return left._derived(out, origins=left.origins | right.origins, ordered=False, fresh=True)
