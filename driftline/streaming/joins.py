"""As-of and interval joins of streams: both sides in one stateful processor, records in order of a micro-batch.

What a record meets is what came before it: earlier micro-batches, and in its own those of smaller (time, side,
offset), the right side first. Inputs that are not aligned in time meet as they arrive.
"""

from __future__ import annotations

from bisect import bisect_right, insort
from typing import TYPE_CHECKING, Any

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import joins
from ..operators.state import plain
from ..operators.windows import HEADERS, KEY, ORDER, TIME
from .processors import KeyProcessor, keyed

if TYPE_CHECKING:
    from ..frame import EventFrame


class _Both(KeyProcessor):
    def __init__(self, columns: list[str], left: list[str], right: list[str], on_merge: str):
        super().__init__(columns)
        self.left, self.right, self.on_merge = left, right, on_merge

    def sides(self, pdf: pd.DataFrame) -> Any:
        pdf = pdf.sort_values([TIME, "side__", ORDER], kind="stable")
        for row in pdf.itertuples(index=False, name=None):
            c = dict(zip(pdf.columns, map(plain, row), strict=True))
            names, prefix = (self.right, "r__") if c["side__"] == 0 else (self.left, "l__")
            yield c["side__"], c[TIME], c[ORDER], c[HEADERS], {n: c[f"{prefix}{n}"] for n in names}

    def row(self, key: Any, time: int, headers: Any, order: int, left: dict | None, right: dict | None) -> tuple:
        both = [left or {}, right or {}] if self.on_merge != "keep-left" or left is None else [right or {}, left]
        merged = both[0] | both[1]
        return (key, time, headers, order, *(merged.get(c) for c in self.columns[4:]))


class Asof(_Both):
    def __init__(self, how: str, grace: int, *args: Any):
        super().__init__(*args)
        self.how, self.grace = how, grace

    def run(self, key: Any, pdf: pd.DataFrame, state: Any) -> tuple[list[tuple], Any]:
        rights, newest = state or ([], 0)  # (time, value), one for each time
        out = []
        for side, time, order, headers, value in self.sides(pdf):
            if side == 0:
                rights = [r for r in rights if r[0] != time]
                insort(rights, (time, value), key=lambda r: r[0])
                newest = max(newest, time)
                rights = [r for r in rights if r[0] >= newest - self.grace]
                continue
            k = bisect_right(rights, time, key=lambda r: r[0])
            match = rights[k - 1][1] if k and any(v is not None for v in rights[k - 1][1].values()) else None
            if match is not None or self.how == "left":
                out.append(self.row(key, time, headers, order, value, match))
        return out, (rights, newest)


class Interval(_Both):
    def __init__(self, how: str, grace: int, back: int, ahead: int, *args: Any):
        super().__init__(*args)
        self.how, self.grace, self.back, self.ahead = how, grace, back, ahead

    def run(self, key: Any, pdf: pd.DataFrame, state: Any) -> tuple[list[tuple], Any]:
        lefts, rights = state or ([], [])
        out = []
        for side, time, order, _, value in self.sides(pdf):
            if side == 0:
                met = [v for t, v in lefts if time - self.ahead <= t <= time]
                out += [self.row(key, time, None, order, v, value) for v in met]
                if not met and self.how in ("right", "outer"):
                    out.append(self.row(key, time, None, order, None, value))
                insort(rights, (time, value), key=lambda r: r[0])
            else:
                met = [v for t, v in rights if time - self.back <= t <= time]
                out += [self.row(key, time, None, order, value, v) for v in met]
                if not met and self.how in ("left", "outer"):
                    out.append(self.row(key, time, None, order, value, None))
                insort(lefts, (time, value), key=lambda r: r[0])
        keep = lambda rows: [r for r in rows if r[0] >= rows[-1][0] - self.grace] if rows else rows
        return out, (keep(lefts), keep(rights))


def _union(left: EventFrame, right: EventFrame) -> Any:
    a = left.df.select(KEY, TIME, HEADERS, ORDER, F.lit(1).alias("side__"), *[F.col(c).alias(f"l__{c}") for c in left.value_columns])
    b = right.df.select(KEY, TIME, HEADERS, ORDER, F.lit(0).alias("side__"), *[F.col(c).alias(f"r__{c}") for c in right.value_columns])
    return a.unionByName(b, allowMissingColumns=True)


def _schema(left: EventFrame, right: EventFrame, on_merge: joins.Merge) -> T.StructType:
    if callable(on_merge):
        raise ValueError("streams are merged by raise, keep-left or keep-right")
    joins.merged(left, right, on_merge)  # raises on overlap
    fields = [left.df.schema[c] for c in (KEY, TIME, HEADERS, ORDER, *left.value_columns)]
    fields += [right.df.schema[c] for c in right.value_columns if c not in left.value_columns]
    return T.StructType([T.StructField(f.name, f.dataType) for f in fields])


def stream_asof(left: EventFrame, right: EventFrame, how: str, on_merge: joins.Merge, grace: int) -> EventFrame:
    joins.check(left, right, how, ("inner", "left"), on_merge)
    schema = _schema(left, right, on_merge)
    run = Asof(how, grace, list(schema.names), left.value_columns, right.value_columns, on_merge)
    return left._derived(keyed(_union(left, right), run, schema), origins=left.origins | right.origins)


def stream_interval(left: EventFrame, right: EventFrame, how: str, on_merge: joins.Merge, grace: int, back: int, ahead: int) -> EventFrame:
    joins.check(left, right, how, ("inner", "left", "right", "outer"), on_merge)
    if back > grace:
        raise ValueError("backward_ms is not more than grace_ms")
    schema = _schema(left, right, on_merge)
    run = Interval(how, grace, back, ahead, list(schema.names), left.value_columns, right.value_columns, on_merge)
    return left._derived(keyed(_union(left, right), run, schema), origins=left.origins | right.origins, ordered=False)
