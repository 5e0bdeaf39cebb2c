"""Windows of one key as records arrive, one by one: the sequential rules, in plain Python.

The stateful processors and the batch replay with triggers run this; its state is a plain dict.
"""

from __future__ import annotations

from bisect import insort
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from ..operators import aggregations as A
from ..operators.windows import window_ranges


class Fold:
    """One aggregator as a step function over records; state is None before the first."""

    def __init__(self, a: A.BaseAggregator):
        self.a = a

    def value(self, value: Any) -> Any:
        return value if self.a.column is None else (value or {}).get(self.a.column)

    def step(self, s: Any, value: Any, time: int, order: int) -> Any:
        a, v = self.a, self.value(value)
        if isinstance(a, A.Reduce):
            return (a.initializer(v) if s is None else a.reducer(s, v),) if not isinstance(s, tuple) else (a.initializer(v) if s[0] is None else a.reducer(s[0], v),)
        if isinstance(a, A._Listed):
            keyed = (time, order) if not isinstance(a, A.Collect) or a.by_time else (order, order)
            return [*(s or []), (keyed, time, v)]
        if v is None:
            return s
        if isinstance(a, A.Count):
            return (s or 0) + 1
        if isinstance(a, A.Sum):
            return v if s is None else s + v
        if isinstance(a, A.Mean):
            return (float(v), 1) if s is None else (s[0] + v, s[1] + 1)
        if isinstance(a, A.Max):
            return v if s is None or v > s else s
        if isinstance(a, A.Min):
            return v if s is None or v < s else s
        if isinstance(a, A.Earliest):
            return ((time, order), v) if s is None or (time, order) < s[0] else s
        if isinstance(a, A.Latest):
            return ((time, order), v) if s is None or (time, order) >= s[0] else s
        if isinstance(a, A.First):
            return ((order,), v) if s is None or (order,) < s[0] else s
        if isinstance(a, A.Last):
            return ((order,), v) if s is None or (order,) >= s[0] else s
        raise TypeError(f"no fold for {type(a).__name__}")

    def result(self, s: Any) -> Any:
        a = self.a
        if isinstance(a, A.Count | A.Sum):
            return s or 0
        if isinstance(a, A.Mean):
            return None if s is None else s[0] / s[1]
        if isinstance(a, A.Reduce):
            return None if s is None else s[0]
        if isinstance(a, A._Placed):
            return None if s is None else s[1]
        if isinstance(a, A._Listed):
            items = sorted(s or [], key=lambda x: x[0])
            if isinstance(a, A.Collector):
                return a.finish([v for _, _, v in items])
            if isinstance(a, A.Aggregator):
                state = a.initialize()
                for _, time, v in sorted(s or [], key=lambda x: x[0][1]):
                    if v is not None:
                        state = a.agg(state, v, time)
                return a.finish(state)
            return [v for _, _, v in items]
        return s


@dataclass
class Engine:
    """Windows of a definition; ``process`` takes a record and gives what it closes (or, with ``current``, updates)."""

    kind: str
    size: dict[str, int]
    named: dict[str, A.BaseAggregator]
    single: bool
    current: bool = False
    before_update: Callable | None = None
    after_update: Callable | None = None
    on_late: Callable | None = None
    folds: dict[str, Fold] = field(default_factory=dict)

    def __post_init__(self) -> None:
        by_order = self.kind == "count"
        self.folds = {n: Fold(A.Collect(a.column, by_time=False) if by_order and type(a) is A.Collect else a) for n, a in self.named.items()}

    def fresh(self) -> dict:
        return {"latest": 0, "windows": {}, "rows": [], "done": -1, "open": []}

    def _empty(self) -> dict:
        return dict.fromkeys(self.folds)

    def _step(self, states: dict, value: Any, time: int, order: int, only: bool | None = None) -> dict:
        return {n: f.step(states.get(n), value, time, order) if only is None or f.a.collects == only else states.get(n) for n, f in self.folds.items()}

    def _results(self, states: dict) -> dict:
        return {n: f.result(states.get(n)) for n, f in self.folds.items()}

    def _shown(self, states: dict) -> Any:
        """What triggers see: the one value, or values by name."""
        plain = {n: f.result(states.get(n)) for n, f in self.folds.items() if not f.a.collects} or self._results(states)
        return plain["value"] if self.single else plain

    def process(self, s: dict, value: Any, key: Any, time: int, headers: Any, order: int) -> list[tuple[int, int, dict]]:
        """(start, end, results) in order of emission; triggered windows come first."""
        if self.kind == "count":
            return self._count(s, value, time, order)
        s["latest"] = max(s["latest"], time)
        if self.kind == "sliding":
            return self._slide(s, value, key, time, order)
        duration, step, grace = self.size["duration"], self.size["step"], self.size["grace"]
        closed = s["latest"] - grace - duration
        out, updated = [], []
        for start, end in window_ranges(time, duration, step):
            if start <= closed:
                self._late(value, key, start, end, time, s["latest"] - grace - time)
                continue
            states = s["windows"].get(start) or self._empty()
            if self.before_update and self.before_update(self._shown(states), value, key, time, headers):
                out.append((start, end, self._results(states)))
                # the record itself is not aggregated; what is collected stays for the window to come
                s["windows"][start] = self._step(self._kept(states), value, time, order, only=True)
                continue
            states = self._step(states, value, time, order)
            if self.after_update and self.after_update(self._shown(states), value, key, time, headers):
                out.append((start, end, self._results(states)))
                s["windows"][start] = self._kept(states)
                continue
            s["windows"][start] = states
            updated.append((start, end, self._results(states)))
        if self.current:
            out += updated
        for start in sorted(w for w in s["windows"] if w <= closed):
            states = s["windows"].pop(start)
            if not self.current and any(x is not None for n, x in states.items() if not self.folds[n].a.collects or len(self.folds) == 1 or self._only_collects()):
                out.append((start, start + duration, self._results(states)))
        return out

    def _only_collects(self) -> bool:
        return all(f.a.collects for f in self.folds.values())

    def _kept(self, states: dict) -> dict:
        """After a trigger: aggregates begin anew, collections stay."""
        return {n: states.get(n) if f.a.collects else None for n, f in self.folds.items()}

    def _late(self, value: Any, key: Any, start: int, end: int, time: int, late_by: int) -> None:
        if self.on_late:
            self.on_late(value, key, start, end, time, late_by)

    def _slide(self, s: dict, value: Any, key: Any, time: int, order: int) -> list[tuple[int, int, dict]]:
        duration, grace = self.size["duration"], self.size["grace"]
        bound = s["latest"] - grace - 1 - duration
        if time <= bound:
            self._late(value, key, max(0, time - duration), time, time, s["latest"] - grace - time)
            return []
        insort(s["rows"], (time, order, value), key=lambda r: r[:2])
        fold = lambda end: self._over([r for r in s["rows"] if end - duration <= r[0] <= end])
        if self.current:
            out = [(max(0, time - duration), time, fold(time))]
        else:
            ends = sorted({r[0] for r in s["rows"] if r[0] > s["done"] and max(0, r[0] - duration) <= bound})
            out = [(max(0, e - duration), e, fold(e)) for e in ends]
        s["done"] = max([s["done"], *(r[0] for r in s["rows"] if max(0, r[0] - duration) <= bound)])
        s["rows"] = [r for r in s["rows"] if r[0] > s["done"] - duration or r[0] > bound]
        return out

    def _over(self, rows: list[tuple]) -> dict:
        states = self._empty()
        for time, order, value in rows:
            states = self._step(states, value, time, order)
        return self._results(states)

    def _count(self, s: dict, value: Any, time: int, order: int) -> list[tuple[int, int, dict]]:
        count, step = self.size["count"], min(self.size["step"], self.size["count"])
        number = s["done"] + 1
        s["done"] = number
        if number % step == 0:
            s["open"].append({"n": 0, "start": time, "end": time, "states": self._empty()})
        out, left = [], []
        for w in s["open"]:
            w["n"] += 1
            w["start"], w["end"] = min(w["start"], time), max(w["end"], time)
            w["states"] = self._step(w["states"], value, time, order)
            full = w["n"] == count
            if full or self.current:
                out.append((w["start"], w["end"], self._results(w["states"])))
            if not full:
                left.append(w)
        s["open"] = left
        return out
