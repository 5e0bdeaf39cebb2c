"""Secret scans (operator 7): strong patterns, and weak parts that count only together.

Strong (base) findings are spans of three patterns. Weak parts have a role each: access identifiers, secrets and
endpoints. Parts are joined by interval within a scope (a stretch of code points around each part); an identifier or
a secret is reported where a part of the complementary role lies in its scope, an endpoint where both do. Strong
findings take part in the join with their roles, and are reported anyway.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chosen, column, fields_of, free_name, kept_as, map_arrow

#: The patterns of the base kinds, in their order.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
BASE = ("assign", "access", "hex")
WEAK = ("identifier", "secret", "endpoint")

_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_NAMED = re.compile(r"""(?:user(?:name)?|login|client_?id|account_?id|access_?key(?:_?id)?)["']?\x20*[:=]\x20*["']?([A-Za-z0-9@+/_.-]{3,})""", re.ASCII | re.IGNORECASE)
_NAMES = ("user", "login", "clientid", "client_id", "accountid", "account_id", "accesskey", "access_key")
_LONG = re.compile(r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/]*[0-9])(?=[0-9a-z+/]*[A-Z])(?=[0-9A-Z+/]*[a-z])[A-Za-z0-9+/]{24,}={0,2}(?![A-Za-z0-9+/_=-])")
_ENDPOINT = re.compile(r"\b[a-z][a-z0-9+.-]{1,15}://[^\s\"'<>]{3,}|\b(?:[a-z0-9-]{1,63}\.){1,10}[a-z]{2,6}:[0-9]{2,5}\b", re.ASCII)


@dataclass(frozen=True, order=True)
class Span:
    start: int
    order: int
    end: int
    kind: str
    role: str


def base_spans(text: str) -> list[Span]:
    """Spans of the base kinds, by start, then kind: leftmost non-overlapping matches of each, short ones dropped."""
    out = []
    low = text.lower()
    if any(w in low for w in _WORDS):
        out += [Span(m.start(), 0, m.end(), "assign", "secret") for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        out += [Span(m.start(), 1, m.end(), "access", "identifier") for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    if any(len(w) >= 16 and HEX.search(w) for w in text.split()):
        out += [Span(m.start(), 2, m.end(), "hex", "secret") for m in HEX.finditer(text)]
    return sorted(out)


def weak_parts(text: str, base: list[Span]) -> list[Span]:
    """Candidates that say little alone: short assignments, named identifiers, long mixed strings, endpoints.

    A host has up to ten labels. Candidates that overlap a base span are left out.
    """
    out = []
    low = text.lower()
    if any(w in low for w in _WORDS):
        out += [Span(m.start(), 4, m.end(), "secret", "secret") for m in ASSIGN.finditer(text) if 4 <= len(m[2]) < 12]
    if any(len(w) >= 24 for w in text.split()):
        out += [Span(m.start(), 4, m.end(), "secret", "secret") for m in _LONG.finditer(text)]
    if "AKIA" in text:
        out += [Span(m.start(), 3, m.end(), "identifier", "identifier") for m in ACCESS.finditer(text) if 12 <= m.end() - m.start() < 18]
    if any(w in low for w in _NAMES):
        out += [Span(m.start(), 3, m.end(), "identifier", "identifier") for m in _NAMED.finditer(text)]
    if "://" in text or ":" in text and re.search(r"\.[a-z]{2,6}:[0-9]", text):
        out += [Span(m.start(), 5, m.end(), "endpoint", "endpoint") for m in _ENDPOINT.finditer(text)]
    taken = sorted((s.start, s.end) for s in base)
    reach = list(accumulate((end for _, end in taken), max))  # the furthest end so far

    def free(s: Span) -> bool:
        i = bisect_left(taken, (s.end, 0))
        return not i or reach[i - 1] <= s.start

    return sorted(s for s in out if free(s))


def linked(weak: list[Span], base: list[Span], scope: int) -> list[Span]:
    """The weak parts with their complements in scope: an interval join by one sweep over the sorted parts."""
    if not weak:
        return []
    parts = sorted([*weak, *base])
    near: dict[Span, set[str]] = {s: set() for s in parts}
    last: dict[str, int] = {}  # by role: the furthest end of the parts that begin before
    for s in parts:
        near[s] |= {r for r, end in last.items() if s.start - end <= scope}
        last[s.role] = max(last.get(s.role, s.end), s.end)
    first: dict[str, int] = {}  # by role: the nearest start of the parts that begin after
    for s in reversed(parts):
        near[s] |= {r for r, start in first.items() if start - s.end <= scope}
        first[s.role] = s.start
    needs = {"identifier": ({"secret"},), "secret": ({"identifier"}, {"endpoint"}), "endpoint": ({"identifier", "secret"},)}
    return [s for s in weak if any(n <= near[s] for n in needs[s.role])]


def scan_text(text: str, scope: int = 300) -> tuple[list[Span], list[Span]]:
    """Base spans and added spans of one text."""
    base = base_spans(text)
    return base, linked(weak_parts(text, base), base, scope)


def scan(docs: DataFrame, scope: int = 300, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """Per row: the columns ``keep`` and ``found``, an array of (kind, role, start, end, base) by start and kind.

    Offsets are code points, ends exclusive. Map-only; whole texts. Null texts count as empty and have no spans;
    repeated rows and null keys stay; an empty table gives no rows; other columns are not read.
    """
    names = kept_as(keep, ["found"])
    at = free_name(list(names), "text_")
    slim = docs.select(*chosen(keep, names), F.coalesce(column(text), F.lit("")).alias(at))
    fields = fields_of(slim.drop(at))
    entry = pa.struct([("kind", pa.string()), ("role", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for t in batch.column(batch.num_columns - 1):
                base, more = scan_text(t.as_py(), scope)
                strong = set(base)
                out.append([{"kind": s.kind, "role": s.role, "start": s.start, "end": s.end, "base": s in strong} for s in sorted([*base, *more])])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out, pa.list_(entry))], names=[*names, "found"])

    return map_arrow(slim, run, ", ".join([*fields, "found array<struct<kind:string,role:string,start:bigint,end:bigint,base:boolean>>"]))


def digest(found: DataFrame) -> DataFrame:
    """The columns of ``found`` but for the array, with counts of base kinds, the base digest and all spans as text."""
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("found", lambda s: s["base"])
    counts = [F.size(F.filter(base, lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}") for k in BASE]  # noqa: B023
    return found.select(*[c for c in found.columns if c != "found"], *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"))


