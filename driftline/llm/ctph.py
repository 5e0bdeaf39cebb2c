"""Context-triggered piecewise hashing (operator 10).

A rolling hash of the last seven bytes marks boundaries wherever its lowest bits are zero, so that boundaries
depend on the context alone. The pieces between them are hashed to a letter each. The block size (a power of two)
is the least one that gives at most 64 pieces; a signature is kept for it and for its double, so fingerprints
compare at equal block sizes or at one twice the other. Likeness is one minus edit distance over length.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chosen, column, fields_of, free_name, integer_key, kept_as, map_arrow

LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
WINDOW, MOST, LEAST_LEVEL = 7, 64, 2
_BLOCK = 1 << 20


def _rolling(data: np.ndarray) -> np.ndarray:
    """Mixed polynomial hash of the up to seven bytes that end at each place."""
    wide = data.astype(np.uint32)
    out = wide.copy()
    factor = 1
    for k in range(1, min(WINDOW, len(wide))):
        factor = factor * 0x01000193 & 0xFFFFFFFF
        out[k:] += wide[:-k] * np.uint32(factor)
    out ^= out >> np.uint32(15)
    out *= np.uint32(0x2C1B3C6D)
    out ^= out >> np.uint32(13)
    return out | np.uint32(1 << 31)


def fingerprint(text: str | None) -> str:
    """``block size:signature:signature at the double block size`` of a whole text; null counts as empty."""
    data = (text or "").encode("utf-8", "surrogatepass")
    level = max(LEAST_LEVEL, (len(data) // MOST).bit_length() - 3)
    places, hashes = [], []
    for at in range(0, len(data), _BLOCK):  # long texts in blocks that overlap by the window
        head = max(0, at - WINDOW + 1)
        part = _rolling(np.frombuffer(data, np.uint8, min(len(data), at + _BLOCK) - head, head))[at - head :]
        found = np.flatnonzero((part & np.uint32((1 << level) - 1)) == 0)
        places.append(found + at + 1)
        hashes.append(part[found])
    ends = np.concatenate(places) if places else np.empty(0, dtype=np.int64)
    marks = np.concatenate(hashes) if hashes else np.empty(0, dtype=np.uint32)
    while len(ends) >= MOST:
        level += 1
        keep = (marks & np.uint32((1 << level) - 1)) == 0
        ends, marks = ends[keep], marks[keep]
    coarse = ends[(marks & np.uint32((1 << (level + 1)) - 1)) == 0]
    return f"{1 << level}:{_signature(data, ends.tolist())}:{_signature(data, coarse.tolist())}"


def _signature(data: bytes, ends: list[int]) -> str:
    out, at = [], 0
    for end in [*ends, len(data)]:
        if end > at:
            out.append(LETTERS[zlib.crc32(data[at:end]) & 63])
        at = end
    return "".join(out)


def distance(a: str, b: str) -> int:
    """Edit distance (insert, delete, replace) of a string of at most 64 letters to another, a column in one word."""
    if not a or not b:
        return len(a) + len(b)
    full, top = (1 << len(a)) - 1, 1 << (len(a) - 1)
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    up, down, score = full, 0, len(a)
    for c in b:
        same = at.get(c, 0)
        diagonal = (((same & up) + up) ^ up) | same | down
        plus, minus = down | (full & ~(diagonal | up)), up & diagonal
        score += 1 if plus & top else -1 if minus & top else 0
        plus = (plus << 1) | 1
        up = (minus << 1 | (full & ~(diagonal | plus))) & full
        down = plus & diagonal & full
    return score


def likeness(one: str, other: str) -> float:
    """0 to 1: equal fingerprints 1; signatures at incompatible block sizes, or without three letters in a row alike, 0.

    The run of three is asked of signatures of twelve or more letters only.
    """
    if one == other:
        return 1.0
    (size, a, a2), (other_size, b, b2) = one.split(":"), other.split(":")
    if size != other_size:
        if int(size) == 2 * int(other_size):
            b = b2
        elif int(other_size) == 2 * int(size):
            a = a2
        else:
            return 0.0
    if not a or not b:
        return 1.0 if a == b else 0.0
    if min(len(a), len(b)) >= 12 and not {a[i : i + 3] for i in range(len(a) - 2)} & {b[i : i + 3] for i in range(len(b) - 2)}:
        return 0.0
    return max(0.0, 1.0 - distance(a, b) / max(len(a), len(b)))


def fingerprints(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """The columns ``keep`` and ``fingerprint`` of every row; map-only."""
    names = kept_as(keep, ["fingerprint"])
    at = free_name(list(names), "text_")
    slim = docs.select(*chosen(keep, names), column(text).alias(at))
    fields = fields_of(slim.drop(at))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = pa.array([fingerprint(t.as_py()) for t in batch.column(batch.num_columns - 1)], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], out], names=[*names, "fingerprint"])

    return map_arrow(slim, run, ", ".join([*fields, "fingerprint string"]))


def with_next(docs: DataFrame, key: str = "doc_id", text: str = "text", per_task: int = 8) -> DataFrame:
    """Rows in ranges of ``key`` (column ``to``), each range closed by a copy (``guest``) of the row that follows it.

    Bounds are approximate quantiles; only they and the least key of each range reach the driver, a few for each
    shuffle partition. The rows themselves move once. Rows of one key follow each other by text; null keys come
    last, in ranges of their texts' first seven bytes; after the last row comes the first.
    """
    spark = docs.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = per_task * tasks
    own, data = integer_key(docs, key), F.coalesce(column(text), F.lit(""))
    begin = F.conv(F.rpad(F.hex(F.substring(data.cast("binary"), 1, 7)), 14, "0"), 16, 10).cast("long")
    slim = docs.select(own.alias("id"), F.when(own.isNull(), begin).alias("begin"), data.alias("text"))
    shares = [i / ranges for i in range(1, ranges)]
    cuts = lambda c: np.array(sorted(set(slim.select(c).approxQuantile(c, shares, 0.25 / ranges))), dtype=np.int64)
    bounds = cuts("id")
    null_bounds = np.empty(0, dtype=np.int64) if slim.select("id").where("id is null").isEmpty() else cuts("begin")

    def place(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        """The range of each row, and its order there."""
        null = batch.column(0).is_null().to_numpy(zero_copy_only=False)
        id_, first = (batch.column(i).fill_null(0).to_numpy(zero_copy_only=False) for i in (0, 1))
        to = np.where(null, len(bounds) + 1 + np.searchsorted(null_bounds, first, "right"), np.searchsorted(bounds, id_, "right"))
        return to.astype(np.int64), np.where(null, first, id_)

    def least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            to, order = place(batch)
            names, at = np.unique(to, return_inverse=True)
            low = np.full(len(names), np.iinfo(np.int64).max)
            np.minimum.at(low, at, order)
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(low)], names=["to", "least"])

    heads = map_arrow(slim.select("id", "begin"), least, "to long, least long").groupBy("to").agg(F.min("least").alias("least")).collect()
    heads = np.array(sorted((r["to"], r["least"]) for r in heads), dtype=np.int64).reshape(-1, 2)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        guests: dict[int, tuple] = {}
        held = 0

        def call() -> pa.RecordBatch:
            rows = [(to, True, *row) for to, row in guests.items()]
            guests.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)

        types, names = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.string()], ["to", "guest", "id", "begin", "text"]
        for batch in batches:
            to, order = place(batch)
            at = np.searchsorted(heads[:, 0], to)
            for i in np.flatnonzero(heads[at, 1] == order).tolist():  # it may be what follows the range before
                before, row = int(heads[at[i] - 1, 0]), tuple(batch.column(k)[i].as_py() for k in range(3))
                if before not in guests or row[2] < guests[before][2]:
                    guests[before] = row
                    held += len(row[2])
            yield pa.RecordBatch.from_arrays([pa.array(to), pa.array(np.zeros(len(to), dtype=bool)), *batch.columns], names=names)
            if held > 32 << 20:
                yield call()
                held = 0
        yield call()

    sent = map_arrow(slim, deal, "to long, guest boolean, id long, begin long, text string")
    return sent.repartition(tasks, "to").sortWithinPartitions("to", "guest", F.col("id").asc_nulls_last(), "text").drop("begin")


def edited(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likenesses.

    Edited: the last floor(n/2) of the n code points give way to the first as many of the next document's, by
    ascending key. Columns: ``key``, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next. Keys are integers (others raise TypeError). Null texts count as empty; order of ties and nulls as in ``with_next``; a single row is its own
    next; an empty table gives no rows; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, out = None, []

        def row(now: tuple, then: tuple) -> tuple:
            (_, _, id_, text_, mark), (_, _, _, after, mark2) = now, then
            half = len(text_) // 2
            changed = text_[: len(text_) - half] + after[:half]
            other = mark if changed == text_ else fingerprint(changed)
            sha = hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest()
            return id_, len(text_), sha, mark, other, likeness(mark, other), likeness(mark, mark2)

        for batch in batches:
            for to, guest, id_, text_ in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if guest and (held is None or held[0] != to or held[1]):
                    held = held if held is not None and held[0] == to else None
                    continue
                now = (to, guest, id_, text_, fingerprint(text_))
                if held is not None and held[0] == to:
                    out.append(row(held, now))
                held = now
            yield _rows(out, key)
            out = []

    return map_arrow(with_next(docs, key, text), run, f"`{key}` long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def _rows(rows: list[tuple], key: str) -> pa.RecordBatch:
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    names = [key, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)
