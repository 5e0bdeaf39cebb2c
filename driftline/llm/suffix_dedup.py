"""Repeated byte strings across documents (operator 3), by external induced sorting of suffixes.

Text is dealt to shards so that equal strings meet: each window of ``length`` bytes is named by the least hash of its
20-byte strings, and neighbouring windows of one name form a segment. Names that occur in one document alone are set
aside; the distinct segments of the others are collected by name, and every shard of them is suffix-sorted with common
prefixes (``induced``). Suffixes that share ``length`` bytes are neighbours there; the least document among them
decides for all. Names depend on the windows' bytes only, so nothing is lost between shards.

What is alike is put together before it moves: documents are collected by the least hash of their 20-byte strings, so
that copies come to lie side by side, and go in chunks. A chunk sends a name once and a segment once, with its least
and greatest document, and gets one answer for it, which meets the chunk's own list of occurrences. So a passage in a
third of all documents is as many rows in one task as there are chunks. Segments of a name that has very many distinct
ones are named again by 44-byte strings, and dealt by those.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, fields_of, forget, integer_key, kept_as, map_arrow, stored
from .induced import CHUNK, Scratch, count_stars, directly, suffixes

GRAM, LONG_GRAM = 20, 44
LAST = (1 << 63) - 1
_BLOCK = 1 << 21
_CHUNK = 4 << 20
_FACTORS = np.random.default_rng(50).integers(0, 1 << 64, 64, dtype=np.uint64) | np.uint64(1)


def _heads(*columns: np.ndarray) -> np.ndarray:
    """Where one of the columns changes, the first place included."""
    if not len(columns[0]):
        return np.empty(0, dtype=np.int64)
    new = np.zeros(len(columns[0]), dtype=bool)
    new[0] = True
    for x in columns:
        new[1:] |= x[1:] != x[:-1]
    return np.flatnonzero(new)


def gram_hashes(block: bytes, gram: int = GRAM) -> np.ndarray:
    """A hash of each string of ``gram`` bytes (8 at least)."""
    a = np.frombuffer(block + b"\0" * 8, np.uint8)
    words = np.ascontiguousarray(np.lib.stride_tricks.as_strided(a, (len(block) + 1, 8), (1, 1))).view("<u8").ravel()
    m = len(block) - gram + 1
    h = np.zeros(m, dtype=np.uint64)
    for k, j in enumerate([*range(0, gram - 8, 8), gram - 8]):
        h ^= words[j : j + m] * _FACTORS[k]
        h = (h << np.uint64(23)) | (h >> np.uint64(41))
    h ^= h >> np.uint64(29)
    h *= _FACTORS[-1]
    return h ^ (h >> np.uint64(32))


def window_runs(data: bytes, length: int, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of neighbouring windows of one name: names, first windows, windows after the last.

    A window of ``length`` bytes is named by the least hash of the strings of ``gram`` bytes in it.
    """
    names, heads = [np.empty(0, dtype=np.uint64)], [np.empty(0, dtype=np.int64)]
    n = max(0, len(data) - length + 1)
    for at in range(0, n, _BLOCK):  # long texts in overlapping blocks
        h = gram_hashes(data[at : at + _BLOCK + length - 1], gram)
        width, span = 1, length - gram + 1
        while 2 * width <= span:
            h = np.minimum(h[:-width], h[width:])
            width *= 2
        rest = span - width
        h = np.minimum(h[: len(h) - rest], h[rest:])
        own = _heads(h)
        own = own[1:] if len(names[-1]) and names[-1][-1] == h[0] else own
        names.append(h[own])
        heads.append(own + at)
    heads = np.concatenate(heads)
    return np.concatenate(names).view(np.int64), heads, np.append(heads[1:], n) if n else heads


def likeness(data: bytes) -> int:
    """The least hash of the 20-byte strings of a text; copies share it, and near copies often do."""
    return int(min(gram_hashes(data[a : a + _BLOCK + GRAM]).min() for a in range(0, max(1, len(data) - GRAM), _BLOCK)).view(np.int64))


class Shard:
    """Distinct segments collected for one sort, and what is known of them; all in scratch, whatever their number."""

    def __init__(self, length: int, budget: int):
        self.length, self.scratch = length, Scratch(budget)
        self.text, self.lists, self.rows = [], [], []  # blocks
        self.size = self.n = self.n_rows = self.stars = self.more = 0

    def full(self, size: int) -> bool:
        """Whether to sort now: at ``size``, or as another block like the last would call for a recursion."""
        return self.size >= size or self.n_rows >= size or self.stars + self.more > directly()

    def add(self, name: np.ndarray, hash_: np.ndarray, facts: list[np.ndarray], least: np.ndarray, segments: pa.Array) -> None:
        """Rows of whole names, by name and hash: a chunk that has the segment (``facts``: chunk, at, base, most)."""
        heads = _heads(name, hash_)
        number = self.n + np.repeat(np.arange(len(heads)), np.diff(np.append(heads, len(name))))
        names = name[heads]
        starts = np.concatenate([[True], names[1:] != names[:-1]])
        alone = starts & np.append(starts[1:], True)  # with its name: needs no sorting, so its text is left out
        sizes = pc.binary_length(segments).to_numpy(zero_copy_only=False).astype(np.int64)[heads]
        sorted_ = pa.array(heads[~alone])
        kept = segments.take(sorted_)
        own = np.where(alone, 0, sizes)
        data = np.frombuffer(kept.buffers()[2], np.uint8)[: int(own.sum())] if len(kept) else np.empty(0, dtype=np.uint8)
        text = np.full(len(data) + len(heads), 0xFF, dtype=np.uint8)  # a separator after each
        text[np.arange(len(data)) + np.repeat(np.arange(len(heads)), own)] = data
        self.more = count_stars(text + np.uint8(2))
        self.stars += self.more
        self.text.append(self.scratch.put(text))
        self.lists.append(self.scratch.put(np.stack([own, np.minimum.reduceat(least, heads), sizes - self.length + 1], axis=1).ravel()))
        self.rows.append(self.scratch.put(np.stack([number, *facts], axis=1).ravel()))
        self.size, self.n, self.n_rows = self.size + len(text), self.n + len(heads), self.n_rows + len(name)

    def _line(self, blocks: list, width: int, total: int) -> np.ndarray:
        out, at = self.scratch.array(width * total, np.int64), 0
        for kept in blocks:
            part = self.scratch.get(kept)
            out[at : at + len(part)] = part
            at += len(part)
            self.scratch.free(kept)
        blocks.clear()
        return out.reshape(total, width)

    def answers(self) -> Iterator[list[np.ndarray]]:
        """Windows that a smaller document has, for each chunk with some: chunk, at, offset, windows, document."""
        facts, rows = self._line(self.lists, 3, self.n), self._line(self.rows, 5, self.n_rows)
        for a in range(0, self.n_rows, CHUNK // 4):
            own = rows[a : a + CHUNK // 4]
            own = own[own[:, 4] > facts[own[:, 0], 1]]
            if len(own):  # the segment as a whole
                yield [own[:, 1], own[:, 2], own[:, 3], facts[own[:, 0], 2], facts[own[:, 0], 1]]
        if self.size == self.n:
            return
        of = np.asarray(rows[:, 0])
        for segment, offset, windows, first in self.repeats(facts[:, 0], facts[:, 1]):
            low = np.searchsorted(of, segment, "left")
            n = np.searchsorted(of, segment, "right") - low
            ends = np.cumsum(n)
            for a in range(0, int(ends[-1]), CHUNK // 4):  # a segment may be in very many chunks
                k = np.arange(a, min(int(ends[-1]), a + CHUNK // 4))
                which = np.searchsorted(ends, k, "right")
                own = rows[low[which] + k - (ends[which] - n[which])]
                good = own[:, 4] > first[which]
                own, which = own[good], which[good]
                if len(own):
                    yield [own[:, 1], own[:, 2], own[:, 3] + offset[which], windows[which], first[which]]

    def repeats(self, sizes: np.ndarray, least: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Runs of windows that also occur in a segment of a smaller document, by segment: number, offset, windows, document."""
        scratch, length = self.scratch, self.length
        text = scratch.array(self.size + 1, np.uint8)
        at = 0
        for kept in self.text:
            part = scratch.get(kept)
            text[at : at + len(part)] = part + np.uint8(2)  # bytes FE and FF are not in UTF-8; separators become 1
            at += len(part)
            scratch.free(kept)
        starts = np.cumsum(sizes + 1) - sizes - 1
        by_least = np.argsort(least, kind="stable")
        rank = np.empty(self.n + 1, dtype=np.uint32)
        rank[by_least] = np.arange(self.n)
        windows = np.maximum(sizes - length + 1, 0)
        of = scratch.array(self.size + 1, np.uint32)  # by place: the segment whose window begins there, and 1
        for a in range(0, self.n, CHUNK // 8):
            k = np.arange(a, min(self.n, a + CHUNK // 8))
            n = windows[k]
            own = np.repeat(k, n)
            of[np.repeat(starts[k], n) + np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n)] = own + 1
        first = scratch.array(self.size + 1, np.uint32)  # by place: the segment whose document decides, and 1
        held: list = []

        def close() -> None:
            """The groups held: places that share ``length`` bytes, each from a head on."""
            best, group = np.empty(0, dtype=np.uint32), -1
            for kept in held:
                places, common = (scratch.get(x) for x in kept)
                new = common < length
                if not new[0] and group >= 0:  # the group of the block before goes on
                    n = int(np.argmax(new)) if new.any() else len(new)
                    best[group] = min(best[group], rank[of[places[:n]].astype(np.int64) - 1].min())
                heads = np.flatnonzero(new)
                if len(heads):
                    best = np.append(best, np.minimum.reduceat(rank[of[places].astype(np.int64) - 1], heads))
                    group += len(heads)
            group = -1
            for kept in held:
                places, common = (scratch.get(x) for x in kept)
                own = np.cumsum(common < length) + group
                group = int(own[-1])
                segment = of[places].astype(np.int64) - 1
                winner = by_least[best[own]]
                later = least[winner] < least[segment]
                first[places[later]] = winner[later] + 1
                for x in kept:
                    scratch.free(x)
            held.clear()

        waiting = 0
        for places, common in suffixes(text, length, scratch):
            # what begins no window, or a window that no other is like, has a group of its own
            new = common < length
            keep = (of[places] > 0) & ~(new & np.append(new[1:], False))
            places, common = places[keep], common[keep]
            new = np.flatnonzero(common < length)
            if len(new) and waiting + int(new[-1]) > CHUNK // 2:  # what came before the last group's head is complete
                cut = int(new[-1])
                if cut:
                    held.append((scratch.put(places[:cut]), scratch.put(common[:cut])))
                if held:
                    close()
                waiting, places, common = 0, places[cut:], common[cut:]
            if len(places):
                held.append((scratch.put(places), scratch.put(common)))
                waiting += len(places)
        if held:
            close()
        for a in range(0, self.size, CHUNK):
            place = np.flatnonzero(first[a : a + CHUNK]) + a
            if len(place):
                won, segment = first[place].astype(np.int64) - 1, of[place].astype(np.int64) - 1
                heads = _heads(segment, place - np.arange(len(place)), won)
                yield segment[heads], place[heads] - starts[segment[heads]], np.diff(np.append(heads, len(place))), least[won[heads]]


def _batch(columns: list, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=names)


def _chunks(texts: DataFrame, length: int) -> DataFrame:
    """Texts of ``length`` bytes or more in chunks of like ones: ``chunk, tag, id, mark, data``."""
    fields = ["tag", "id", "mark", "data"]

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _batch([*batch.columns, pa.array([likeness(x.as_py()) for x in batch.column(3)], pa.int64())], [*fields, "like"])

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        chunk, size = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            sizes = np.cumsum([size, *(len(x.as_py()) for x in batch.column(3))])
            own = chunk + sizes[:-1] // _CHUNK
            yield _batch([own, *batch.columns[:4]], ["chunk", *fields])
            size = int(sizes[-1])

    long = texts.where(F.length("data") >= length)
    alike = map_arrow(long, hashed, "tag long, id long, mark int, data binary, like long").hint("rebalance", "like")
    return map_arrow(alike.sortWithinPartitions("like", "id", "mark"), number, "chunk long, tag long, id long, mark int, data binary")


def _names_of(names: list[np.ndarray], tags: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct names of some documents (their distinct names, and tags), and whether each is in two of them or more."""
    n = np.concatenate(names)
    t = np.repeat(np.array(tags, dtype=np.int64), [len(x) for x in names])
    order = np.lexsort((t, n))
    n, t = n[order], t[order]
    heads = _heads(n)
    ends = np.append(heads[1:], len(n))
    return n[heads], t[heads] != t[ends - 1] if len(n) else np.empty(0, dtype=bool)


def _shared_names(chunks: DataFrame, length: int) -> DataFrame:
    """Per chunk the names that one document of it has, and others elsewhere: ``chunk, name``."""

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: list[np.ndarray] = []
        tags: list[int] = []
        last = None

        def done() -> pa.RecordBatch:
            own, several = _names_of(names, tags)
            names.clear()
            tags.clear()
            return _batch([own, np.full(len(own), last), several], ["name", "chunk", "several"])

        for batch in batches:
            for chunk, tag, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if chunk != last and names:
                    yield done()
                last = chunk
                names.append(np.unique(window_runs(data.as_py(), length)[0]))
                tags.append(tag)
        if names:
            yield done()

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64), np.empty(0, dtype=bool)]

        def settle(columns: list[np.ndarray]) -> pa.RecordBatch:
            n, c, several = columns
            heads = _heads(n)
            counts = np.diff(np.append(heads, len(n)))
            known = np.repeat((counts > 1) | several[heads], counts) & ~several
            return _batch([c[known], n[known]], ["chunk", "name"])

        for batch in batches:
            held = [np.concatenate([a, b.to_numpy(zero_copy_only=False)]) for a, b in zip(held, batch.columns, strict=True)]
            if len(held[0]):
                cut = int(_heads(held[0])[-1])  # the last name may go on
                yield settle([c[:cut] for c in held])
                held = [c[cut:] for c in held]
        if len(held[0]):
            yield settle(held)

    named = map_arrow(chunks.select("chunk", "tag", "data"), name, "name long, chunk long, several boolean")
    return map_arrow(named.repartition("name").sortWithinPartitions("name"), shared, "chunk long, name long")


def _segments(chunks: DataFrame, shared: DataFrame, length: int) -> DataFrame:
    """Distinct segments by chunk, of names that two documents have: ``chunk, at, name, hash, least, most, segment``.

    ``at`` numbers them within the chunk; ``places`` (tag, mark, id, start) is where they occur there.
    """
    place = pa.struct([("tag", pa.int64()), ("mark", pa.int32()), ("id", pa.int64()), ("start", pa.int64())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        last = None
        told: list[int] = []  # shared names
        rows: list[tuple] = []  # tag, id, mark, data, runs

        def done() -> Iterator[pa.RecordBatch]:
            if not rows:
                told.clear()
                return
            own, several = _names_of([np.unique(r[4][0]) for r in rows], [r[0] for r in rows])
            wanted = np.union1d(own[several], np.array(told, dtype=np.int64))
            known: dict[tuple[int, int], int] = {}
            segments: list[bytes] = []
            found: list[tuple] = []
            copies: dict[bytes, tuple[np.ndarray, np.ndarray]] = {}
            for tag, id_, mark, data, (mine, heads, ends) in rows:
                if data in copies:
                    found.append((copies[data][0], tag, mark, id_, copies[data][1]))
                    continue
                at = np.minimum(np.searchsorted(wanted, mine), max(0, len(wanted) - 1))
                which = np.flatnonzero(wanted[at] == mine) if len(wanted) else at[:0]
                numbers = []
                for n, a, b in zip(mine[which].tolist(), heads[which].tolist(), ends[which].tolist(), strict=True):
                    segment = data[a : b + length - 1]
                    key = (n, xxh64_intdigest(segment) - (1 << 63))
                    at = known.setdefault(key, len(segments))
                    if at == len(segments):
                        segments.append(segment)
                    numbers.append(at)
                copies[data] = np.array(numbers, dtype=np.int64), heads[which]
                found.append((copies[data][0], tag, mark, id_, copies[data][1]))
            told.clear()
            rows.clear()
            if not segments:
                return
            of = np.concatenate([f[0] for f in found])
            order = np.argsort(of, kind="stable")
            tag, mark, id_ = (np.repeat(np.array([f[i] for f in found], dtype=np.int64), [len(f[0]) for f in found])[order] for i in (1, 2, 3))
            start = np.concatenate([f[4] for f in found])[order]
            offsets = np.searchsorted(of[order], np.arange(len(segments) + 1))
            least, most = np.minimum.reduceat(id_, offsets[:-1]), np.maximum.reduceat(id_, offsets[:-1])
            name, hash_ = (np.array([k[i] for k in known], dtype=np.int64) for i in (0, 1))
            for a in range(0, len(segments), 20_000):
                b = min(len(segments), a + 20_000)
                x, y = int(offsets[a]), int(offsets[b])
                places = pa.StructArray.from_arrays([pa.array(tag[x:y]), pa.array(mark[x:y], pa.int32()), pa.array(id_[x:y]), pa.array(start[x:y])], fields=list(place))
                places = pa.ListArray.from_arrays(pa.array(offsets[a : b + 1] - x, pa.int32()), places)
                yield _batch([np.full(b - a, last), np.arange(a, b), name[a:b], hash_[a:b], least[a:b], most[a:b], pa.array(segments[a:b], pa.binary()), places], names_out)

        names_out = ["chunk", "at", "name", "hash", "least", "most", "segment", "places"]
        for batch in batches:
            for chunk, name, tag, id_, mark, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if chunk != last:
                    yield from done()
                    last = chunk
                if data is None:
                    told.append(name)
                else:
                    before = rows[-1] if rows else None  # a copy often follows what it is a copy of
                    rows.append((tag, id_, mark, data, before[4] if before and before[3] == data else window_runs(data, length)))
        yield from done()

    none = lambda kind: F.lit(None).cast(kind)
    both = chunks.select("chunk", none("long").alias("name"), "tag", "id", "mark", "data").unionAll(
        shared.select("chunk", "name", none("long"), none("long"), none("int"), none("binary"))
    )
    met = both.repartition("chunk").sortWithinPartitions("chunk", F.col("tag").asc_nulls_first(), "id")
    return map_arrow(met, cut, "chunk long, at long, name long, hash long, least long, most long, segment binary, places array<struct<tag:bigint,mark:int,id:bigint,start:bigint>>")


def _dealt(segments: DataFrame, length: int, hot: int) -> DataFrame:
    """Segments to be sorted: ``name, hash, chunk, at, base, least, most, segment``; those of frequent names in parts.

    A name with ``hot`` rows or more is frequent; its segments are cut by the names of 44-byte strings, which depend
    on the windows' bytes as well, and ``base`` is where a part begins.
    """
    slim = segments.select("name", "hash", "chunk", "at", F.lit(0).cast("long").alias("base"), "least", "most", "segment")
    often = stored(slim.groupBy("name").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= hot).select("name"), "frequent")
    many = often.limit(1_000_001).count()  # the table of frequent names goes everywhere only if it is small
    if not many:
        return slim
    side = (F.broadcast(often) if many <= 1_000_000 else often).withColumn("frequent", F.lit(True))

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        names = ["name", "hash", "chunk", "at", "base", "least", "most", "segment"]
        for batch in batches:
            frequent = batch.column(8).to_numpy(zero_copy_only=False)
            if not frequent.any():
                yield _batch(batch.columns[:8], names)
                continue
            yield _batch([c.filter(pa.array(~frequent)) for c in batch.columns[:8]], names)
            rows = []
            for _, _, chunk, at, _, least, most, segment, _ in zip(*(c.to_pylist() for c in batch.filter(batch.column(8)).columns), strict=True):
                for own, a, b in zip(*(x.tolist() for x in window_runs(segment, length, LONG_GRAM)), strict=True):
                    piece = segment[a : b + length - 1]
                    rows.append((own, xxh64_intdigest(piece) - (1 << 63), chunk, at, a, least, most, piece))
            yield _batch([pa.array([r[i] for r in rows], pa.binary() if i == 7 else pa.int64()) for i in range(8)], names)

    marked = slim.join(side, "name", "left").withColumn("frequent", F.coalesce("frequent", F.lit(False)))
    return map_arrow(marked, part, "name long, hash long, chunk long, at long, base long, least long, most long, segment binary")


def _answers(dealt: DataFrame, length: int, shard: int, budget: int) -> DataFrame:
    """Windows of a chunk's segments that a smaller document has: ``chunk, at, offset, windows, first``."""
    own = ["chunk", "at", "offset", "windows", "first"]

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = Shard(length, budget), []

        def add(rows: pa.Table) -> None:
            rows = rows.combine_chunks()
            name, hash_, *facts, least = (rows.column(c).to_numpy() for c in ("name", "hash", "chunk", "at", "base", "most", "least"))
            segments = rows.column("segment")
            now.add(name, hash_, facts, least, segments.chunk(0) if segments.num_chunks == 1 else pa.concat_arrays(segments.chunks))

        for batch in batches:
            names = batch.column(0).to_numpy()
            cut = int(_heads(names)[-1]) if len(names) else 0  # the last name may go on
            if held and len(names) and (cut or held[-1].column(0)[-1].as_py() != names[0]):
                add(pa.Table.from_batches([*held, batch.slice(0, cut)]))
                held = []
                if now.full(shard):
                    yield from (_batch(x, own) for x in now.answers())
                    now = Shard(length, budget)
            elif cut:
                add(pa.Table.from_batches([batch.slice(0, cut)]))
            if cut < len(names):
                held.append(batch.slice(cut))
        if held:
            add(pa.Table.from_batches(held))
        if now.n:
            yield from (_batch(x, own) for x in now.answers())

    met = dealt.repartition("name").sortWithinPartitions("name", "hash")
    return map_arrow(met, sort, "chunk long, at long, offset long, windows long, first long")


def _texts(docs: DataFrame, key: str, text: str, *more) -> DataFrame:
    """``tag`` (the document), ``id`` (its key, null last), ``mark`` (tells texts of one key apart), ``data`` and more."""
    own = integer_key(docs, key)
    data = F.coalesce(column(text), F.lit("")).cast("binary")
    return docs.select(F.coalesce(own, F.xxhash64(data)).alias("tag"), F.coalesce(own, F.lit(LAST)).alias("id"), F.hash(data).alias("mark"), data.alias("data"), *more)


def repeats(docs: DataFrame, length: int = 50, key: str = "doc_id", text: str = "text", shard: int = 16 << 20, budget: int = 48 << 20, hot: int = 100_000) -> DataFrame:
    """Per document: ``tag`` (see ``_texts``) and ``spans`` of windows that repeat (mark, start, end).

    A window repeats if its bytes also start in a row of a smaller key. Null texts are empty, null keys come last.
    ``shard``: bytes that are sorted together, ``budget``: memory for that, beyond which it goes to scratch files.
    """
    chunks = stored(_chunks(_texts(docs, key, text), length), "chunks")
    shared = stored(_shared_names(chunks, length), "names")
    segments = stored(_segments(chunks, shared, length), "segments")
    forget(chunks, shared)
    answers = stored(_answers(_dealt(segments, length, hot), length, shard, budget), "answers")
    met = segments.select("chunk", "at", "places").join(answers, ["chunk", "at"])
    later = F.filter("places", lambda p: p["id"] > F.col("first"))
    each = met.select(F.explode(later).alias("p"), "offset", "windows")
    begin = F.col("p.start") + F.col("offset")
    span = F.struct(F.col("p.mark").alias("mark"), begin.alias("start"), (begin + F.col("windows")).alias("end"))
    return stored(each.select(F.col("p.tag").alias("tag"), span.alias("span")).groupBy("tag").agg(F.collect_list("span").alias("spans")), "spans")


def drop_repeats(docs: DataFrame, length: int = 50, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ("doc_id",), with_text: bool = True, **sizes: int) -> DataFrame:
    """Per row: the columns ``keep``, n_bytes, n_removed, n_spans, kept_sha256 and, if wanted, ``kept`` (bytes left).

    A byte goes if a string of ``length`` bytes over it also starts in a row of a smaller key; strings are judged on
    the input. Keys are integers (others raise TypeError). Rows of equal keys do not act on each other; repeated rows
    are treated alike; null texts are empty, null keys come last; texts shorter than ``length`` stay; an empty table
    gives no rows; other columns are not read. ``kept`` may end in a part of a character. ``sizes`` go to ``repeats``.
    """
    if not LONG_GRAM <= length < 255:
        raise ValueError("strings are 44 to 254 bytes")
    found = repeats(docs, length, key, text, **sizes)
    kept = [f"kept{i}_" for i in range(len(keep))]
    rows = _texts(docs, key, text, *(column(k).alias(v) for k, v in zip(keep, kept, strict=True)))
    joined = rows.join(found, "tag", "left").select(*kept, "mark", "data", "spans")
    own = ["n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept"] if with_text else [])]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()][: len(own)]
    fields = fields_of(joined.select(*kept))
    schema = ", ".join([*fields, "n_bytes long, n_removed long, n_spans long, kept_sha256 string", *(["kept binary"] if with_text else [])])

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            spans = batch.column(len(kept) + 2)
            offsets, flat = spans.offsets.to_numpy(), spans.values
            found_marks, starts, ends = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(3))
            marks = batch.column(len(kept)).to_pylist()
            for i, data in enumerate(batch.column(len(kept) + 1)):
                data = data.as_py()
                a, b = int(offsets[i]), int(offsets[i + 1])
                mine = np.flatnonzero(found_marks[a:b] == marks[i]) + a if spans[i].is_valid else np.empty(0, dtype=np.int64)
                if not len(mine):
                    out.append((len(data), 0, 0, hashlib.sha256(data).hexdigest(), data))
                    continue
                mine = mine[np.argsort(starts[mine], kind="stable")]
                begin, reach = starts[mine], np.maximum.accumulate(ends[mine] + length - 1)
                heads = np.flatnonzero(np.concatenate([[True], begin[1:] > reach[:-1]]))
                runs = list(zip(begin[heads].tolist(), reach[np.append(heads[1:], len(mine)) - 1].tolist(), strict=True))
                left = b"".join(data[x:y] for (_, x), (y, _) in zip([(0, 0), *runs], [*runs, (len(data), 0)], strict=True))
                out.append((len(data), len(data) - len(left), len(runs), hashlib.sha256(left).hexdigest(), left))
            yield _batch([*batch.columns[: len(kept)], *(pa.array([r[i] for r in out], t) for i, t in enumerate(types))], [*kept, *own])

    return map_arrow(joined, remove, schema).toDF(*kept_as(keep, own), *own)
