"""External induced sorting: suffix order and capped common prefixes of a byte string, in bounded memory.

S* suffixes are named by their substrings (sorted runs in scratch, merged in blocks) and sorted by recursion on the
string of names, until they are so few that they are sorted in memory. From them L suffixes are induced in ascending and S suffixes in descending order, by a priority
queue of suffix tuples (first character, order of insertion; place, common prefix with the tuple before). Tuples come
out by character and then in the order in which they went in, so the queue is kept as first-in-first-out blocks by
range of characters: a range holds about ``CHUNK`` tuples of several characters, or one frequent character. Only the
range being worked off is in memory. Its tuples are taken in vectors of as many characters as push nothing back among
themselves; a character that does is worked off by generations.

Common prefixes are carried along, in characters of the text at every level and up to ``cap``: that of two induced
suffixes is the width of their character (1, or the length a name stands for) and the least one between their causes;
neighbouring names have theirs from naming. Only where S and L suffixes of one character meet is the text compared.

Everything that grows with the text (the text, names, stars, tuples, results) is in arrays and blocks of a ``Scratch``:
in memory up to its budget, beyond it in unlinked files of the task. They are private to the task and gone with it;
nothing reads them after a failure, as a retried task starts anew.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np

CHUNK = 1 << 19
#: So many times ``CHUNK`` S* suffixes at most are sorted in memory, the end of the recursion.
_DIRECT = 5
_FILE = 8 << 20


def directly() -> int:
    """The most S* suffixes that are sorted without recursion."""
    return int(_DIRECT * CHUNK)


def count_stars(text: np.ndarray) -> int:
    """S* suffixes of a piece of text that begin between its ends: where it turns from falling to rising."""
    own = text[np.append(True, text[1:] != text[:-1])] if len(text) else text
    return int(((own[1:-1] < own[:-2]) & (own[1:-1] < own[2:])).sum())


class Scratch:
    """Memory that the sorts of one task may use together, and files for what is beyond.

    ``spilled`` counts the blocks and arrays that went to files.
    """

    def __init__(self, budget: int = 64 << 20):
        self.left, self.spilled = budget, 0
        self.file, self.end, self.live = None, 0, {}
        self.held: dict[int, int] = {}

    def array(self, n: int, kind) -> np.ndarray:
        """A zeroed array, to be given back by ``drop``."""
        size = n * np.dtype(kind).itemsize
        if size <= self.left or not size:
            self.left -= size
            out = np.zeros(n, dtype=kind)
            self.held[id(out)] = size
            return out
        self.spilled += 1
        with tempfile.TemporaryFile() as f:
            f.truncate(size)
            return np.asarray(np.memmap(f, dtype=kind, mode="r+", shape=(n,)))

    def drop(self, *arrays: np.ndarray) -> None:
        for a in arrays:
            self.left += self.held.pop(id(a), 0)

    def put(self, a: np.ndarray):
        if a.nbytes <= self.left:
            self.left -= a.nbytes
            return a
        self.spilled += 1
        if self.file is None or self.end >= _FILE:  # files are closed when all of their blocks are free
            if self.file is not None and not self.live[self.file]:
                self.file.close()
            self.file, self.end = tempfile.TemporaryFile(), 0
            self.live[self.file] = 0
        self.file.seek(self.end)
        self.file.write(np.ascontiguousarray(a).data)
        self.live[self.file] += 1
        at, self.end = self.end, self.end + a.nbytes
        return self.file, at, len(a), a.dtype

    def get(self, kept) -> np.ndarray:
        if isinstance(kept, np.ndarray):
            return kept
        file, at, n, kind = kept
        file.seek(at)
        return np.frombuffer(file.read(n * kind.itemsize), dtype=kind)

    def free(self, kept) -> None:
        if isinstance(kept, np.ndarray):
            self.left += kept.nbytes
            return
        file = kept[0]
        self.live[file] -= 1
        if not self.live[file] and file is not self.file:
            del self.live[file]
            file.close()


class Queue:
    """First in, first out, of tuples held as columns; small pushes are gathered to blocks."""

    def __init__(self, scratch: Scratch):
        self.scratch, self.blocks, self.small, self.waiting = scratch, [], [], 0

    def push(self, *columns: np.ndarray) -> None:
        self.small.append(columns)
        self.waiting += len(columns[0])
        if self.waiting >= 1 << 14:
            self._gather()

    def _gather(self) -> None:
        if self.small:
            self.blocks.append([self.scratch.put(np.concatenate(c)) for c in zip(*self.small, strict=True)])
            self.small, self.waiting = [], 0

    def take(self, most: int) -> list[np.ndarray] | None:
        """The columns of the first blocks, up to about ``most`` tuples; they leave the queue."""
        self._gather()
        got, n = [], 0
        while self.blocks and n < most:
            kept = self.blocks.pop(0)
            got.append([self.scratch.get(x) for x in kept])
            for x in kept:
                self.scratch.free(x)
            n += len(got[-1][0])
        return [np.concatenate(c) for c in zip(*got, strict=True)] if got else None


@dataclass
class Level:
    """A string to sort: positive characters, ending in its only 0.

    ``origin``: where in the text each place begins (None: the text itself). ``width`` and ``near``, by character: how
    much text it stands for, and what it shares with the character before it. ``counts``: places by character.
    """

    text: np.ndarray
    size: int
    cap: int
    scratch: Scratch
    base: np.ndarray
    origin: np.ndarray | None = None
    width: np.ndarray | None = None
    near: np.ndarray | None = None
    depth: int = 0
    counts: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        self.counts = np.zeros(self.size, dtype=np.int64)
        for a in range(0, len(self.text), CHUNK):
            self.counts += np.bincount(self.text[a : a + CHUNK], minlength=self.size)
        self.place = np.uint32 if len(self.text) < 1 << 32 else np.int64

    def begin(self, places: np.ndarray) -> np.ndarray:
        return places if self.origin is None else self.origin[places]

    def shared(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Common prefixes of suffixes, compared in the text."""
        return common_prefix(self.base, self.begin(a), self.begin(b), self.cap)

    def between(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """What suffixes share that begin with the characters a < b."""
        if self.near is None:
            return np.zeros(len(a), dtype=np.uint8)
        if (b - a == 1).all():
            return self.near[b]
        cuts = np.stack([a + 1, b + 1], axis=1).ravel()
        return np.minimum.reduceat(np.append(self.near, 255).astype(np.uint8), cuts)[::2]


def common_prefix(text: np.ndarray, a: np.ndarray, b: np.ndarray, cap: int) -> np.ndarray:
    """Common prefixes of suffixes a and b, up to ``cap``; ``text`` ends in its only 0."""
    out, alive = np.zeros(len(a), dtype=np.uint8), np.arange(len(a))
    x, y = a.astype(np.int64), b.astype(np.int64)
    for k in range(cap):
        same = text[x] == text[y]
        if not same.all():
            alive, x, y = alive[same], x[same], y[same]
        if not len(alive):
            break
        out[alive] = k + 1
        x, y = np.minimum(x + 1, len(text) - 1), np.minimum(y + 1, len(text) - 1)
    return out


def _range_min(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Least of values[low..high], ends included, by doubled blocks."""
    out = np.full(len(low), 255, dtype=np.uint8)
    width = high - low + 1
    level, table = 0, values
    todo = np.frexp(width.astype(float))[1] - 1
    most = todo.max(initial=-1)
    while level <= most:
        here = np.flatnonzero(todo == level)
        if len(here):
            out[here] = np.minimum(table[low[here]], table[high[here] - (1 << level) + 1])
        half = 1 << level
        table = np.minimum(table[:-half], table[half:])
        level += 1
    return out


@dataclass
class Fixed:
    """Suffixes whose order is known, by character: ``places[starts[c] : starts[c + 1]]`` with common prefixes.

    Ascending; with ``flip``, characters and order are turned around.
    """

    places: np.ndarray
    common: np.ndarray
    starts: np.ndarray
    flip: bool

    def __post_init__(self) -> None:
        self.n = len(self.places)
        if self.flip:
            self.starts = self.n - self.starts[::-1]

    def take(self, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        """Entries a to b of the order asked for, each with its common prefix with the one before."""
        if not self.flip:
            return np.asarray(self.places[a:b]), np.array(self.common[a:b])
        low, high = self.n - b, self.n - a
        common = np.array(self.common[low + 1 : high + 1])
        return np.asarray(self.places[low:high])[::-1], np.concatenate([common, np.zeros(high - low - len(common), dtype=np.uint8)])[::-1]


class Pass:
    """One induction: movers come from the queue, fixed suffixes from their list, both by character.

    Ascending, movers are L suffixes and the fixed ones S*; descending (``flip``), characters are turned around, movers
    are S suffixes and the fixed ones L. In both, movers of a character come before its fixed suffixes, and a suffix
    pushes its predecessor if that begins with a greater character, or with the same one if it is a mover.
    """

    def __init__(self, level: Level, fixed: Fixed, flip: bool):
        self.level, self.fixed, self.flip, self.scratch = level, fixed, flip, level.scratch
        self.size, self.cap = level.size, level.cap
        counts = level.counts[::-1] if flip else level.counts
        most = CHUNK if level.origin is None else CHUNK // 8
        heavy = counts > most // 2
        light = np.cumsum(np.where(heavy, 0, counts)) // most
        cut = heavy.copy()
        cut[1:] |= heavy[:-1] | (light[1:] != light[:-1])
        self.range_of = np.cumsum(cut) - int(cut[0])
        self.bounds = np.append(np.flatnonzero(np.concatenate([[True], np.diff(self.range_of) > 0])), self.size)
        self.queues: dict[int, Queue] = {}
        self.pushed = np.full(self.size, -1, dtype=np.int64)  # by character: which suffix of the pass pushed to it last
        self.seen, self.latest = 0, np.full(256, -1, dtype=np.int64)  # suffixes so far, the last of each common prefix
        self.last: tuple[int, bool, int] | None = None  # character, whether a mover, place

    def chars(self, places: np.ndarray) -> np.ndarray:
        found = self.level.text[places]
        return (self.size - 1 - found.astype(np.int64)) if self.flip else found.astype(np.int64)

    def _between(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return self.level.between(self.size - 1 - b, self.size - 1 - a) if self.flip else self.level.between(a, b)

    def causes(self, chars: np.ndarray, places: np.ndarray, mover: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Characters of the predecessors, and which of these are induced."""
        before = self.chars(places - (places > 0))
        return before, (places > 0) & ((before > chars) | (mover & (before == chars)))

    def emit(self, chars, places, common, mover, before, pushes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Settles the common prefixes of a vector of suffixes in order; returns what it pushes, by character."""
        n = len(places)
        c = np.empty(n + 1, dtype=np.int64)
        m = np.empty(n + 1, dtype=bool)
        p = np.empty(n + 1, dtype=np.int64)
        c[1:], m[1:], p[1:] = chars, mover, places
        c[0], m[0], p[0] = self.last if self.last else (-1, False, 0)
        edge = np.flatnonzero(c[1:] != c[:-1])
        if len(edge):
            common[edge] = 0
            inner = edge[c[edge] >= 0]
            if self.level.near is not None and len(inner):
                common[inner] = self._between(c[inner], c[inner + 1])
        seam = np.flatnonzero((c[1:] == c[:-1]) & (m[1:] != m[:-1]))
        if len(seam):
            common[seam] = self.level.shared(p[seam], p[seam + 1])
        self.last = (int(c[-1]), bool(m[-1]), int(p[-1]))

        some = np.flatnonzero(pushes)
        to = before[some]
        small = to.astype(np.uint8 if self.size <= 256 else np.uint16 if self.size <= 65536 else np.uint32)
        order = np.argsort(small, kind="stable")
        to, some = to[order], some[order]
        first_here, self.seen = self.seen, self.seen + n
        before_here = np.maximum.accumulate(self.latest)
        self.latest[common] = np.arange(first_here, self.seen)
        if not len(some):
            return to, places[some], np.empty(0, dtype=np.uint8)
        first = np.concatenate([[True], to[1:] != to[:-1]])
        least = _range_min(common, np.where(first, 0, np.concatenate([[0], some[:-1] + 1])), some)
        heads = np.flatnonzero(first)
        own = to[heads]
        # least common prefix between the last push to a character and this vector
        least[heads] = np.minimum(least[heads], np.searchsorted(before_here, self.pushed[own] + 1))
        self.pushed[own] = first_here + some[np.append(heads[1:], len(some)) - 1]
        width = 1 if self.level.width is None else self.level.width[self.size - 1 - to if self.flip else to].astype(np.int64)
        return to, places[some] - 1, np.minimum(self.cap, least.astype(np.int64) + width).astype(np.uint8)

    def push(self, chars: np.ndarray, places: np.ndarray, common: np.ndarray) -> None:
        """To the queues of ranges to come; sorted by character."""
        if not len(chars):
            return
        ranges = self.range_of[chars]
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(ranges)) + 1, [len(ranges)]])
        chars, places = chars.astype(np.uint32), places.astype(self.level.place)
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            r = int(ranges[a])
            if r not in self.queues:
                self.queues[r] = Queue(self.scratch)
            self.queues[r].push(chars[a:b], places[a:b], common[a:b])

    def __iter__(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """All suffixes of the pass in order: places, common prefixes with the one before, whether movers."""
        for r in range(len(self.bounds) - 1):
            low, high = int(self.bounds[r]), int(self.bounds[r + 1])
            yield from self._single(r, low) if high == low + 1 else self._several(r, low, high)
            self.queues.pop(r, None)

    def _one(self, char: int, places: np.ndarray, common: np.ndarray, is_mover: bool):
        """One character's movers or fixed suffixes: what comes out, and what goes to the same character."""
        chars, mover = np.full(len(places), char), np.full(len(places), is_mover)
        places = places.astype(np.int64)
        before, pushes = self.causes(chars, places, mover)
        to, at, shared = self.emit(chars, places, common, mover, before, pushes)
        k = int(np.searchsorted(to, char, "right"))  # nothing goes to a smaller one
        return (places, common, mover), (to[:k], at[:k], shared[:k]), (to[k:], at[k:], shared[k:])

    def _generations(self, char: int, places: np.ndarray, common: np.ndarray, push) -> Iterator[tuple]:
        """All of a character's movers that come from some of them, which are the last in its queue."""
        age = 0
        while len(places):
            if age <= self.cap:
                out, (_, places, common), on = self._one(char, places, common, True)
                push(*on)
                yield out
                age += 1
                continue
            # a run: whatever comes now shares the cap, so many generations are taken at once
            n, k = len(places), max(1, min(4096, (1 << 18) // len(places)))
            line = places[None, :].astype(np.int64) - np.arange(k + 1)[:, None]
            same = (line >= 0) & (self.chars(np.maximum(line, 0)) == char)
            alive = np.logical_and.accumulate(same, axis=0)
            at = line[:k][alive[:k]]
            own = np.full(len(at), self.cap, dtype=np.uint8)
            chars, mover = np.full(len(at), char), np.ones(len(at), dtype=bool)
            before = self.chars(np.maximum(at - 1, 0))
            push(*self.emit(chars, at, own, mover, before, (at > 0) & (before > char)))
            yield at, own, mover
            places = line[k][alive[k]]
            if len(places):
                self.pushed[char] = self.seen - 1

    def _single(self, r: int, char: int) -> Iterator[tuple]:
        while (queue := self.queues.get(r)) and (got := queue.take(CHUNK)):
            if not queue.blocks and len(got[1]) < 4096:
                yield from self._generations(char, got[1], got[2].copy(), self.push)
                continue
            out, again, on = self._one(char, got[1], got[2].copy(), True)
            self.push(*again)
            self.push(*on)
            yield out
        a, end = int(self.fixed.starts[char]), int(self.fixed.starts[char + 1])
        while a < end:
            b = min(end, a + CHUNK)
            out, _, on = self._one(char, *self.fixed.take(a, b), False)
            self.push(*on)
            yield out
            a = b

    def _several(self, r: int, low: int, high: int) -> Iterator[tuple]:
        queue, starts = self.queues.get(r), self.fixed.starts
        held = queue.take(1 << 62) if queue else None
        none = [np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64), np.empty(0, dtype=np.uint8)]
        if held:
            order = np.argsort(held[0], kind="stable")
            held = [held[0][order].astype(np.int64), held[1][order].astype(np.int64), held[2][order]]
        else:
            held = none
        # sorted runs, oldest first: what the queue held, and what has been pushed to this range since
        runs: list[list] = [[*held, 0]] if len(held[0]) else []
        want = 1024

        def after(to, at, shared) -> None:  # pushes of this range wait in memory, others go to their queues
            nonlocal runs
            k = int(np.searchsorted(to, high))
            self.push(to[k:], at[k:], shared[k:])
            if not k:
                return
            runs.append([to[:k], at[:k], shared[:k], 0])
            if len(runs) > 16:  # all but the queue's own become one
                kept = runs[:1] if len(held[0]) and runs[0][0] is held[0] else []
                more = [[x[r[3] :] for x in r[:3]] for r in runs[len(kept) :]]
                both = [np.concatenate(x) for x in zip(*more, strict=True)]
                order = np.argsort(both[0], kind="stable")
                runs = [*kept, [*(x[order] for x in both), 0]]

        def advance(upto: int) -> None:
            nonlocal runs
            for r in runs:
                r[3] = int(np.searchsorted(r[0], upto))
            runs = [r for r in runs if r[3] < len(r[0])]

        while True:
            nexts = [int(r[0][r[3]]) for r in runs]
            f = int(starts[low])
            if f < int(starts[high]):
                nexts.append(int(np.searchsorted(starts, f, "right")) - 1)
            if not nexts:
                return
            low = min(nexts)
            f = int(starts[low])
            stop = [int(r[0][r[3] + want]) for r in runs if r[3] + want < len(r[0])]
            if f + want < int(starts[high]):
                stop.append(int(np.searchsorted(starts, f + want, "right")) - 1)
            upto = max(low + 1, min([high, *stop]))
            parts = [[x[r[3] : int(np.searchsorted(r[0], upto))] for x in r[:3]] for r in runs]
            fp, fc = self.fixed.take(f, int(starts[upto]))
            chars = np.concatenate([*(x[0] for x in parts), np.repeat(np.arange(low, upto), np.diff(starts[low : upto + 1]))])
            mover = np.arange(len(chars)) < len(chars) - len(fp)
            order = np.argsort(chars * 2 + ~mover, kind="stable")
            places = np.concatenate([*(x[1] for x in parts), fp.astype(np.int64)])[order]
            common = np.concatenate([*(x[2] for x in parts), fc])[order]
            chars, mover = chars[order], mover[order]
            before, pushes = self.causes(chars, places, mover)
            back = before[pushes & (before < upto)]
            least = int(back.min()) if len(back) else upto
            if least > low:
                n = int(np.searchsorted(chars, least))
                chars, places, common, mover = chars[:n], places[:n], common[:n], mover[:n]
                pushed = self.emit(chars, places, common, mover, before[:n], pushes[:n])
                advance(least)
                want = 2 * want if least == upto else max(256, 2 * n)
                low = least
                after(*pushed)
                yield places, common, mover
                continue
            n = int(np.searchsorted(chars, low, "right"))  # the first character pushes to itself
            k = int(mover[:n].sum())
            fixed = places[k:n], common[k:n].copy()
            advance(low + 1)
            places, common = places[:k], common[:k].copy()
            yield from self._generations(low, places, common, after)
            if len(fixed[0]):
                out, _, on = self._one(low, *fixed, False)
                after(*on)
                yield out
            low += 1


def _stars(level: Level) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """S* places in text order (the last is the sentinel), lengths of the runs that begin there, L suffixes by character."""
    text, n, scratch = level.text, len(level.text), level.scratch
    blocks, m = [], 0
    smaller = np.zeros(level.size, dtype=np.int64)
    end = n - 1  # where the run that holds the place after the chunk ends
    for b in range(n, 0, -CHUNK):
        a = max(0, b - CHUNK)
        part, after = text[a:b], np.append(text[a + 1 : b], text[b] if b < n else 0).astype(text.dtype)
        differs = part != after
        if b == n:
            differs[-1] = True
        at = np.where(differs, np.arange(a, b), end if b < n else n - 1)
        at = np.minimum.accumulate(at[::-1])[::-1]
        end = int(at[0])
        is_s = text[at] < text[np.minimum(at + 1, n - 1)]
        if b == n:
            is_s[-1] = True
        smaller += np.bincount(part[~is_s], minlength=level.size)
        before = np.concatenate([text[a - 1 : a] if a else part[:1], part[:-1]])
        here = np.flatnonzero(is_s & (before > part))
        runs = np.minimum(at[here] - (here + a) + 1, 1 << 15).astype(np.uint16)
        blocks.append((scratch.put((here + a).astype(level.place)), scratch.put(runs)))
        m += len(here)
    stars, run = scratch.array(m, level.place), scratch.array(m, np.uint16)
    at = 0
    for kept in reversed(blocks):
        for x, to in zip(kept, (stars, run), strict=True):
            own = scratch.get(x)
            to[at : at + len(own)] = own
            scratch.free(x)
        at += len(own)
    return stars, run, smaller


def _local_names(level: Level, stars: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct substrings of some stars in order (as rows of words), an example of each, and each star's own."""
    text, n = level.text, len(level.text)
    per, bits = (8, 8) if text.dtype == np.uint8 else (4, 16) if text.dtype == np.uint16 else (2, 32)

    def word(of: np.ndarray, w: int) -> np.ndarray:
        key = np.zeros(len(of), dtype=np.uint64)
        for t in range(w * per, (w + 1) * per):
            char = text[np.minimum(stars[of] + np.int64(t), n - 1)].astype(np.uint64)
            char[lengths[of] <= t] = 0
            key = (key << np.uint64(bits)) | char
        return key

    every = np.arange(len(stars))
    _, first = np.unique(word(every, 0), return_inverse=True)
    long = np.flatnonzero(lengths > per)
    rank = first.astype(np.int64) * (len(long) + 1)
    if len(long):
        more = [word(long, w) for w in range(1, -(-int(lengths[long].max()) // per))]
        order = np.lexsort([*more[::-1], first[long]])
        new = np.zeros(len(long), dtype=bool)
        for x in (first[long], *more):
            new[1:] |= x[order][1:] != x[order][:-1]
        rank[long[order]] += 1 + np.cumsum(new)
    _, example, own = np.unique(rank, return_index=True, return_inverse=True)
    words = -(-int(lengths[example].max()) // per)
    keys = np.stack([word(example, w) for w in range(words)], axis=1)
    return keys, example, own


def _named(level: Level, stars: np.ndarray, run: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Names of the stars' substrings in text order, and by name: an example (number of the star), the width.

    A substring goes from a star to the next one, through the run of equal characters there, to the first that
    differs: so none is the beginning of another, and plain comparison gives the order of suffixes. Those that are
    longer than ``depth`` asks for are cut; suffixes of one such name are alike up to the cap. Runs of distinct
    substrings are sorted by chunk and merged in blocks.
    """
    scratch, m, n = level.scratch, len(stars), len(level.text)
    most = (level.cap + 16 >> level.depth) + 2
    runs, inverse = [], []
    for a in range(0, m, CHUNK // 2):
        b = min(m, a + CHUNK // 2)
        here = stars[a:b].astype(np.int64)
        then = np.append(stars[a + 1 : b + 1], stars[-1:] if b == m else []).astype(np.int64)
        full = np.where(then < n - 1, then - here + np.append(run[a + 1 : b + 1], run[-1:] if b == m else []).astype(np.int64) + 1, n - here)
        cut = full > most
        width = np.minimum(level.cap, level.begin(then).astype(np.int64) - level.begin(here).astype(np.int64))
        keys, example, own = _local_names(level, here, np.minimum(full, most))
        flat = np.ascontiguousarray(keys.astype(">u8")).view(f"S{8 * keys.shape[1]}").ravel()
        runs.append([scratch.put(x) for x in (flat, (example + a).astype(np.int64), np.where(cut, level.cap, width)[example].astype(np.uint8))])
        inverse.append((a, b, scratch.put(own.astype(np.uint32))))
    found = [scratch.get(x[0]) for x in runs]
    widest = max(x.dtype.itemsize for x in found)
    heads, maps, parts, total = [0] * len(runs), [scratch.array(len(x), np.uint32) for x in found], [], 0
    block = max(1024, CHUNK // (8 * len(runs)))
    facts = [[scratch.get(y) for y in x[1:]] for x in runs]
    while any(h < len(x) for h, x in zip(heads, found, strict=True)):
        ends = [x[h + block - 1] for h, x in zip(heads, found, strict=True) if h + block < len(x)]
        bound = min(ends) if ends else None
        tops = [len(x) if bound is None else h + int(np.searchsorted(x[h : h + block], bound, "right")) for h, x in zip(heads, found, strict=True)]
        keys = np.concatenate([x[h:t].astype(f"S{widest}") for h, t, x in zip(heads, tops, found, strict=True)])
        distinct, example, own = np.unique(keys, return_index=True, return_inverse=True)
        at = 0
        for k, (h, t) in enumerate(zip(heads, tops, strict=True)):
            maps[k][h:t] = own[at : at + t - h] + total
            at += t - h
        some = [np.concatenate([f[i][h:t] for h, t, f in zip(heads, tops, facts, strict=True)])[example] for i in (0, 1)]
        parts.append([scratch.put(x) for x in some])
        total += len(distinct)
        heads = tops
    del found, facts
    for x in runs:
        for y in x:
            scratch.free(y)
    names = scratch.array(m, np.uint16 if total <= 1 << 16 else np.uint32)
    for (a, b, own), to in zip(inverse, maps, strict=True):
        names[a:b] = to[scratch.get(own)]
        scratch.free(own)
    scratch.drop(*maps)
    example, width = scratch.array(total, np.int64), scratch.array(total, np.uint8)
    at = 0
    for kept in parts:
        for x, to in zip(kept, (example, width), strict=True):
            own = scratch.get(x)
            to[at : at + len(own)] = own
            scratch.free(x)
        at += len(own)
    return names, example, width


def _directly(level: Level, stars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """S* suffixes in ascending order, with common prefixes, by words of their characters; ties alone go on."""
    text, n, m = level.text, len(level.text), len(stars)
    per, bits = (8, 8) if text.dtype == np.uint8 else (4, 16) if text.dtype == np.uint16 else (2, 32)
    rank = np.zeros(m, dtype=np.int64)  # the first place of the group
    todo, first = np.arange(m), stars.astype(np.int64)
    for w in range(((level.cap >> level.depth) + 1) // per + 1):  # a character stands for 2**depth of the text at least
        key = np.zeros(len(todo), dtype=np.uint64)
        at = first[todo] + w * per
        for t in range(per):
            inside = at + t < n
            char = text[np.minimum(at + t, n - 1)].astype(np.uint64)
            char[~inside] = 0
            key = (key << np.uint64(bits)) | char
        by = np.lexsort((key, rank[todo])) if w else np.argsort(key, kind="stable")
        todo, key = todo[by], key[by]
        own = rank[todo]
        group = np.concatenate([[True], own[1:] != own[:-1]])
        heads = group | np.concatenate([[True], key[1:] != key[:-1]])
        place = np.arange(len(todo))
        rank[todo] = own + (place[heads][np.cumsum(heads) - 1] - place[group][np.cumsum(group) - 1])
        todo = todo[~(heads & np.append(heads[1:], True))]
        if not len(todo):
            break
    order, common = level.scratch.array(m, level.place), level.scratch.array(m, np.uint8)
    order[:] = stars[np.argsort(rank, kind="stable")]
    if m > 1:
        common[1:] = level.shared(order[:-1], order[1:])
    return order, common


def _sorted_stars(level: Level, stars: np.ndarray, run: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """S* suffixes in ascending order, with common prefixes: by their names, by recursion on these, or if few directly."""
    scratch, m = level.scratch, len(stars)
    if m <= directly():
        return _directly(level, stars)
    names, example, width = _named(level, stars, run)
    total = len(example)
    near = scratch.array(total, np.uint8)
    for a in range(1, total, CHUNK):
        b = min(total, a + CHUNK)
        near[a:b] = level.shared(stars[example[a - 1 : b - 1]], stars[example[a:b]])
    scratch.drop(example)
    order, common = scratch.array(m, level.place), scratch.array(m, np.uint8)
    counts = np.zeros(total, dtype=np.int64)
    for a in range(0, m, CHUNK):
        counts += np.bincount(names[a : a + CHUNK], minlength=total)
    if total == m or (width[counts > 1] >= level.cap).all():  # the names alone decide
        free = np.cumsum(counts) - counts
        for a in range(0, m, CHUNK):
            own = names[a : a + CHUNK]
            by = np.argsort(own, kind="stable")
            line = own[by]
            new = np.concatenate([[True], line[1:] != line[:-1]])
            heads = np.flatnonzero(new)
            inside = np.arange(len(line)) - heads[np.cumsum(new) - 1]
            to = free[line] + inside
            order[to] = stars[a + by]
            common[to] = np.where(free[line] + inside == (np.cumsum(counts) - counts)[line], near[line], level.cap)
            free += np.bincount(own, minlength=total)
    else:
        origin = level.begin(stars)
        below = Level(names, total, level.cap, scratch, level.base, origin, width, near, level.depth + 1)
        at = m
        for places, shared, _ in _suffixes(below):
            order[at - len(places) : at] = stars[places][::-1]
            to = np.arange(at, at - len(places), -1)  # with the one after it
            inner = to < m
            common[to[inner]] = shared[inner]
            at -= len(places)
    scratch.drop(names, width, near)
    return order, common


def _suffixes(level: Level) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """All suffixes in descending order, in vectors, with common prefixes with the one before."""
    scratch, n = level.scratch, len(level.text)
    if n == 1:
        yield np.zeros(1, dtype=np.int64), np.zeros(1, dtype=np.uint8), np.ones(1, dtype=bool)
        return
    stars, run, smaller = _stars(level)
    order, common = _sorted_stars(level, stars, run)
    heads = np.zeros(level.size, dtype=np.int64)
    for a in range(0, len(stars), CHUNK):
        heads += np.bincount(level.text[stars[a : a + CHUNK]], minlength=level.size)
    scratch.drop(stars, run)
    starts = lambda counts: np.concatenate([[0], np.cumsum(counts)])
    total = int(smaller.sum())
    line, shared, at = scratch.array(total, level.place), scratch.array(total, np.uint8), 0
    for places, own, mover in Pass(level, Fixed(order, common, starts(heads), False), False):
        k = int(mover.sum())
        line[at : at + k], shared[at : at + k] = places[mover], own[mover]
        at += k
    scratch.drop(order, common)
    yield from Pass(level, Fixed(line, shared, starts(smaller), True), True)
    scratch.drop(line, shared)
    yield np.array([n - 1]), np.zeros(1, dtype=np.uint8), np.ones(1, dtype=bool)


def suffixes(text: np.ndarray, cap: int, scratch: Scratch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All suffixes in descending order, in vectors, each with its common prefix (up to ``cap``) with the one before.

    ``text`` holds positive characters and ends in its only 0; suffixes alike in ``cap`` characters may come in any
    order.
    """
    if not 0 < cap < 255:
        raise ValueError("common prefixes are carried up to 254 characters")
    for places, common, _ in _suffixes(Level(text, int(text.max()) + 1, cap, scratch, text)):
        yield places, common
