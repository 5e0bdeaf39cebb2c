"""Token counts (operator 9): prefix dynamic programming over byte-pair encodings.

The encoding of a prefix ends in exactly one token whose pairing with the encoding of the shorter prefix is
stable under the merges. So a table of (last token, count) over the prefixes of a piece is filled from left to
right, and holds the exact token count of every prefix. A text is cut where no token crosses (before a space
or line feed that follows a non-space); the tables of its chunks, added up, answer count, truncation and budget questions
without encoding anything again.
"""

from __future__ import annotations

import gc
import json
import re
from array import array
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chosen, column, fields_of, free_name, kept_as, map_arrow

DEFAULT = "byte_bpe_50k.json"
#: For the tokenizer's splitter, these are one run of letters and one of marks, whatever prefix is taken.
_WORD = re.compile(r"(\n?)( ?[A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?]*)\Z")
_ODD_SPACE = re.compile(r"\s[ \n]")
_CUT = re.compile(r"(?<=\S)(?=[ \n])")
#: White space and contractions of three characters, as the tokenizer's splitter has them.
_SPACES = frozenset("\t\n\x0b\x0c\r \x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(map(chr, range(0x2000, 0x200B))))
_PARTED = frozenset(("'re", "'ve", "'ll"))
_KEEP, _LONG, _HEADS = 600_000, 256, (9, 7, 5)


def byte_letters() -> dict[str, int]:
    """Byte-level alphabet: printable bytes stand for themselves, the others for code points from 256 upward."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class PrefixCounter:
    """Exact token counts of all prefixes of texts, for a byte-level BPE tokenizer file without normalizer."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        raw = lambda s: bytes(letters[c] for c in s)
        specials = {x["content"] for x in spec["added_tokens"]}
        self.special = re.compile("|".join(map(re.escape, sorted(specials, key=len, reverse=True)))) if specials else None
        self.vocab = {raw(s) for s in spec["model"]["vocab"] if s not in specials}
        pairs = (m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"])
        self.ranks = {(raw(a), raw(b)): i for i, (a, b) in enumerate(pairs)}
        self.halves = {a + b: (a, b) for a, b in reversed(self.ranks)}
        self.spines: dict[tuple[bytes, bool], list[tuple[bytes, int]]] = {}
        self.tails = {t[i:] for t in self.vocab for i in range(len(t))}
        self.split = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str
        self.heads: dict[bytes, tuple[list[int], list[int], list[bytes]]] = {}
        self.fits: dict[tuple[bytes, bytes], bool] = {}
        self.tables = _Tables(self)
        self.totals = _Totals(self)

    def encode(self, piece: bytes) -> list[bytes]:
        """Plain merging of one short piece, the definition that the tables are checked against."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        ranks, none = self.ranks, len(self.ranks)
        while len(parts) > 1:
            least = min(map(lambda p: ranks.get(p, none), zip(parts, parts[1:], strict=False)))
            if least == none:
                break
            out, i = [], 0
            while i < len(parts):
                if i + 1 < len(parts) and ranks.get((parts[i], parts[i + 1])) == least:
                    out.append(parts[i] + parts[i + 1])
                    i += 2
                else:
                    out.append(parts[i])
                    i += 1
            parts = out
        return parts

    def spine(self, token: bytes, right: bool) -> list[tuple[bytes, int]]:
        """The parts of a token that stood at its right (or left) end while it was merged, and each one's last rank."""
        key = (token, right)
        got = self.spines.get(key)
        if got is None:
            got, death = [], len(self.ranks) + 1
            while True:
                got.append((token, death))
                if len(token) == 1:
                    break
                halves = self.halves[token]
                token, death = halves[right], self.ranks[halves]
            got.reverse()
            self.spines[key] = got
        return got

    def stable(self, a: bytes, b: bytes) -> bool:
        """Whether the tokens a and b stay as they are side by side: no merge across them comes before their own.

        Of two merges of one rank, the left one is first.
        """
        if not a:
            return True
        if (got := self.fits.get((a, b))) is not None:
            return got
        if len(self.fits) > 2 * _KEEP:
            self.fits.clear()
        ranks, none = self.ranks, len(self.ranks) + 2
        left, right, i, j = self.spine(a, True), self.spine(b, False), 0, 0
        while True:
            (x, x_ends), (y, y_ends) = left[i], right[j]
            across = ranks.get((x, y), none)
            if across < x_ends and across <= y_ends:
                got = False
                break
            if i + 1 < len(left) and (x_ends <= y_ends or j + 1 == len(right)):
                i += 1
            elif j + 1 < len(right):
                j += 1
            else:
                got = True
                break
        self.fits[a, b] = got
        return got

    def piece(self, data: bytes) -> list[int]:
        """Token counts of the prefixes of 0, 1, ... bytes of one piece."""
        vocab, tails, stable, fits = self.vocab, self.tails, self.stable, self.fits
        counts, starts, last = [0], [0], [b""]
        for cut in _HEADS:  # many words begin alike
            if len(data) >= cut and (head := self.heads.get(data[:cut])):
                counts, starts, last = head[0][:], head[1][:], head[2][:]
                break
        for end in range(len(counts), len(data) + 1):
            at = starts[-1]  # the token that ended here before is often the one that grows
            token = data[at:end]
            if not (token in vocab and ((own := last[at]) == b"" or (fits[own, token] if (own, token) in fits else stable(own, token)))):
                for at in range(end - 1, -1, -1):
                    token = data[at:end]
                    if token in vocab and ((own := last[at]) == b"" or (fits[own, token] if (own, token) in fits else stable(own, token))):
                        break
                    if token not in tails:
                        raise ValueError(f"no encoding of {data[:end]!r}")
            counts.append(counts[at] + 1)
            starts.append(at)
            last.append(token)
            if end in _HEADS:
                if len(self.heads) >= _KEEP // 8:
                    self.heads.clear()
                self.heads[data[:end]] = counts[:], starts[:], last[:]
        return counts

    def chars(self, piece: str) -> list[int]:
        """Token counts of the prefixes of 0, 1, ... code points of one piece."""
        data = piece.encode()
        counts = self.piece(data)
        if len(data) == len(piece):
            return counts
        at = accumulate((1 if c < "\x80" else 2 if c < "ࠀ" else 3 if c < "\U00010000" else 4 for c in piece), initial=0)
        return [counts[i] for i in at]

    def table(self, chunk: str) -> list[int]:
        """Token counts of the code point prefixes of a chunk without special strings.

        The pieces come from the tokenizer's own splitter. Where the end of a prefix changes them (a run of space
        leaves its last character to what follows; contractions), the table is that of the prefix's own pieces.
        """
        if m := _WORD.match(chunk):
            line, word, marks = m.groups()
            if not line and not marks:
                return self.chars(chunk)
            out = [0, 1] if line else [0]
            for part in (word, marks):
                if part:
                    base = out[-1]
                    out += [base + x for x in (self.tables[part] if part is word else self.chars(part))[1:]]
            return out
        out, s, run, counts, before = [0], 0, (0, 0), [0], 0
        base = 0  # tokens of the pieces before
        for _, (_, e) in self.split(chunk):
            piece = chunk[s:e]
            own = self.chars(piece)
            if s >= run[1] and piece[0] in _SPACES:  # a run of space that a prefix ends in is one piece
                stop = s + 1
                while stop < len(chunk) and chunk[stop] in _SPACES:
                    stop += 1
                run, before, counts = (s, stop), base, self.chars(chunk[s:stop])
            inside = max(0, min(e, run[1]) - s)
            out += [before + counts[s - run[0] + i] for i in range(1, inside + 1)]
            out += [base + x for x in own[inside + 1 :]]
            if piece in _PARTED:  # its first two characters are two pieces
                out[-2] = base + 2
            s, base = e, base + own[-1]
        return out

    @staticmethod
    def chunks(text: str) -> list[str]:
        """The text, cut before every space and line feed that follows something else than white space."""
        if _ODD_SPACE.search(text):
            return [x for x in _CUT.split(text) if x]
        out: list[str] = []
        for line in text.split("\n"):
            first, *rest = line.split(" ")
            out.append(f"\n{first}")
            out += [f" {x}" for x in rest]
        if len(out[0]) > 1:
            out[0] = out[0][1:]
        else:
            del out[0]
        return out

    def parts(self, text: str) -> Iterator[tuple[str, bool]]:
        """Ordinary stretches and special strings, in order."""
        at = 0
        for m in self.special.finditer(text) if self.special else ():
            if m.start() > at:
                yield text[at : m.start()], False
            yield m[0], True
            at = m.end()
        if at < len(text):
            yield text[at:], False

    def count(self, text: str) -> int:
        """Tokens of a whole text: the last entry of its prefix table."""
        total = 0
        for part, special in self.parts(text):
            total += 1 if special else sum(map(self.totals.__getitem__, self.chunks(part)))
        return total

    def prefixes(self, text: str) -> list[int]:
        """Token counts of the prefixes of 0, 1, ..., all code points of a text."""
        out = [0]
        for part, special in self.parts(text):
            base = out[-1]
            if special:  # an unfinished special string is ordinary text after the stretch before it
                whole = text[: len(out) - 1]
                near = whole[max(self._safe(whole), self._after_special(whole)) :]
                head = base - self.count(near)
                out += [head + self.count(near + part[:i]) for i in range(1, len(part))] + [base + 1]
            else:
                for chunk in self.chunks(part):
                    table, base = self.tables[chunk], out[-1]
                    out += [base + x for x in table[1:]]
        return out

    def _after_special(self, text: str) -> int:
        return max((m.end() for m in self.special.finditer(text)), default=0) if self.special else 0

    @staticmethod
    def _safe(text: str) -> int:
        found = None
        for found in _CUT.finditer(text):
            pass
        return found.end() if found else 0

    def fitting(self, text: str, budgets: Iterable[int]) -> list[int]:
        """For each budget, the code points of the longest prefix of the text that has no more tokens."""
        return self.measured(text, budgets)[1]

    def measured(self, text: str, budgets: Iterable[int]) -> tuple[int, list[int]]:
        """``count`` and ``fitting`` of a text, which is cut once."""
        if self.special and self.special.search(text):  # an unfinished special string has tokens of its own
            counts = self.prefixes(text)
            return counts[-1], [max(i for i, x in enumerate(counts) if x <= b) for b in budgets]
        chunks = self.chunks(text) if text else []
        totals = list(map(self.totals.__getitem__, chunks))
        total = sum(totals)
        if total <= min(budgets, default=total):
            return total, [len(text) for _ in budgets]
        sums = [0, *accumulate(totals)]
        out = []
        for budget in budgets:
            k = bisect_right(sums, budget) - 1
            best = sum(map(len, chunks[:k]))
            if k < len(chunks):
                best += max(i for i, x in enumerate(self.tables[chunks[k]]) if sums[k] + x <= budget)
            out.append(best)
        return total, out


class _Tables(dict):
    """Prefix tables by chunk; emptied when full, and long chunks are not kept."""

    def __init__(self, counter: PrefixCounter):
        super().__init__()
        self.counter = counter

    def __missing__(self, chunk: str):
        table = self.counter.table(chunk)
        table = bytes(table) if max(table) < 256 else array("l", table)
        if len(chunk) <= _LONG:
            if len(self) >= _KEEP // 2:
                self.clear()
            self[chunk] = table
        return table


class _Totals(dict):
    """The last entries of the tables."""

    def __init__(self, counter: PrefixCounter):
        super().__init__()
        self.counter = counter

    def __missing__(self, chunk: str) -> int:
        if m := _WORD.match(chunk):
            line, word, marks = m.groups()
            if marks or line:
                total = (1 if line else 0) + self[word] + (self[marks] if marks else 0)
            else:
                total = self.counter.piece(chunk.encode())[-1]
        else:
            total = self.counter.table(chunk)[-1]
        if len(chunk) <= _LONG:
            if len(self) >= _KEEP:
                self.clear()
            self[chunk] = total
        return total


_counters: dict[str, PrefixCounter] = {}


def counter(tokenizer: str) -> PrefixCounter:
    """One counter for each tokenizer file and Python worker; a bare file name is one of ``public_tokenizers``."""
    if tokenizer not in _counters:
        path = tokenizer
        if "/" not in tokenizer:
            import public_tokenizers

            path = public_tokenizers.path(tokenizer)
        _counters[tokenizer] = PrefixCounter(path)
    return _counters[tokenizer]


def token_counts(docs: DataFrame, tokenizer: str = DEFAULT, budgets: tuple[int, ...] = (512,), keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """Per row: the columns ``keep``, ``n_bytes``, ``n_tokens`` and, for each budget b, ``chars_within_b``.

    ``chars_within_b`` is the code point length of the longest prefix of at most b tokens. Map-only: rows keep
    their partitions, memory holds one batch and the bounded chunk tables. A null text counts as empty (0 bytes,
    0 tokens); repeated rows and null keys each keep their row; an empty table gives an empty result; other
    columns of the input, whatever their names, are not read. Special strings inside texts count as the
    tokenizer's one token, its default.
    """
    own_names = ["n_bytes", "n_tokens", *(f"chars_within_{b}" for b in budgets)]
    names = kept_as(keep, own_names)
    at = free_name(list(names), "text_")
    slim = docs.select(*chosen(keep, names), F.coalesce(column(text), F.lit("")).alias(at))
    fields = fields_of(slim.drop(at))
    schema = ", ".join([*fields, "n_bytes long", "n_tokens long", *(f"chars_within_{b} long" for b in budgets)])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(tokenizer)
        gc.set_threshold(500_000, 50, 1000)  # the tables are large and hold no cycles
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            rows = [(len(t.encode()), *own.measured(t, budgets)) for t in (x.as_py() for x in texts)]
            arrays = [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64())]
            arrays += [pa.array([r[2][i] for r in rows], pa.int64()) for i in range(len(budgets))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *arrays], names=[*names, *own_names])

    return map_arrow(slim, count, schema)
