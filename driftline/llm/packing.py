"""Packing (operator 6): vector bin packing of token sequences.

A piece has a demand vector (tokens, segments, loss-bearing tokens), a sequence has that many left of each, and
the dot-product heuristic puts next into the open sequence the piece whose demands, weighted by how scarce each
resource is, point most along what is left. Pieces wait in a window of bounded size, grouped by length class, so a
choice looks at a few hundred candidates. When no waiting piece fits whole, the best one is cut (where cutting is
allowed), so that sequences come out full.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections import deque
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chosen, column, fields_of, free_name, kept_as, map_arrow
from .tokens import byte_letters

DEFAULT, END = "word_bpe_49k.json", 2
#: One run of letters whose lower case is one code point each, and marks that are one piece after it.
_WORD = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?]*)\Z")
_KEEP, _LONG = 500_000, 256


#: Words that a tokenizer must encode alike alone and in a text.
_TRIED = "The straße of déjà vu, don't x1 2024 (ÜBER)! 漢字 a\u0301 ... #tag _y z"


class WordTokenizer:
    """Ids of whole texts, for lower-casing BPE tokenizers whose tokens never cross white space.

    Words are looked up; a new one is its run of letters, in lower case, and the marks after it. A run is one piece
    for the tokenizer, so its model is asked directly; that this holds is tried on some words at first. Words of any
    other make are encoded as they are.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.inner = Tokenizer.from_file(path)
        self.model = self.inner.model.tokenize
        self.letters = {b: c for c, b in byte_letters().items()}
        self.direct, self.known = False, _Words(self)
        tried = ["The", "Straße", "déjà", "ÜBERÿ", "x"]
        self.direct = all(self._run(w.lower()) == e for w, e in zip(tried, self._encode(tried), strict=True))
        alone = b"".join(self._encode(_TRIED.split()))
        if any(next(self._encode([sep.join(_TRIED.split())])) != alone for sep in (" ", "\n", "  \n ", "\t")):
            raise ValueError(f"{path}: tokens depend on the white space around words; use a tokenizer for which they do not")

    def _encode(self, words: list[str]) -> Iterator[bytes]:
        for at in range(0, len(words), 20_000):
            for e in self.inner.encode_batch(words[at : at + 20_000], add_special_tokens=False):
                yield np.array(e.ids, dtype="<u4").tobytes()

    def _run(self, run: str) -> bytes:
        """Ids of a lower-case run of letters."""
        shown = run if run.isascii() else "".join(map(self.letters.__getitem__, run.encode()))
        return array("I", [t.id for t in self.model(shown)]).tobytes()

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        get = self.known.__getitem__
        return [np.frombuffer(b"".join(map(get, t.replace("\n", " ").split(" "))), dtype="<u4") for t in texts]


class _Words(dict):
    """Ids by word, learnt where they are first asked for; emptied when full."""

    def __init__(self, tokenizer: WordTokenizer):
        super().__init__()
        self.tokenizer, self.runs = tokenizer, {}

    def __missing__(self, word: str) -> bytes:
        own, runs = self.tokenizer, self.runs
        run, marks = (word, "") if word.isascii() and word.isalpha() else m.groups() if (m := _WORD.match(word)) else ("", "")
        if run and own.direct:
            run = run.lower()
            found = runs.get(run)
            if found is None:
                if len(runs) >= _KEEP:
                    runs.clear()
                found = runs[run] = own._run(run)
            if marks:
                found += self[marks]
        else:
            found = next(own._encode([word]))
        if len(word) <= _LONG:
            if len(self) >= _KEEP:
                self.clear()
            self[word] = found
        return found


_tokenizers: dict[str, WordTokenizer] = {}


def tokenizer(name: str) -> WordTokenizer:
    """One for each file and Python worker; a bare file name is one of ``public_tokenizers``."""
    if name not in _tokenizers:
        path = name
        if "/" not in name:
            import public_tokenizers

            path = public_tokenizers.path(name)
        _tokenizers[name] = WordTokenizer(path)
    return _tokenizers[name]


@dataclass
class Piece:
    """A run of one document's ids. ``loss`` marks ids that bear loss (None: all of them)."""

    key: tuple
    ids: np.ndarray
    start: int
    total: int
    loss: np.ndarray | None = None

    def __len__(self) -> int:
        return len(self.ids)

    @property
    def loss_tokens(self) -> int:
        return len(self.ids) if self.loss is None else int(self.loss.sum())

    def cut(self, n: int) -> tuple[Piece, Piece]:
        head = Piece(self.key, self.ids[:n], self.start, self.total, None if self.loss is None else self.loss[:n])
        return head, Piece(self.key, self.ids[n:], self.start + n, self.total, None if self.loss is None else self.loss[n:])


class Packer:
    """Streams pieces into sequences under three limits; holds at most ``window`` waiting tokens (and one document)."""

    def __init__(self, tokens: int = 4096, segments: int = 128, loss: int = 4096, window: int = 2_000_000, cut: bool = True, choices: int = 64):
        if min(tokens, segments, loss) < 1:
            raise ValueError("limits are positive")
        self.limit = np.array([tokens, segments, loss], dtype=float)
        self.window, self.may_cut, self.choices = window, cut, choices
        self.waiting: list[deque[Piece]] = [deque() for _ in range(64)]  # by bit length
        self.held = 0
        self.open: list[Piece] = []
        self.left = self.limit.copy()

    def add(self, piece: Piece) -> Iterator[list[Piece]]:
        """Take a document; yields sequences that got full on the way."""
        tokens = int(self.limit[0])
        if self.may_cut:
            while len(piece) >= tokens and (head := piece.cut(tokens)[0]).loss_tokens <= self.limit[2]:
                piece = piece.cut(tokens)[1]
                yield [head]
        elif len(piece) > tokens or piece.loss_tokens > self.limit[2]:
            raise ValueError("a document exceeds a sequence's limits, and cutting is off")
        if len(piece):
            self._wait(piece)
        while self.held > self.window:
            yield from self._step()

    def finish(self) -> Iterator[list[Piece]]:
        """The rest; with cutting, the last sequence is split at powers of two, which need no padding."""
        while self.held:
            yield from self._step()
        if self.open:
            yield from self._powers(self.open) if self.may_cut else [self.open]
            self.open = []

    def _wait(self, piece: Piece) -> None:
        self.waiting[len(piece).bit_length()].append(piece)
        self.held += len(piece)

    def _candidates(self) -> list[Piece]:
        """The oldest pieces of each length class, longest class first."""
        out: list[Piece] = []
        share = max(4, self.choices // 8)
        for line in reversed(self.waiting):
            out += [line[i] for i in range(min(share, len(line)))]
            if len(out) >= self.choices:
                break
        return out

    def _step(self) -> Iterator[list[Piece]]:
        """Put one piece into the open sequence, or close it."""
        some = self._candidates()
        # classes that do not fit at all are passed over, so that shorter ones are seen
        room = int(self.left[0])
        if all(len(p) > room for p in some):
            some = [line[i] for line in self.waiting[: room.bit_length() + 1] for i in range(min(8, len(line)))] or some
        demand = np.array([[len(p), 1, p.loss_tokens] for p in some], dtype=float) / self.limit
        left = self.left / self.limit
        fits = (demand <= left + 1e-12).all(axis=1)
        if fits.any():
            score = np.where(fits, demand @ left, -1.0)
            piece = some[int(score.argmax())]
            self._take(piece)
            self._place(piece)
        elif not self.may_cut or self.left[1] < 1 or min(self.left[0], self.left[2]) < 1:
            yield self._close()
            return
        else:
            piece = some[int((demand @ left).argmax())]
            n = min(int(self.left[0]), len(piece))
            if piece.loss is None:
                n = min(n, int(self.left[2]))
            else:
                n = min(n, int(np.searchsorted(np.cumsum(piece.loss), self.left[2], side="right")))
            self._take(piece)
            head, rest = piece.cut(n)
            self._place(head)
            if len(rest):
                self._wait(rest)
        if self.left[0] < 1 or self.left[1] < 1 or self.left[2] < 1:
            yield self._close()

    def _take(self, piece: Piece) -> None:
        line = self.waiting[len(piece).bit_length()]
        for i, p in enumerate(line):
            if p is piece:
                del line[i]
                break
        self.held -= len(piece)

    def _place(self, piece: Piece) -> None:
        self.open.append(piece)
        self.left -= (len(piece), 1, piece.loss_tokens)

    def _close(self) -> list[Piece]:
        full, self.open, self.left = self.open, [], self.limit.copy()
        return full

    @staticmethod
    def _powers(pieces: list[Piece]) -> Iterator[list[Piece]]:
        left = sum(map(len, pieces))
        line = deque(pieces)
        while left:
            want = 1 << (left.bit_length() - 1)
            left -= want
            out = []
            while want:
                piece = line.popleft()
                if len(piece) > want:
                    piece, rest = piece.cut(want)
                    line.appendleft(rest)
                want -= len(piece)
                out.append(piece)
            yield out


def _flush(sequences: Iterator[list[Piece]], first: int) -> Iterator[tuple]:
    for k, sequence in enumerate(sequences):
        offset = 0
        for p in sequence:
            yield (p.key, p.start, len(p), zlib.crc32(p.ids.tobytes()), p.total, first + k, offset, p.loss_tokens)
            offset += len(p)


def pack(docs: DataFrame, tokens: int = 4096, segments: int = 128, loss: int = 4096, tokenizer_file: str = DEFAULT, end: int = END, keep: tuple[str, ...] = ("doc_id",), text: str = "text", window: int = 2_000_000, cut: bool = True, loss_mask: Callable | None = None) -> DataFrame:
    """Per piece: the columns ``keep``, start, length, ids_crc32, doc_tokens, sequence_id, offset, loss_tokens.

    Map-only: each input partition fills its own sequences, so any number of executors work without a shuffle, and
    a retried task gives the same sequences from the same rows. ``sequence_id`` is the partition's number times
    2**40 plus the sequence's number there. ``loss_mask(ids)`` gives the loss-bearing ids (None: all). A null text
    is one end id; null keys and repeated rows are packed each as a document of its own; very long texts are cut
    and stream through; an empty table gives no rows; other columns are not read.
    """
    own = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "loss_tokens"]
    names = kept_as(keep, own)
    at = free_name(list(names), "text_")
    slim = docs.select(*chosen(keep, names), F.coalesce(column(text), F.lit("")).alias(at))
    fields = fields_of(slim.drop(at))
    types = pa.schema([pa.field(n, pa.int64()) for n in own])

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = tokenizer(tokenizer_file)
        packer = Packer(tokens, segments, loss, window, cut)
        number = TaskContext.get().partitionId() << 40
        rows: list[tuple] = []
        key_types: list[pa.DataType] = []

        def out() -> pa.RecordBatch:
            keys = [pa.array([r[0][i] for r in rows], t) for i, t in enumerate(key_types)]
            columns = [pa.array([r[i + 1] for r in rows], types.field(i).type) for i in range(len(own))]
            rows.clear()
            return pa.RecordBatch.from_arrays([*keys, *columns], names=[*names, *own])

        for batch in batches:
            key_types = [c.type for c in batch.columns[:-1]]
            texts = batch.column(batch.num_columns - 1).to_pylist()
            lists = [c.to_pylist() for c in batch.columns[:-1]]
            for a in range(0, len(texts), 256):
                for i, ids in enumerate(words.ids(texts[a : a + 256]), a):
                    ids = np.append(ids, np.uint32(end))
                    piece = Piece(tuple(c[i] for c in lists), ids, 0, len(ids), None if loss_mask is None else np.asarray(loss_mask(ids), dtype=bool))
                    for sequence in packer.add(piece):
                        rows += _flush(iter([sequence]), number)
                        number += 1
            if len(rows) > 20_000:
                yield out()
        for sequence in packer.finish():
            rows += _flush(iter([sequence]), number)
            number += 1
        if rows:
            yield out()

    return map_arrow(slim, fill, ", ".join([*fields, *(f"{n} long" for n in own)]))
