"""SimHash near-duplicates (operator 4) by meet-in-the-middle ball hashing.

Two fingerprints differ in at most r bits exactly if some value is within r/2 bits of both (r even). So every
distinct fingerprint emits all variants within half the radius, variants are shuffled to bins, and fingerprints
that share a variant are linked. The bin of a variant is its exclusive-or folded to ``fold`` bits, which is linear:
the 2081 variants of radius 2 lie in 1 + 12 + 66 of 4096 bins, and which of them lie in a bin follows from the
fingerprint. So one message for each fingerprint and bin stands for all its variants there, and the bin's task
expands them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, chosen, column, fields_of, free_name, join_unequal, kept_as, map_arrow, row_identity, stored
from .components import components

SEED = 42
_BLOCK, _ROUND = 1 << 16, 4_000_000


def fingerprint(text: str | None, words: int = 4) -> int:
    """64-bit SimHash of the word shingles, repeats included; ASCII case is folded; no words: 0."""
    from xxhash import xxh64_intdigest

    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return 0
    n = max(1, len(parts) - words + 1)
    joined = b" ".join(parts)
    ends = np.cumsum([len(p) + 1 for p in parts]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    last = ends[min(words, len(parts)) - 1 :]
    set_bits = np.zeros(64, dtype=np.int64)
    for at in range(0, n, _BLOCK):  # long texts in blocks
        spans = zip(starts[at : min(n, at + _BLOCK)].tolist(), last[at : at + _BLOCK].tolist(), strict=False)
        hashes = np.array([xxh64_intdigest(joined[a:b], SEED) for a, b in spans], dtype="<u8")
        set_bits += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * set_bits > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, words: int = 4, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """The columns ``keep`` and ``simhash`` (the 64 bits as a long) of every row; map-only."""
    names = kept_as(keep, ["simhash"])
    at = free_name(list(names), "text_")
    slim = docs.select(*chosen(keep, names), column(text).alias(at))
    fields = fields_of(slim.drop(at))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t.as_py(), words) for t in batch.column(batch.num_columns - 1)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found.view(np.int64))], names=[*names, "simhash"])

    return map_arrow(slim, run, ", ".join([*fields, "simhash long"]))


def fold_of(values: np.ndarray, fold: int) -> np.ndarray:
    """Exclusive-or of a 64-bit value's groups of ``fold`` bits."""
    out, rest = np.zeros(values.shape, dtype=np.uint64), values.astype(np.uint64)
    for at in range(0, 64, fold):
        out ^= (rest >> np.uint64(at)) & np.uint64((1 << fold) - 1)
    return out.astype(np.int64)


@lru_cache(maxsize=4)
def masks(half: int, fold: int) -> dict[int, np.ndarray]:
    """All 64-bit values of at most ``half`` set bits, by their fold."""
    flat = np.array([sum(1 << b for b in c) for k in range(half + 1) for c in combinations(range(64), k)], dtype=np.uint64)
    bins = fold_of(flat, fold)
    order = np.argsort(bins, kind="stable")
    cuts = np.flatnonzero(np.diff(bins[order])) + 1
    return {int(bins[part[0]]): flat[part] for part in np.split(order, cuts)}


_PARITIES = np.random.default_rng(SEED).integers(0, 1 << 64, 24, dtype=np.uint64)


def _parity(values: np.ndarray, bits: int) -> np.ndarray:
    """Parities of the value under some fixed masks: linear, like the fold, and independent of it."""
    out = np.zeros(len(values), dtype=np.int64)
    for k in range(bits):
        out |= (np.bitwise_count(values & _PARITIES[k]).astype(np.int64) & 1) << k
    return out


def meet(own: np.ndarray, at: int, half: int, fold: int) -> np.ndarray:
    """Links (rows of two) among the fingerprints whose balls reach bin ``at``: those that share a variant there.

    Fingerprints with a common variant are all within 2 x half bits of each other, so links to the least of them
    keep the components. Larger bins are split by parities of the variants: as these are linear too, which variants
    of a fingerprint lie in a part follows from its own parities, and each is made once.
    """
    by_fold, groups = masks(half, fold), fold_of(own, fold)
    total = sum(int(n) * len(by_fold.get(int(g) ^ at, ())) for g, n in zip(*np.unique(groups, return_counts=True), strict=True))
    bits = min(len(_PARITIES), max(0, (total - 1) // _ROUND).bit_length())
    order = np.lexsort((_parity(own, bits), groups))
    groups, parities = groups[order], _parity(own[order], bits)
    cuts = np.flatnonzero((np.diff(groups) != 0) | (np.diff(parities) != 0)) + 1
    parts = [(int(groups[p[0]]), int(parities[p[0]]), order[p]) for p in np.split(np.arange(len(own)), cuts)]
    split: dict[int, dict[int, np.ndarray]] = {}
    for g in {g for g, _, _ in parts}:
        if (m := by_fold.get(g ^ at)) is not None:
            of = _parity(m, bits)
            split[g] = {int(v): m[of == v] for v in np.unique(of)}
    links = []
    for now in range(1 << bits):
        values, owners = [], []
        for g, u, p in parts:
            if (m := split.get(g, {}).get(u ^ now)) is not None:
                values.append((own[p, None] ^ m[None, :]).ravel())
                owners.append(np.repeat(p, len(m)))
        if not values:
            continue
        variants, who = np.concatenate(values), np.concatenate(owners)
        ranked = np.sort(variants)
        twice = np.unique(ranked[1:][ranked[1:] == ranked[:-1]])
        if not len(twice):
            continue
        place = np.minimum(np.searchsorted(twice, variants), len(twice) - 1)
        hit = twice[place] == variants
        run, who = place[hit], own[who[hit]]
        order = np.lexsort((who, run))
        run, who = run[order], who[order]
        first = np.concatenate([[True], run[1:] != run[:-1]])
        least = who[first][np.cumsum(first) - 1]
        pairs = np.stack([least, who], axis=1)[~first]
        links.append(np.unique(pairs[np.bitwise_count(pairs[:, 0] ^ pairs[:, 1]) <= 2 * half], axis=0))
    return np.unique(np.concatenate(links), axis=0) if links else np.empty((0, 2), dtype=np.uint64)


class Forest:
    """Keeps, of the links seen so far, those that join two trees."""

    def __init__(self, most: int = 400_000):
        self.up: dict[int, int] = {}
        self.most = most

    def root(self, x: int) -> int:
        up, y = self.up, x
        while (p := up.get(y, y)) != y:
            y = p
        while (p := up.get(x, x)) != y:
            up[x], x = y, p
        return y

    def joins(self, a: int, b: int) -> bool:
        if len(self.up) > self.most:
            self.up.clear()  # some links may come again
        x, y = self.root(a), self.root(b)
        if x == y:
            return False
        self.up[max(x, y)] = min(x, y)
        return True


def ball_links(distinct: DataFrame, radius: int = 4, fold: int | None = None) -> DataFrame:
    """Links ``a, b`` between distinct fingerprints (column ``simhash``) that keep the components at ``radius`` bits.

    There are 2**``fold`` bins; without it, so many that a bin holds about a million variants.
    """
    if radius % 2 or not 0 < radius <= 6:
        raise ValueError("the radius is 2, 4 or 6 bits")
    half = radius // 2
    if fold is None:
        variants = distinct.count() * sum(math.comb(64, k) for k in range(half + 1))
        fold = min(30, max(12, (variants // 1_000_000).bit_length()))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reach = np.array(sorted(masks(half, fold)), dtype=np.int64)
        for batch in batches:
            own = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for a in range(0, len(own), 20_000):
                part = own[a : a + 20_000]
                bins = (fold_of(part, fold)[:, None] ^ reach[None, :]).ravel()
                order = np.argsort(bins, kind="stable")
                who, bins = part[order // len(reach)], bins[order]
                cuts = np.concatenate([[0], np.flatnonzero(np.diff(bins)) + 1, [len(bins)]])
                blobs = [who[i:j].tobytes() for i, j in zip(cuts[:-1], cuts[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(bins[cuts[:-1]], pa.int32()), pa.array(blobs, pa.binary())], names=["bin", "own"])

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, at, held = Forest(), None, []

        def done() -> pa.RecordBatch:
            own = np.unique(np.frombuffer(b"".join(held), dtype=np.uint64))
            found = [(a, b) for a, b in meet(own, at, half, fold).tolist() if forest.joins(a, b)] if len(own) > 1 else []
            flat = np.array(found, dtype=np.uint64).reshape(-1, 2).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(flat[:, 0]), pa.array(flat[:, 1])], names=["a", "b"])

        for batch in batches:
            for b, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if b != at and held:
                    yield done()
                    held = []
                at = b
                held.append(blob)
        if held:
            yield done()

    sent = map_arrow(distinct.select("simhash"), emit, "bin int, own binary")
    return map_arrow(sent.repartition("bin").sortWithinPartitions("bin"), link, "a long, b long")


def grouped(docs: DataFrame, words: int, radius: int, fold: int | None, keep: tuple[str, ...], text: str = "text") -> tuple[DataFrame, DataFrame]:
    """The columns ``keep`` and ``simhash`` of every row, and of every fingerprint its ``root``, the group's name."""
    found = stored(fingerprints(docs, words, keep, text), "simhash")
    distinct = checkpointed(found.select("simhash").distinct())
    parts = components(ball_links(distinct, radius, fold))
    named = distinct.join(parts.withColumnRenamed("node", "simhash"), "simhash", "left").select("simhash", F.coalesce("component", "simhash").alias("root"))
    return found, checkpointed(named)


def near_duplicates(docs: DataFrame, words: int = 5, radius: int = 4, fold: int | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: ``key``, ``simhash`` (long) and ``component_id``, the smallest key in its component.

    Documents are linked where their fingerprints differ in at most ``radius`` bits; components are those of all
    links. Rows with equal fingerprints are one node, so a group of copies of any size costs one. Null and empty
    texts have fingerprint 0 and are linked like others; rows with a null key get a component but never name one
    (a component of null keys alone has a null id); repeated rows stay; an empty table gives no rows; other
    columns are not read.
    """
    rows, named = grouped(docs, words, radius, fold, (key,), text)
    least = rows.groupBy("simhash").agg(F.min(column(key)).alias("least")).join(named, "simhash")
    ids = least.groupBy("root").agg(F.min("least").alias("component_id"))
    of = checkpointed(join_unequal(named, ids, "root").select("simhash", "component_id"))
    return join_unequal(rows, of, "simhash").select(column(key), "simhash", "component_id")


def drop_near_duplicates(docs: DataFrame, words: int = 5, radius: int = 4, fold: int | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each component: the one of the smallest key (null keys last, ties by row hash).

    Of repeated rows one stays. Columns are those of the input, whatever their names; nulls as above.
    """
    own = free_name(docs.columns, "row_")
    named = docs.withColumn(own, row_identity(docs))
    rows, roots = grouped(named, words, radius, fold, (key, own), text)
    first = F.min(F.struct(column(key).isNull().alias("n"), column(key).alias("k"), F.col(own).alias("r"))).alias("first")
    heads = rows.groupBy("simhash").agg(first).join(roots, "simhash").groupBy("root").agg(F.min("first").alias("first"))
    return named.join(heads.select(F.col("first.r").alias(own)), own).dropDuplicates([own]).select(*map(column, docs.columns))
