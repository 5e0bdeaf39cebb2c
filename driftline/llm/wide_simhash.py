"""Near-duplicates by a wide SimHash (the pipeline's near-dedup stage), by meet-in-the-middle ball hashing.

A SimHash bit differs between two sets in proportion to their angle. Sets of Jaccard similarity 0.8 are 27 degrees
apart, so of 64 bits 9.7 differ on average, too many for one ball. So the SimHash is 80 sub-fingerprints of 32 bits
wide, and a pair is met where one of them differs in at most 2 bits, which is where their balls of radius 1 share a
variant: a pair at 0.8 meets somewhere with probability 0.9999. As in ``simhash``, variants are binned by a linear
fold, so a message stands for all variants of a sub-fingerprint in a bin. What meets is compared by all bits, and
what may reach the threshold by them, or is not far below it, is of one family: texts of a group just below the
threshold would otherwise meet, and be told apart, in round after round. Equal sub-fingerprints come first, each node against one of its
bucket, so that the balls need only tell of nodes which that has left in different families; of these a bucket tells
no more than joins them. The pairs of a family are compared exactly, from the shingle sets, where its blocks meet, and
only links that join two trees leave the task. So a group of like texts costs rows in proportion to its size (times
its blocks), whether or not its texts reach the threshold, and its pairs are never rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, fields_of, forget, free_name, join_unequal, map_arrow, row_identity, stored
from .components import components
from .shingles import by_bucket, candidates, hub_links, shingle_set
from .simhash import SEED, fold_of

TABLES, BITS = 80, 32
#: Hashed features of a set, and bits of the sketch that only tell met pairs apart.
FEATURES, CHECKED = 1024, 64
#: Differing bits that a pair at 0.8 exceeds but once in some 100,000 times (4.3 deviations): of the last 64, of all.
_MOST_CHECKED, _MOST = 22, 512
#: Differing bits up to which nodes are of one family, whose pairs are compared exactly; more than ``_MOST`` loses nothing.
_RELATED = 672
_ROUNDS, _FIRST, _IN_BIN = 16, 32, 4_000_000
#: So many links at most are joined by one task.
_AT_ONCE = 1_000_000
#: Rounds after which families are joined by what was found. A family's blocks: so many, or of the most nodes and bytes.
_JOINED, _BLOCKS, _LEAST_NODES, _MOST_NODES, _MOST_BYTES = (0, 1, 3, 7), 8, 256, 2048, 16 << 20
_MESSAGE = np.dtype([("own", "<u4"), ("node", "<i8"), ("check", "<u8"), ("label", "<i8")])
_planes: list[np.ndarray] = []


def planes() -> np.ndarray:
    """Normal vectors of the hyperplanes, in whole numbers, so that sums are exact in any order."""
    if not _planes:
        drawn = np.random.default_rng(SEED).standard_normal((FEATURES, TABLES * BITS + CHECKED), dtype=np.float32)
        _planes.append(np.clip(np.rint(drawn * 32), -127, 127))
    return _planes[0]


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """The wide SimHash of each set of shingle hashes, as bytes: the sub-fingerprints, then the bits to compare."""
    counts = np.zeros((len(sets), FEATURES), dtype=np.float32)
    for k, own in enumerate(sets):
        at = (own % np.uint64(FEATURES)).astype(np.int64)
        signs = 1.0 - 2.0 * (own >> np.uint64(63)).astype(np.float64)
        counts[k] = np.bincount(at, signs, FEATURES)
    return np.packbits(counts @ planes() > 0, axis=1, bitorder="little")


def differing(marks: np.ndarray, mark: np.ndarray, most: int = _MOST) -> np.ndarray:
    """Whether sketches are near enough to one that the sets may be alike."""
    return np.bitwise_count(marks.view(np.uint64) ^ mark.view(np.uint64)).sum(axis=1, dtype=np.int64) <= most


def related(marks: np.ndarray, mark: np.ndarray) -> np.ndarray:
    """Whether sketches are near enough to one to be of its family."""
    return differing(marks, mark, _RELATED)


def meet(own: np.ndarray, node: np.ndarray, check: np.ndarray, label: np.ndarray, at: int, fold: int) -> tuple[np.ndarray, np.ndarray]:
    """Variants in bin ``at`` that sub-fingerprints of several labels have, and the nodes; every pair within 2 bits has one.

    Left out is what says nothing new: a variant of one sub-fingerprint alone, as all its nodes meet at the value
    itself, and the greater of the two between two sub-fingerprints. So are two nodes that the other bits tell apart.
    """
    away = fold_of(own, fold) ^ at
    values, owners = [own[away == 0]], [np.flatnonzero(away == 0)]
    for bit in range(BITS):
        near = np.flatnonzero(away == 1 << bit % fold)
        values.append(own[near] ^ np.uint32(1 << bit))
        owners.append(near)
    variants, who = np.concatenate(values), np.concatenate(owners)
    order = np.argsort(variants, kind="stable")
    variants, who = variants[order], who[order]
    if not len(variants):
        return variants, node[:0]
    new = np.concatenate([[True], variants[1:] != variants[:-1]])
    heads = np.flatnonzero(new)
    sizes = np.diff(np.append(heads, len(variants)))
    found = own[who]
    least, most = np.minimum.reduceat(found, heads), np.maximum.reduceat(found, heads)
    middle = np.minimum.reduceat(np.where(found == variants, 0, 1), heads) == 1  # nobody has the value itself
    value = variants[heads]
    labels = label[who]
    keep = np.minimum.reduceat(labels, heads) != np.maximum.reduceat(labels, heads)
    keep &= ~(middle & (least == most))
    two = np.flatnonzero(keep & (sizes == 2))
    x, y = who[heads[two]], who[heads[two] + 1]
    keep[two] = (np.bitwise_count(check[x] ^ check[y]) <= _MOST_CHECKED) & ~(middle[two] & ((least[two] ^ most[two] ^ value[two]) < value[two]))
    rows = np.repeat(keep, sizes)
    return variants[rows], node[who[rows]]


def _met(nodes: DataFrame, first: int, last: int, fold: int) -> DataFrame:
    """``bucket`` (table and variant) and ``node``, of the tables from ``first`` to before ``last``."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reach = np.array([0, *(1 << j for j in range(min(fold, BITS)))], dtype=np.int64)
        for batch in batches:
            marks = np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype=np.uint8).reshape(len(batch), -1)
            message = np.empty(len(batch), dtype=_MESSAGE)
            message["node"], message["label"] = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            message["check"] = np.ascontiguousarray(marks[:, -8:]).view("<u8").ravel()
            for table in range(first, last):
                message["own"] = np.ascontiguousarray(marks[:, 4 * table : 4 * table + 4]).view("<u4").ravel()
                bins = (fold_of(message["own"], fold)[:, None] ^ reach[None, :]).ravel()
                order = np.argsort(bins, kind="stable")
                who, bins = message[order // len(reach)], bins[order]
                cuts = np.concatenate([[0], np.flatnonzero(np.diff(bins)) + 1, [len(bins)]])
                blobs = [who[i:j].tobytes() for i, j in zip(cuts[:-1], cuts[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(bins[cuts[:-1]] + (table << fold)), pa.array(blobs, pa.binary())], names=["bin", "own"])

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []

        def done() -> pa.RecordBatch:
            rows = np.frombuffer(b"".join(held), dtype=_MESSAGE)
            variants, node = meet(*(np.ascontiguousarray(rows[n]) for n in ("own", "node", "check", "label")), at & ((1 << fold) - 1), fold)
            return pa.RecordBatch.from_arrays([pa.array(variants.astype(np.int64) + ((at >> fold) << BITS)), pa.array(node)], names=["bucket", "node"])

        for batch in batches:
            for b, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if b != at and held:
                    yield done()
                    held = []
                at = b
                held.append(blob)
        if held:
            yield done()

    sent = map_arrow(nodes.select("node", "marks", "label"), emit, "bin long, own binary")
    return map_arrow(sent.repartition("bin").sortWithinPartitions("bin"), link, "bucket long, node long")


def _equal(nodes: DataFrame, tables: int) -> DataFrame:
    """``bucket`` and ``node`` of nodes that have a sub-fingerprint in common, of the first tables."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype=np.uint8).reshape(len(batch), -1)
            own = np.ascontiguousarray(marks[:, : 4 * tables]).view("<u4").astype(np.int64) + (np.arange(tables) << BITS)
            yield pa.RecordBatch.from_arrays([pa.array(own.ravel()), pa.array(np.repeat(batch.column(0).to_numpy(), tables))], names=["bucket", "node"])

    sent = map_arrow(nodes.select("node", "marks"), emit, "bucket long, node long")
    return by_bucket(sent, lambda r: [r.column(0).to_numpy(), r.column(1).to_numpy()], ["bucket", "node"])


def joining(node: np.ndarray, label: np.ndarray, like: Callable[[int, np.ndarray], np.ndarray], part: np.ndarray | None = None) -> np.ndarray:
    """Links of all pairs that are alike, as far as they join trees; at the start the nodes of a label are one.

    ``like(i, rest)`` tells which of the nodes ``rest`` are like node i. With ``part``, pairs within a part are not looked at.
    """
    links, root = [], label.copy()
    for i in range(len(node) - 1):
        wanted = root[i + 1 :] != root[i]
        if part is not None:
            wanted &= part[i + 1 :] != part[i]
        rest = i + 1 + np.flatnonzero(wanted)
        if not len(rest):
            continue
        found = rest[like(i, rest)]
        if len(found):
            roots, at = np.unique(root[found], return_index=True)
            links.append(np.stack([np.full(len(at), node[i]), node[found[at]]], axis=1))
            root[np.isin(root, roots)] = root[i]
    return np.concatenate(links) if links else np.empty((0, 2), dtype=np.int64)


def tree_links(node: np.ndarray, marks: np.ndarray, label: np.ndarray, like_one: Callable) -> np.ndarray:
    """Links that join the labels of a bucket as all pairs of it that ``like_one`` tells would."""
    return joining(node, label, lambda i, rest: like_one(marks[rest], marks[i]))


def _families(nodes: DataFrame, found: DataFrame) -> DataFrame:
    """The nodes with ``label``, the family that the pairs found so far make."""
    labels = components(found, at_once=_AT_ONCE).select("node", F.col("component").alias("label"))
    return stored(nodes.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")), "sketch-labels")


def _with_sets(members: DataFrame, words: int) -> DataFrame:
    """``family``, ``node``, ``marks`` and ``shingles`` (the set, as bytes) of rows that have ``text`` in place of the last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, len(batch), 256):
                part = batch.slice(a, 256)
                sets = pa.array([shingle_set(t.as_py(), words).tobytes() for t in part.column(3)], pa.binary())
                yield pa.RecordBatch.from_arrays([*part.columns[:3], sets], names=["family", "node", "marks", "shingles"])

    return map_arrow(members.select("family", "node", "marks", "text"), run, "family long, node long, marks binary, shingles binary")


def _links(members: DataFrame, similarity: float) -> DataFrame:
    """Links ``a``, ``b`` that make the components of all pairs of a family (``_with_sets``) which reach the similarity.

    A family is dealt in blocks, by the nodes' hashes; each pair of blocks is one bucket.
    """
    size = F.length("shingles")
    least = F.least(F.lit(_MOST_NODES), F.greatest(F.lit(_LEAST_NODES), F.ceil(F.count(F.lit(1)) / _BLOCKS)))
    blocks = F.greatest(F.ceil(F.count(F.lit(1)) / least), F.ceil(F.sum(size) / _MOST_BYTES)).cast("long").alias("blocks")
    sizes = stored(members.groupBy("family").agg(blocks), "sketch-families")
    block = F.pmod(F.xxhash64("node"), F.col("blocks"))
    dealt = join_unequal(members, sizes, "family").withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    bucket = F.xxhash64("family", F.least("block", "other"), F.greatest("block", "other")).alias("bucket")

    def run(rows: pa.RecordBatch) -> list[np.ndarray]:
        node, part = rows.column(1).to_numpy(), rows.column(2).to_numpy()
        marks = np.frombuffer(b"".join(rows.column(3).to_pylist()), dtype=np.uint8).reshape(len(rows), -1)
        sets = [np.frombuffer(x, dtype=np.uint64) for x in rows.column(4).to_pylist()]
        sizes = np.array([len(x) for x in sets])

        def like(i: int, rest: np.ndarray) -> np.ndarray:
            out, own = np.zeros(len(rest), dtype=bool), sets[i]
            may = similarity * np.maximum(sizes[rest], len(own)) <= np.minimum(sizes[rest], len(own))
            may[may] = differing(marks[rest[may]], marks[i])
            some = rest[may]
            if len(some):
                flat = np.concatenate([sets[j] for j in some])
                hit = own[np.minimum(np.searchsorted(own, flat), len(own) - 1)] == flat
                both = np.add.reduceat(hit, np.cumsum(sizes[some]) - sizes[some], dtype=np.int64)
                out[may] = both >= similarity * (len(own) + sizes[some] - both)
            return out

        links = joining(node, np.arange(len(node)), like, part if part.min() < part.max() else None)
        return [links.min(axis=1), links.max(axis=1)] if len(links) else [np.empty(0, dtype=np.int64)] * 2

    return by_bucket(dealt.select(bucket, "node", "block", "marks", "shingles"), run, ["a", "b"]).distinct()


def _signed(rows: DataFrame, words: int, key: str, own: str, text: str) -> DataFrame:
    """``key``, ``own``, ``node`` (hash of the shingle set) and ``marks`` (the sketch; no words: empty); map-only."""
    slim = rows.select(column(key), own, column(text).alias(free_name([key, own], "text_")))
    fields = fields_of(slim)[:2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        for batch in batches:
            for a in range(0, len(batch), 256):
                part = batch.slice(a, 256)
                sets = [shingle_set(t.as_py(), words) for t in part.column(2)]
                ids = np.array([xxh64_intdigest(s.tobytes(), SEED) for s in sets], dtype=np.uint64).view(np.int64)
                marks = [m.tobytes() if len(s) else b"" for s, m in zip(sets, sketches(sets), strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns[:2], pa.array(ids), pa.array(marks, pa.binary())], names=[key, own, "node", "marks"])

    return map_arrow(slim, run, ", ".join([*fields, "node long", "marks binary"]))


def drop_similar(docs: DataFrame, words: int = 5, similarity: float = 0.8, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each component: the one of the smallest key (null keys last, ties by row hash).

    Two rows are linked where the Jaccard similarity of their sets of word shingles is at least ``similarity`` (0.8
    and more is what the sub-fingerprints are made for); components are those of all links. Rows of equal sets, so
    all rows without words too, are one node. Of repeated rows one stays. Columns are those of the input.
    """
    if not 0.8 <= similarity <= 1:
        raise ValueError("the similarity is 0.8 to 1")
    own = free_name([*docs.columns, "node", "marks"], "row_")
    named = docs.withColumn(own, row_identity(docs))
    rows = stored(_signed(named, words, key, own, text), "sketches")
    nodes = stored(rows.where(F.length("marks") > 0).groupBy("node").agg(F.min("marks").alias("marks"), F.min(own).alias(own)), "sketch-nodes")
    first = F.min(F.struct(column(key).isNull().alias("n"), column(key).alias("k"), F.col(own).alias("r"))).alias("first")
    firsts = stored(rows.groupBy("node").agg(first), "sketch-firsts")
    forget(rows)

    marks = nodes.select("node", "marks")
    equal = stored(_equal(nodes, _FIRST), "sketch-equal")
    found = stored(candidates(equal.join(marks, "node").withColumn("label", F.lit(0).cast("long")), hub_links, related), "sketch-links")
    forget(equal)
    parts = [found]
    labelled = _families(nodes, found)
    fold = min(BITS, max(3, (labelled.count() * (BITS + 1) // _IN_BIN).bit_length()))
    cuts = [TABLES * k // _ROUNDS for k in range(_ROUNDS + 1)]
    for k in range(_ROUNDS):
        met = stored(_met(labelled, cuts[k], cuts[k + 1], fold), "sketch-met")
        part = stored(candidates(met.join(labelled.select("node", "marks", "label"), "node"), tree_links, related), "sketch-links")
        forget(met)
        parts.append(part)
        if not part.isEmpty():
            found = found.unionAll(part)
            if k in _JOINED:
                before, labelled = labelled, _families(nodes, found)
                forget(before)
    families = components(found, at_once=_AT_ONCE).select("node", F.col("component").alias("family"))
    members = families.join(nodes, "node").join(named.select(own, column(text).alias("text")).dropDuplicates([own]), own)
    forget(labelled, *parts)
    sets = stored(_with_sets(members, words), "sketch-sets")
    links = stored(_links(sets, similarity), "sketch-links")
    forget(sets, nodes)
    joined = components(links, at_once=_AT_ONCE)
    forget(links)
    heads = firsts.join(joined, "node", "left").groupBy(F.coalesce("component", "node").alias("root")).agg(F.min("first").alias("first"))
    return named.join(heads.select(F.col("first.r").alias(own)), own).dropDuplicates([own]).select(*map(column, docs.columns))
