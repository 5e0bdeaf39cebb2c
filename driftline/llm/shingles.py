"""Near-duplicates by the Jaccard similarity of word shingles, by minimum hashes.

A 64-bit SimHash within 4 bits is far stricter than Jaccard 0.8, whose pairs differ in about 10 bits. So each
distinct set of shingles gets 24 sub-fingerprints of five minimum hashes; a pair of similarity 0.8 shares one of
them with probability 0.9999. What shares one is compared by one byte of each of the 120 minima, and what may reach
the threshold by that is compared exactly, from the texts. Links go to a hub of each bucket first; then every pair
of a bucket that is not yet in one component is tried too, so components are those of all pairs found.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, column, fields_of, free_name, map_arrow, row_identity, stored
from .components import components
from .simhash import SEED

BANDS, WIDTH = 24, 5
_BLOCK = 1024
_rng = np.random.default_rng(SEED)
_FLIPS, _FACTORS = _rng.integers(0, 1 << 64, (2, BANDS * WIDTH, 1), dtype=np.uint64) | np.array([0, 1], dtype=np.uint64)[:, None, None]
_MIX = _rng.integers(0, 1 << 64, (BANDS, WIDTH), dtype=np.uint64) | np.uint64(1)


def shingle_set(text: str | None, words: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the word shingles, as in ``simhash.fingerprint``; no words: empty."""
    from xxhash import xxh64_intdigest

    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = max(1, len(parts) - words + 1) if parts else 0
    return np.unique(np.array([xxh64_intdigest(b" ".join(parts[i : i + words]), SEED) for i in range(n)], dtype=np.uint64))


def minima(own: np.ndarray) -> np.ndarray:
    """The least value of the set under each of the 120 orders."""
    least = np.full(BANDS * WIDTH, np.uint64((1 << 64) - 1))
    for at in range(0, len(own), _BLOCK):
        least = np.minimum(least, ((own[None, at : at + _BLOCK] ^ _FLIPS) * _FACTORS).min(axis=1))
    return least


def sub_fingerprints(least: np.ndarray) -> np.ndarray:
    """One 64-bit value of each band of minima, different between bands."""
    mixed = (least.reshape(BANDS, WIDTH) * _MIX).sum(axis=1, dtype=np.uint64)
    return (mixed ^ (mixed >> np.uint64(31))) * _MIX[:, 0] + np.arange(BANDS, dtype=np.uint64)


def enough(similarity: float) -> int:
    """Agreements of 120 minima that a pair of the similarity reaches but once in some 100,000 times (4.3 deviations)."""
    n = BANDS * WIDTH
    return int(n * similarity - 4.3 * (n * similarity * (1 - similarity)) ** 0.5)


def hub_links(node: np.ndarray, marks: np.ndarray, label: np.ndarray, like_one: Callable) -> np.ndarray:
    """Links of each node not yet taken to the first of those left that it may be like."""
    links, rest = [], np.arange(len(node))
    while len(rest) > 1:
        like = like_one(marks[rest[1:]], marks[rest[0]])
        taken = rest[1:][like]
        links.append(np.stack([np.full(len(taken), node[rest[0]]), node[taken]], axis=1))
        rest = rest[1:][~like]
    return np.concatenate(links) if links else np.empty((0, 2), dtype=np.int64)


def cross_links(node: np.ndarray, marks: np.ndarray, label: np.ndarray, like_one: Callable) -> np.ndarray:
    """All pairs that may be alike and have different labels; pairs within the commonest label are not looked at."""
    names, place, count = np.unique(label, return_inverse=True, return_counts=True)
    if len(names) < 2:
        return np.empty((0, 2), dtype=np.int64)
    most = place == np.argmax(count)
    order = np.argsort(most, kind="stable")
    node, marks, place = node[order], marks[order], place[order]
    links = []
    for i in range(int((~most).sum())):
        like = i + 1 + np.flatnonzero(like_one(marks[i + 1 :], marks[i]))
        like = like[place[like] != place[i]]
        links.append(np.stack([np.full(len(like), node[i]), node[like]], axis=1))
    return np.concatenate(links)


def _signed(rows: DataFrame, words: int, key: str, own: str, text: str) -> DataFrame:
    """``key``, ``own``, ``node`` (hash of the shingle set), ``marks`` (a byte of each minimum), ``bands``; map-only."""
    slim = rows.select(column(key), own, column(text).alias(free_name([key, own], "text_")))
    fields = fields_of(slim)[:2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        for batch in batches:
            nodes, marks, bands = [], [], []
            for t in batch.column(2):
                found = shingle_set(t.as_py(), words)
                nodes.append(xxh64_intdigest(found.tobytes(), SEED))
                least = minima(found)
                marks.append((least >> np.uint64(24)).astype(np.uint8).tobytes())
                bands.append(sub_fingerprints(least).tobytes() if len(found) else b"")
            ids = pa.array(np.array(nodes, dtype=np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], ids, pa.array(marks, pa.binary()), pa.array(bands, pa.binary())], names=[key, own, "node", "marks", "bands"])

    return map_arrow(slim, run, ", ".join([*fields, "node long", "marks binary", "bands binary"]))


def by_bucket(rows: DataFrame, f: Callable[[pa.RecordBatch], list[np.ndarray]], names: list[str]) -> DataFrame:
    """``f`` of the rows of each value of the column ``bucket`` (the first), which come in order of the columns."""
    dealt = rows.repartition("bucket").sortWithinPartitions("bucket", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def done() -> pa.RecordBatch:
            whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in f(whole)], names=names)

        for batch in batches:
            ids = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(ids)) + 1).tolist(), len(ids)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if b > a:
                    if held and held[0].column(0)[0].as_py() != ids[a]:
                        if sum(map(len, held)) > 1:
                            yield done()
                        held = []
                    held.append(batch.slice(a, b - a))
        if sum(map(len, held)) > 1:
            yield done()

    return map_arrow(dealt, run, ", ".join(f"{n} long" for n in names))


def candidates(members: DataFrame, links: Callable, like_one: Callable) -> DataFrame:
    """Distinct pairs ``a < b`` that ``links`` finds in the buckets of ``members`` (bucket, node, marks, label).

    ``like_one(marks, mark)`` tells which rows of bytes may belong to nodes that are like the one of ``mark``.
    """

    def run(rows: pa.RecordBatch) -> list[np.ndarray]:
        marks = np.frombuffer(b"".join(rows.column(2).to_pylist()), dtype=np.uint8).reshape(len(rows), -1)
        found = links(rows.column(1).to_numpy(), marks, rows.column(3).to_numpy(), like_one)
        return [found.min(axis=1), found.max(axis=1)] if len(found) else [np.empty(0, dtype=np.int64)] * 2

    return by_bucket(members.select("bucket", "node", "marks", "label"), run, ["a", "b"]).distinct()


def alike(pairs: DataFrame, texts: DataFrame, words: int, similarity: float) -> DataFrame:
    """The pairs whose shingle sets reach the similarity."""
    side = lambda c: texts.select(F.col("node").alias(c), F.col("text").alias(f"text_{c}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "text_a", "text_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = lru_cache(maxsize=512)(lambda t: shingle_set(t, words))
        for batch in batches:
            keep = []
            for s, t in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                x, y = of(s), of(t)
                both = len(np.intersect1d(x, y, assume_unique=True)) if similarity * max(len(x), len(y)) <= min(len(x), len(y)) else 0
                keep.append(both >= similarity * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep, pa.bool_())) for c in batch.columns[:2]], names=["a", "b"])

    return map_arrow(both, run, "a long, b long")


def drop_similar(docs: DataFrame, words: int = 5, similarity: float = 0.8, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each component: the one of the smallest key (null keys last, ties by row hash).

    Two rows are linked where the Jaccard similarity of their sets of word shingles is at least ``similarity`` (0.8
    and more is what the sub-fingerprints are made for); components are those of all links. Rows of equal sets, so
    all rows without words too, are one node. Of repeated rows one stays. Columns are those of the input.
    """
    if not 0.8 <= similarity <= 1:
        raise ValueError("the similarity is 0.8 to 1")
    own = free_name([*docs.columns, "node", "marks", "bands"], "row_")
    named = docs.withColumn(own, row_identity(docs))
    rows = stored(_signed(named, words, key, own, text), "shingles")
    nodes = rows.where(F.length("bands") > 0).groupBy("node").agg(F.min("marks").alias("marks"), F.min(own).alias(own))
    bands = rows.where(F.length("bands") > 0).select("node", "bands").dropDuplicates(["node"])

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype=np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(flat), pa.array(np.repeat(batch.column(0).to_numpy(), BANDS))], names=["bucket", "node"])

    met = by_bucket(map_arrow(bands, emit, "bucket long, node long"), lambda r: [r.column(0).to_numpy(), r.column(1).to_numpy()], ["bucket", "node"])
    met = checkpointed(met)
    chosen = checkpointed(met.select("node").distinct().join(nodes, "node"))
    texts = chosen.select("node", own).join(named.select(own, column(text).alias("text")).dropDuplicates([own]), own).select("node", "text")
    texts = stored(texts, "shingle-texts")
    members = met.join(chosen.select("node", "marks"), "node")

    least = enough(similarity)
    agree = lambda marks, mark: (marks == mark).sum(axis=1) >= least
    tried = checkpointed(candidates(members.withColumn("label", F.lit(0).cast("long")), hub_links, agree))
    links = checkpointed(alike(tried, texts, words, similarity))
    labels = components(links).select("node", F.col("component").alias("label"))
    labelled = members.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    others = checkpointed(candidates(labelled, cross_links, agree).join(tried, ["a", "b"], "left_anti"))
    links = links.unionAll(checkpointed(alike(others, texts, words, similarity)))
    parts = components(links)

    first = F.min(F.struct(column(key).isNull().alias("n"), column(key).alias("k"), F.col(own).alias("r"))).alias("first")
    heads = rows.groupBy("node").agg(first).join(parts, "node", "left").groupBy(F.coalesce("component", "node").alias("root")).agg(F.min("first").alias("first"))
    return named.join(heads.select(F.col("first.r").alias(own)), own).dropDuplicates([own]).select(*map(column, docs.columns))
