"""Embedding near-duplicates (operator 2) by collision-counting projections.

Unit vectors are rotated to m orthonormal one-dimensional projections, each sorted; a pair collides on a projection
when one lies in the window of half-width w centred on the other. As the squared differences on all m projections
sum to the squared distance, a pair within distance d misses at most floor(d^2 / w^2) windows. So the count that a
candidate must reach is calibrated to full recall, and pairs that reach it are verified by cosine in double precision.

Work is dealt in blocks of the first projection's order: a task holds two blocks, counts in sorted ranks, and adds up
link counts and a spanning forest tile by tile, never holding the pairs of more than one tile. Pairs of blocks further apart than d on that projection
are passed over. The number of block pairs grows with the square of the rows where the projection does not separate
them: counting collisions for all pairs is quadratic work. They are dealt in rounds, so that no round moves a row to
more than a few pairs and disk stays in proportion to the rows; vectors move as they were given (floats as floats).
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, column, fields_of, forget, join_unequal, map_arrow, stored
from .components import components

BLOCK, TILE = 8192, 64
#: Copies of a row that a round moves, and bytes that a round may move whatever the copies.
COPIES, ROUND_BYTES = 4, 128 << 20


def rotation(dim: int, seed: int = 11) -> np.ndarray:
    """A fixed random orthonormal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(dim, dim)))
    return q * np.sign(np.diag(r))


def calibration(dim: int, threshold: float) -> tuple[float, int, int]:
    """Half-width of the windows, misses a pair at the threshold may have, projections counted for all pairs."""
    squared = max(0.0, 2 - 2 * threshold) + 1e-9
    half = max(0.566 * math.sqrt(2 / dim), math.sqrt(squared / max(1, dim - 1)))
    misses = int(squared / half**2 + 1e-6)
    return half, misses, min(dim, 8 + math.ceil(2.4 * misses))


def candidates(one: np.ndarray, other: np.ndarray, threshold: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs that reach the count, a part of a tile of ``one`` at a time; of one block with itself, each pair once."""
    half, misses, first = calibration(one.shape[1], threshold)
    m = one.shape[1]
    kind = np.uint16 if len(other) < 1 << 16 else np.uint32  # ties on the lead can make a block larger than asked
    low, high, rank = (np.empty((m, len(x)), dtype=kind) for x in (one, one, other))
    for j in range(m):
        order = np.argsort(other[:, j], kind="stable")
        line = other[order, j]
        rank[j, order] = np.arange(len(order), dtype=kind)
        low[j] = np.searchsorted(line, one[:, j] - half, "left")
        high[j] = np.searchsorted(line, one[:, j] + half, "right")
    # all pairs are counted in ranks of one byte, with windows widened to match; what is left in exact ranks
    step = max(0, (len(other) - 1).bit_length() - 8)
    rough, start_of = (rank >> step).astype(np.uint8), (low >> step).astype(np.uint8)
    size = np.where(high > low, (np.maximum(high, 1) - 1 >> step) - (low >> step), -1)
    never, size = size < 0, np.maximum(size, 0).astype(np.uint8)
    for at in range(0, len(one), TILE):
        end = min(len(one), at + TILE)
        start = at + 1 if same else 0
        if start >= len(other):
            break
        missed = np.zeros((end - at, len(other) - start), dtype=np.uint8 if first < 256 else np.uint16)
        gap, out = np.empty(missed.shape, dtype=np.uint8), np.empty(missed.shape, dtype=bool)
        for j in range(first):
            np.subtract(rough[j, None, start:], start_of[j, at:end, None], out=gap)
            np.greater(gap, size[j, at:end, None], out=out)
            if never[j, at:end].any():
                out[never[j, at:end]] = True
            np.add(missed, out.view(np.uint8), out=missed)
        np.less_equal(missed, misses, out=out)
        q, y = divmod(np.flatnonzero(out), out.shape[1])
        q, y = q + at, y + start
        if same:
            keep = q < y
            q, y = q[keep], y[keep]
        for a in range(0, len(q), 200_000):
            qq, yy = q[a : a + 200_000], y[a : a + 200_000]
            part = np.zeros(len(qq), dtype=np.int64)
            for j in range(m):
                part += (rank[j, yy] < low[j, qq]) | (rank[j, yy] >= high[j, qq])
                if j % 8 == 7:
                    keep = part <= misses
                    qq, yy, part = qq[keep], yy[keep], part[keep]
            yield qq[part <= misses], yy[part <= misses]


def linked(one: np.ndarray, other: np.ndarray, threshold: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of unit vectors with cosine of at least ``threshold``, some at a time."""
    turn = rotation(one.shape[1])
    a = one @ turn
    b = a if same else other @ turn
    for q, y in candidates(a, b, threshold, same):
        for k in range(0, len(q), 1 << 15):
            qq, yy = q[k : k + (1 << 15)], y[k : k + (1 << 15)]
            good = np.einsum("ij,ij->i", one[qq], other[yy]) >= threshold
            yield qq[good], yy[good]


def units_of(raw: list[bytes], kind: str) -> np.ndarray:
    """The unit vectors of some vectors of one length, as ``project`` makes them."""
    u = np.frombuffer(b"".join(raw), dtype=kind).reshape(len(raw), -1).astype(float)
    u /= np.abs(u).max(axis=1, keepdims=True)
    u /= np.sqrt(np.einsum("ij,ij->i", u, u))[:, None]
    return u


class Trees:
    """Components of links that come in parts; least members name them."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def roots(self, x: np.ndarray) -> np.ndarray:
        at = self.up[x]
        while (above := self.up[at]).tolist() != at.tolist():
            at = above
        self.up[x] = at
        return at

    def join(self, q: np.ndarray, y: np.ndarray) -> None:
        while True:
            a, b = self.roots(q), self.roots(y)
            open_ = a != b
            if not open_.any():
                return
            q, y, a, b = q[open_], y[open_], a[open_], b[open_]
            np.minimum.at(self.up, np.maximum(a, b), np.minimum(a, b))


def near_vectors(vectors: DataFrame, threshold: float = 0.95, block: int = BLOCK, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Per row: ``key``, n_links (rows linked directly), component_id (smallest key reachable) and kept.

    Rows link where the cosine in double precision is at least ``threshold``. Null and zero vectors, vectors with
    null or non-finite components and vectors of other lengths link with nothing. Rows of one unit vector are one
    node with a weight, so a group of copies of any size costs one. Rows with a null key count as links but never
    name a component, and are not kept unless alone with a null id (kept is false for null keys). An empty table
    gives no rows; other columns are not read.
    """
    if not 0.5 <= threshold <= 1 or not 1 < block <= 32768:
        raise ValueError("thresholds are 0.5 to 1, blocks up to 32768 rows")
    v = F.col("v")
    fine = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    slim = vectors.select(column(key).alias("key"), column(vector).alias("v"))
    kind = "<f4" if slim.schema["v"].dataType.simpleString() == "array<float>" else "<f8"
    slim = slim.select("key", v.cast("array<double>").alias("v"))
    slim = slim.select("key", F.when(F.coalesce(fine, F.lit(False)), F.col("v")).alias("v"))

    def project(seed: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from xxhash import xxh64_intdigest

            for batch in batches:
                node, check, lead, raws, dims = [], [], [], [], []
                for x in batch.column(1):
                    u, raw = x.as_py(), None
                    if u is not None:
                        u = np.array(u, dtype=float)
                        raw = u.astype(kind).tobytes()
                        u /= np.abs(u).max()
                        u /= math.sqrt(float(u @ u))
                        u += 0.0  # one zero only
                    unit = None if u is None else u.tobytes()
                    node.append(None if u is None else xxh64_intdigest(unit, seed) - (1 << 63))
                    check.append(None if u is None else xxh64_intdigest(unit, seed + 1) - (1 << 63))
                    lead.append(None if u is None else float(u @ rotation_lead(len(u))))
                    raws.append(raw)
                    dims.append(None if u is None else len(u))
                columns = [batch.column(0), pa.array(node, pa.int64()), pa.array(check, pa.int64()), pa.array(dims, pa.int32()), pa.array(lead, pa.float64()), pa.array(raws, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["key", "node", "check", "dim", "lead", "raw"])

        return run

    for seed in range(0, 64, 2):  # until no two unit vectors have one name, which is to be expected at once
        fields = f"{fields_of(slim.select('key'))[0]}, node long, check long, dim int, lead double, raw binary"
        rows = stored(map_arrow(slim, project(seed), fields), "vectors")
        if rows.where("node is not null").groupBy("node").agg((F.min("check") != F.max("check")).alias("two")).where("two").isEmpty():
            break
        forget(rows)
    every, rows = rows, checkpointed(rows.select("key", "node"))
    each = every.where("node is not null").groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.first("dim").alias("dim"), F.first("lead").alias("lead"), F.first("raw").alias("raw"))
    units = stored(each, "units")
    forget(every)
    nodes = checkpointed(units.select("node", "n"))
    reach = math.sqrt(max(0.0, 2 - 2 * threshold)) + 1e-9
    found = None
    for r in units.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).collect():  # one row for each vector length
        for own in _found(units.where(F.col("dim") == r["dim"]), r["n"], r["dim"], kind, threshold, block, reach):
            found = own if found is None else found.unionAll(own)
    forget(units)
    if found is None:
        found = rows.sparkSession.createDataFrame([], "a long, b long, links long")
    links = found.where("links is not null").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    parts = components(found.where("b is not null").select("a", "b"))
    named = nodes.select("node", "n").join(links, "node", "left").join(parts, "node", "left")
    named = checkpointed(named.select("node", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "node").alias("root")))
    least = rows.where("node is not null").groupBy("node").agg(F.min("key").alias("least")).join(named.select("node", "root"), "node")
    ids = least.groupBy("root").agg(F.min("least").alias("component_id"))
    of = checkpointed(join_unequal(named, ids, "root").select("node", "n_links", "component_id"))
    out = join_unequal(rows, of, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("key")).otherwise(F.col("component_id"))
    return out.select(F.col("key").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("key") == component, F.lit(False)).alias("kept"))


_leads: dict[int, np.ndarray] = {}


def rotation_lead(dim: int) -> np.ndarray:
    if dim not in _leads:
        _leads[dim] = rotation(dim)[:, 0]
    return _leads[dim]


def rounds_of(count: np.ndarray, copies: int) -> list[np.ndarray]:
    """Pairs of blocks (rows of two) in rounds that have each block at most ``copies`` times (3 at least).

    Block i is near blocks i to i + count[i] - 1. Pairs of one distance have a block twice, those of distance 0 once.
    """
    rounds, part, load = [], [], 0
    for away in range(int(count.max(initial=0))):
        cost = 2 if away else 1
        if part and load + cost > max(3, copies):
            rounds.append(np.concatenate(part))
            part, load = [], 0
        i = np.flatnonzero(count > away)
        part.append(np.stack([i, i + away], axis=1))
        load += cost
    return [*rounds, np.concatenate(part)] if part else rounds


def _found(units: DataFrame, n: int, dim: int, kind: str, threshold: float, block: int, reach: float) -> Iterator[DataFrame]:
    """Link counts (``a, links``) and forest links (``a, b``) among unit vectors of one length, checkpointed by round.

    Blocks follow the first projection; rows of one value there (or of one range that the quantiles could not cut)
    are cut further by their names, so no block is much larger than ``block``. A round's pairs of near blocks are
    numbered and dealt by number, one to a task where there are that many.
    """
    spark = units.sparkSession
    most = -(-n // block)
    bounds = np.array(sorted(set(units.stat.approxQuantile("lead", [i / most for i in range(1, most)], 0.05 / most))) if most > 1 else [], dtype=float)

    def range_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.searchsorted(bounds, batch.column(0).to_numpy(zero_copy_only=False), "right").astype(np.int64)
            ranges, n = np.unique(at, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(ranges), pa.array(n)], names=["range", "n"])

    ranges = map_arrow(units.select("lead"), range_of, "range long, n long")
    sizes = {r["range"]: r["n"] for r in ranges.groupBy("range").agg(F.sum("n").alias("n")).collect()}  # one row a block
    parts = np.array([-(-sizes.get(r, 0) // block) for r in range(len(bounds) + 1)], dtype=np.int64)
    first = np.concatenate([[0], np.cumsum(parts)])
    edges = np.concatenate([[-np.inf], bounds, [np.inf]])
    low, high = np.repeat(edges[:-1], parts), np.repeat(edges[1:], parts)  # by block
    count = np.searchsorted(low, high + reach, "right") - np.arange(len(low))  # blocks i to i + count[i] - 1 are near block i
    row_bytes = dim * np.dtype(kind).itemsize + 40
    for pairs in rounds_of(count, max(COPIES, ROUND_BYTES // (n * row_bytes))):
        tasks = int(min(len(pairs), max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)))
        dealt = map_arrow(units.select("lead", "node", "n", "raw"), _dealer(pairs, bounds, first, parts), "pair long, second boolean, node long, n long, raw binary")
        sent = dealt.withColumn("task", (F.col("pair") % tasks).cast("int")).repartitionById(tasks, "task").sortWithinPartitions("pair", "second", "node")
        yield checkpointed(map_arrow(sent.drop("task"), _linker(pairs, kind, threshold), "a long, b long, links long"))


def _dealer(pairs: np.ndarray, bounds: np.ndarray, first: np.ndarray, parts: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Sends each row to the pairs that its block is in."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of: dict[int, list[tuple[int, bool]]] = {}
        for number, (i, j) in enumerate(pairs.tolist()):
            of.setdefault(i, []).append((number, False))
            if i != j:
                of.setdefault(j, []).append((number, True))
        for batch in batches:
            at = np.searchsorted(bounds, batch.column(0).to_numpy(zero_copy_only=False), "right").astype(np.int64)
            node = batch.column(1).to_numpy()
            own = first[at] + (node.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)).astype(np.int64) % parts[at]
            for b in np.unique(own).tolist():
                rows = batch.filter(pa.array(own == b)).select(["node", "n", "raw"])
                for number, second in of.get(b, ()):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), number)), pa.array(np.full(len(rows), second)), *rows.columns], names=["pair", "second", "node", "n", "raw"])

    return deal


def _linker(pairs: np.ndarray, kind: str, threshold: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Links of each pair of blocks, whose rows come together."""

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            numbers = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(numbers)) + 1).tolist(), len(numbers)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if b > a:
                    if held and held[0].column(0)[0].as_py() != numbers[a]:
                        yield met(held)
                        held = []
                    held.append(batch.slice(a, b - a))
        if held:
            yield met(held)

    def met(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        whole = pa.Table.from_batches(held)
        second, nodes, weight = (whole.column(k).to_numpy() for k in (1, 2, 3))
        unit = units_of(whole.column(4).to_pylist(), kind)
        k, (i, j) = int((~second).sum()), pairs[int(whole.column(0)[0].as_py())]
        same = i == j
        links, trees = np.zeros(len(nodes), dtype=np.int64), Trees(len(nodes))
        if same or 0 < k < len(nodes):
            for q, y in linked(unit[:k], unit[:k] if same else unit[k:], threshold, same):
                y = y if same else y + k
                links += np.bincount(q, weight[y], len(nodes)).astype(np.int64) + np.bincount(y, weight[q], len(nodes)).astype(np.int64)
                trees.join(q, y)
        roots = trees.roots(np.arange(len(nodes)))
        some, tree = np.flatnonzero(links), np.flatnonzero(roots != np.arange(len(nodes)))
        a = pa.array(np.concatenate([nodes[some], nodes[tree]]))
        b = pa.array([*[None] * len(some), *nodes[roots[tree]].tolist()], pa.int64())
        return pa.RecordBatch.from_arrays([a, b, pa.array([*links[some].tolist(), *[None] * len(tree)], pa.int64())], names=["a", "b", "links"])

    return link
