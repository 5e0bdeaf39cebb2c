"""Connected components of a distributed edge list, without a driver-side graph."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, forget, map_arrow, stored


def least_reachable(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of some edges, ascending, and the smallest node that each reaches."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y, up = at[: len(a)], at[len(a) :], np.arange(len(nodes))
    while len(x):
        np.minimum.at(up, np.maximum(x, y), np.minimum(x, y))
        while (up != (further := up[up])).any():
            up = further
        x, y = up[x], up[y]
        x, y = x[x != y], y[x != y]
    return nodes, nodes[up]


def _at_once(edges: DataFrame) -> DataFrame:
    """``node`` and ``into``, the smallest node it reaches, by one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
        if held:
            node, into = least_reachable(*(np.concatenate(c) for c in zip(*held, strict=True)))
            for k in range(0, len(node), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(node[k : k + (1 << 16)]), pa.array(into[k : k + (1 << 16)])], names=["node", "into"])

    return map_arrow(edges.select("a", "b").coalesce(1), run, "node long, into long")


def components(edges: DataFrame, max_rounds: int = 60, at_once: int = 0) -> DataFrame:
    """Smallest reachable node of every node that has an edge.

    ``edges`` has the long columns ``a`` and ``b``; loops, repeats and rows with nulls do no harm. Returns
    ``node, component``. Each round gives every node a random rank, lets it join its neighbour (or itself) of
    least rank, and keeps the contracted edges, so that the nodes left at least halve on average whatever the
    graph's shape. Aggregations are partial first, so a hub costs one row for each task; rounds end in a
    checkpoint. No edges give an empty result.

    With ``at_once``, so many edges or fewer (counted) are left to one task, at the start or after some rounds, and
    rounds end in stored tables, which go, with their shuffle files, as soon as nothing reads them again.
    """
    kept = (lambda df: stored(df, "links")) if at_once else checkpointed
    left = edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    left, steps = kept(left), []
    while not left.isEmpty():
        if left.count() <= at_once:
            steps.append(kept(_at_once(left)))
            forget(left)
            if len(steps) == 1:
                return steps[0].withColumnRenamed("into", "component")
            break
        if len(steps) == max_rounds:
            raise RuntimeError("components: no end in sight")
        rank = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(len(steps))).alias("r"), F.col(c).alias("n"))  # noqa: B023, E731
        both = left.select(F.col("a").alias("node"), rank("b").alias("best")).unionAll(left.select(F.col("b"), rank("a")))
        joins = both.groupBy("node").agg(F.min("best").alias("best")).select("node", F.least("best", rank("node"))["n"].alias("into"))
        joins = kept(joins)
        at = lambda c: joins.select(F.col("node").alias(c), F.col("into").alias(f"{c}2"))  # noqa: B023, E731
        before = left
        left = left.join(at("a"), "a").join(at("b"), "b").where("a2 <> b2").select(F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b")).distinct()
        left = kept(left)
        forget(before)
        steps.append(joins)
    if not steps:
        return left.select(F.col("a").alias("node"), F.col("b").alias("component"))
    found = steps[0].select("node", F.col("into").alias("root"))
    for step in steps[1:]:
        found = found.join(step.select(F.col("node").alias("root"), "into"), "root", "left").select("node", F.coalesce("into", "root").alias("root"))
    found = kept(found)
    forget(*steps)
    least = found.groupBy("root").agg(F.min("node").alias("component"))
    return found.join(least, "root").select("node", "component")
