"""Connected components of a distributed edge list; nothing is gathered on the driver."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm._store import materialize


#: Edges that one task solves, at most: 16 bytes each.
ONE_TASK = 1_000_000


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node but the smallest of its component, and that smallest node, for the components of these edges."""
    nodes, index = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = index[: len(a)], index[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, root[x], low)
        np.minimum.at(new, root[y], low)
        new = new[new]
        while True:  # shorten all paths
            short = new[new]
            if (short == new).all():
                break
            new = short
        if (new == root).all():
            break
        root = new
    child = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[child], nodes[root[child]]


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b = stars(batch.column(0).to_numpy(), batch.column(1).to_numpy())
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["node", "component"])


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
    if held:
        a, b = stars(*(np.concatenate(c) for c in zip(*held, strict=True)))
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["node", "component"])


def components(edges: DataFrame, one_task: int = ONE_TASK) -> DataFrame:
    """``edges`` (two long columns, no nulls) as node, component for each node that isn't the smallest of its component.

    Up to ``one_task`` edges, counted first, are solved in one task of an executor in bounded memory; more go through alternating
    large-star and small-star steps over all executors, with the same result: every step links neighbours to a smaller node and
    keeps components, and the end is reached in a number of rounds that grows with the logarithm of the longest path. Edges are first
    contracted within batches. The smallest neighbour of a node is a partial aggregate, so a node with very many edges is no hot spot there; the
    joins that follow are ones that adaptive execution can split.
    """
    a, b = edges.columns
    now = materialize(edges.select(F.greatest(a, b).alias("node"), F.least(a, b).alias("component")).where("node != component").mapInArrow(_contract, "node long, component long"))
    if now.count() <= one_task:
        return materialize(now.coalesce(1).mapInArrow(_solve, "node long, component long"))
    now = now.distinct()
    mark = None
    while True:
        found = now.agg(F.count("*"), F.sum(F.xxhash64("node", "component").cast("decimal(38,0)"))).first()
        if found == mark or not found[0]:
            return now
        mark = found
        # Large star: larger neighbours go to the smallest node around.
        both = now.unionByName(now.select(F.col("component").alias("node"), F.col("node").alias("component")))
        least = both.groupBy("node").agg(F.min("component").alias("low")).select("node", F.least("low", "node").alias("low"))
        large = both.where("component > node").join(least, "node").select(F.col("component").alias("node"), F.col("low").alias("component")).where("node != component").distinct()
        # Small star: smaller neighbours go to the smallest of them.
        low = large.groupBy("node").agg(F.min("component").alias("low"))
        small = large.join(low, "node").select(F.col("component").alias("node"), F.col("low").alias("component")).where("node != component").unionByName(low.withColumnRenamed("low", "component"))
        now = materialize(small.mapInArrow(_contract, "node long, component long").distinct())
