"""Connected components of an edge table by alternating large-star and small-star rounds, all of it in DataFrames.

Every round keeps the components and pulls all nodes towards their smallest one; the number of rounds grows with the logarithm of the longest chain. Minima are found with partial aggregation and joined back, so a node with very many neighbours is reduced before it is shuffled and adaptive execution can split what is left.

A table of at most EDGES edges is finished in one task, by hooking and pointer jumping over arrays: a round of it takes milliseconds, while a round of joins takes some thousand tasks, however few the rows, of each of which the driver keeps a record.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import cut

#: So many edges are held in one task, and rows that it gives back at once.
EDGES, ROWS = 1 << 20, 1 << 16


def state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).cast("string")).first())


def roots(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of the edges, sorted, and the smallest node that each is linked with."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b, root = at[: len(u)], at[len(u) :], np.arange(len(nodes))
    while len(a):
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root] != root).any():
            root = root[root]
        a, b = root[a], root[b]
        a, b = a[a != b], b[a != b]
    return nodes, nodes[root]


def starred(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges u, v from each node to its root, of a whole table of edges."""
    held = [[c.to_numpy(zero_copy_only=False) for c in batch.columns] for batch in batches if batch.num_rows]
    if held:
        u, v = roots(*(np.concatenate(x) for x in zip(*held, strict=True)))
        u, v = u[u != v], v[u != v]
        for k in range(0, len(u), ROWS):
            yield pa.RecordBatch.from_pydict({"u": pa.array(u[k : k + ROWS]), "v": pa.array(v[k : k + ROWS])})


def components(edges: DataFrame) -> DataFrame:
    """node, root (the smallest node it is linked with) for every node of `edges(u, v)` that isn't its own root. Loops and repeated edges do no harm."""
    now = cut(edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = state(now)
    few = 0 < before[0] <= EDGES
    if few:
        now = cut(now.coalesce(1).mapInArrow(starred, now.schema))
    while before[0] and not few:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = now.select(F.col("v").alias("u"), F.col("u").alias("w")).join(low, "u").select(F.col("w").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        now = cut(small.where("u != v").distinct())
        after = state(now)
        if after == before:
            break
        before = after
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
