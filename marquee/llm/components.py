"""Connected components of a graph kept as a table of edges, with DataFrame operations.

Alternating large-star and small-star steps (Kiveris et al., "Connected Components in MapReduce and
Beyond", 2014). Each step is an aggregation that combines before its shuffle and an equi-join on the
same key, which adaptive execution can split where one node has very many neighbours. The edges are
written to the shared folder after each round, so lost executors cost one round at most. Where the
edges fit what a broadcast may hold, one task joins them instead of all these rounds: the same result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import is_small, written

#: Rounds halve the depth of every tree; a graph that takes more than 60 has more than 2**60 nodes.
MAX_ROUNDS = 60


def _least(neighbours: DataFrame) -> DataFrame:
    return neighbours.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of u is linked with the least of u and its neighbours."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    # a table of its own on the join's other side lets adaptive execution split a node with very many neighbours
    return both.filter("v > u").join(written(_least(both)), "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """u and its smaller neighbours are linked with the least of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = _least(down)
    return down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))


def _least_reached(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(u, v) of all edges of the task: each node that isn't its component's least, and the least."""
    parts = [(x.column(0).to_numpy(), x.column(1).to_numpy()) for x in batches if x.num_rows]
    if not parts:
        return
    node, at = np.unique(np.concatenate([*(x for x, _ in parts), *(y for _, y in parts)]), return_inverse=True)
    u, v = at.reshape(2, -1)
    root = np.arange(len(node))
    while True:
        x, y = root[u], root[v]
        if not (apart := x != y).any():
            break
        u, v, x, y = u[apart], v[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while ((up := root[root]) != root).any():
            root = up
    some = np.flatnonzero(root != np.arange(len(node)))
    yield pa.RecordBatch.from_arrays([pa.array(node[some]), pa.array(node[root[some]])], ["u", "v"])


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node that an edge names; component is the least node that it reaches.

    edges: columns a and b, of one orderable type. Null ends and loops name no neighbour: a loop's node
    is returned only if another edge has it. An empty table gives no rows. Repeated edges count once.
    Edges of 64-bit numbers that may be broadcast are joined by one task, all others by rounds of steps.
    """
    now = written(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u <> v").distinct())
    if now.schema["u"].dataType.simpleString() == "bigint" and is_small(now):
        now = written(now.coalesce(1).mapInArrow(_least_reached, "u long, v long"))
        return _members(now)
    before = None
    for _ in range(MAX_ROUNDS):
        now = written(_small_star(_large_star(now)).filter("u <> v").distinct())
        seen = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if before == seen:
            break
        before = seen
    else:
        raise RuntimeError(f"no fixed point after {MAX_ROUNDS} rounds")
    return _members(now)


def _members(stars: DataFrame) -> DataFrame:
    return stars.select(F.col("u").alias("node"), F.col("v").alias("component")).union(stars.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
