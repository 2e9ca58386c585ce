"""Connected components of an edge table: forests within tasks first, then alternating star contractions, all distributed."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, release

#: Edges that a task joins to a forest in memory. Edges of which every task has made a forest and that fit into one task are done after one more.
EDGES = 1 << 18


def forest(batches: Iterator[pa.RecordBatch], most: float = EDGES) -> Iterator[pa.RecordBatch]:
    """Of the edges (u, v) of a task: (node, least node reached) for every node that is not the least; anew after each `most` nodes."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        top = x
        while (up := root.get(top, top)) != top:
            top = up
        while x != top:
            root[x], x = top, root.get(x, x)
        return top

    def stars() -> pa.RecordBatch:
        nodes = [x for x in root if find(x) != x]
        out = pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([find(x) for x in nodes], pa.int64())], names=["u", "v"])
        root.clear()
        return out

    for batch in batches:
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = find(u), find(v)
            if a != b:
                root[max(a, b)] = min(a, b)
                root.setdefault(min(a, b), min(a, b))
        if len(root) >= most:
            yield stars()
    if root:
        yield stars()


def _with_least(pairs: DataFrame) -> DataFrame:
    """pairs (u, v) with m: the least of u and the v's of its rows. The join goes by the complement of u, so that
    both sides are shuffled for it and Spark can split the rows of a hub."""
    least = pairs.groupBy("u").agg(F.least("u", F.min("v")).alias("m")).select(F.bitwise_not("u").alias("w"), "m")
    return pairs.withColumn("w", F.bitwise_not("u")).join(least, "w").select("u", "v", "m")


def _signature(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """edges: (u, v) longs. (node, component) for every node that is not the least of its component.

    Every task makes its edges a forest of stars, which has fewer edges than nodes. Forests that fit into one task (EDGES) are joined there; larger ones are
    contracted: each round attaches neighbours to the least node around, and after O(log^2 n) rounds only stars are left, which a round does not change. The
    edges of a round are stored, so a round depends on nothing but its file."""
    e = materialize(edges.where("u <> v").select("u", "v").mapInArrow(forest, "u long, v long"), "cc-edges")
    seen = _signature(e)
    if seen[0] <= EDGES:
        joined = e.repartition(1).mapInArrow(lambda batches: forest(batches, float("inf")), "u long, v long")
        return materialize(joined, "cc-stars").select(F.col("u").alias("node"), F.col("v").alias("component"))
    for _ in range(rounds):
        if not seen[0]:
            break
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        near = _with_least(large)
        small = near.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(near.select("u", F.col("m").alias("v")))
        old, e = e, materialize(small.distinct(), "cc-edges")
        release(old)
        before, seen = seen, _signature(e)
        if seen == before:
            break
    else:
        raise RuntimeError(f"no stars after {rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component"))
