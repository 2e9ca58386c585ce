"""Exact top-k inner-product search, branch and bound over a columnar layout.

Vectors become integers floor(scale * x). Candidates are packed, within their partitions, into blocks of a
bounded number of vectors; so are the queries. Query blocks are dealt to every bucket of candidate blocks, and
each pair of blocks is scored alone: the candidate block is laid out dimension by dimension, scores are
accumulated one block of dimensions at a time, and after each the survivors are compacted to those whose
partial score plus the Cauchy-Schwarz bound on the remaining mass of query and candidate still reaches the k-th
best score known. A first block scored in full gives that threshold, which later blocks of the task reuse.
Each pair yields at most k rows per query, and a window keeps the best k of them all.

Sums are exact: float64 arithmetic is used only where all partial sums stay under 2**53, else Python integers.

Defined results: vectors that are null, empty, or hold a null, NaN or infinite component take no part; neither
do rows with a null id; vectors of different lengths are never compared with each other; every row is a candidate of its own, also one with the
id or vector of another, and each of several rows with a query's id is a query: only the query's own row is not its candidate; equal scores go to the smaller
id; scores beyond 64 bits count as the largest or least long; fewer than k candidates give fewer rows; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize

#: Vectors in a candidate block and in a query block; dimensions that are accumulated between two compactions.
CANDIDATES, QUERIES, DIMENSIONS = 8192, 512, 16
_EXACT = float(1 << 53)


def _whole(batch: pa.RecordBatch, scale: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """(row, id, whole numbers as float64) of the vectors that take part."""
    for row, i, v in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
        if i is None or not v or any(x is None for x in v):
            continue
        x = np.asarray(v, np.float64)
        if np.isfinite(x).all():
            y = np.floor(x * scale)
            if np.isfinite(y).all():
                yield row, i, y


def _packed(size: int, scale: int, keep):
    """Partition by partition, blocks of at most `size` vectors of one length: dim, rows, ids, data (column-major)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple]] = {}

        def flush(dim: int) -> pa.RecordBatch:
            rows, ids, vectors = zip(*held.pop(dim), strict=True)
            data = np.ascontiguousarray(np.array(vectors).T)  # dimensions x vectors
            whole = [np.array(x, np.int64).tobytes() for x in (rows, ids)]
            return pa.RecordBatch.from_pydict({"dim": pa.array([dim], pa.int32()), "rows": whole[:1], "ids": whole[1:], "data": [data.tobytes()]})

        for batch in batches:
            for row, i, y in _whole(batch, scale):
                if keep(i):
                    held.setdefault(len(y), []).append((row, i, y))
                    if len(held[len(y)]) >= size:
                        yield flush(len(y))
        for dim in list(held):
            yield flush(dim)

    return run


BLOCK = "dim int, rows binary, ids binary, data binary"
RESULT = "query long, row long, vec_id long, score long"


def block_top_k(q_rows, q, c_rows, c_ids, c, k: int, known: dict[int, int]) -> tuple[list, list, list, list]:
    """The k best candidates of c (dimensions x candidates) for each query of q (dimensions x queries) that
    can still be among the query's best: query, row, id, score. known: the k-th best score by query so far, raised here."""
    dims, n = c.shape
    largest = float(np.abs(c).max(initial=0)) * float(np.abs(q).max(initial=0)) * dims
    exact = largest < _EXACT
    if not exact:
        c, q = c.astype(object), q.astype(object)
        for m in (c, q):
            m[...] = np.vectorize(int, otypes=[object])(m)
    order = np.argsort(-np.abs(q).astype(np.float64).sum(1), kind="stable")  # heaviest dimensions first
    c, q = c[order], q[order]
    edges = [*range(0, dims, DIMENSIONS), dims]
    cf, qf = c.astype(np.float64), q.astype(np.float64)
    # mass that remains from each edge on; a hair is added against rounding
    c_left = [np.sqrt((cf[e:] ** 2).sum(0)) * (1 + 1e-9) for e in edges]
    q_left = [np.sqrt((qf[e:] ** 2).sum(0)) * (1 + 1e-9) for e in edges]
    first = q[: edges[1]].T @ c[: edges[1]]  # queries x candidates
    out = ([], [], [], [])
    for j, me in enumerate(q_rows.tolist()):
        part, alive = first[j], np.arange(n)
        least = known.get(me)
        if least is None and n > 4 * k:  # full scores of the k most promising candidates
            some = np.argpartition(-(part.astype(np.float64) + q_left[1][j] * c_left[1]), 2 * k)[: 2 * k]
            full = sorted((q[:, j] @ c[:, some[c_rows[some] != me]]).tolist())
            if len(full) >= k:
                least = full[-k]
        for b in range(1, len(edges)):
            if b > 1:
                part = part + q[edges[b - 1] : edges[b], j] @ c[edges[b - 1] : edges[b]][:, alive]
            if least is not None:
                bound = part.astype(np.float64) + q_left[b][j] * c_left[b][alive] + 1e-6 * abs(float(least))
                fits = bound >= float(least) if b < len(edges) - 1 else part >= least
                part, alive = part[fits], alive[fits]
                if not len(alive):
                    break
        others = c_rows[alive] != me
        alive, part = alive[others], part[others]
        if not len(alive):
            continue
        ids = c_ids[alive]
        by = np.lexsort((ids, -part)) if exact else np.array(sorted(range(len(ids)), key=lambda i: (-part[i], ids[i])), int)
        by = by[:k]
        if len(by) == k:
            worst = int(part[by[-1]])
            known[me] = max(known.get(me, worst), worst)
        out[0].extend([me] * len(by))
        out[1].extend(c_rows[alive[by]].tolist())
        out[2].extend(ids[by].tolist())
        out[3].extend(int(s) for s in part[by].tolist())
    return out


def top_k(vectors: DataFrame, k: int = 10, every: int = 100, scale: int = 1024, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """For each row whose id is divisible by `every`: the k best other rows. query_id, rank, vec_id, score."""
    rows = vectors.select(F.monotonically_increasing_id().alias("row"), F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    rows = materialize(rows, "top-k-rows")  # both sides read them, and a row keeps its number
    cands = rows.mapInArrow(_packed(CANDIDATES, scale, lambda i: True), BLOCK)
    asked = rows.where(F.col("id") % every == 0)
    queries = asked.mapInArrow(_packed(QUERIES, scale, lambda i: True), BLOCK)
    # A bucket is a task's worth of candidate blocks; every query block goes to each of them.
    buckets = max(8, -(-rows.count() // CANDIDATES))
    cands = cands.withColumn("bucket", F.pmod(F.xxhash64("rows"), F.lit(buckets)))
    queries = queries.withColumn("bucket", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1)))).select(
        F.col("bucket").cast("long").alias("bucket"), "dim", F.col("rows").alias("q_rows"), F.col("data").alias("q_data")
    )
    pairs = queries.join(cands, ["bucket", "dim"]).select("dim", "q_rows", "q_data", "rows", "ids", "data")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, int] = {}
        for batch in batches:
            for r in batch.to_pylist():
                shape = (r["dim"], -1)
                q_rows, c_rows, c_ids = (np.frombuffer(r[n], np.int64) for n in ("q_rows", "rows", "ids"))
                got = block_top_k(q_rows, np.frombuffer(r["q_data"]).reshape(shape), c_rows, c_ids, np.frombuffer(r["data"]).reshape(shape), k, known)
                clipped = [max(-(1 << 63), min((1 << 63) - 1, s)) for s in got[3]]
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (*got[:3], clipped)], names=["query", "row", "vec_id", "score"])

    best = W.partitionBy("query").orderBy(F.col("score").desc(), "vec_id", "row")
    found = pairs.mapInArrow(score, RESULT).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return found.join(asked.select(F.col("row").alias("query"), F.col("id").alias("query_id")), "query").select("query_id", "rank", "vec_id", "score")
