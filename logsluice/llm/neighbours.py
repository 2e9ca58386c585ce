"""Approximate nearest neighbours by cross-polytope hashing, reranked exactly.

A unit vector is turned by fast Hadamard pseudo-rotations (three times: random signs, then the transform) and assigned to the nearest signed axis; one or two such
axes name its bucket, and there are TABLES independent tables. A query probes, in each table, the buckets whose axes are nearest to its own turned
vector. How many, and whether one or two axes name a bucket, is fitted: for a bounded sample of queries (SAMPLE) the exact neighbours are searched in all rows,
and the number of probes is the least that finds WANTED of them. Every row is indexed.

Work is dealt out by bucket, and large buckets by part: counts per bucket say how many parts of about ROWS candidates and QUERIES probes it
makes, each pair of parts is one group of a co-group, and gives the k nearest of its candidates per query by their exact distance. Of equal
vectors only the k + 1 smallest ids can be among a query's nearest, so that Spark keeps no more of them before it shuffles. No
candidate is dropped beyond that. Queries that find fewer than k rows in their buckets are compared with all rows.

Distances are float64, from the vectors as they are; a matrix product chooses, with room for its rounding, which of them are worked out.

Defined results: rows whose vector is null, empty, zero or holds a null, NaN or infinite component, or whose id is null, take no part; vectors of different
lengths are never compared; every other row is a candidate, also one with the query's id or vector: only the query's own row is not; each of
several rows with a query's id is a query; equal distances go to the smaller id; distances beyond the range of a double are infinite; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize
from .vectors import matrices, usable

TABLES, TURNS = 3, 3
#: Candidates and queries of one group, at about which a bucket is split.
ROWS, QUERIES = 4096, 1024
#: Queries whose exact neighbours are searched to fit the probes, the share of neighbours to find, and the most buckets per table for two axes.
SAMPLE, WANTED, MOST_PROBES = 100, 0.97, 512
#: Rows per bucket beyond which two axes are tried.
CROWDED = 16384
#: Numbers that are turned at once.
AT_ONCE = 1 << 20


class Tables:
    """The tables for vectors of one length: signs come from the seed, so that every task has the same."""

    def __init__(self, dim: int, axes: int, tables: int = TABLES, seed: int = 0):
        self.dim, self.axes, self.size = dim, axes, max(2, 1 << (dim - 1).bit_length())
        self.signs = np.random.default_rng([seed, dim]).choice([-1.0, 1.0], (tables, 2, TURNS, self.size))
        self.buckets = (2 * self.size) ** axes

    def turned(self, x: np.ndarray, table: int, axis: int) -> np.ndarray:
        """Unit vectors x, turned, by their nearness to each of the signed axes."""
        y = np.zeros((len(x), self.size))
        y[:, : self.dim] = x
        for signs in self.signs[table, axis]:
            y *= signs
            half = 1
            while half < self.size:
                pairs = y.reshape(len(x), -1, 2, half)
                y = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], 2).reshape(len(x), self.size)
                half *= 2
            y /= np.sqrt(self.size)
        return np.concatenate([y, -y], 1)

    def bucket(self, x: np.ndarray, table: int) -> np.ndarray:
        out = np.zeros(len(x), np.int64)
        for axis in range(self.axes):
            out = out * 2 * self.size + self.turned(x, table, axis).argmax(1)
        return out

    def probed(self, x: np.ndarray, table: int, probes: int) -> np.ndarray:
        """Buckets in the order in which a query takes them, nearest first: queries x probes."""
        near = self.turned(x, table, 0)
        cost = (near.max(1, keepdims=True) - near) ** 2
        if self.axes > 1:
            other = self.turned(x, table, 1)
            cost = (cost[:, :, None] + ((other.max(1, keepdims=True) - other) ** 2)[:, None]).reshape(len(x), -1)
        return np.argsort(cost, axis=1, kind="stable")[:, :probes]


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


KEYED = "uid long, id long, v array<double>, dim int, tbl int, bucket long"


def _keyed(rows: DataFrame, axes: dict[int, int], probes: dict[int, int] | None = None, tables: int = TABLES) -> DataFrame:
    """rows once per table with their bucket, or once per bucket that they probe."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            uid, ids, vectors = batch.columns
            for dim, at, x in matrices(vectors):
                t = Tables(dim, axes[dim])
                step = max(1, AT_ONCE // (t.buckets if probes else 2 * t.size))
                for a in range(0, len(at), step):
                    unit, some = _unit(x[a : a + step]), pa.array(at[a : a + step])
                    for n in range(tables):
                        buckets = t.probed(unit, n, probes[dim]) if probes else t.bucket(unit, n)[:, None]
                        each = pa.array(np.repeat(some.to_numpy(), buckets.shape[1]))
                        rest = [pa.array(np.full(len(each), v, np.int32)) for v in (dim, n)]
                        for b in range(0, len(each), 4096):
                            cut = each[b : b + 4096]
                            yield pa.RecordBatch.from_arrays(
                                [uid.take(cut), ids.take(cut), vectors.take(cut), *(r[b : b + 4096] for r in rest), pa.array(buckets.ravel()[b : b + 4096], pa.int64())],
                                names=["uid", "id", "v", "dim", "tbl", "bucket"],
                            )

    return rows.select("uid", "id", "v").mapInArrow(run, KEYED)


FOUND = "query long, query_id long, uid long, vec_id long, score double"


def rerank(cands: pa.Table, queries: pa.Table, k: int) -> pa.Table:
    """For each query its k nearest candidates, its own row not among them, by exact distance and then id."""
    c_uid, c_id, q_uid, q_id = (t[n].to_numpy() for t, n in ((cands, "uid"), (cands, "id"), (queries, "uid"), (queries, "id")))
    (_, _, c), (_, _, q) = (next(matrices(t["v"].combine_chunks())) for t in (cands, queries))
    out: tuple[list, ...] = ([], [], [], [], [])
    with np.errstate(over="ignore", invalid="ignore"):
        norms = (c * c).sum(1)
        for a in range(0, len(q), 256):
            rough = norms - 2 * (q[a : a + 256] @ c.T)
            for j, row in enumerate(rough, a):
                some = np.arange(len(c))
                if len(c) > k + 1 and np.isfinite(row).all():
                    room = 1e-9 * (float(norms.max()) + float(q[j] @ q[j]))
                    some = np.flatnonzero(row <= np.partition(row, k)[k] + room)
                some = some[c_uid[some] != q_uid[j]]
                apart = c[some] - q[j]
                d = np.sqrt((apart * apart).sum(1))
                best = np.lexsort((c_uid[some], c_id[some], d))[:k]
                out[0].extend([q_uid[j]] * len(best))
                out[1].extend([q_id[j]] * len(best))
                out[2].extend(c_uid[some[best]].tolist())
                out[3].extend(c_id[some[best]].tolist())
                out[4].extend(d[best].tolist())
    return pa.table([*(pa.array(x, pa.int64()) for x in out[:4]), pa.array(out[4], pa.float64())], names=["query", "query_id", "uid", "vec_id", "score"])


KEY = ["dim", "tbl", "bucket"]


def _nearest(cands: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """cands and queries with their keys: the k nearest of each part of a bucket, for each query of a part."""
    counts = cands.groupBy(*KEY).agg(F.count("*").alias("c")).join(queries.groupBy(*KEY).agg(F.count("*").alias("q")), KEY)
    parts = materialize(counts.select(*KEY, F.ceil(F.col("c") / ROWS).cast("int").alias("c_parts"), F.ceil(F.col("q") / QUERIES).cast("int").alias("q_parts")), "ann-parts")

    def dealt(rows: DataFrame, own: str, other: str, salt: int) -> DataFrame:
        # The table of buckets has TABLES times the buckets of a table at most, whatever the rows.
        mine: Column = F.pmod(F.xxhash64("uid", F.lit(salt)), F.col(own)).cast("int")
        each = F.explode(F.sequence(F.lit(0), F.col(other) - 1))
        return rows.join(F.broadcast(parts), KEY).withColumn(own[0], mine).withColumn(other[0], each).select(*KEY, "c", "q", "uid", "id", "v")

    left, right = dealt(cands, "c_parts", "q_parts", 1), dealt(queries, "q_parts", "c_parts", 2)
    by = [*KEY, "c", "q"]
    return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(lambda one, two: rerank(one, two, k) if len(one) and len(two) else rerank_none(), FOUND)


def rerank_none() -> pa.Table:
    return pa.table({n: pa.array([], t) for n, t in (("query", pa.int64()), ("query_id", pa.int64()), ("uid", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64()))})


def _best(found: DataFrame, k: int) -> DataFrame:
    each = found.groupBy("query", "query_id", "uid", "vec_id").agg(F.min("score").alias("score"))
    by = W.partitionBy("query").orderBy("score", "vec_id", "uid")
    return each.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)


def _exact(cands: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """All candidates: every one and every query in the same bucket, which is split by its counts."""
    one = lambda rows: rows.select("uid", "id", "v", F.size("v").alias("dim"), F.lit(0).alias("tbl"), F.lit(0).cast("long").alias("bucket"))
    return _nearest(one(cands), one(queries), k)


def fitted(cands: DataFrame, queries: DataFrame, k: int, sample: int = SAMPLE, wanted: float = WANTED) -> tuple[dict[int, int], dict[int, int]]:
    """Axes per bucket and probes per table, by vector length: the least probes that find `wanted` of the exact neighbours of a sample of `sample` queries.
    The sample, its neighbours and one number per pair come to the driver, and the number of vectors per length."""
    many = {r["dim"]: r["n"] for r in cands.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n")).collect()}
    some = materialize(queries.orderBy(F.xxhash64("uid"), "uid").limit(sample), "ann-sample")
    true = materialize(_best(_exact(cands, some, k), k).select("query", "uid"), "ann-true")
    asked = {r["uid"]: r["v"] for r in some.collect()}
    pairs = true.join(cands.select("uid", "v").hint("shuffle_hash"), "uid").collect()
    axes, probes = {}, {}
    for dim, n in many.items():
        mine = [(asked[r["query"]], r["v"]) for r in pairs if len(r["v"]) == dim]
        options = [1, 2] if n > CROWDED * 2 * Tables(dim, 1).size else [1]
        for a in options:
            t = Tables(dim, a)
            first = np.full(len(mine), t.buckets)
            for table in range(TABLES if mine else 0):
                step = max(1, AT_ONCE // t.buckets)
                for at in range(0, len(mine), step):
                    q, c = (_unit(np.array(x)) for x in zip(*mine[at : at + step], strict=True))
                    turn = t.probed(q, table, t.buckets) == t.bucket(c, table)[:, None]
                    first[at : at + step] = np.minimum(first[at : at + step], turn.argmax(1) + 1)
            least = int(np.quantile(first, wanted, method="higher")) if mine else t.buckets
            if a == 1 or least <= MOST_PROBES:
                axes[dim], probes[dim] = a, least
    return axes, probes


def neighbours(vectors: DataFrame, k: int = 10, every: int = 100, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """For each row whose id is divisible by `every`: the k nearest other rows found. query_id, rank, vec_id, score."""
    rows = usable(vectors, key, vector).where(F.col("id").isNotNull() & F.exists("v", lambda x: x != 0))
    rows = materialize(rows.withColumn("uid", F.monotonically_increasing_id()), "ann-rows")
    queries = rows.where(F.col("id") % every == 0)
    same = W.partitionBy("v").orderBy("id", "uid")
    cands = materialize(rows.withColumn("nth", F.row_number().over(same)).where(F.col("nth") <= k + 1).drop("nth"), "ann-candidates")
    axes, probes = fitted(cands, queries, k)
    found = materialize(_best(_nearest(_keyed(cands, axes), _keyed(queries, axes, probes), k), k), "ann-found")
    enough = found.where(F.col("rank") == k).select(F.col("query").alias("uid"))
    short = materialize(queries.join(enough, "uid", "left_anti"), "ann-short")
    if not short.isEmpty():
        found = found.join(short.select(F.col("uid").alias("query")), "query", "left_anti").unionByName(_best(_exact(cands, short, k), k))
    return found.select("query_id", "rank", "vec_id", "score")
