"""Centroid clustering with annulus search.

Vectors become whole numbers floor(scale * x) and are packed into blocks once. A round assigns every vector to its nearest centroid: the
centroids are sorted by norm, the nearer of the two whose norms enclose the vector's gives an upper bound u of the distance, and by the triangle
inequality only centroids with norms within u of the vector's can be as near. Binary search finds that annulus; its centroids, both
borders included, are compared exactly. Per task, counts and sums of each cluster leave for the next centroids: nothing else is shuffled, and the
driver holds the centroids alone (k vectors).

All comparisons and sums are of whole numbers: float64 where everything stays below 2**53, else Python integers. Norms only choose who is
compared, and the annulus is widened by more than their rounding.

Defined results: vectors that are null, of another length, hold a null, NaN or infinite component, or overflow when scaled take no part;
rows with a null id take part but are never a first centroid before rows that have one; repeated rows are vectors of their own, each, and
can be first centroids of their own (the later one then stays empty), rows with one id in the order of their components; with fewer than k vectors
there are as many centroids; distances beyond 64 bits count as the largest long; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .vectors import EXACT, LONG, packed, sums_of, unpacked, usable, whole


def _norms(x: np.ndarray) -> np.ndarray:
    if x.dtype == object:
        return np.array([float(math.isqrt(s)) for s in (x * x).sum(1).tolist()])
    return np.sqrt((x * x).sum(1))


def nearest(x: np.ndarray, centroids: list[list[int]]) -> tuple[np.ndarray, np.ndarray, int]:
    """Per row of x (whole numbers as float64) the number of its nearest centroid and the squared distance; and how many comparisons
    with annulus members that took."""
    largest = max(int(np.abs(x).max(initial=0)), max(abs(v) for c in centroids for v in c))
    exact = x.shape[1] * (2 * largest) ** 2 < EXACT
    c = np.array(centroids, dtype=np.float64 if exact else object)
    x = x if exact else whole(x)
    far, norm = _norms(c), _norms(x)
    order = np.argsort(far, kind="stable")
    far = far[order]
    apart = lambda rows, j: ((x[rows] - c[order[j]]) ** 2).sum(1)
    # The bound: the nearer of the two centroids next to the vector in norm.
    above = np.clip(np.searchsorted(far, norm), 0, len(far) - 1)
    pivots = np.stack([above, np.maximum(above - 1, 0)])
    bound = np.full(len(x), np.inf)
    for side in pivots:
        for j in np.unique(side).tolist():
            rows = np.flatnonzero(side == j)
            bound[rows] = np.minimum(bound[rows], np.sqrt(apart(rows, j).astype(np.float64)) if exact else [float(math.isqrt(d) + 1) for d in apart(rows, j)])
    slack = 1 + 1e-9 * (norm + bound)
    low, high = np.searchsorted(far, norm - bound - slack, "left"), np.searchsorted(far, norm + bound + slack, "right")
    best, who, compared = np.full(len(x), -1, x.dtype), np.full(len(x), -1), 0
    for j in range(int(low.min(initial=0)), int(high.max(initial=0))):
        rows = np.flatnonzero((low <= j) & (j < high))
        compared += len(rows)
        d, number = apart(rows, j), order[j]
        better = (who[rows] < 0) | (d < best[rows]) | ((d == best[rows]) & (number < who[rows]))
        best[rows[better]], who[rows[better]] = d[better], number
    return who, best, compared


def first_centroids(rows: DataFrame, k: int, scale: int, salt: str) -> list[list[int]]:
    """The k vectors whose ids have the smallest hashes, in that order: k rows come to the driver."""
    found = rows.select(F.sha2(F.concat(F.lit(salt), F.col("id").cast("string")), 256).alias("hash"), "v").orderBy(F.col("hash").asc_nulls_last(), "v").limit(k).collect()
    return [[int(math.floor(x * scale)) for x in r["v"]] for r in found]


def clustered(
    vectors: DataFrame, k: int = 16, rounds: int = 3, scale: int = 64, dims: int = 64, salt: str = "1:", key: str = "vec_id", vector: str = "embedding"
) -> DataFrame:
    """Per vector that takes part: vec_id, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256."""
    spark = vectors.sparkSession
    rows = usable(vectors, key, vector).where(F.size("v") == dims)
    fits = F.forall("v", lambda x: F.abs(x * F.lit(float(scale))) < F.lit(float("inf")))
    blocks = materialize(packed(rows, scale), "cluster-blocks")
    centroids = first_centroids(rows.where(fits), k, scale, salt)
    schema = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not centroids:
        return spark.createDataFrame([], schema)

    def moved(centroids: list[list[int]]) -> list[list[int]]:
        def each(ids: list, x: np.ndarray) -> Iterator[tuple[int, list]]:
            who, _, _ = nearest(x, centroids)
            safe = len(x) * int(np.abs(x).max(initial=0)) < EXACT
            y = x if safe else whole(x)
            for j in np.unique(who).tolist():
                mine = y[who == j]
                yield j, [len(mine), *map(int, mine.sum(0).tolist())]

        found = sums_of(blocks, "string", each)
        return [[s // found[j][0] for s in found[j][1:]] if j in found else c for j, c in enumerate(centroids)]

    for _ in range(rounds):
        centroids = moved(centroids)

    def inertias(ids: list, x: np.ndarray) -> Iterator[tuple[int, list]]:
        who, distance, _ = nearest(x, centroids)
        distance = whole(distance) if distance.dtype != object else distance
        for j in np.unique(who).tolist():
            yield j, [int(distance[who == j].sum())]

    inertia = {j: v for j, (v,) in sums_of(blocks, "string", inertias).items()}
    total = min(LONG, sum(inertia.values()))
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, x in unpacked(batches):
            who, distance, _ = nearest(x, centroids)
            numbers = who.tolist()
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, pa.int64()), pa.array(numbers, pa.int32()), pa.array([min(LONG, int(d)) for d in distance.tolist()], pa.int64()),
                    pa.array([min(LONG, inertia[j]) for j in numbers], pa.int64()), pa.array([total] * len(numbers), pa.int64()), pa.array([digests[j] for j in numbers]),
                ],
                names=["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"],
            )

    return blocks.mapInArrow(run, schema)
