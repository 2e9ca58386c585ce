"""Embedding whitening: a randomised range finder with Rayleigh-Ritz over all rows.

Components become whole numbers x = floor(scale * c) + offset. One pass over the packed vectors gives their number n and the exact sums S. The
covariance V is never formed: a pass adds up V Q = sum of (x - S/n) ((x - S/n)' Q) / n for a block Q of orthonormal columns, as many as
components are asked for and OVERSAMPLING more. Rayleigh-Ritz on (Q, V Q) gives components with their residuals; while these are above
TOLERANCE of the largest eigenvalue, V Q is orthonormalised for the next power pass. If POWER_PASSES do not suffice, Q is expanded to the
full dimension, where Rayleigh-Ritz is the whole eigenproblem. Deviations n * x - S are exact before they are centred; partial sums of tasks are
added in two levels. The driver holds matrices of dimension times block, never vectors of rows. A last pass measures the covariance of the whitened rows.

Defined results: vectors that are null, empty, hold a null, NaN or infinite component, or overflow when scaled have no rows; vectors of each
length are a table of their own; rows with a null id and repeated rows take part, each; components beyond the rank (an eigenvalue
of 1e-12 of the trace or less, as of constant or single vectors) have no direction and are left out; a deviation beyond 64 bits is the largest
long; a component's sign makes its largest entry positive; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .vectors import EXACT, LONG, packed, sums_of, unpacked, usable, whole

OVERSAMPLING, POWER_PASSES, TOLERANCE = 8, 3, 1e-13
RANK = 1e-12


def deviations(x: np.ndarray, offset: int, n: int, sums: list[int]) -> np.ndarray:
    """n * (x + offset) - sums, exactly: int64 where it fits, else Python integers."""
    largest = int(np.abs(x).max(initial=0)) + abs(offset)
    if n * largest < 1 << 62 and max(map(abs, sums)) < 1 << 62:
        return n * (x.astype(np.int64) + offset) - np.array(sums, np.int64)
    return n * (whole(x) + offset) - np.array(sums, object)


def centred(x: np.ndarray, offset: int, n: int, sums: list[int]) -> np.ndarray:
    d = deviations(x, offset, n, sums)
    return (d / n).astype(np.float64)


def _by_row(slots: dict[int, list], rows: int, columns: int) -> np.ndarray:
    return np.array([slots[i] for i in range(rows)]).reshape(rows, columns)


def covariance_times(blocks: DataFrame, offset: int, n: int, sums: list[int], q: np.ndarray) -> tuple[np.ndarray, float]:
    """V Q and the trace of V, by one pass over all rows; one slot per dimension, so that no sum is longer than a row of V Q."""
    dim = len(sums)

    def each(ids: list, x: np.ndarray) -> Iterator[tuple[int, list]]:
        c = centred(x, offset, n, sums)
        w, square = c.T @ (c @ q), (c * c).sum(0)
        for i in range(dim):
            yield i, [float(square[i]), *w[i].tolist()]

    found = _by_row(sums_of(blocks, "double", each), dim, 1 + q.shape[1]) / n
    return found[:, 1:], float(found[:, 0].sum())


def components(blocks: DataFrame, offset: int, n: int, sums: list[int], k: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray, float, list[int]]:
    """The k largest eigenvalues of V, their eigenvectors (columns), the trace, and the width of the block in each pass."""
    dim = len(sums)
    width, widths = min(dim, k + OVERSAMPLING), []
    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, width)))[0]
    while True:
        w, trace = covariance_times(blocks, offset, n, sums, q)
        widths.append(width)
        inner = q.T @ w
        values, turn = np.linalg.eigh((inner + inner.T) / 2)
        values, turn = values[::-1][:k], turn[:, ::-1][:, :k]
        found = q @ turn
        left = np.linalg.norm(w @ turn - found * values, axis=0)
        if width == dim or left.max() <= TOLERANCE * max(values[0], 0):
            return values, found, trace, widths
        if len(widths) < POWER_PASSES:
            q = np.linalg.qr(w)[0]
        else:  # the residuals failed: all dimensions, where Q is the identity
            width, q = dim, np.eye(dim)


def whitened(vectors: DataFrame, k: int = 8, scale: int = 1024, offset: int = 100_000, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Per vector and component: vec_id, component, n, deviation, whitened, explained, identity_error."""
    spark = vectors.sparkSession
    blocks = materialize(packed(usable(vectors, key, vector).where(F.size("v") > 0), scale), "whitening-blocks")
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    out = spark.createDataFrame([], schema)
    for dim in sorted(r["dim"] for r in blocks.select("dim").distinct().collect()):
        out = out.unionByName(_whitened(blocks.where(F.col("dim") == dim), k, offset, schema))
    return out


def _whitened(blocks: DataFrame, k: int, offset: int, schema: str) -> DataFrame:
    def totals(ids: list, x: np.ndarray) -> Iterator[tuple[int, list]]:
        y = x if len(x) * int(np.abs(x).max(initial=0)) < EXACT else whole(x)
        yield 0, [len(x), *(int(s) + offset * len(x) for s in y.sum(0).tolist())]

    n, *sums = sums_of(blocks, "string", totals)[0]
    values, vectors, trace, _ = components(blocks, offset, n, sums, k)
    known = values > RANK * trace
    values, vectors = values[known], vectors[:, known]
    if not len(values):
        return blocks.sparkSession.createDataFrame([], schema)
    vectors = vectors * np.where(vectors[np.abs(vectors).argmax(0), np.arange(len(values))] < 0, -1.0, 1.0)
    turn, explained, found = vectors / np.sqrt(values), (values / trace).tolist(), len(values)

    def products(ids: list, x: np.ndarray) -> Iterator[tuple[int, list]]:  # deviations sum up to zero exactly, so the rows are centred
        z = centred(x, offset, n, sums) @ turn
        yield from enumerate((z.T @ z).tolist())

    error = float(np.abs(_by_row(sums_of(blocks, "double", products), found, found) / n - np.eye(found)).max())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, x in unpacked(batches):
            d = deviations(x, offset, n, sums)
            fits = d.dtype == object or len(sums) * max(int(d.max(initial=0)), -int(d.min(initial=0))) ** 2 <= LONG
            squares = ((d if fits else d.astype(object)) ** 2).sum(1).tolist()
            z, m = (d / n).astype(np.float64) @ turn, len(ids)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([i for i in ids for _ in range(found)], pa.int64()), pa.array(list(range(1, found + 1)) * m, pa.int32()), pa.array([n] * (m * found), pa.int64()),
                    pa.array([min(LONG, int(s)) for s in squares for _ in range(found)], pa.int64()), pa.array(z.ravel()), pa.array(explained * m), pa.array([error] * (m * found)),
                ],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return blocks.mapInArrow(run, schema)
