"""What the operators on embeddings share: usable vectors, blocks of vectors as matrices, sums over all rows."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Vectors in a block, and the numbers that a task holds back at most while it packs blocks.
BLOCK, HELD = 4096, 1 << 22
BLOCKS = "dim int, ids array<long>, data binary"
#: Whole numbers up to here, and sums of them that stay here, are exact in float64.
EXACT = 1 << 53
#: Groups that partial sums are first added up in, so that no task adds up one row of every other task.
FIRST_SUMS = 64
LONG = (1 << 63) - 1


def usable(df: DataFrame, key: str, vector: str) -> DataFrame:
    """id long, v array<double>: the rows whose vector is neither null nor holds a null, NaN or infinite component."""
    rows = df.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return rows.where(F.col("v").isNotNull() & fine)


def matrices(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, places, vectors x components) for each length of the lists of a column without nulls."""
    sizes = pc.list_value_length(column).to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    starts = np.cumsum(sizes) - sizes
    for dim in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == dim)
        yield dim, at, flat[(starts[at, None] + np.arange(dim)).ravel()].reshape(len(at), dim)


def packed(rows: DataFrame, scale: int, block: int = BLOCK) -> DataFrame:
    """rows (id, v) as blocks of vectors of one length, row by row, with whole components floor(scale * x) as float64, packed within
    their partitions. Vectors that overflow when scaled are left out. Nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[list, list]] = {}

        def flush(dim: int) -> pa.RecordBatch:
            ids, data = held.pop(dim)
            return pa.RecordBatch.from_pydict({"dim": pa.array([dim], pa.int32()), "ids": pa.array([ids], pa.list_(pa.int64())), "data": [np.concatenate(data).tobytes()]})

        for batch in batches:
            ids = batch.column(0).to_pylist()
            for dim, at, x in matrices(batch.column(1)):
                with np.errstate(over="ignore"):
                    y = np.floor(x * scale)
                fits = np.isfinite(y).all(1)
                for a in range(0, len(at), block):
                    some = fits[a : a + block]
                    here, data = held.setdefault(dim, ([], []))
                    here.extend(ids[i] for i in at[a : a + block][some].tolist())
                    data.append(y[a : a + block][some])
                    if len(here) >= block:
                        yield flush(dim)
            while sum(len(ids) * dim for dim, (ids, _) in held.items()) > HELD:
                yield flush(max(held, key=lambda dim: len(held[dim][0]) * dim))
        for dim in list(held):
            if held[dim][0]:
                yield flush(dim)

    return rows.select("id", "v").mapInArrow(run, BLOCKS)


def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, np.ndarray]]:
    """(ids, vectors x components) of each block."""
    for batch in batches:
        for r in batch.to_pylist():
            yield r["ids"], np.frombuffer(r["data"]).reshape(len(r["ids"]), r["dim"])


def whole(x: np.ndarray) -> np.ndarray:
    """Python integers of any size instead of whole float64 numbers."""
    return np.vectorize(int, otypes=[object])(x) if x.size else x.astype(object)


def added(parts: DataFrame, kind: str) -> DataFrame:
    """parts: slot int, part long, values array<kind>. One row per slot with the sums, place by place: of kind string, whole numbers of any
    size, added exactly; of kind double, rounded once per level. Each task of what came before gives one row per slot, so a first level of
    FIRST_SUMS groups per slot adds up most."""
    add: Callable = (lambda xs: str(sum(map(int, xs)))) if kind == "string" else math.fsum

    def one(table: pa.Table) -> pa.Table:
        sums = [add(xs) for xs in zip(*table["values"].to_pylist(), strict=True)]
        return pa.table({"slot": table["slot"][:1], "part": table["part"][:1], "values": pa.array([sums], table.schema.field("values").type)})

    schema = f"slot int, part long, values array<{kind}>"
    first = parts.groupBy("slot", F.pmod("part", F.lit(FIRST_SUMS))).applyInArrow(one, schema)
    return first.groupBy("slot").applyInArrow(one, schema)


def sums_of(blocks: DataFrame, kind: str, each: Callable[[list, np.ndarray], Iterator[tuple[int, list]]]) -> dict[int, list]:
    """each gives (slot, values) of a block; the sums per slot over all blocks. What comes to the driver is one row per slot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total: dict[int, list] = {}
        for ids, x in unpacked(batches):
            for slot, values in each(ids, x):
                total[slot] = [a + b for a, b in zip(total[slot], values, strict=True)] if slot in total else values
        part = TaskContext.get().partitionId()
        for slot, values in total.items():
            values = [str(v) for v in values] if kind == "string" else [float(v) for v in values]
            yield pa.RecordBatch.from_pydict({"slot": pa.array([slot], pa.int32()), "part": pa.array([part], pa.int64()), "values": [values]})

    parts = blocks.mapInArrow(run, f"slot int, part long, values array<{kind}>")
    back = int if kind == "string" else float
    return {r["slot"]: [back(v) for v in r["values"]] for r in added(parts, kind).collect()}
