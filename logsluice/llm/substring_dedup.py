"""Substring deduplication by content-defined chunking.

A gear hash rolls over each text's bytes; a chunk ends where its upper bits are zero, so cuts depend on the last bytes alone and
an insertion shifts no cut but those around it. Of candidate cuts closer than MIN_CHUNK to the one before, the later goes (a rule
that is local too); stretches without cuts are cut every MAX_CHUNK bytes. Chunks are grouped by a 96-bit digest. Within a document, consecutive
chunks that stand elsewhere too, in other documents or in this one, make a run; runs of RUN_BYTES or more are repeated passages. The first chunk of each group
(least document id, then place) stays; later ones in repeated passages are removed. Cuts and digests are taken from the text with each
run of white space (space, TAB to CR) as one space, so other line breaks hide no copy; spans are those of the text itself.

Digests are counted with partial sums before the shuffle, and marks are joined back to thin chunk rows, whose hot keys
Spark's skew join splits.

Defined results: null and empty texts have no chunks; rows without id pass through unmarked; rows with one id are documents of their
own if their texts differ; if these are equal too they count once and have equal results; an empty table gives an empty result; other columns are ignored. Whole texts are cut; a task holds
some megabytes of text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize, row_key, small_batches

#: The window of the gear hash, the bits that must be zero at a cut (one place in 32), and the bounds of chunks, in bytes.
WINDOW, CUT_BITS = 16, 5
MIN_CHUNK, MAX_CHUNK = 16, 192
#: Bytes from which a run of repeated chunks is a repeated passage.
RUN_BYTES = 96
SLICE = 4 << 20

#: 256 pseudo-random 32-bit words, one per byte value.
GEAR = np.frombuffer(hashlib.shake_128(b"gear").digest(1024), "<u4")


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """The gear hash at each byte over the last WINDOW bytes: sum of GEAR[b] << age, by doubling."""
    h, span = GEAR[data], 1
    while span < WINDOW:
        more = h.copy()
        more[span:] += h[:-span] << np.uint32(span)
        h, span = more, span * 2
    return h


def cut_points(data: np.ndarray) -> np.ndarray:
    """Where chunks of one text end (exclusive), the text's end included."""
    n = len(data)
    at = np.flatnonzero((gear_hashes(data) >> np.uint32(WINDOW)) & np.uint32((1 << CUT_BITS) - 1) == 0) + 1
    if len(at):
        at = at[np.diff(at, prepend=-MIN_CHUNK) >= MIN_CHUNK]
    edges = np.unique(np.concatenate((at, [n])))
    starts = np.concatenate(([0], edges[:-1]))
    long = np.flatnonzero(edges - starts > MAX_CHUNK)
    if len(long):
        extra = [np.arange(starts[i] + MAX_CHUNK, edges[i], MAX_CHUNK) for i in long.tolist()]
        edges = np.unique(np.concatenate((edges, *extra)))
    return edges


def single_spaced(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes with each run of white space as one space, and where each of them comes from."""
    gap = (data == 32) | ((data >= 9) & (data <= 13))
    kept = ~(gap & np.concatenate(([False], gap[:-1])))
    return np.where(gap, np.uint8(32), data)[kept], np.flatnonzero(kept)


CHUNK = "doc_id long, row long, nth int, start int, end int, size int, h1 long, h2 int"


def chunks(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per chunk: doc_id, row (a 64-bit digest of the text), nth, start and end in code points, size in bytes, digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list[list] = [[] for _ in range(8)]
            for doc_id, t, row in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if doc_id is None or not t:
                    continue
                raw = t.encode("utf-8", "replace")
                whole = np.frombuffer(raw, np.uint8)
                data, source = single_spaced(whole)
                raw = data.tobytes()
                ends = cut_points(data)
                at = ends.tolist()
                digests = np.frombuffer(b"".join(hashlib.blake2b(raw[a:b], digest_size=12).digest() for a, b in zip([0, *at], at, strict=False)), [("h1", "<i8"), ("h2", "<i4")])
                places = np.append(source, len(whole))[ends]
                if len(t) != len(whole):
                    places = np.append(0, np.cumsum((whole & 0xC0) != 0x80))[places]
                last = places.tolist()
                n = len(at)
                for col, new in zip(cols, ([doc_id] * n, [row] * n, range(n), [0, *last[:-1]], last, np.diff(ends, prepend=0).tolist(), digests["h1"].tolist(), digests["h2"].tolist()), strict=True):
                    col.extend(new)
                if len(cols[0]) > 200_000:
                    yield out(cols)
                    cols = [[] for _ in range(8)]
            yield out(cols)

    def out(cols) -> pa.RecordBatch:
        types = [pa.int64(), pa.int64(), *[pa.int32()] * 4, pa.int64(), pa.int32()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["doc_id", "row", "nth", "start", "end", "size", "h1", "h2"])

    return small_batches(docs).select(F.col(key).cast("long"), F.col(text), row_key(text)).mapInArrow(run, CHUNK)


def repeated_chunks(cut: DataFrame) -> DataFrame:
    """The chunks that stand in several places, of one document or of several, with `first`: whether it is the first of its group. Rows equal in
    id and text are one place."""
    place = F.struct("doc_id", "row", "nth")
    groups = cut.groupBy("h1", "h2").agg(F.min(place).alias("p"), F.max(place).alias("last")).where("p < last")
    groups = groups.select(F.bitwise_not("h1").alias("w1"), F.bitwise_not("h2").alias("w2"), "p")
    rows = cut.withColumn("w1", F.bitwise_not("h1")).withColumn("w2", F.bitwise_not("h2"))
    return rows.join(groups, ["w1", "w2"]).select("doc_id", "row", "nth", "start", "end", "size", (place == F.col("p")).alias("first"))


def passages(cut: DataFrame) -> DataFrame:
    """Repeated passages: doc_id, row, start, end, and removed: the spans (start, end) of chunks that are not first."""
    by = W.partitionBy("doc_id", "row").orderBy("nth")
    again = F.lag("nth").over(by).eqNullSafe(F.col("nth"))  # of a row that is there several times
    runs = repeated_chunks(cut).withColumn("again", again).where(~F.col("again")).withColumn("run", F.col("nth") - F.row_number().over(by))
    late = F.when(~F.col("first"), F.struct("start", "end"))
    found = runs.groupBy("doc_id", "row", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum("size").alias("bytes"), F.sort_array(F.collect_list(late)).alias("removed"))
    return found.where(F.col("bytes") >= RUN_BYTES).drop("run", "bytes")


def substring_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of docs: doc_id, n_chars, n_passages, repeated_chars (within repeated passages), removed_chars, spans of the repeated
    passages as start:end, comma-joined."""
    cut = materialize(chunks(docs, key, text), "chunks")
    found = passages(cut)
    span = F.expr("concat_ws(',', transform(sort_array(collect_list(struct(start, end))), x -> concat(x.start, ':', x.end)))")
    marks = found.groupBy("doc_id", "row").agg(
        F.count("*").alias("n_passages"),
        F.sum(F.col("end") - F.col("start")).alias("repeated_chars"),
        F.sum(F.expr("aggregate(removed, 0L, (s, x) -> s + x.end - x.start)")).alias("removed_chars"),
        span.alias("spans"),
    )
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), row_key(text).alias("row"), F.coalesce(F.char_length(text), F.lit(0)).cast("long").alias("n_chars"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return rows.join(marks, ["doc_id", "row"], "left").select("doc_id", "n_chars", zero("n_passages"), zero("repeated_chars"), zero("removed_chars"), F.coalesce("spans", F.lit("")).alias("spans"))


def without_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with the later copies of repeated passages taken out of the text."""
    cut = materialize(chunks(docs, key, text), "chunks")
    gone = passages(cut).groupBy("doc_id", "row").agg(F.sort_array(F.flatten(F.collect_list("removed"))).alias("__gone"))
    gone = gone.where(F.size("__gone") > 0).select(F.col("doc_id").alias("__id"), F.col("row").alias("__row"), "__gone")
    rows = docs.withColumn("__row2", row_key(text))
    joined = rows.join(gone, (F.col(key).cast("long") == F.col("__id")) & (F.col("__row2") == F.col("__row")), "left")
    kept = F.expr(
        f"CASE WHEN __gone IS NULL THEN {text} ELSE concat(aggregate(__gone, named_struct('at', 0, 't', ''), "
        f"(s, x) -> named_struct('at', x.end, 't', concat(s.t, substring({text}, s.at + 1, x.start - s.at)))).t, substring({text}, element_at(__gone, -1).end + 1)) END"
    )
    return joined.withColumn(text, kept).select(*docs.columns)
