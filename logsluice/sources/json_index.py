"""JSON documents of any size, cut into records by a structural index.

Spark reads a file by splits, as text that ends at commas; a task joins what it reads to chunks of CHUNK bytes and stores them with the parity of
their quotes and, for either state of a string at their start, what they add to the depth of brackets. Prefix sums of parity and depth over the
chunks of a file give each chunk's state at its start. With it, a chunk tells where records are parted: at the commas at depth one of an array,
at those of the list under events, records, logs or data of an object, else nowhere. Counts of these, summed up over the chunks, number the records.
Each chunk then gives the records that start and end in it whole, and parts of the others, which are joined by record. So no task
holds a document, unless it is one record.

A comma is never within an escape sequence or a UTF-8 character, so chunks can end there. Files that are not one JSON value by their brackets
and quotes, or of whose records one is no JSON, are read by line, by the same chunks. (What stands beside the list of an object is checked by its
brackets and quotes only.)
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.store import stored
from .files import MOST_CHARS, known

#: Bytes of a chunk (it ends at the next comma), and characters of a line that is no JSON.
CHUNK = 1 << 20
#: Records of an Arrow batch, and their bytes.
BATCH, BATCH_BYTES = 4096, 8 << 20
# The lists of an object that hold records, the first that there is counts.
LISTS = ("events", "records", "logs", "data")
_ESCAPED = re.compile(rb"\\.", re.DOTALL)
_LIST = re.compile(rb'\s*"(' + b"|".join(k.encode() for k in LISTS) + rb')"\s*:\s*\[')
_SPACE = np.isin(np.arange(256), [9, 10, 13, 32])
_MARK = b"\xef\xbb\xbf"

CHUNKS = "file string, block long, chunk int, data binary, n long, size long, quotes int, delta_out int, delta_in int, utf8 boolean, head int"


def _shape(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes with escapes blanked, the parity of the quotes up to each, and what each adds to the depth outside strings."""
    a = np.frombuffer(_ESCAPED.sub(b"__", data) if b"\\" in data else data, np.uint8)
    parity = (np.cumsum(a == 34, dtype=np.int64) & 1).astype(np.int8)
    step = ((a == 123) | (a == 91)).astype(np.int8) - ((a == 125) | (a == 93)).astype(np.int8)
    return a, parity, step


def _chunk(file: str, size: int, block: int, nth: int, held: list[bytes]) -> pa.RecordBatch:
    data = b",".join(held) + b","
    a, parity, step = _shape(data)
    try:
        data.decode()
        fine = True
    except UnicodeDecodeError:
        fine = False
    start = 3 if data.startswith(_MARK) and block == nth == 0 else 0
    seen = np.flatnonzero(~_SPACE[a[start:]])
    row = {"file": file, "block": block, "chunk": nth, "data": data, "n": len(data), "size": size, "quotes": int(parity[-1]), "delta_out": int(step[parity == 0].sum()),
           "delta_in": int(step[parity == 1].sum()), "utf8": fine, "head": int(a[start + seen[0]]) if len(seen) else None}
    types = [pa.string(), pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.int32()]
    return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row.values(), types, strict=True)], names=list(row))


def chunks(spark: SparkSession, path: str, size: int = CHUNK) -> DataFrame:
    """The files' chunks, stored."""
    meta = [F.col(f"_metadata.{c}").alias(c) for c in ("file_path", "file_size", "file_block_start")]
    pieces = spark.read.option("lineSep", ",").text(path).select(F.col("value").cast("binary").alias("value"), *meta).where(known("file_path"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, much, nth = None, [], 0, 0
        for batch in batches:
            files, sizes, blocks = (batch.column(i).to_pylist() for i in (1, 2, 3))
            for value, *here in zip(batch.column(0).to_pylist(), files, sizes, blocks, strict=True):
                if here != at or much >= size:
                    if held:
                        yield _chunk(*at, nth, held)
                    at, held, much, nth = here, [], 0, nth + 1 if here == at else 0
                held.append(value)
                much += len(value) + 1
        if held:
            yield _chunk(*at, nth, held)

    return stored(pieces.mapInArrow(run, CHUNKS), "json-chunks")


def _in_order(frame: DataFrame) -> W:
    return W.partitionBy("file").orderBy("block", "chunk")


def states(cut: DataFrame) -> DataFrame:
    """Per chunk its state at the start: p0 (1 in a string), d0 (depth); whether it is the last, and whether its last comma is not in the file; the file's
    root character. From the thin columns of the stored chunks. Spark takes a mark off a file's start, so that it may count three bytes less."""
    each = _in_order(cut)
    before, whole = each.rowsBetween(W.unboundedPreceding, -1), W.partitionBy("file")
    out = cut.select("file", "block", "chunk", "n", "size", "quotes", "delta_out", "delta_in", "utf8", "head")
    out = out.withColumn("p0", F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2)
    out = out.withColumn("d0", F.coalesce(F.sum(F.when(F.col("p0") == 0, F.col("delta_out")).otherwise(F.col("delta_in"))).over(before), F.lit(0)))
    return out.select(
        "file", "block", "chunk", F.col("p0").cast("int").alias("p0"), F.col("d0").cast("int").alias("d0"), F.lead("chunk").over(each).isNull().alias("last"), F.lag("chunk").over(each).isNull().alias("first"),
        (F.sum("n").over(whole) - F.col("size")).isin(1, 1 - len(_MARK)).alias("added"), F.min(F.col("utf8").cast("int")).over(whole).cast("boolean").alias("utf8"),
        F.first("head", ignorenulls=True).over(each.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)).alias("root"),
    )


def _line_ends(a: np.ndarray, utf8: bool) -> np.ndarray:
    """Places of the last byte of each line end, as str.splitlines knows them."""
    after, before = np.append(a[1:], 0), np.insert(a[:-1], 0, 0)
    ends = np.isin(a, (10, 11, 12, 28, 29, 30)) | ((a == 13) & (after != 10))
    if utf8:
        two = np.insert(before[:-1], 0, 0)
        return np.flatnonzero(ends | ((a == 0x85) & (before == 0xC2)) | (np.isin(a, (0xA8, 0xA9)) & (before == 0x80) & (two == 0xE2)))
    return np.flatnonzero(ends | (a == 0x85))


class _Read:
    """A chunk with its state: its text without a comma that is not in the file, and the depth after each byte outside strings."""

    def __init__(self, r: dict):
        self.text = r["data"][:-1] if r["last"] and r["added"] else r["data"]
        self.skip = 3 if r["first"] and self.text.startswith(_MARK) else 0
        a, parity, step = _shape(self.text)
        self.raw = np.frombuffer(self.text, np.uint8)
        self.a, self.outside = a, (parity + r["p0"]) % 2 == 0
        self.step = np.where(self.outside & (a != 34), step, 0)
        self.depth = r["d0"] + np.cumsum(self.step)

    def commas(self, level: int) -> np.ndarray:
        return np.flatnonzero((self.a == 44) & self.outside & (self.depth == level))

    def closed(self, level: int) -> np.ndarray:
        """Where a bracket closes that stands at a depth."""
        return np.flatnonzero((self.step < 0) & (self.depth == level))

    def opened(self, level: int) -> np.ndarray:
        return np.flatnonzero((self.step > 0) & (self.depth == level + 1))


FACTS = "file string, block long, chunk int, members int, lists array<struct<key:int,member:int>>, elements array<int>, lines int, opens int, faults int, ends_at int, ends_in int"


def facts(placed: DataFrame) -> DataFrame:
    """Per chunk: commas at depth one (which part an array's elements or an object's members), the lists of records that start in it (their key's rank, and
    the number of commas at depth one before), commas at depth two by member, line ends, and what is wrong for one JSON value."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                c = _Read(r)
                parts = c.commas(1)
                starts = [*([c.opened(0)[0] + 1] if len(c.opened(0)) else []), *(parts + 1).tolist()]
                if not r["first"] and r["d0"] == 1 and r["p0"] == 0:
                    starts.append(0)
                lists = []
                if r["root"] == 123:
                    for at in starts:
                        if m := _LIST.match(c.text, at):
                            lists.append({"key": LISTS.index(m[1].decode()), "member": int(np.searchsorted(parts, at))})
                elements = np.bincount(np.searchsorted(parts, c.commas(2)), minlength=len(parts) + 1) if r["root"] == 123 else []
                outer = c.outside & (c.depth == 0) & (c.step == 0) & ~_SPACE[c.a]
                outer[: c.skip] = False
                wrong = int(outer.sum()) + int((c.depth < 0).sum()) + int((c.a[c.closed(0)] != (r["root"] or 0) + 2).sum())
                out.append((r["file"], r["block"], r["chunk"], len(parts), lists, list(elements), len(_line_ends(c.raw, r["utf8"])), len(c.opened(0)), wrong,
                            int(c.depth[-1]) if len(c.depth) else r["d0"], int(not c.outside[-1]) if len(c.outside) else r["p0"]))
            types = [pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.struct([("key", pa.int32()), ("member", pa.int32())])), pa.list_(pa.int32()), *[pa.int32()] * 5]
            names = [x.strip().split(" ")[0] for x in re.sub(r"<[^>]*>>?", "", FACTS).split(",")]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

    return placed.select("file", "block", "chunk", "data", "p0", "d0", "last", "first", "added", "utf8", "root").mapInArrow(run, FACTS)


def plan(state: DataFrame, fact: DataFrame) -> DataFrame:
    """Per chunk, how it is cut: mode, the member that holds the list (counted from the chunk's first), the records that start before it, and all of the
    file's; the same for lines."""
    each, whole = _in_order(state), W.partitionBy("file")
    before = each.rowsBetween(W.unboundedPreceding, -1)
    total = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    rows = state.join(fact, ["file", "block", "chunk"]).withColumn("m0", total("members"))
    found = F.array_min(F.transform("lists", lambda x: F.struct(x["key"], (x["member"] + F.col("m0")).alias("member"))))
    rows = rows.withColumn("chosen", F.min(found).over(whole))
    at_end = F.max(F.when(F.col("last"), (F.col("ends_at") != 0) | (F.col("ends_in") != 0)).otherwise(False)).over(whole)
    bad = at_end | (F.sum("faults").over(whole) > 0) | (F.sum("opens").over(whole) != 1)
    rows = rows.withColumn("mode", F.when(bad, "lines").when(F.col("root") == 91, "array").when(F.col("root") != 123, "lines").when(F.col("chosen").isNotNull(), "list").otherwise("whole"))
    rows = rows.withColumn("member", (F.col("chosen.member") - F.col("m0")).cast("int"))
    opens_here = F.exists("lists", lambda x: (x["member"] == F.col("member")) & (x["key"] == F.col("chosen.key")))
    inside = F.coalesce(F.get("elements", F.col("member")), F.lit(0)) + F.when(opens_here, 1).otherwise(0)
    starts = F.when(F.col("mode") == "array", F.col("members") + F.col("opens")).when(F.col("mode") == "list", inside).otherwise(F.col("first").cast("int"))
    rows = rows.withColumn("starts", starts).withColumn("line_starts", F.col("lines") + F.col("first").cast("int"))
    return rows.select(
        "file", "block", "chunk", "p0", "d0", "last", "first", "added", "utf8", "root", "mode", F.when(F.col("member") >= 0, F.col("member")).alias("member"),
        F.when(opens_here, F.col("chosen.key")).alias("key"), total("starts").alias("base"), F.sum("starts").over(whole).alias("total"), total("line_starts").alias("line_base"),
    )


def _segments(r: dict) -> Iterator[tuple[int, bytes, bool]]:
    """(number from 0, text, whether it is a whole record) of the parts of records in a chunk."""
    c, mode = _Read(r), r["mode"]
    begin, end, base = c.skip, len(c.text), r["base"]
    starts, ends, parts = r["first"], r["last"], np.array([], np.int64)
    if mode == "lines":
        parts, base = _line_ends(c.raw, r["utf8"]), r["line_base"]
    elif mode != "whole":
        level = 1 if mode == "array" else 2
        opening = c.opened(0)
        if mode == "list":
            member = c.commas(1)
            if r["member"] is None or r["member"] > len(member):
                return
            low, high = (int(member[r["member"] - 1]) + 1 if r["member"] else 0), (int(member[r["member"]]) if r["member"] < len(member) else end)
            opening = c.opened(1)
            opening = opening[(opening >= low) & (opening < high)] if r["key"] is not None else opening[:0]
        if len(opening):
            begin, starts = int(opening[0]) + 1, True
        elif r["d0"] < level or (mode == "list" and r["member"]):  # the list starts in a later chunk
            return
        else:
            starts = r["p0"] == 0 and r["d0"] == level
        shut = c.closed(level - 1)
        shut = shut[shut >= begin]
        ends = len(shut) > 0
        end = int(shut[0]) if ends else end
        parts = c.commas(level)
        parts = parts[(parts >= begin) & (parts < end)]
    number = base if begin == c.skip and r["first"] or (mode in ("array", "list") and len(opening)) else base - 1
    at = begin
    for part in parts.tolist():
        yield number, c.text[at : part + 1] if mode == "lines" else c.text[at:part], starts
        number, starts, at = number + 1, True, part + 1
    if at < end or (ends and mode != "lines"):
        yield number, c.text[at:end], starts and ends


RECORDS = "file string, no long, block long, chunk int, data binary, complete boolean, mode string, utf8 boolean, total long"


def _cut(placed: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.bool_(), pa.string(), pa.bool_(), pa.int64()]
        names = [x.split(" ")[0] for x in RECORDS.split(", ")]
        for batch in batches:
            for r in batch.to_pylist():
                held, much = [], 0
                for number, text, complete in _segments(r):
                    held.append((r["file"], number, r["block"], r["chunk"], text, complete, r["mode"], r["utf8"], r["total"]))
                    much += len(text)
                    if len(held) >= BATCH or much >= BATCH_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*held, strict=True), types, strict=True)], names=names)
                        held, much = [], 0
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*held, strict=True), types, strict=True)], names=names)

    return placed.mapInArrow(run, RECORDS)


def _joined(parts: DataFrame) -> DataFrame:
    """Records of which chunks hold parts. A group is one record."""

    def one(table: pa.Table) -> pa.Table:
        table = table.sort_by([("block", "ascending"), ("chunk", "ascending")])
        whole = pa.array([b"".join(table["data"].to_pylist())], pa.binary())
        return table.slice(0, 1).set_column(table.schema.get_field_index("data"), "data", whole)

    return parts.groupBy("file", "no").applyInArrow(one, RECORDS)


READ = "file string, line_number long, content string, is_blank boolean, fine boolean"


def _read(records: DataFrame) -> DataFrame:
    """Records as compact JSON, and lines as they are; fine: whether a record is JSON."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                text = r["data"].decode("utf-8" if r["utf8"] else "latin-1")
                fine = True
                if r["mode"] == "lines":
                    text = (text.splitlines() or [""])[0][:MOST_CHARS]
                elif r["total"] == 1 and r["mode"] != "whole" and not text.strip():
                    continue  # an array without elements
                else:
                    try:
                        value = json.loads(text)
                        text = json.dumps(value, separators=(",", ":"), ensure_ascii=False)
                        if any("\ud800" <= x <= "\udfff" for x in text):  # half of a surrogate pair, which only an escape can write
                            text = json.dumps(value, separators=(",", ":"))
                    except (ValueError, RecursionError):
                        fine = False
                        text = ""
                out.append((r["file"], r["no"] + 1, text, not text.strip(), fine))
            types = [pa.string(), pa.int64(), pa.string(), pa.bool_(), pa.bool_()]
            names = ["file", "line_number", "content", "is_blank", "fine"]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*out, strict=True) if out else [[]] * 5, types, strict=True)], names=names)

    return records.select("file", "no", "data", "mode", "utf8", "total").mapInArrow(run, READ)


def _records(cut: DataFrame, how: DataFrame) -> DataFrame:
    placed = cut.select("file", "block", "chunk", "data").join(how, ["file", "block", "chunk"])
    parts = stored(_cut(placed), "json-parts")
    return _read(parts.where("complete")).unionByName(_read(_joined(parts.where("NOT complete"))))


def read_json(spark: SparkSession, path: str, size: int = CHUNK) -> DataFrame:
    """JSON files of any size: the elements of an array, or of the list under events, records, logs or data, or the whole object, as compact JSON in
    order; other files by line. file, line_number, content, is_blank."""
    cut = chunks(spark, path, size)
    state = states(cut)
    fact = stored(facts(cut.select("file", "block", "chunk", "data").join(state, ["file", "block", "chunk"])), "json-facts")
    how = stored(plan(state, fact), "json-plan")
    found = stored(_records(cut, how), "json-records")
    bad = stored(found.where("NOT fine").select("file").distinct(), "json-bad")
    if not bad.isEmpty():
        lines = how.join(bad, "file", "left_semi").withColumn("mode", F.lit("lines"))
        found = found.join(bad, "file", "left_anti").unionByName(_records(cut, lines))
    return found.select("file", "line_number", "content", "is_blank")
