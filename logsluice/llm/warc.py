"""WARC archives as seekable Zstandard bundles.

Each page becomes a WARC 1.1 record. Records with equal payloads are found by their SHA-1: the one with the
largest id is a response, the others are revisits of it and carry no payload. A task writes its records into
bundles; within a bundle, records are grouped into frames that decompress independently, and a footer in a
skippable frame (the public seekable format) lists the frames' sizes. The index maps each record to its bundle,
frame, and offset and length within the decompressed frame, so one record is read by one seek.

Defined results: a null payload is empty; a null id is never the largest, and rows without id are responses
only where no row of their payload has one; rows that repeat the largest id are all responses; payloads shorter
than min_bytes are all responses; a null url has no target header; an empty table writes no bundle and gives an empty
result; other columns are ignored. A record larger than a frame is a frame of its own; a task holds one frame.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, new_path, small_batches
from .files import Written, open_input

FRAME_BYTES = 256 << 10
BUNDLE_BYTES = 64 << 20
TASK_BYTES = 64 << 20
LEVEL = 3

# Fixed values of the seekable format: magic numbers of a skippable frame and of its footer.
SKIPPABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1

INDEX = "page_id long, bundle string, frame int, offset long, length long"
RECORD = "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id, url, payload, size, sha1: bytes, kind: str, refers_to, date: str) -> bytes:
    """One WARC record; a revisit's block is the response's HTTP header alone."""
    name = "none" if page_id is None else page_id
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + (payload or b"")
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:page:{name}>",
        f"WARC-Date: {date}",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(sha1).decode()}",
    ]
    if url is not None:
        head.append("WARC-Target-URI: " + quote(url, safe=":/?#[]@!$&'()*+,;=%~-._"))
    if kind == "revisit":
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        head.append(f"WARC-Refers-To: <urn:page:{'none' if refers_to is None else refers_to}>")
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes, at: int) -> tuple[dict, int]:
    """The record that starts at `at`, and where the next one starts."""
    end = data.index(b"\r\n\r\n", at)
    lines = data[at:end].decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"no WARC record at {at}")
    head = dict(x.split(": ", 1) for x in lines[1:])
    block = data[end + 4 : end + 4 + int(head["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(next(x for x in http.split(b"\r\n") if x.startswith(b"Content-Length: "))[16:])
    kind = head["WARC-Type"]
    sha1 = head["WARC-Payload-Digest"].removeprefix("sha1:")
    if kind == "response" and (len(payload) != size or digest(payload) != sha1):
        raise ValueError(f"payload of {head['WARC-Record-ID']} is damaged")
    ident = lambda name: None if name in (None, "<urn:page:none>") else int(name[10:-1])
    found = {
        "page_id": ident(head["WARC-Record-ID"]), "url": head.get("WARC-Target-URI"), "payload": payload if kind == "response" else None,
        "payload_bytes": size, "payload_digest": sha1, "record_type": kind, "refers_to": ident(head.get("WARC-Refers-To")),
    }
    return found, end + 4 + len(block) + 4


def seek_table(frames: list[tuple[int, int]]) -> bytes:
    body = b"".join(struct.pack("<II", c, d) for c, d in frames) + struct.pack("<IBI", len(frames), 0, SEEKABLE_MAGIC)
    return struct.pack("<II", SKIPPABLE_MAGIC, len(body)) + body


def read_seek_table(file) -> list[tuple[int, int, int]]:
    """(offset, compressed size, decompressed size) of each frame of an open bundle."""
    size = file.size()
    file.seek(size - 9)
    n, _, magic = struct.unpack("<IBI", file.read(9))
    if magic != SEEKABLE_MAGIC:
        raise ValueError("no seek table")
    file.seek(size - 9 - 8 * n)
    sizes = struct.unpack(f"<{2 * n}I", file.read(8 * n))
    found, at = [], 0
    for c, d in zip(sizes[::2], sizes[1::2], strict=True):
        found.append((at, c, d))
        at += c
    return found


class Frames:
    """Reads frames, keeping the last bundle open."""

    def __init__(self):
        self._uri, self._file, self._table = None, None, []

    def read(self, uri: str, frame: int) -> bytes:
        if uri != self._uri:
            if self._file:
                self._file.close()
            self._file, self._uri = open_input(uri), uri
            self._table = read_seek_table(self._file)
        at, packed, size = self._table[frame]
        self._file.seek(at)
        return zstandard.ZstdDecompressor().decompress(self._file.read(packed), max_output_size=size)


def revisits(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """pages (page_id, url, html) as records to write: a revisit's payload is null."""
    rows = small_batches(pages).select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload")
    ).withColumn("sha1", F.sha1("payload"))
    largest = rows.groupBy("sha1").agg(F.max("page_id").alias("largest")).select(F.unhex("sha1").alias("d"), "largest")
    found = rows.withColumn("d", F.unhex("sha1")).join(largest, "d")
    size = F.octet_length("payload").cast("long")
    response = (size < min_bytes) | F.col("page_id").eqNullSafe(F.col("largest"))
    return found.select(
        "page_id",
        "url",
        F.when(response, F.col("payload")).alias("payload"),
        size.alias("size"),
        F.col("d").alias("sha1"),
        F.when(response, F.lit("response")).otherwise(F.lit("revisit")).alias("kind"),
        F.when(~response, F.col("largest")).alias("refers_to"),
    )


def write_archive(pages: DataFrame, folder: str, min_bytes: int = 0, date: str = "1970-01-01T00:00:00Z", frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES) -> DataFrame:
    """Write a record per page into bundles below folder; the index of all records, already stored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stem = f"part-{TaskContext.get().partitionId():06d}"
        zstd = zstandard.ZstdCompressor(level=LEVEL)
        bundle, frames, held, size, rows = None, [], [], 0, []

        def end_frame():
            nonlocal bundle, held, size
            if bundle is None:
                bundle = Written(folder, stem, ".warc.zst")
            raw = b"".join(held)
            bundle.write(packed := zstd.compress(raw))
            frames.append((len(packed), len(raw)))
            held, size = [], 0

        def end_bundle():
            nonlocal bundle, frames, rows
            bundle.write(seek_table(frames))
            bundle.close()
            cols = list(zip(*rows, strict=True))
            out = [cols[0], [bundle.uri] * len(rows), *cols[1:]]
            types = [pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64()]
            names = ["page_id", "bundle", "frame", "offset", "length"]
            bundle, frames, rows = None, [], []
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names=names)

        for batch in batches:
            for r in batch.to_pylist():
                raw = record(r["page_id"], r["url"], r["payload"], r["size"], r["sha1"], r["kind"], r["refers_to"], date)
                if held and size + len(raw) > frame_bytes:
                    end_frame()
                    if bundle.size >= bundle_bytes:
                        yield end_bundle()
                rows.append((r["page_id"], len(frames), size, len(raw)))
                held.append(raw)
                size += len(raw)
        if held:
            end_frame()
        if bundle is not None:
            yield end_bundle()

    return materialize(revisits(pages, min_bytes).mapInArrow(run, INDEX), "warc-index")


def _records(rows: list[dict]) -> pa.RecordBatch:
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])
    return pa.RecordBatch.from_pylist(rows, schema=schema)


def read_archive(index: DataFrame) -> DataFrame:
    """All records of the bundles that index names, read frame by frame."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frames = Frames()
        for batch in batches:
            for r in sorted(batch.to_pylist(), key=lambda r: (r["bundle"], r["frame"])):
                data, at, rows = frames.read(r["bundle"], r["frame"]), 0, []
                while at < len(data):
                    found, at = parse(data, at)
                    rows.append(found)
                yield _records(rows)

    # the rows to deal out are tiny but each stands for a frame: their number of tasks follows the records' bytes
    tasks = max(8, -(-(index.agg(F.sum("length")).first()[0] or 0) // TASK_BYTES))
    return index.select("bundle", "frame").distinct().repartition(tasks, "bundle", "frame").mapInArrow(run, RECORD)


def fetch(index: DataFrame) -> DataFrame:
    """The records of these index rows alone, by frame and offset."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frames = Frames()
        for batch in batches:
            for r in sorted(batch.to_pylist(), key=lambda r: (r["bundle"], r["frame"], r["offset"])):
                yield _records([parse(frames.read(r["bundle"], r["frame"]), r["offset"])[0]])

    return index.mapInArrow(run, RECORD)


def archive_round_trip(pages: DataFrame) -> DataFrame:
    """Write pages into the shared folder and read every record back."""
    index = write_archive(pages, new_path(pages.sparkSession, "warc"))
    return read_archive(index)
