"""Log sources as a Python Data Source: spark.read.format("logs") and spark.readStream.format("logs").

A file is cut into byte ranges, one task each. A line belongs to the range that holds its first byte, and the task of that range reads on to its end,
so no task holds a file and no line is cut or read twice. Filters on the file's name and on offset reach the source with the option pushFilters:
files and ranges that cannot hold a wanted line are not opened. The stream reader's offset says how far each file was read; only lines that are
ended are taken, so that a line which is still being written waits for its end.

Rows: file, block (where the range starts), nth (of the line in its range, from 0), offset (byte at which the line starts; lines that only rare
ends part share it), content, is_utf8, is_blank. Lines end at \\n, \\r\\n and \\r, and within those at the rarer ends that str.splitlines knows. A line is
cut at MOST_CHARS characters. read_logs adds line numbers from one stored pass.

Files are opened with pyarrow's file systems (local, HDFS, S3, GCS), as Python data sources have no access to Spark's own; files.read_lines reads
everything that Spark can reach.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual,
    StringContains, StringEndsWith, StringStartsWith,
)

from ..functions.store import stored
from .files import EXTENSIONS, MOST_CHARS

SCHEMA = "file string, block long, nth long, offset long, content string, is_utf8 boolean, is_blank boolean"
#: Bytes of a range, unless the option rangeBytes says otherwise; bytes read at once past its end; rows of an Arrow batch.
RANGE_BYTES, STEP, BATCH = 16 << 20, 1 << 16, 4096
#: A line's bytes beyond those that MOST_CHARS characters can take are read over, not kept.
MOST_LINE = 4 * MOST_CHARS + 4
ENDS = re.compile(rb"\r\n|\n|\r")
# Kinds of sources and what those that are not set up would need.
KINDS = {
    "FILE": "", "SIMULATED": "", "SYSLOG": "a UDP or TCP listener, or a relay", "HTTP": "an endpoint to pull from and credentials",
    "WINDOWS": "event forwarding, or an agent that exports events", "FIREWALL": "the vendor's interface, or its syslog feed",
}


class Lines(InputPartition):
    """Lines of a file that start in [start, end). until: how far the file may be read (its end, or the last ended line of a stream)."""

    def __init__(self, file: str, start: int, end: int, until: int, origin: int = 0):
        self.file, self.start, self.end, self.until, self.origin = file, start, end, until, origin


def _opened(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if re.match(r"^[a-z][a-z0-9+.-]*:/", path) else (pafs.LocalFileSystem(), path)


def listed(path: str) -> list[tuple[str, int]]:
    """(file, bytes) of the log files at a path (a file, or a folder and its folders), by name; names that start with _ or . are left out."""
    system, where = _opened(path)
    info = system.get_file_info(where)
    found = [info] if info.type == pafs.FileType.File else system.get_file_info(pafs.FileSelector(where, recursive=True))
    head = path[: len(path) - len(where)] if path.endswith(where) else ""
    inner = lambda p: p[len(where) :].lstrip("/").split("/")
    shown = [i for i in found if i.type == pafs.FileType.File and i.size and i.extension.lower() in EXTENSIONS and not any(x[:1] in "_." for x in inner(i.path) if x)]
    return sorted((head + i.path, i.size) for i in shown)


def read_range(p: Lines) -> Iterator[tuple[int, bytes]]:
    """(offset, bytes with their end) of the lines that start in the range; of an overlong line its head."""
    system, where = _opened(p.file)
    with system.open_input_file(where) as f:
        back = 1 if p.start > p.origin else 0
        data = f.read_at(min(p.end + 1, p.until) - (p.start - back), p.start - back)
        base, at = p.start - back, back
        if back and not (data[:1] == b"\n" or (data[:1] == b"\r" and data[1:2] != b"\n")):
            ended = ENDS.search(data, at)  # the range starts within a line, or within \r\n
            if not ended:
                return
            at = ended.end()
        while base + at < p.end:
            ended = ENDS.search(data, at)
            if ended and (ended.end() < len(data) or base + len(data) >= p.until or ended[0] != b"\r"):
                yield base + at, data[at : ended.end()]
                at = ended.end()
                continue
            if base + len(data) >= p.until:  # the file's last line has no end
                if at < len(data):
                    yield base + at, data[at:]
                return
            # the last line goes on behind the range
            start, kept, end = base + at, data[at:], base + len(data)
            while end < p.until:
                more = f.read_at(min(STEP, p.until - end), end)
                seam = len(kept) - 1 if kept[-1:] == b"\r" else len(kept)
                kept, end = kept + more, end + len(more)
                ended = ENDS.search(kept, max(0, seam))
                if ended and (ended.end() < len(kept) or end >= p.until or ended[0] != b"\r"):
                    kept = kept[: ended.end()]
                    break
                if len(kept) > MOST_LINE + STEP:
                    kept = kept[:MOST_LINE] + kept[-1:]
            yield start, kept
            return


def _texts(line: bytes) -> tuple[list[str], bool]:
    try:
        return line.decode().splitlines() or [""], True
    except UnicodeDecodeError:
        return line.decode("latin-1").splitlines() or [""], False


def rows(p: Lines) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    nth = 0

    def batch() -> pa.RecordBatch:
        names = ["file", "block", "nth", "offset", "content", "is_utf8", "is_blank"]
        types = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.bool_()]
        out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names=names)
        held.clear()
        return out

    for offset, line in read_range(p):
        if offset == 0 and line.startswith(b"\xef\xbb\xbf"):
            line = line[3:]
        texts, fine = _texts(line)
        for text in texts:
            held.append((p.file, p.start, nth, offset, text[:MOST_CHARS], fine, not text.strip()))
            nth += 1
        if len(held) >= BATCH:
            yield batch()
    if held:
        yield batch()


def _cut(file: str, start: int, end: int, size: int) -> list[Lines]:
    return [Lines(file, a, min(a + size, end), end, start) for a in range(start, end, size)]


class LogReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.size = options["path"], int(options["rangeBytes"])

    def wanted(self, file: str) -> bool:
        return True

    def overlaps(self, p: Lines) -> bool:
        return True

    def partitions(self) -> list[InputPartition]:
        cut = [p for file, size in listed(self.path) if self.wanted(file) for p in _cut(file, 0, size, self.size)]
        return [p for p in cut if self.overlaps(p)] or [Lines("", 0, 0, 0)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        return rows(partition) if partition.file else iter(())


class PrunedReader(LogReader):
    """Takes filters over. Spark 4.1 keeps the filters of one query for later ones over the same frame, so that each query needs a frame of its
    own from load(); hence the option."""

    def __init__(self, options: dict):
        super().__init__(options)
        self.tests: list = []
        self.low, self.high = 0, None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            name, value = ".".join(getattr(f, "attribute", ())), getattr(f, "value", None)
            if name == "file" and isinstance(f, (EqualTo, In, StringStartsWith, StringEndsWith, StringContains)):
                self.tests.append(f)
                continue
            if name == "offset" and isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                self.low = max(self.low, int(value))
            if name == "offset" and isinstance(f, (LessThan, LessThanOrEqual)):
                top = int(value) + isinstance(f, LessThanOrEqual)
                self.high = top if self.high is None else min(self.high, top)
            yield f  # a range holds lines on either side of an offset: Spark filters those

    def wanted(self, file: str) -> bool:
        def one(f: Filter) -> bool:
            if isinstance(f, EqualTo):
                return file == f.value
            if isinstance(f, In):
                return file in f.value
            if isinstance(f, StringStartsWith):
                return file.startswith(f.value)
            return file.endswith(f.value) if isinstance(f, StringEndsWith) else f.value in file

        return all(one(f) for f in self.tests)

    def overlaps(self, p: Lines) -> bool:
        return p.end > self.low and (self.high is None or p.start < self.high)


class LogStreamReader(DataSourceStreamReader):
    """Offsets are {file: bytes read}. A batch is what was added to the files, up to the last ended line of each."""

    def __init__(self, options: dict):
        self.path, self.size = options["path"], int(options["rangeBytes"])
        self.seen: dict[str, int] = {}

    def initialOffset(self) -> dict:
        return {"files": "{}"}

    def _ended(self, file: str, size: int, known: int) -> int:
        """Where the last ended line of the file ends."""
        if size <= known:
            return known
        system, where = _opened(file)
        with system.open_input_file(where) as f:
            end = size
            while end > known:
                start = max(known, end - STEP)
                at = f.read_at(end - start, start).rfind(b"\n")
                if at >= 0:
                    return start + at + 1
                end = start
        return known

    def latestOffset(self) -> dict:
        self.seen = {file: self._ended(file, size, self.seen.get(file, 0)) for file, size in listed(self.path)}
        return {"files": json.dumps(self.seen, sort_keys=True)}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        old, new = json.loads(start["files"]), json.loads(end["files"])
        return [p for file in sorted(new) for p in _cut(file, old.get(file, 0), new[file], self.size)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        return rows(partition)

    def commit(self, end: dict) -> None:
        pass


class LogSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "logs"

    def schema(self) -> str:
        return SCHEMA

    def _checked(self) -> dict:
        kind = str(self.options.get("kind", "FILE")).upper()
        if kind != "FILE":
            needs = KINDS.get(kind)
            raise ValueError(f"{kind}: " + ("unknown kind of source" if needs is None else f"NOT_CONFIGURED: it needs {needs or 'files.simulated'}"))
        if "path" not in self.options:
            raise ValueError("FILE: a path is needed")
        return {"path": self.options["path"], "rangeBytes": self.options.get("rangeBytes", str(RANGE_BYTES))}

    def reader(self, schema) -> DataSourceReader:
        pushed = str(self.options.get("pushFilters", "false")).lower() == "true"
        return (PrunedReader if pushed else LogReader)(self._checked())

    def streamReader(self, schema) -> DataSourceStreamReader:
        return LogStreamReader(self._checked())


def register(spark: SparkSession) -> None:
    """Makes the format "logs" known to the session, and lets Spark hand filters to Python sources."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(LogSource)


def kinds(spark: SparkSession) -> DataFrame:
    """The kinds of sources: kind, status, requires."""
    return spark.createDataFrame([(k, "NOT_CONFIGURED" if v else "READY", v) for k, v in KINDS.items()], "kind string, status string, requires string")


def numbered(lines: DataFrame) -> DataFrame:
    """Rows of the source, as files.read_lines gives them: file, line_number, content, is_blank. A line's number is its place in its range and the
    number of lines in the file's ranges before it, which are counted from the rows once they are stored. In a file that is not UTF-8
    throughout, every line is Latin-1."""
    lines = stored(lines, "log-lines")
    ranges = lines.groupBy("file", "block").agg(F.count("*").alias("n"), F.min(F.col("is_utf8").cast("int")).alias("fine"))
    before = W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    ranges = ranges.select("file", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"), F.min("fine").over(W.partitionBy("file")).alias("fine"))
    text = F.when((F.col("fine") == 0) & F.col("is_utf8"), F.decode(F.encode("content", "UTF-8"), "ISO-8859-1")).otherwise(F.col("content"))
    out = lines.join(ranges, ["file", "block"])
    return out.select("file", (F.col("before") + F.col("nth") + 1).alias("line_number"), F.left(text, F.lit(MOST_CHARS)).alias("content"), "is_blank")


def read_logs(spark: SparkSession, path: str, **options) -> DataFrame:
    """The lines of log files with their numbers, read by the "logs" source."""
    register(spark)
    return numbered(spark.read.format("logs").options(**options).load(path))
