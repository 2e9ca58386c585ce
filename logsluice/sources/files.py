"""Readers of log files into records (file, line_number, content, is_blank), a table of refused files, and writers of results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.store import stored

EXTENSIONS = ("log", "txt", "syslog", "json", "jsonl", "ndjson", "csv")
#: Characters of a line that are kept.
MOST_CHARS = 65_536
#: Where lines end besides CR and LF: at vertical tab, form feed, the separators FS to RS, NEL and the Unicode line and paragraph separators.
RARE_ENDS = "[\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"


def known(path: str = "path") -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^.]*)$", 1)).isin(*EXTENSIONS)


def rejected(spark: SparkSession, path: str) -> DataFrame:
    """Files that the readers leave out: file, bytes, reason."""
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), F.col("length").alias("bytes"))
    reason = F.when(~known("file"), "unknown extension").when(F.col("bytes") == 0, "empty")
    return files.withColumn("reason", reason).where("reason IS NOT NULL")


def listing(spark: SparkSession, path: str) -> DataFrame:
    """Files and what they are: file, bytes, category (the folder that holds it), extension, accepted."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length")
    parts = F.split("path", "/")
    return files.select(F.col("path").alias("file"), F.col("length").alias("bytes"), F.element_at(parts, -2).alias("category"), F.lower(F.regexp_extract("path", r"\.([^.]*)$", 1)).alias("extension"), (known() & (F.col("length") > 0)).alias("accepted"))


def decoded(c: str = "content"):
    """UTF-8 without its mark, or Latin-1 where the bytes are no UTF-8."""
    text = F.when(F.expr(f"is_valid_utf8({c})"), F.decode(F.col(c), "UTF-8")).otherwise(F.decode(F.col(c), "ISO-8859-1"))
    return F.regexp_replace(text, "^\ufeff", "")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Text files line by line, numbered within each file; lines are cut at MOST_CHARS. Spark splits large files, so no task holds one: lines are
    stored as they are read, once, and numbered by their place in a split and the number of lines in the splits before it. A file is Latin-1 if any of
    its bytes are no UTF-8."""
    found = spark.read.text(path)
    meta = [F.col(f"_metadata.{c}").alias(c) for c in ("file_path", "file_block_start")]
    rows = found.select(F.col("value").cast("binary").alias("value"), *meta, F.monotonically_increasing_id().alias("at")).where(known("file_path"))
    rows = stored(rows, "text-lines").withColumn("value", F.col("value").cast("string"))
    more = F.size(F.split("value", RARE_ENDS)) - 1
    splits = rows.groupBy("file_path", "file_block_start").agg(
        F.count("*").alias("n"), F.min("at").alias("first_at"), F.sum(more).alias("more"), F.bool_and(F.expr("is_valid_utf8(value)")).alias("valid"))
    before = W.partitionBy("file_path").orderBy("file_block_start").rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy("file_path")
    splits = splits.select("file_path", "file_block_start", "first_at", F.coalesce(F.sum(F.col("n") + F.col("more")).over(before), F.lit(0)).alias("before"), (F.sum("more").over(whole) > 0).alias("rare"), F.min(F.col("valid").cast("int")).over(whole).alias("valid"))
    rows = rows.join(splits, ["file_path", "file_block_start"])
    text = F.when(F.col("valid") == 1, F.col("value")).otherwise(F.decode(F.col("value").cast("binary"), "ISO-8859-1"))
    rows = rows.withColumn("line_number", F.col("before") + F.col("at") - F.col("first_at") + 1).withColumn("value", F.when(F.col("line_number") == 1, F.regexp_replace(text, "^\ufeff", "")).otherwise(text))
    plain = rows.where("NOT rare").select("file_path", "line_number", "value")
    # files with other line ends: what such lines add to the numbers is summed up within a split
    run = F.coalesce(F.sum(more).over(W.partitionBy("file_path", "file_block_start").orderBy("at").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    odd = rows.where("rare").withColumn("line_number", F.col("line_number") + run).select("file_path", "line_number", F.posexplode(F.split("value", RARE_ENDS)).alias("i", "value"))
    lines = plain.unionByName(odd.select("file_path", (F.col("line_number") + F.col("i")).alias("line_number"), "value"))
    return lines.select(F.col("file_path").alias("file"), F.col("line_number").cast("long").alias("line_number"), F.left("value", F.lit(MOST_CHARS)).alias("content"), (F.trim("value") == "").alias("is_blank"))


def logfmt(df: DataFrame) -> DataFrame:
    """Each row as key=value text: trimmed, empty cells left out, quoted where a value holds a space or an equals sign."""
    cell = lambda c: F.trim(F.col(f"`{c}`").cast("string"))
    shown = lambda c: F.when(cell(c).rlike(r"[\s=]"), F.concat(F.lit('"'), cell(c), F.lit('"'))).otherwise(cell(c))
    return df.select(F.concat_ws(" ", *[F.when(cell(c) != "", F.concat(F.lit(c.strip() + "="), shown(c))) for c in df.columns]).alias("content"))


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV files with a header as logfmt lines."""
    return logfmt(spark.read.option("header", True).csv(path))


def simulated(spark: SparkSession, n: int, start: str = "2026-01-01 00:00:00") -> DataFrame:
    """n made-up sshd and access-log lines, three seconds apart; the same for every call."""
    h = F.pmod(F.xxhash64("id"), F.lit(1_000_003))
    at = F.timestamp_micros(F.unix_micros(F.lit(start).cast("timestamp")) + F.col("id") * 3_000_000)
    ip = F.concat(F.lit("192.0.2."), (h % 250 + 1).cast("string"))
    auth = F.concat(F.date_format(at, "MMM dd HH:mm:ss"), F.lit(" web-1 sshd["), (h % 9000 + 100).cast("string"), F.lit("]: "), F.when(h % 4 == 0, "Accepted").otherwise("Failed"), F.lit(" password for user"), (h % 20).cast("string"), F.lit(" from "), ip, F.lit(" port "), (h % 60000 + 1024).cast("string"), F.lit(" ssh2"))
    web = F.concat(ip, F.lit(" - - ["), F.date_format(at, "dd/MMM/yyyy:HH:mm:ss"), F.lit(' +0000] "GET /p/'), (h % 50).cast("string"), F.lit(' HTTP/1.1" '), (F.lit(200) + 100 * (h % 4)).cast("string"), F.lit(" "), (h % 5000).cast("string"), F.lit(' "-" "agent/1.0"'))
    return spark.range(n).select((F.col("id") + 1).alias("line_number"), F.when(F.col("id") % 2 == 0, auth).otherwise(web).alias("content"))


#: Kinds of sources; only the first two read anything, the others report that they are not set up.
ADAPTERS = {"FILE": True, "SIMULATED": True, "SYSLOG": False, "HTTP": False, "WINDOWS": False, "FIREWALL": False}


def adapter(spark: SparkSession, kind: str, **config) -> DataFrame:
    if not ADAPTERS.get(kind):
        raise ValueError(f"{kind}: NOT_CONFIGURED")
    return simulated(spark, int(config.get("count", 100))) if kind == "SIMULATED" else read_lines(spark, config["path"])


def write_ndjson(documents: DataFrame, path: str, column: str = "document") -> None:
    documents.select(F.col(column).alias("value")).write.text(path)


def write_events(events: DataFrame, path: str) -> None:
    """Appends events as Parquet, one folder per day, so that time filters skip files."""
    events.withColumn("event_date", F.to_date("timestamp")).write.mode("append").partitionBy("event_date").parquet(path)
