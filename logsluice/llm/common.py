"""Helpers that the training-data operators share: tables in the shared folder, schemas, files."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Java regular expression of the separators between words, and of a word.
SEPARATORS = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
#: Estimates beyond this are none: Spark gives such where it knows nothing.
UNKNOWN_BYTES = 1 << 57
#: Bytes of an Arrow batch that goes to Python; a batch holds at least one row.
BATCH_BYTES = "16m"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a local master (tests on one machine)
    gets a new temporary folder for the rest of the session; a cluster gets an error, as its machines share no such folder."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="logsluice-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def small_batches(df: DataFrame, rows: int = 2000) -> DataFrame:
    """df, after making sure that Arrow hands its rows to Python in batches of no more than `rows`, and of BATCH_BYTES: texts can be long."""
    conf = df.sparkSession.conf
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(name)) <= rows:
        conf.set(name, str(rows))
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if conf.get(name) == "67108864b":  # as Spark sets it; any other value is the user's
        conf.set(name, BATCH_BYTES)
    return df


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it again: the lineage ends there, so a lost
    executor costs no recomputation of what came before."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(df: DataFrame) -> None:
    """Give back the space of a table that materialize stored and nothing reads any more: it is written over with no rows."""
    for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
        df.sparkSession.range(0).coalesce(1).write.mode("overwrite").parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def text_of(column: str = "text") -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(column), F.lit(""))


def scan_bytes(df: DataFrame) -> int:
    """The optimizer's estimate of the bytes that df reads; it only sets how finely work is dealt out."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def pieces(df: DataFrame, bytes_each: int, least: int = 8) -> int:
    """How many parts of about bytes_each the input of df makes. Where Spark has no estimate (rows of the driver, products of
    joins), strings and binaries are measured."""
    size = scan_bytes(df)
    if size > UNKNOWN_BYTES:
        long = [F.coalesce(F.octet_length(f"`{f.name}`"), F.lit(0)) for f in df.schema if f.dataType.simpleString() in ("string", "binary")]
        size = df.agg(F.sum(sum(long, F.lit(8 * len(df.columns))).cast("long"))).first()[0] or 0
    return max(least, -(-size // bytes_each))


def row_key(text: str = "text") -> Column:
    """A 64-bit digest that tells the texts of rows with one id apart; a null text differs from an empty one."""
    return F.xxhash64(F.col(text))


def chosen_rows(docs: DataFrame, key: Column, digest: Column, kept: DataFrame) -> DataFrame:
    """The rows of docs whose key and digest are in kept (id, digest), and of rows equal in both the least by all columns in
    order (by those that have an order). Equal rows are folded before the shuffle, which the join then reuses."""
    ordered = [f.name for f in docs.schema if not any(x in f.dataType.simpleString() for x in ("map<", "variant"))]
    rest = [c for c in docs.columns if c not in ordered]
    columns = [f"`{c}`" for c in (*ordered, *rest)]
    named = lambda c: (c.isNull().alias("__none"), F.coalesce(c.cast("string"), F.lit("")).alias("__id"))
    rows = docs.select(*named(key), digest.alias("__digest"), F.struct(*columns).alias("__row"))
    least = F.min_by("__row", F.struct(*[f"__row.`{c}`" for c in ordered])) if rest else F.min("__row")
    each = rows.groupBy("__none", "__id", "__digest").agg(least.alias("__row"))
    kept = kept.select(*named(F.col("id")), F.col("digest").alias("__digest"))
    return each.join(kept, ["__none", "__id", "__digest"], "left_semi").select("__row.*").select(*[f"`{c}`" for c in docs.columns])
