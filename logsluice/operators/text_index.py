"""Free-text search over a written event table without reading all of it.

Rows are laid out in time in blocks of BLOCK_ROWS rows, in shelves (folders) of a range of time each. The postings say which three-character sequences
occur in the text columns of which block. A search intersects the postings of its text's sequences, reads the shelves and blocks that are left, and
applies the search itself to their rows, so that its result is that of query.search. Texts of fewer than three characters are searched in all rows.
"""

from __future__ import annotations

import dataclasses

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.store import stored
from . import query as Q

#: Rows of a block, the characters of a sequence.
BLOCK_ROWS, GRAM = 256, 3
#: Shelves up to which a search names them, so that Spark opens no other folder; beyond, blocks are joined.
MOST_SHELVES = 5000


def _grams(text: Column) -> Column:
    starts = F.when(F.length(text) >= GRAM, F.sequence(F.lit(1), F.length(text) - (GRAM - 1))).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(starts, lambda i: F.substring(text, i, F.lit(GRAM))))


def write(events: DataFrame, path: str, shelves: int = 64, time: str = "timestamp") -> None:
    """Writes the rows and the postings of an event table into a new folder."""
    by = [F.col(time).asc_nulls_last(), *([F.col("event_id")] if "event_id" in events.columns else [])]
    rows = events.repartitionByRange(shelves, *by).sortWithinPartitions(*by).withColumn("at", F.monotonically_increasing_id())
    rows = rows.withColumn("shelf", F.shiftright("at", 33).cast("int")).withColumn("block", F.floor(F.col("at").bitwiseAND((1 << 33) - 1) / BLOCK_ROWS).cast("int")).drop("at")
    rows.write.partitionBy("shelf").parquet(f"{path}/rows")
    columns = [c for c in Q.TEXT_COLUMNS if c in events.columns]
    kept = events.sparkSession.read.parquet(f"{path}/rows").select("shelf", "block", *columns)
    # a sequence never spans two columns
    found = F.array_distinct(F.flatten(F.array(*[_grams(F.coalesce(F.lower(F.col(c)), F.lit(""))) for c in columns])))
    postings = kept.select("shelf", "block", F.explode(found).alias("gram")).distinct()
    postings.repartitionByRange(shelves, "gram").sortWithinPartitions("gram", "shelf", "block").write.parquet(f"{path}/postings")


def rows(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/rows")


def blocks(spark: SparkSession, path: str, text: str) -> DataFrame:
    """(shelf, block) of the blocks that hold all sequences of a text of at least GRAM characters."""
    low = text.lower()
    grams = sorted({low[i : i + GRAM] for i in range(len(low) - GRAM + 1)})
    found = spark.read.parquet(f"{path}/postings").where(F.col("gram").isin(*grams))
    return found.groupBy("shelf", "block").agg(F.count("*").alias("n")).where(F.col("n") == len(grams)).select("shelf", "block")


def candidates(spark: SparkSession, path: str, text: str) -> DataFrame:
    """The rows of the blocks that may hold a text."""
    every = rows(spark, path)
    if len(text.lower()) < GRAM:
        return every
    left = stored(blocks(spark, path, text), "text-blocks")
    shelves = [r["shelf"] for r in left.select("shelf").distinct().limit(MOST_SHELVES + 1).collect()]
    if len(shelves) <= MOST_SHELVES:
        every = every.where(F.col("shelf").isin(*shelves)) if shelves else every.where("false")
    return every.join(left, ["shelf", "block"], "left_semi")


def search(spark: SparkSession, path: str, q: Q.EventQuery) -> DataFrame:
    """query.search over a written table: all conditions, by the index where there is a text."""
    found = candidates(spark, path, q.text) if q.text else rows(spark, path)
    return Q.search(found.drop("shelf", "block"), q)


def scanned(spark: SparkSession, path: str, q: Q.EventQuery) -> tuple[int, int]:
    """Rows that a search looks at, and rows of the table."""
    return candidates(spark, path, dataclasses.replace(q).text or "").count(), rows(spark, path).count()
