"""Cutting lineage in the folder that driver and executors share, and what needs it."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where that is unset, a local master (tests on one machine) gets a temporary folder for the rest of the
    session; a cluster gets an error, as its machines share no such folder."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="logsluice-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """df from a reliable checkpoint: computed once, and no lost executor brings back what came before."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


def stored(df: DataFrame, name: str) -> DataFrame:
    """df as Parquet in the shared folder: as cut, but later reads take only the columns that they need."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def settled(df: DataFrame) -> DataFrame:
    """df behind a one-row-per-row generator: what is computed below is computed once per row. Without it the optimizer
    pushes later filters down through the projections, and each step copies the expressions of the one before."""
    return df.select(F.explode(F.array(F.struct(*df.columns))).alias("row")).select("row.*")


def ranked(df: DataFrame, by: str, name: str = "nth") -> DataFrame:
    """df with each row's place (from 1) in the order of `by`, whose values are distinct. Rows are sorted in ranges, and one number per range is
    summed up over the ranges, so no task sees all rows."""
    placed = stored(df.repartitionByRange(by).sortWithinPartitions(by).withColumn("__at", F.monotonically_increasing_id()), "ranked")
    part: Column = F.shiftright("__at", 33)
    ranges = placed.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # one row per range
    ranges = ranges.select("__part", before.alias("__before"))
    found = placed.withColumn("__part", part).join(F.broadcast(ranges), "__part")
    return found.withColumn(name, F.col("__before") + F.col("__at").bitwiseAND((1 << 33) - 1) + 1).drop("__at", "__part", "__before")
