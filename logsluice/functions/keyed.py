"""Keyed tables: rows by a key, in hash buckets of which an upsert rewrites only those that it touches.

A table is a folder. data/<generation>/bucket=<n> holds the rows of a bucket as some upsert wrote them; manifest/v=<n> is one row that names the
valid generation of each bucket, the schema, and the last batch of each writer. An upsert writes the touched buckets as a new generation and
then the manifest, which is one file and appears at once by Spark's commit: until then, and if the run is lost, the table is as it was. A batch that was
taken already (by its writer's number) changes nothing, so a run can be repeated. One writer works on a table at a time.

Defined results: keys are unique in the table; a batch with repeated or null keys is refused; columns that a batch lacks stay as they are (null for new keys),
columns that it adds are null in older rows; an empty batch changes no row; a table without batches has no rows.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .store import stored

#: How a column of a known key changes: to the batch's value, not at all, or to the least, largest or added value.
CHANGES = ("new", "old", "min", "max", "sum")
MANIFEST = "version long, schema string, places array<struct<bucket:int,generation:string>>, batches map<string,long>"


class KeyedTable:
    def __init__(self, spark: SparkSession, path: str, key: str | Iterable[str], buckets: int = 64):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets
        self.key = [key] if isinstance(key, str) else list(key)

    def manifest(self):
        """The newest manifest, or None."""
        try:
            rows = self.spark.read.parquet(f"{self.path}/manifest")
        except AnalysisException as e:
            if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                return None
            raise
        newest = rows.agg(F.max("v")).first()[0]  # v is the folder's name: no file is read
        return None if newest is None else rows.where(F.col("v") == newest).first()

    def bucket_of(self) -> Column:
        return F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int")

    def _rows(self, manifest, buckets: set[int] | None = None) -> DataFrame:
        paths = [f"{self.path}/data/{p['generation']}/bucket={p['bucket']}" for p in manifest["places"] if buckets is None or p["bucket"] in buckets]
        schema = StructType.fromJson(json.loads(manifest["schema"]))
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def read(self) -> DataFrame:
        manifest = self.manifest()
        if manifest is None:
            raise ValueError(f"{self.path} has no rows yet: its columns are not known")
        return self._rows(manifest)

    def exists(self) -> bool:
        return self.manifest() is not None

    def get(self, *values) -> DataFrame:
        """The row of a key: one bucket is read."""
        wanted = self.spark.range(1).select(*[F.lit(v).alias(k) for k, v in zip(self.key, values, strict=True)])
        manifest = self.manifest()
        if manifest is None:
            raise ValueError(f"{self.path} has no rows yet: its columns are not known")
        types = {f.name: f.dataType for f in StructType.fromJson(json.loads(manifest["schema"]))}
        bucket = wanted.select(*[F.col(k).cast(types[k]) for k in self.key]).select(self.bucket_of()).first()[0]
        found = self._rows(manifest, {bucket})
        for k, v in zip(self.key, values, strict=True):
            found = found.where(F.col(k) == F.lit(v))
        return found

    def upsert(self, batch: DataFrame, writer: str, number: int, changes: dict[str, str] | None = None) -> bool:
        """Takes a batch of a writer; False if it (or a later one) was taken before. changes: by column, one of CHANGES ("new" if not named)."""
        changes = changes or {}
        if bad := {c for c in changes.values() if c not in CHANGES}:
            raise ValueError(f"unknown change {sorted(bad)}")
        old = self.manifest()
        if old is not None and old["batches"].get(writer, -1) >= number:
            return False
        batch = stored(batch, "batch")
        keyed = batch.select(*self.key)
        n, distinct, empty = keyed.agg(F.count("*"), F.count_distinct(F.struct(*self.key)), F.count_if(F.greatest(*[F.col(k).isNull() for k in self.key], F.lit(False)))).first()
        if distinct != n or empty:
            raise ValueError(f"a batch needs one row per key: {n} rows, {distinct} keys, {empty} rows without a key")
        touched = {r[0] for r in batch.select(self.bucket_of()).distinct().collect()}
        rows, schema = self._merged(batch, old, touched, changes)
        generation = f"g-{uuid.uuid4().hex}"
        if touched:
            rows.withColumn("bucket", self.bucket_of()).repartition("bucket").sortWithinPartitions("bucket", *self.key).write.partitionBy("bucket").parquet(f"{self.path}/data/{generation}")
        places = {p["bucket"]: p["generation"] for p in (old["places"] if old else [])} | dict.fromkeys(touched, generation)
        self._commit(0 if old is None else old["version"] + 1, schema, places, {**(old["batches"] if old else {}), writer: number})
        return True

    def _merged(self, batch: DataFrame, old, touched: set[int], changes: dict[str, str]) -> tuple[DataFrame, StructType]:
        if old is None:
            return batch, batch.schema
        known = self._rows(old, touched)
        columns = [*known.columns, *[c for c in batch.columns if c not in known.columns]]
        a = known.select(*self.key, *[F.col(f"`{c}`").alias(f"a_{c}") for c in known.columns if c not in self.key], F.lit(True).alias("in_a"))
        b = batch.select(*self.key, *[F.col(f"`{c}`").alias(f"b_{c}") for c in batch.columns if c not in self.key], F.lit(True).alias("in_b"))

        def value(c: str) -> Column:
            if c not in known.columns:
                return F.col(f"b_{c}")
            if c not in batch.columns:
                return F.col(f"a_{c}")
            x, y = F.col(f"a_{c}"), F.col(f"b_{c}")
            both = {"new": y, "old": x, "min": F.least(x, y), "max": F.greatest(x, y), "sum": F.coalesce(x + y, x, y)}[changes.get(c, "new")]
            return F.when(F.col("in_b").isNull(), x).when(F.col("in_a").isNull(), y).otherwise(both)

        rows = a.join(b, self.key, "full_outer").select(*[F.col(c) if c in self.key else value(c).alias(c) for c in columns])
        types = {f.name: f for f in [*batch.schema, *known.schema]}
        return rows.select(*[F.col(c).cast(types[c].dataType).alias(c) for c in columns]), StructType([types[c] for c in columns])

    def _commit(self, version: int, schema: StructType, places: dict[int, str], batches: dict[str, int]) -> None:
        row = (version, schema.json(), sorted(places.items()), batches)
        self.spark.createDataFrame([row], MANIFEST).coalesce(1).write.parquet(f"{self.path}/manifest/v={version}")

    def superseded(self) -> DataFrame:
        """Folders that no manifest needs any more (bucket, path): for whoever sweeps the store, once no reader of an older manifest is left."""
        valid = {(p["bucket"], p["generation"]) for p in self.manifest()["places"]}
        found = self.spark.read.parquet(f"{self.path}/manifest").select(F.explode("places").alias("p")).select("p.*").distinct().collect()
        gone = [(r["bucket"], f"{self.path}/data/{r['generation']}/bucket={r['bucket']}") for r in found if (r["bucket"], r["generation"]) not in valid]
        return self.spark.createDataFrame(gone, "bucket int, path string")
