"""A keyed Parquet table with versions: rows are dealt to buckets by key hash,
an update rewrites only the buckets it touches, and a manifest goes in last.

    <root>/rows/<batch>/_bucket=<b>/*.parquet   rows; never changed once written
    <root>/versions/<n>/*.json                  one file: a line for each bucket

Version n's manifest says where every bucket's rows lie; untouched buckets keep
the folder of an earlier batch. Spark moves a finished manifest into its place
as one file, so a reader sees a version whole or not at all, and a run that
ends before that has changed nothing (its rows are never looked at, and its
unfinished version is made anew by the next writer). There is no lock, one
writer works at a time; one that finds its next version taken fails instead of
hiding the other's rows. Readers go on with the version they began with.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.subsets import upsert

MANIFEST = "version long, bucket int, batch string, about string"


@dataclass(frozen=True)
class KeyedTable:
    """One version of the table at ``root``: what a reader or a writer holds."""

    spark: SparkSession
    root: str
    version: int
    keys: tuple[str, ...]
    buckets: int
    schema: StructType
    places: dict[int, str]  # bucket -> batch that wrote it; at most ``buckets`` entries

    @classmethod
    def create(cls, spark: SparkSession, root: str, schema: StructType, keys: list[str], buckets: int = 64) -> "KeyedTable":
        """A new, empty table. ``buckets`` bounds what an update of one key
        rewrites; it is fixed for the table."""
        table = cls(spark, root.rstrip("/"), -1, tuple(keys), buckets, schema, {})
        return table._commit({})

    @classmethod
    def open(cls, spark: SparkSession, root: str, version: int | None = None) -> "KeyedTable":
        """The newest version, or the one asked for."""
        root = root.rstrip("/")
        lines = spark.read.schema(MANIFEST).json(f"{root}/versions/*")
        if version is None:
            version = lines.agg(F.max("version")).first()[0]
        rows = lines.where(F.col("version") == F.lit(version)).collect()  # a row a bucket
        if not rows:
            raise ValueError(f"no version {version} at {root}")
        about = json.loads(next(r["about"] for r in rows if r["bucket"] == -1))
        places = {r["bucket"]: r["batch"] for r in rows if r["bucket"] >= 0}
        return cls(spark, root, version, tuple(about["keys"]), about["buckets"], StructType.fromJson(about["schema"]), places)

    def bucket_of(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def read(self, buckets: list[int] | None = None) -> DataFrame:
        """All rows of this version, or those of some buckets."""
        wanted = sorted(self.places if buckets is None else set(buckets) & set(self.places))
        if not wanted:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*(f"{self.root}/rows/{self.places[b]}/_bucket={b}" for b in wanted))

    def upsert(self, rows: DataFrame, order_col: str) -> "KeyedTable":
        """Insert or replace: of the rows of a key, old ones included, the one
        with the largest ``order_col`` stays (ties: the largest values)."""
        return self._write(rows, lambda old, new: upsert(old, new, list(self.keys), order_col))

    def insert_new(self, rows: DataFrame, order_col: str) -> "KeyedTable":
        """Insert or ignore: a key that is there keeps its row; of a new key's
        rows the one with the smallest ``order_col`` comes in."""
        def merge(old: DataFrame, new: DataFrame) -> DataFrame:
            values = [c for c in self.schema.names if c not in self.keys]
            tagged = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
            first = F.min_by(F.struct(*values), F.struct("_new", order_col, *values)).alias("_v")
            return tagged.groupBy(*self.keys).agg(first).select(*self.keys, *(F.col(f"_v.{c}").alias(c) for c in values))
        return self._write(rows, merge)

    def delete(self, keys: DataFrame) -> "KeyedTable":
        """Remove the rows of the given keys (null keys match null keys)."""
        def merge(old: DataFrame, gone: DataFrame) -> DataFrame:
            tagged = old.withColumn("_gone", F.lit(0)).unionByName(gone.select(*self.keys).withColumn("_gone", F.lit(1)), allowMissingColumns=True)
            values = [c for c in self.schema.names if c not in self.keys]
            kept = tagged.groupBy(*self.keys).agg(F.max("_gone").alias("_g"), F.max(F.struct(*values)).alias("_v")).where("_g = 0")
            return kept.select(*self.keys, *(F.col(f"_v.{c}").alias(c) for c in values))
        return self._write(keys.select(*self.keys), merge)

    def _write(self, rows: DataFrame, merge) -> "KeyedTable":
        touched = sorted(r[0] for r in rows.select(self.bucket_of().alias("b")).distinct().collect())  # at most ``buckets``
        if not touched:
            return self
        batch = f"{self.version + 1:012d}-{uuid.uuid4().hex}"
        merged = merge(self.read(touched), rows).select(*self.schema.names).withColumn("_bucket", self.bucket_of())
        # a task for each bucket, and more for one that is large: AQE splits what it rebalances
        merged.hint("rebalance", "_bucket").write.partitionBy("_bucket").parquet(f"{self.root}/rows/{batch}")
        filled = {r[0] for r in self.spark.read.parquet(f"{self.root}/rows/{batch}").select("_bucket").distinct().collect()} if self._any(batch) else set()
        places = {b: p for b, p in self.places.items() if b not in set(touched)} | {b: batch for b in touched if b in filled}
        return self._commit(places)

    def _any(self, batch: str) -> bool:
        """Whether the batch holds rows (a delete may leave none)."""
        return bool(self.spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true")
                    .load(f"{self.root}/rows/{batch}").select("path").take(1))

    def _commit(self, places: dict[int, str]) -> "KeyedTable":
        version = self.version + 1
        about = json.dumps({"keys": list(self.keys), "buckets": self.buckets, "schema": json.loads(self.schema.json())})
        lines = [(version, -1, None, about)] + [(version, b, p, None) for b, p in sorted(places.items())]
        manifest = self.spark.createDataFrame(lines, MANIFEST).coalesce(1)
        if version and not self.spark.read.schema(MANIFEST).json(f"{self.root}/versions/*").where(F.col("version") >= version).isEmpty():
            raise RuntimeError(f"version {version} of {self.root} was written by another run")
        manifest.write.mode("overwrite" if version else "errorifexists").json(f"{self.root}/versions/{version:012d}")
        return KeyedTable(self.spark, self.root, version, self.keys, self.buckets, self.schema, places)
