"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_path, spread


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables, read by Spark (any store Spark knows)."""
    return spread(spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet"), spark)


def staged(spark: SparkSession, df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet under the shared checkpoint folder and read it
    back: cuts the lineage, survives lost executors, keeps column pruning."""
    path = checkpoint_path(spark, f"llm-{name}-{uuid.uuid4().hex}")
    df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, digest, text): only what is needed, null texts as empty.

    ``digest`` tells apart rows that share a doc_id; rows equal in both are
    repeats of one another and always get the same result.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("digest"), text.alias("text"))


def batch_of(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    """A record batch from Python / numpy columns in schema order."""
    return pa.RecordBatch.from_arrays([c if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c, f.type)
                                       for c, f in zip(columns, schema)], schema=schema)


def pieces(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The batches in slices: what a task makes of a batch at once stays small."""
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)


def text_runs(texts: list[str], most_chars: int = 1 << 20) -> Iterator[list[int]]:
    """Row numbers in runs of about ``most_chars`` characters (a single longer
    text is a run of its own): bounds what a task holds besides its batch."""
    run: list[int] = []
    chars = 0
    for i, t in enumerate(texts):
        if run and chars + len(t) > most_chars:
            yield run
            run, chars = [], 0
        run.append(i)
        chars += len(t)
    if run:
        yield run


class Memo(dict):
    """``memo[x]`` computes ``of(x)`` once. Cleared at ``most`` entries, so
    memory is bounded; results never depend on it."""

    def __init__(self, of, most: int = 1 << 18):
        super().__init__()
        self.of, self.most = of, most

    def __missing__(self, x):
        if len(self) >= self.most:
            self.clear()
        y = self[x] = self.of(x)
        return y


#: bits of a ``Sieve``; its broadcast has this size whatever the table's
SIEVE_BITS = 1 << 26


class Sieve:
    """A Bloom filter of fixed size over long keys: keeps rows away from a
    shuffle that cannot join. It only ever lets too much through, so results
    do not depend on it; on a table of very many keys it lets all through."""

    def __init__(self, spark: SparkSession, keys: DataFrame, *cols: str):
        slots = keys.select(F.explode(F.array(*self.slots(*cols))).alias("s"))
        words = (slots.groupBy(F.shiftright("s", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(s & 63 as int))")).alias("m"))).toArrow()
        bits = np.zeros(SIEVE_BITS >> 6, np.int64)
        bits[words.column("w").to_numpy()] = words.column("m").to_numpy()
        shared = spark.sparkContext.broadcast(bits.view(np.uint64))

        @F.pandas_udf("boolean")
        def has(a: pd.Series, b: pd.Series) -> pd.Series:
            table = shared.value
            hit = np.ones(len(a), bool)
            for s in (a.to_numpy(), b.to_numpy()):
                hit &= (table[s >> 6] >> (s & 63).astype(np.uint64)) & np.uint64(1) == 1
            return pd.Series(hit)

        self.has = has

    @staticmethod
    def slots(*cols: str) -> list[Column]:
        return [F.pmod(F.xxhash64(F.lit(i), *cols), F.lit(SIEVE_BITS)) for i in range(2)]

    def keep(self, df: DataFrame, *cols: str) -> DataFrame:
        return df.where(self.has(*self.slots(*cols)))
