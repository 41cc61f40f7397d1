"""Durable scoring: pending rows as a stream, a commit for each micro-batch.

The pending rows are written once in files of about ``rows_per_batch`` rows;
the stream takes ``files_per_batch`` of them a micro-batch. A batch's scores
go to a folder of its own, written whole; Spark's checkpoint then notes the
batch. A run that ends in between does that batch again and overwrites its
folder, so every row has one result, and no committed batch is scored twice.
Rows that were scored with an error are pending again in the next run.

Layout under ``root``: ``input/<run>``, ``begun/<run>`` (noted once the input
is whole), ``checkpoints/<run>`` and ``scores/<run>/batch_id=<n>``. A run that
did not end is resumed with its own input; only when it has ended does a new
run look for what is pending.
"""

from __future__ import annotations

import time
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.ml import score_texts
from ..operators.subsets import pending

RUNS = "run string, files long, rows long"


def paced(scorer, texts_per_second: float | None):
    """The scorer, held to a pace in each task (a hosted model's rate limit
    divided by the tasks that run at once). It waits between its calls."""
    if not texts_per_second:
        return scorer
    free = [0.0]  # when this task may call again

    def call(texts):
        wait = free[0] - time.monotonic()
        if wait > 0:
            time.sleep(wait)
        free[0] = time.monotonic() + len(texts) / texts_per_second
        return scorer(texts)
    return call


def _begin(spark: SparkSession, rows: DataFrame, root: str, run: str, rows_per_batch: int) -> int:
    """Write the run's input, then note the run; the number of its files."""
    n = rows.count()
    files = -(-n // rows_per_batch)
    if files:
        rows.repartition(files).write.mode("overwrite").parquet(f"{root}/input/{run}")
        spark.createDataFrame([(run, files, n)], RUNS).coalesce(1).write.json(f"{root}/begun/{run}")
    return files


def score_pending(spark: SparkSession, rows: DataFrame, root: str, scorer, *, id_col: str = "id", text_col: str = "text", out_col: str = "score", out_type: str = "string",
                  rows_per_batch: int = 10_000, files_per_batch: int = 1, tasks: int | None = None, texts_per_second: float | None = None) -> DataFrame:
    """Score what is pending of ``rows`` and return all results so far: the id,
    ``out_col`` and ``error``, one row an id.

    ``scorer(list[str]) -> list`` as in ``score_texts``. ``tasks`` is the number
    of tasks that score at once, each at ``texts_per_second``. Call it again
    after a run that ended early: the run goes on behind its last commit. A
    null id is left out; a repeated id is scored once, by its smallest text.
    """
    root = root.rstrip("/")
    given = rows.where(F.col(id_col).isNotNull()).groupBy(id_col).agg(F.min(text_col).alias(text_col))
    result = T.StructType([given.schema[id_col], T.StructField(out_col, T._parse_datatype_string(out_type)), T.StructField("error", T.StringType())])
    known = spark.createDataFrame([], result)
    if (last := _last_run(spark, root)) is not None:
        _drain(spark, root, last, given.schema, scorer, id_col, text_col, out_col, out_type, files_per_batch, tasks, texts_per_second)  # what it left
        known = _results(spark, root, result, id_col)
    rest = pending(given, known.where(F.col("error").isNull()), id_col)
    run = f"{time.time_ns():020d}-{uuid.uuid4().hex}"
    if _begin(spark, rest, root, run, rows_per_batch):
        _drain(spark, root, run, given.schema, scorer, id_col, text_col, out_col, out_type, files_per_batch, tasks, texts_per_second)
        known = _results(spark, root, result, id_col)
    return known


def _last_run(spark: SparkSession, root: str) -> str | None:
    try:
        return spark.read.schema(RUNS).json(f"{root}/begun/*").agg(F.max("run")).first()[0]
    except AnalysisException as e:  # nothing was ever scored here
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def _results(spark: SparkSession, root: str, schema: T.StructType, id_col: str) -> DataFrame:
    """One row an id: the newest one without an error, else the newest."""
    found = spark.read.schema(schema).parquet(f"{root}/scores/*/*").select(*schema.names, F.col("_metadata.file_path").alias("_path"))
    run = F.regexp_extract("_path", r"/scores/([^/]+)/", 1)
    values = F.struct(*(c for c in schema.names if c != id_col))
    best = found.groupBy(id_col).agg(F.max_by(values, F.struct(F.col("error").isNull(), run)).alias("_v"))
    return best.select(id_col, *(F.col(f"_v.{c}").alias(c) for c in schema.names if c != id_col))


def _drain(spark: SparkSession, root: str, run: str, schema: T.StructType, scorer, id_col: str, text_col: str, out_col: str, out_type: str,
           files_per_batch: int, tasks: int | None, texts_per_second: float | None) -> None:
    """Run the stream over the run's input until nothing is left. A run that
    has ended finds no new file and does nothing."""
    def score_batch(batch: DataFrame, batch_id: int) -> None:
        dealt = batch.repartition(tasks) if tasks else batch
        scored = score_texts(dealt, paced(scorer, texts_per_second), text_col, out_col, out_type)
        scored.select(id_col, out_col, "error").write.mode("overwrite").parquet(f"{root}/scores/{run}/batch_id={batch_id}")

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(f"{root}/input/{run}")
    query = stream.writeStream.foreachBatch(score_batch).option("checkpointLocation", f"{root}/checkpoints/{run}").trigger(availableNow=True).start()
    query.awaitTermination()
