"""The rough keyword cut as a Structured Streaming job over a dump folder.

New dump files are picked up as they land. Parsing, the date test,
routing and matching are stateless. Hits and line counts are written per
micro-batch by ``foreachBatch`` into folders partitioned by batch id; a
replayed batch overwrites its own partition (idempotent), and
``line_counts`` sums the partitions at read time.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.dumps import parse_json_lines, scan_line_counts, short_name, tag_lines


def dump_stream(spark: SparkSession, folder: str, max_files_per_trigger: int | None = None) -> DataFrame:
    r = spark.readStream.format("text")
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.load(folder).select(F.col("_metadata.file_name").alias("file"), F.col("value").alias("line"))


def start(spark: SparkSession, folder: str, out_dir: str, lexicon, checkpoint_dir: str,
          available_now: bool = True, max_files_per_trigger: int | None = None):
    """Start the streaming cut; returns the StreamingQuery.

    out_dir/hits: (file, short_name, id, text, keywords) parquet, append.
    out_dir/line_counts: per-batch (file, total_lines, keyword_lines, bad_lines).
    """
    lines = dump_stream(spark, folder, max_files_per_trigger)
    hits_path = os.path.join(out_dir, "hits")
    counts_path = os.path.join(out_dir, "line_counts")

    def per_batch(lines: DataFrame, batch_id: int) -> None:
        # a batch is an ordinary frame, so a lexicon of any size can be matched
        batch = tag_lines(parse_json_lines(lines), lexicon).persist()
        hits = batch.filter(F.size("keywords") > 0).select(
            "file", short_name(F.col("file")).alias("short_name"), "id", "text", "keywords")
        hits.write.mode("overwrite").parquet(os.path.join(hits_path, f"batch_id={batch_id}"))
        scan_line_counts(batch).write.mode("overwrite").parquet(os.path.join(counts_path, f"batch_id={batch_id}"))
        batch.unpersist()

    w = lines.writeStream.foreachBatch(per_batch).option("checkpointLocation", checkpoint_dir)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.start()


def hits(spark: SparkSession, out_dir: str) -> DataFrame:
    return spark.read.parquet(os.path.join(out_dir, "hits")).drop("batch_id")


def line_counts(spark: SparkSession, out_dir: str) -> DataFrame:
    c = spark.read.parquet(os.path.join(out_dir, "line_counts"))
    return c.groupBy("file").agg(*[F.sum(x).cast("long").alias(x) for x in ("total_lines", "keyword_lines", "bad_lines")])
