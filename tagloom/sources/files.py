"""Folder readers and sinks: sheets, CSV folders, JSON-lines annotations, tables.

Schemas are explicit (no inference pass over the data) and go by column
names; the file a row came from is kept from ``_metadata`` so per-file logic
(subreddit = file stem) needs no driver-side listing loop.
"""

from __future__ import annotations

import csv

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.text import is_json_object

SHEET_SCHEMA = ("post_id string, comment_id string, reply_id string, title string, post_text string, "
                "comment_body string, reply_body string")
SHEET_TEXT_COLUMNS = ["title", "post_text", "comment_body", "reply_body"]
ANNOTATION_SCHEMA = "id string, annotations array<map<string,string>>"


def file_stem(col: str = "_metadata.file_name"):
    return F.regexp_replace(F.col(col), r"\.[^.]*$", "")


def csv_headers(spark: SparkSession, path: str) -> dict[tuple[str, ...], list[str]]:
    """Header (column names) -> files that have it; a row a file reaches the driver."""
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"),
        F.monotonically_increasing_id().alias("i"), "value")
    first = lines.groupBy("f").agg(F.min(F.struct("b", "i", "value"))["value"].alias("h")).collect()
    out: dict[tuple[str, ...], list[str]] = {}
    for r in sorted(first, key=lambda r: r["f"]):
        names = next(csv.reader([r["h"].removeprefix("\ufeff")]), [])
        out.setdefault(tuple(names), []).append(r["f"])
    return out


def read_csv_folder(spark: SparkSession, path: str, schema: str, required: list[str] | None = None) -> DataFrame:
    """All CSV files of a folder as one frame, columns taken by their header
    names (multi-line quoted text allowed).

    Files with the same header are read together, as strings, and cast to
    ``schema``; a column a file lacks is null. Files that lack a ``required``
    column are skipped. ``source_file`` is the file's name.
    """
    want = StructType.fromDDL(schema)
    frames = []
    for names, files in csv_headers(spark, path).items():
        if any(c not in names for c in required or []):
            continue
        at = [f"_c{i}" for i in range(len(names))]  # a header may repeat a name: the first counts
        raw = (spark.read.schema(", ".join(f"{c} string" for c in at)).option("header", True).option("enforceSchema", True)
               .option("multiLine", True).option("escape", '"').csv(files))
        cols = [(F.col(at[names.index(f.name)]) if f.name in names else F.lit(None)).cast(f.dataType).alias(f.name) for f in want.fields]
        frames.append(raw.select(*cols, F.col("_metadata.file_name").alias("source_file")))
    if not frames:
        return spark.createDataFrame([], StructType(want.fields).add("source_file", "string"))
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def read_sheet_folder(spark: SparkSession, path: str, fmt: str = "csv", schema: str = SHEET_SCHEMA) -> DataFrame:
    """Thread sheets exported as CSV (or Parquet); subreddit = file stem.

    Columns go by name. CSV files that lack one of the text columns are
    skipped, as the original skipped such sheets.
    """
    if fmt == "csv":
        df = read_csv_folder(spark, path, schema, SHEET_TEXT_COLUMNS).withColumnRenamed("source_file", "file")
    else:
        df = spark.read.schema(schema).parquet(path).withColumn("file", F.col("_metadata.file_name"))
    return df.withColumn("subreddit", file_stem("file"))


def read_annotations(spark: SparkSession, path: str, schema: str = ANNOTATION_SCHEMA) -> DataFrame:
    """JSON-lines annotation documents, one object a line, with (source_file,
    block, line) as their order in the files; lines that are not one JSON
    object are left out."""
    lines = spark.read.text(path).select(
        "value", F.col("_metadata.file_name").alias("source_file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line"))
    return lines.filter(is_json_object(F.col("value"))).select(F.from_json("value", schema).alias("j"), "source_file", "block", "line") \
        .select("j.*", "source_file", "block", "line")


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite",
                partition_by: list[str] | None = None) -> None:
    """Parquet (default) or CSV sink; one folder per 'sheet'; ``mode='append'`` for logs."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        (w.option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False)
         .option("ignoreTrailingWhiteSpace", False).csv(path))
    else:
        w.parquet(path)
