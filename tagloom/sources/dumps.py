"""Raw forum dumps: JSON lines, one file per (forum, kind), often zstd.

``spark.read.text`` decompresses ``.zst`` natively (one task per file, the
codec is not splittable), so ``read_dump`` repartitions right after the
scan when asked; ``zst.read_frames`` gives a file of many frames to many tasks. Everything after the scan is narrow except the per-file
line counts (one small aggregation).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import is_json_object
from ..lexicon import SHORT_NAME
from ..operators.matching import keyword_match

START_EPOCH = 1577836800  # 2020-01-01 00:00:00 UTC, the rough cut's start date
EPOCHS = (-62135596800, 253402300799)  # the years 1 to 9999

RAW_SCHEMA = "id string, body string, title string, selftext string, created_utc string"


def read_dump(spark: SparkSession, path: str, partitions: int | None = None) -> DataFrame:
    """(file, line) for every line of every file under ``path`` (zst, gz or plain)."""
    df = spark.read.text(path).select(F.col("_metadata.file_name").alias("file"), F.col("value").alias("line"))
    return df.repartition(partitions) if partitions else df


def file_kind(file: Column) -> Column:
    """'comments' / 'submissions' by the file name, else null."""
    return (F.when(file.contains("comments"), F.lit("comments"))
            .when(file.contains("submissions"), F.lit("submissions")))


def short_name(file: Column) -> Column:
    """Forum name + '_' + first letter of the kind (``^([^_]+_[a-zA-Z])``)."""
    return F.nullif(F.regexp_extract(file, SHORT_NAME, 1), F.lit(""))


def parse_json_lines(df: DataFrame, line_col: str = "line", file_col: str = "file") -> DataFrame:
    """Decode each line; ``bad`` = not JSON or a field its kind needs is missing.

    Adds id, body, title, selftext, created_utc (BIGINT), kind, bad. A
    created_utc that is present but not a number, or not a second of the years
    1 to 9999, is also bad (the original stopped reading the file there; we go
    on with the next line). Fractions and exponents (1.6e9) are numbers.
    """
    kind = file_kind(F.col(file_col))
    p = F.from_json(F.col(line_col), RAW_SCHEMA, {"mode": "PERMISSIVE"})
    out = df.withColumn("_j", p).withColumn("kind", kind)
    created = F.col("_j.created_utc")
    number = F.when(created.rlike(r"^\s*-?[0-9]+(\.[0-9]+)?([eE][+-]?[0-9]+)?\s*$"), created.cast("double"))
    created_num = F.when(number.between(*EPOCHS), number.cast("long"))
    bad_json = F.col("_j").isNull() | ~is_json_object(F.col(line_col))
    need_c = F.col("_j.id").isNull() | F.col("_j.body").isNull()
    need_s = F.col("_j.id").isNull() | F.col("_j.title").isNull() | F.col("_j.selftext").isNull()
    missing = (F.when(F.col("kind") == "comments", need_c).when(F.col("kind") == "submissions", need_s)
               .otherwise(F.col("_j.id").isNull()))
    bad = bad_json | missing | created.isNull() | created_num.isNull()
    return out.select(
        *[c for c in df.columns],
        F.col("_j.id").alias("id"), F.col("_j.body").alias("body"), F.col("_j.title").alias("title"),
        F.col("_j.selftext").alias("selftext"), created_num.alias("created_utc"), "kind",
        F.coalesce(bad, F.lit(True)).alias("bad"))


def date_filter(df: DataFrame, epoch_col: str = "created_utc", start_epoch: int = START_EPOCH) -> DataFrame:
    """Keep rows created at or after the start (UTC). Adds ``created`` TIMESTAMP."""
    return df.withColumn("created", F.timestamp_seconds(F.col(epoch_col))) \
        .filter(F.col(epoch_col) >= F.lit(start_epoch))


def removed_body(selftext: Column) -> Column:
    return F.lower(selftext).isin("[deleted]", "[removed]")


def tag_lines(parsed: DataFrame, lexicon, start_epoch: int = START_EPOCH) -> DataFrame:
    """Every parsed line with ``keywords`` (empty when not a hit) and ``removed``.

    Comments match on the lowered body. Submissions skip "[deleted]" /
    "[removed]" bodies, list the title's matches if the title has any, else
    the body's, and carry "title /// body" as text. Bad lines and lines
    before the start date get no keywords.
    """
    live = ~F.col("bad") & (F.col("created_utc") >= start_epoch)
    is_sub = F.col("kind") == "submissions"
    removed = live & is_sub & F.coalesce(removed_body(F.col("selftext")), F.lit(False))
    d = parsed.withColumn("removed", removed).withColumn("_live", live & ~removed)
    d = d.withColumn("text", F.when(is_sub, F.concat(F.lower("title"), F.lit(" /// "), F.lower("selftext")))
                     .otherwise(F.lower("body")))
    d = d.withColumn("_t", F.when(F.col("_live") & is_sub, F.col("title")))
    d = d.withColumn("_b", F.when(F.col("_live"), F.when(is_sub, F.col("selftext")).otherwise(F.col("body"))))
    d = keyword_match(d, "_t", lexicon, "_th", keep_empty=True)
    d = keyword_match(d, "_b", lexicon, "_bh", keep_empty=True)
    kw = F.when(F.size("_th") > 0, F.col("_th")).otherwise(F.col("_bh"))
    return d.withColumn("keywords", kw).drop("_t", "_b", "_th", "_bh", "_live")


def rough_filter(parsed: DataFrame, lexicon, start_epoch: int = START_EPOCH) -> DataFrame:
    """Keyword hits of a parsed dump: (file, short_name, id, text, keywords)."""
    t = tag_lines(parsed, lexicon, start_epoch).filter(F.size("keywords") > 0)
    return t.select("file", short_name(F.col("file")).alias("short_name"), "id", "text", "keywords")


def scan_line_counts(tagged: DataFrame) -> DataFrame:
    """Per file: total_lines, keyword_lines, bad_lines (one aggregation).

    A submission with a removed body is not counted in total_lines (the
    original skipped the counter for it); bad lines are.
    """
    return tagged.groupBy("file").agg(
        F.count_if(~F.col("removed")).alias("total_lines"),
        F.count_if(F.size("keywords") > 0).alias("keyword_lines"),
        F.count_if(F.col("bad")).alias("bad_lines"))
