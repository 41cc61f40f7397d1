"""Thread sheets (post / comment / reply per row): structure-preserving and
per-text-id keyword filters.

"First occurrence" is an aggregation (``min`` / ``min_by`` over an explicit
(file, row, column) order) rather than a window: partial aggregation keeps
a post repeated on a third of all rows cheap, where a window would put the
whole group into one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import py_strip
from ..session import written
from .matching import fence, regex_labels

TEXT_COLS = [("title", "post_id"), ("post_text", "post_id"), ("comment_body", "comment_id"), ("reply_body", "reply_id")]


def _cells(sheet: DataFrame, order_cols: list[str]) -> DataFrame:
    cells = F.array(*[F.struct(F.lit(i).alias("ci"), F.lit(c).alias("col"),
                               F.col(k).cast("string").alias("id_key"), F.col(c).cast("string").alias("text"))
                      for i, (c, k) in enumerate(TEXT_COLS)])
    return sheet.select(*order_cols, F.explode(cells).alias("_c")).select(*order_cols, "_c.*")


def match_by_row(sheet: DataFrame, regex_to_label, order_cols=("file", "row"), sep: str = "; ") -> DataFrame:
    """Rows with a new keyword hit in any text column, plus ``keyword``.

    A (id, column) cell that already matched on an earlier row contributes
    nothing; a null id is never treated as seen. ``keyword`` = sorted
    distinct labels of the row's contributing cells.
    """
    oc = list(order_cols)
    c = _cells(sheet, oc).filter(F.col("text").isNotNull())
    c = fence(c, regex_labels(F.col("text"), regex_to_label), "_labs").filter(F.size("_labs") > 0)
    c = written(sheet.sparkSession, c.select(*oc, "col", "id_key", "_labs"), "matched-cells")  # read twice, matched once
    first = (c.filter(F.col("id_key").isNotNull()).groupBy("col", "id_key")
             .agg(F.min(F.struct(*oc)).alias("_first")))
    kept = c.join(first, ["col", "id_key"], "left").filter(
        F.col("id_key").isNull() | (F.struct(*oc) == F.col("_first")))
    per_row = kept.groupBy(*oc).agg(
        F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list("_labs")))), sep).alias("keyword"))
    return sheet.join(per_row, oc)


def text_units(sheet: DataFrame, order_cols=("file", "row"), source_col: str = "file") -> DataFrame:
    """Unique text units: first non-empty text per post id ("title post_text")
    and per comment / reply id (one shared namespace), with the sheet
    (``source_col``) where it was first seen."""
    oc = list(order_cols)
    post_text = py_strip(F.concat_ws(" ", F.col("title"), F.col("post_text")))
    units = F.array(
        F.struct(F.lit("post").alias("source"), F.lit(0).alias("ci"), F.col("post_id").cast("string").alias("id"),
                 post_text.alias("text")),
        F.struct(F.lit("comment").alias("source"), F.lit(1).alias("ci"), F.col("comment_id").cast("string").alias("id"),
                 py_strip(F.col("comment_body")).alias("text")),
        F.struct(F.lit("comment").alias("source"), F.lit(2).alias("ci"), F.col("reply_id").cast("string").alias("id"),
                 py_strip(F.col("reply_body")).alias("text")),
    )
    u = sheet.select(*oc, F.col(source_col).alias("subreddit"), F.explode(units).alias("_u")).select(*oc, "subreddit", "_u.*")
    u = u.filter(F.col("id").isNotNull() & F.col("text").isNotNull() & (F.col("text") != ""))
    first = u.groupBy("source", "id").agg(
        F.min_by(F.struct("text", "subreddit"), F.struct(*oc, "ci")).alias("_f"))
    return first.select("id", "source", "_f.subreddit", "_f.text")


def match_by_textid(sheet: DataFrame, regex_to_label, order_cols=("file", "row"), sep: str = "; ") -> DataFrame:
    """Each unique text unit matched once: (id, source, subreddit, text, keyword)."""
    u = text_units(sheet, order_cols)
    u = fence(u, regex_labels(F.col("text"), regex_to_label), "_labs").filter(F.size("_labs") > 0)
    return u.select("id", "source", "subreddit", "text", F.array_join("_labs", sep).alias("keyword"))
