"""Keyword statistics: counts, shares, hit rates, usefulness.

All are one aggregation (map-side partial aggregation, one shuffle on the
group keys). Hot keys are harmless here: partial aggregation collapses a
hot keyword to one row per map task before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import keyword_array_parse


def explode_keywords(df: DataFrame, col: str = "keyword", encoding: str = "semicolon",
                     out: str = "keyword") -> DataFrame:
    """One row per keyword of an encoded list column (null -> "" first)."""
    arr = keyword_array_parse(F.col(col), encoding)
    return df.withColumn(out, F.explode(arr))


def keyword_counts(df: DataFrame, group_col: str, kw_col: str = "keyword", overall: str | None = "overall",
                   out_group: str = "source", out_count: str = "freq") -> DataFrame:
    """Count per (group, keyword), plus the same counts over all groups labelled ``overall``.

    The overall rows are summed from the per-group aggregate, so the input
    is shuffled once (the exchange is reused).
    """
    per = df.groupBy(F.col(group_col).alias(out_group), F.col(kw_col).alias("keyword")) \
        .agg(F.count(F.lit(1)).alias(out_count))
    if overall is None:
        return per
    tot = per.groupBy("keyword").agg(F.sum(out_count).alias(out_count)) \
        .select(F.lit(overall).alias(out_group), "keyword", out_count)
    return per.unionByName(tot)


def pivot_counts(df: DataFrame, row_col: str, col_col: str, values: list[str]) -> DataFrame:
    """Wide count table, 0 where a pair is absent. ``values`` fixes the columns."""
    return df.groupBy(row_col).pivot(col_col, values).count().na.fill(0, subset=values)


def crosstab_share(df: DataFrame, row_col: str, col_col: str, digits: int = 9) -> DataFrame:
    """Long crosstab with row share and column share of each count."""
    n = df.groupBy(row_col, col_col).agg(F.count(F.lit(1)).alias("n"))
    return n.select(
        row_col, col_col, "n",
        F.round(F.col("n") / F.sum("n").over(Window.partitionBy(row_col)), digits).alias("row_share"),
        F.round(F.col("n") / F.sum("n").over(Window.partitionBy(col_col)), digits).alias("col_share"),
    )


def hit_rates(df: DataFrame, group_col: str, label_col: str, digits: int = 9,
              count_name: str = "count", rate_name: str = "hit_rate") -> DataFrame:
    """count(label) (non-null only) and mean(label) per group; null group keys dropped."""
    return (df.filter(F.col(group_col).isNotNull())
            .groupBy(group_col)
            .agg(F.count(label_col).alias(count_name),
                 F.round(F.avg(label_col), digits).alias(rate_name)))


def usefulness(rates: DataFrame, count_col: str = "frequency", rate_col: str = "hit_rate",
               null_as_zero: bool = False, digits: int = 9) -> DataFrame:
    """usefulness = hit_rate * ln(frequency + 1)."""
    rate = F.coalesce(F.col(rate_col), F.lit(0.0)) if null_as_zero else F.col(rate_col)
    return rates.withColumn("usefulness", F.round(rate * F.log1p(F.col(count_col)), digits))


def label_matrix(df: DataFrame, kw_col: str, label_col: str, labels=(0, 1), digits: int = 9) -> DataFrame:
    """keyword x label counts (0 filled) and the share of label 1 (precision)."""
    lab = df.filter(F.col(label_col).isNotNull())
    aggs = [F.count_if(F.col(label_col) == v).alias(f"n_{v}") for v in labels]
    out = lab.groupBy(kw_col).agg(*aggs)
    tot = sum((F.col(f"n_{v}") for v in labels), F.lit(0))
    return out.withColumn("precision", F.round(F.col(f"n_{labels[-1]}") / tot, digits))


def threshold_table(df: DataFrame, kw_col: str, count_col: str, min_count: int) -> DataFrame:
    """Keyword totals over all groups, kept when at least ``min_count``."""
    return (df.groupBy(kw_col).agg(F.sum(count_col).alias("total"))
            .filter(F.col("total") >= min_count))


def relevant_irrelevant_long(df: DataFrame, group_cols: list[str], label_col: str) -> DataFrame:
    """Per group: relevant = number of label-1 rows, irrelevant = the rest; melted.

    ``round(n * mean)`` of 0/1 labels equals ``sum(label)``; summing avoids
    float rounding. Rows with a null label count in n but in neither part,
    as n * mean would have it (mean over non-null).
    """
    agg = df.groupBy(*group_cols).agg(
        F.count(label_col).alias("frequency"),
        F.sum(F.col(label_col)).cast("long").alias("relevant"))
    agg = agg.withColumn("relevant", F.coalesce("relevant", F.lit(0))) \
        .withColumn("irrelevant", F.col("frequency") - F.col("relevant"))
    return agg.unpivot(group_cols + ["frequency"], ["relevant", "irrelevant"], "label", "count")
