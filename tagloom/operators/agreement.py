"""Agreement between two coders (human, model or both).

Keys are (id, subreddit) joined as two columns, never concatenated (a
concatenated "a_b" + "c" key could collide with "a" + "b_c").
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .stats import explode_keywords, hit_rates


def inconsistent_labels(df: DataFrame, key_cols: list[str], label_col: str = "label",
                        detail_col: str | None = None) -> DataFrame:
    """Keys that occur more than once with more than one distinct label.

    A non-empty result means the coder file is not self-consistent and the
    comparison should stop. ``detail_col`` values of the rows are listed.
    """
    aggs = [F.count(F.lit(1)).alias("n_rows"), F.count_distinct(label_col).alias("n_labels")]
    if detail_col:
        aggs.append(F.array_join(F.array_sort(F.collect_list(F.col(detail_col).cast("string"))), ",")
                    .alias("rows"))
    return (df.groupBy(*key_cols).agg(*aggs)
            .filter((F.col("n_rows") > 1) & (F.col("n_labels") > 1)))


def coder_match(c1: DataFrame, c2: DataFrame, key_cols: list[str], label_col: str = "label") -> DataFrame:
    """Inner join of the two coders on the key (many-to-many when keys repeat)."""
    a = c1.select(*key_cols, F.col(label_col).alias("label_1"))
    b = c2.select(*key_cols, F.col(label_col).alias("label_2"))
    return a.join(b, key_cols, "inner")


def without_disagreement(rows: DataFrame, other: DataFrame, key_cols: list[str], label_col: str = "label") -> DataFrame:
    """``rows`` without those that the other coder labelled differently; rows
    the other coder has not seen, or left unlabelled, stay."""
    theirs = other.select(*key_cols, F.col(label_col).alias("_other")).filter(F.col("_other").isNotNull())
    clash = [F.col(f"r.{k}") == F.col(f"o.{k}") for k in key_cols] + [F.col(f"r.{label_col}") != F.col("o._other")]
    cond = clash[0]
    for c in clash[1:]:
        cond = cond & c
    return rows.alias("r").join(theirs.alias("o"), cond, "left_anti")


def cohen_kappa(merged: DataFrame, l1: str = "label_1", l2: str = "label_2", digits: int = 9) -> DataFrame:
    """One row: n, agreement, agreement_rate, kappa.

    kappa = (po - pe) / (1 - pe) over the labels seen on either side; null
    when pe = 1 (a single label everywhere) or when there are no rows.
    """
    conf = merged.groupBy(F.col(l1).alias("a"), F.col(l2).alias("b")).agg(F.count(F.lit(1)).alias("c"))
    # each cell counts in its row's and its column's margin, and on the diagonal
    zero, c, same = F.lit(0).cast("long"), F.col("c"), F.col("a") == F.col("b")
    margins = F.array(F.struct(F.col("a").alias("k"), c.alias("r"), zero.alias("s"), F.when(same, c).otherwise(zero).alias("d")),
                      F.struct(F.col("b").alias("k"), zero.alias("r"), c.alias("s"), zero.alias("d")))
    per = conf.select(F.explode(margins).alias("m")).groupBy("m.k").agg(*[F.sum(f"m.{x}").alias(x) for x in "rsd"]).filter("k IS NOT NULL")
    n = F.sum("r")
    agg = per.agg(n.alias("n"), F.sum("d").alias("agreement"), F.sum(F.col("r") * F.col("s")).alias("rs"))
    po = F.col("agreement") / F.col("n")
    pe = F.col("rs") / (F.col("n") * F.col("n"))
    return agg.select(
        F.coalesce(F.col("n"), F.lit(0)).cast("long").alias("n"),
        F.coalesce(F.col("agreement"), F.lit(0)).cast("long").alias("agreement"),
        F.when(F.col("n") > 0, F.round(po, digits)).otherwise(F.lit(0.0)).alias("agreement_rate"),
        F.when((F.col("n") > 0) & (pe != 1), F.round((po - pe) / (1 - pe), digits)).alias("kappa"),
    )


def hit_rate_compare(c1: DataFrame, c2: DataFrame, kw_col: str = "keyword", label_col: str = "label",
                     encoding: str = "semicolon", digits: int = 9) -> DataFrame:
    """Per-keyword hit rates of both coders, full outer join, 0 filled, |diff|."""
    r1 = hit_rates(explode_keywords(c1, kw_col, encoding), "keyword", label_col, digits, "count_1", "hit_rate_1")
    r2 = hit_rates(explode_keywords(c2, kw_col, encoding), "keyword", label_col, digits, "count_2", "hit_rate_2")
    j = r1.join(r2, "keyword", "full").na.fill(0, ["count_1", "count_2"]).na.fill(0.0, ["hit_rate_1", "hit_rate_2"])
    return j.withColumn("hit_rate_diff", F.round(F.abs(F.col("hit_rate_1") - F.col("hit_rate_2")), digits))


def shared_keyword_counts(c1: DataFrame, c2: DataFrame, key_cols: list[str], kw_col: str = "keyword",
                          encoding: str = "semicolon") -> DataFrame:
    """Number of (key, keyword) pairs coded by both coders, per keyword."""
    k1 = explode_keywords(c1.select(*key_cols, kw_col), kw_col, encoding).distinct()
    k2 = explode_keywords(c2.select(*key_cols, kw_col), kw_col, encoding).distinct()
    return k1.join(k2, key_cols + ["keyword"]).groupBy("keyword").agg(F.count(F.lit(1)).alias("n_shared"))
