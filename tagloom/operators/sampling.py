"""Reproducible sampling: ranks by md5, top-n per group, exact cuts, greedy strata.

Random draws of the original (numpy / ``random``) cannot be reproduced, so
every draw here orders rows by ``md5(seed | key)``. The same rank is
computable in SQL, which lets the oracle check the result exactly.

Scale notes
-----------
* ``top_n_per_group`` never puts a whole group into one window partition:
  it ranks inside (group, salt) first, keeps n per salt, then ranks the at
  most n * salts survivors per group. Exact, and a group holding a third of
  all rows is spread over ``salts`` tasks.
* ``bottom_k_flags`` marks the k lowest-ranked rows per group for large k
  (a 20 % test split) with a hash-prefix histogram: counts per (group,
  bucket) and a running sum find the cut bucket. Rows of other buckets are
  decided by comparison; only the cut bucket, about 1 / 2^18 of a group, is
  shuffled and ranked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written

BUCKET_BITS = 18
DEFAULT_SALTS = 64
MAX_BROADCAST_GROUPS = 100_000  # one-row-per-group tables up to which they are broadcast


def md5_rank_key(seed, *parts: Column) -> Column:
    """``md5(seed|part1|part2...)`` as a hex string; equal in Spark and DuckDB."""
    pieces = [F.lit(str(seed))]
    for p in parts:
        pieces += [F.lit("|"), p.cast("string")]
    return F.md5(F.concat(*pieces))


def top_n_per_group(df: DataFrame, group_cols: list[str], order: list[Column], n, rank_col: str = "rank",
                    salts: int = DEFAULT_SALTS, salt_cols: list[str] | None = None) -> DataFrame:
    """Rows ranked 1..n per group by ``order`` (exact; hot groups are salted).

    ``n`` may be an int or a Column (per-group limit). The salt is a hash of
    ``salt_cols`` (default: all columns), so it is the same on a retry.
    """
    n_col = n if isinstance(n, Column) else F.lit(n)
    salt = F.pmod(F.xxhash64(*[F.col(c) for c in (salt_cols or df.columns)]), F.lit(salts))
    w1 = Window.partitionBy(*group_cols, "_salt").orderBy(*order)
    stage1 = (df.withColumn("_salt", salt)
              .withColumn("_r1", F.row_number().over(w1))
              .filter(F.col("_r1") <= n_col)
              .drop("_r1", "_salt"))
    w2 = Window.partitionBy(*group_cols).orderBy(*order)
    return stage1.withColumn(rank_col, F.row_number().over(w2)).filter(F.col(rank_col) <= n_col)


def _hash_bits(h: Column) -> Column:
    """First 60 bits of a hex md5 as a non-negative long."""
    return F.conv(F.substring(h, 1, 15), 16, 10).cast("long")


def bottom_k_flags(df: DataFrame, group_cols: list[str], hash_col: str, k_of_n, flag_col: str = "selected",
                   tiebreak: list[str] | None = None) -> DataFrame:
    """Flag the k lowest rows of each group by the hex hash ``hash_col``.

    ``k_of_n(n_col) -> Column`` gives k from the group size (e.g. ceil(.2 n)),
    or pass an int for a fixed k (all rows when the group is smaller).
    """
    tiebreak = tiebreak or []
    g = list(group_cols)
    b = F.shiftright(_hash_bits(F.col(hash_col)), 60 - BUCKET_BITS)
    withb = df.withColumn("_b", b)
    counts = withb.groupBy(*g, "_b").agg(F.count(F.lit(1)).alias("_c"))
    wcum = Window.partitionBy(*g).orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    wall = Window.partitionBy(*g)
    cum = counts.withColumn("_cum", F.sum("_c").over(wcum)).withColumn("_n", F.sum("_c").over(wall))
    k = k_of_n(F.col("_n")) if callable(k_of_n) else F.least(F.lit(k_of_n), F.col("_n"))
    cum = cum.withColumn("_k", k.cast("long"))
    # the cut bucket: first bucket whose running count reaches k
    cut = (cum.filter((F.col("_cum") >= F.col("_k")) & (F.col("_k") > 0))
           .groupBy(*g).agg(F.min_by(F.struct("_b", (F.col("_k") - (F.col("_cum") - F.col("_c"))).alias("_need")),
                                     F.col("_b")).alias("_cut"))
           .select(*[F.col(c).alias(f"_g{i}") for i, c in enumerate(g)], F.col("_cut._b").alias("_cb"),
                   F.col("_cut._need").alias("_need")))
    cut = written(df.sparkSession, cut, "cut")
    if not g:  # one row: its two numbers are literals
        row = cut.first()
        cb, need = (row["_cb"], row["_need"]) if row else (None, None)
        j = withb.withColumns({"_cb": F.lit(cb).cast("long"), "_need": F.lit(need).cast("long")})
    else:  # one row a group: a broadcast if they are few, null groups included
        small = F.broadcast(cut) if cut.count() <= MAX_BROADCAST_GROUPS else cut
        on = [F.col(c).eqNullSafe(F.col(f"_g{i}")) for i, c in enumerate(g)]
        cond = on[0]
        for c in on[1:]:
            cond = cond & c
        j = withb.join(small, cond, "left").drop(*[f"_g{i}" for i in range(len(g))])
    # rows outside the cut bucket are decided by comparison; only the rows of
    # the cut bucket are shuffled and ranked
    inside = F.coalesce(F.col("_b") == F.col("_cb"), F.lit(False))
    wb = Window.partitionBy(*g, "_b").orderBy(F.col(hash_col), *[F.col(c) for c in tiebreak])
    ranked = j.filter(inside).withColumn(flag_col, F.row_number().over(wb) <= F.col("_need"))
    decided = j.filter(~inside).withColumn(flag_col, F.coalesce(F.col("_b") < F.col("_cb"), F.lit(False)))
    return decided.unionByName(ranked).drop("_b", "_cb", "_need")


def ordinal(df: DataFrame, order_cols: list[str], out_col: str, weight_col: str | None = None) -> DataFrame:
    """Exclusive running count (or sum of ``weight_col``) in the order of
    ``order_cols`` over the whole frame, for keys of any type, without a
    window over all rows: range partitions, a sum for each, and a window
    inside each. Rows with equal keys share a partition, in no fixed order."""
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(c) for c in order_cols]
    one = F.col(weight_col) if weight_col else F.lit(1)
    d = df.repartitionByRange(parts, *keys).withColumn("_ord_p", F.spark_partition_id()).withColumn("_ord_w", one.cast("long"))
    d = written(spark, d, "ranges")
    per = d.groupBy("_ord_p").agg(F.sum("_ord_w").alias("_ord_s"))  # a row a partition
    before = per.select(F.col("_ord_p").alias("_ord_q"), F.coalesce(F.sum("_ord_s").over(
        Window.orderBy("_ord_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_ord_base"))
    w = Window.partitionBy("_ord_p").orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    return (d.join(F.broadcast(before), F.col("_ord_p") == F.col("_ord_q"))
            .withColumn(out_col, (F.col("_ord_base") + F.coalesce(F.sum("_ord_w").over(w), F.lit(0))).cast("long"))
            .drop("_ord_p", "_ord_q", "_ord_w", "_ord_base"))


# ---------------------------------------------------------------------------
# samplers
# ---------------------------------------------------------------------------

def sample_per_group(df: DataFrame, group_col: str, id_col: str, n: int, seed=42,
                     out_col: str = "source_file") -> DataFrame:
    """n rows per group (all if fewer) by md5 rank; the group is kept as ``out_col``."""
    key = md5_rank_key(seed, F.col(id_col))
    ranked = top_n_per_group(df.withColumn("_h", key), [group_col], [F.col("_h"), F.col(id_col)], n, "_rank")
    return ranked.drop("_h", "_rank").withColumn(out_col, F.col(group_col))


def split_train_test(df: DataFrame, id_col: str, label_col: str | None, test_size: float = 0.2,
                     seed=42, out_col: str = "is_test") -> DataFrame:
    """Exact test share per label class (or overall): the ceil(test_size * n)
    lowest md5 ranks go to test. ``out_col`` is 1 for test, 0 for train."""
    g = [label_col] if label_col else []
    d = df.withColumn("_h", md5_rank_key(seed, F.col(id_col)))
    flagged = bottom_k_flags(d, g, "_h", lambda n: F.ceil(n * F.lit(test_size)), "_t", [id_col])
    return flagged.withColumn(out_col, F.col("_t").cast("int")).drop("_h", "_t")


def stratified_sample(df: DataFrame, group_col: str, id_col: str, n: int, seed=42, prefix: float = 4.0) -> DataFrame:
    """Greedy stratified draw: groups in sorted order, each takes up to n of
    its ids that no earlier group drew (lowest md5(seed|group|id) first).

    All ids prefer earlier groups and a group prefers low ranks, so the draw
    is the one stable matching of ids and groups; ``deferred_acceptance``
    finds it in parallel. A group hardly needs more than its first ranks: only
    the pairs below a rank that about ``prefix * n`` of its rows have take
    part, found by comparison, without a shuffle. If a group is filled from
    these, later ones could not change that; a group that is not, and has
    more, gets an eight times longer prefix, and the matching is made anew.

    Rows without a group or an id take no part; repeated (group, id) rows
    count once.
    """
    spark = df.sparkSession
    h = md5_rank_key(seed, F.col(group_col), F.col(id_col))
    pairs = df.select(group_col, id_col).where(F.col(group_col).isNotNull() & F.col(id_col).isNotNull()).withColumn("_h", h)
    pairs = written(spark, pairs, "pairs")
    share = F.least(F.lit(1.0), F.lit(float(prefix * n)) / F.col("_n"))
    depth = written(spark, pairs.groupBy(group_col).agg(F.count("*").alias("_n")).withColumn("_share", share), "depth")
    while True:
        near = _hash_bits(F.col("_h")) <= F.col("_share") * F.lit(float(1 << 60))
        part = pairs.join(_one_a_group(depth.where("_share < 1")), group_col, "left").where(F.col("_share").isNull() | near)
        part = written(spark, part.select(group_col, id_col, "_h").distinct(), "candidates")
        drawn, _ = deferred_acceptance(part, group_col, id_col, "_h", n)
        filled = drawn.groupBy(group_col).agg(F.count("*").alias("_k"))
        short = depth.where("_share < 1").join(filled, group_col, "left").where(F.coalesce("_k", F.lit(0)) < n).select(group_col, F.lit(8.0).alias("_more"))
        short = written(spark, short, "short")
        if short.isEmpty():
            break
        wider = F.least(F.lit(1.0), F.col("_share") * F.coalesce("_more", F.lit(1.0)))
        depth = written(spark, depth.join(short, group_col, "left").withColumn("_share", wider).drop("_more"), "depth")
    keys = ordinal(drawn, [group_col, "_r"], "sample_order").select(group_col, id_col, "sample_order")
    # other columns only for the rows drawn (at most n a group), one row a pair
    return df.join(keys, [group_col, id_col]).dropDuplicates([group_col, id_col])


def _one_a_group(table: DataFrame) -> DataFrame:
    """A (written) table of a row a group: a broadcast if the rows are few."""
    return F.broadcast(table) if table.count() <= MAX_BROADCAST_GROUPS else table


def deferred_acceptance(pairs: DataFrame, group_col: str, id_col: str, rank_col: str, n: int) -> tuple[DataFrame, int]:
    """The stable matching in which ids prefer the smallest group and a group
    the n lowest (rank, id): ((group, id, rank, _r = place in the group), rounds).

    In a round every id proposes to its first group that has not refused it; a
    group keeps its n lowest proposals, and with n of them refuses every pair
    above the last. What a group keeps only gets better, so the last ranks of
    one round are all that the next needs: a round reads the written pairs and
    one row a group. It ends when no proposal is refused.
    """
    spark = pairs.sparkSession
    last = None
    rounds = 0
    while True:
        rounds += 1
        alive = pairs
        if last is not None:
            refused = F.struct(rank_col, id_col) > F.struct("_last._rank", "_last._id")
            alive = pairs.join(_one_a_group(last), group_col, "left").where(F.col("_last").isNull() | ~refused)
        proposals = alive.groupBy(id_col).agg(F.min(F.struct(group_col, rank_col)).alias("_p")).select(f"_p.{group_col}", id_col, f"_p.{rank_col}")
        order = [F.col(rank_col), F.col(id_col)]
        kept = written(spark, top_n_per_group(proposals, [group_col], order, n + 1, "_r"), "proposals")  # one more shows a refusal
        if kept.where(F.col("_r") > n).isEmpty():
            return kept, rounds
        end = F.max(F.struct(F.col(rank_col).alias("_rank"), F.col(id_col).alias("_id"))).alias("_last")
        last = written(spark, kept.where(F.col("_r") <= n).groupBy(group_col).agg(end, F.count("*").alias("_k")).where(F.col("_k") == n).drop("_k"), "last-ranks")


def rare_keyword_sample(df: DataFrame, file_col: str, kw_col: str, rare: list[str], max_rows: int) -> DataFrame:
    """Rows holding any rare keyword; whole files in name order while fewer
    than ``max_rows`` such rows were taken before the file starts."""
    rare_arr = F.array(*[F.lit(k) for k in rare])
    q = df.filter(F.arrays_overlap(F.col(kw_col), rare_arr))
    per_file = q.groupBy(file_col).agg(F.count(F.lit(1)).alias("_q"))
    files = ordinal(per_file, [file_col], "_before", "_q").filter(F.col("_before") < max_rows).select(file_col)
    return q.join(files, file_col, "left_semi")


def unsampled_keywords(lexicon: DataFrame, sample_kw: DataFrame, kw_col: str = "keyword") -> DataFrame:
    """Lexicon terms never seen in the sample."""
    return lexicon.select(F.col("term").alias(kw_col)).distinct().join(
        sample_kw.select(kw_col).distinct(), kw_col, "left_anti")


def text_key(text: Column) -> Column:
    """A wide digest that stands for a text as a key (texts stay out of shuffles)."""
    return F.md5(text)


def uncertain_top_k(pool: DataFrame, known_texts: DataFrame, id_col: str, text_col: str, prob_col: str,
                    k: int = 100) -> DataFrame:
    """Distinct texts (first by id) not already labelled, by 1 - max class
    probability, highest first; ties by id. Texts are compared by digest, and
    only the k rows chosen are joined to theirs."""
    first = pool.groupBy(text_key(F.col(text_col)).alias("_d")).agg(
        F.min(F.struct(F.col(id_col), F.col(prob_col))).alias("_f")).select("_d", f"_f.{id_col}", f"_f.{prob_col}")
    known = known_texts.select(text_key(F.col(text_col)).alias("_d")).distinct()
    rest = first.join(known, "_d", "left_anti")
    p = F.col(prob_col)
    unc = F.round(1 - F.greatest(p, 1 - p), 9)
    top = rest.withColumn("uncertainty", unc).orderBy(F.col("uncertainty").desc(), F.col(id_col)).limit(k)
    texts = pool.select(id_col, text_col).withColumn("_d", text_key(F.col(text_col)))
    return texts.join(F.broadcast(top), [id_col, "_d"]).dropDuplicates([id_col]).select(id_col, text_col, prob_col, "uncertainty")


def top_k_per_group_union(scored: DataFrame, k: int, id_col: str = "id") -> DataFrame:
    """Top k by priority per keyword and per subreddit, union, first row per id."""
    s = scored.withColumn("keyword", F.lower(F.trim("keyword"))).withColumn("subreddit", F.lower(F.trim("subreddit")))
    order = [F.col("priority_score").desc(), F.col(id_col), F.col("keyword"), F.col("subreddit")]
    a = top_n_per_group(s, ["keyword"], order, k, "_rk").withColumn("_src", F.lit(0)).withColumn("_grp", F.col("keyword"))
    b = top_n_per_group(s, ["subreddit"], order, k, "_rk").withColumn("_src", F.lit(1)).withColumn("_grp", F.col("subreddit"))
    u = a.unionByName(b)
    firsts = u.groupBy(id_col).agg(F.min_by(F.struct("subreddit", "keyword", "priority_score"),
                                            F.struct("_src", "_grp", "_rk")).alias("_f"))
    return firsts.select(id_col, "_f.subreddit", F.col("_f.keyword").alias("sampled_keyword"), "_f.priority_score")
