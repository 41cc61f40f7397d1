"""Id sets: category membership, subsets for labelling, lookups, resume, upsert.

Set algebra is expressed as semi / anti joins and unions on id columns, so
nothing is pulled into driver-side Python sets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..lexicon import NUM_KFAILS_FOR_GPT, NUM_PASSED_FOR_GPT, NUM_RANDOM_KFAILS
from ..session import written
from .sampling import bottom_k_flags, md5_rank_key


def comments_in_category(comments: DataFrame, posts: DataFrame, category: str) -> DataFrame:
    """Comment ids whose parent post has ``category``."""
    cat = posts.filter(F.col("category") == category).select(F.col("id").alias("post_id"))
    return comments.join(cat, "post_id", "left_semi").select("id")


def matched_in_category(matches: DataFrame, posts: DataFrame, comments: DataFrame, category: str) -> DataFrame:
    """Distinct matched ids that are a post of ``category`` or a comment under one."""
    cat_posts = posts.filter(F.col("category") == category).select("id")
    as_post = matches.join(cat_posts, "id", "left_semi").select("id")
    as_comment = matches.join(comments_in_category(comments, posts, category), "id", "left_semi").select("id")
    return as_post.unionByName(as_comment).distinct()


def take_k(ids: DataFrame, k: int, seed) -> DataFrame:
    """k ids by md5 rank (all of them when fewer), exact at any scale."""
    h = ids.withColumn("_h", md5_rank_key(seed, F.col("id")))
    return bottom_k_flags(h, [], "_h", k, "_s", ["id"]).filter("_s").select("id")


def build_subsets(posts: DataFrame, comments: DataFrame, matches: DataFrame, gold_ids: DataFrame,
                  annotated_ids: DataFrame, category: str, date_created: str,
                  n_random_fails: int = NUM_RANDOM_KFAILS, n_fails_for_llm: int = NUM_KFAILS_FOR_GPT,
                  n_passed_for_llm: int = NUM_PASSED_FOR_GPT) -> DataFrame:
    """Subset membership rows (id, subset, date_created), unique on (id, subset).

    all = posts of the category + their comments; fails = all - matched;
    random_kfails = n_random_fails of the fails; the LLM set = gold + some
    random fails + annotated + some matched ids that are neither gold nor
    annotated. A short pool gives what it has.

    Each source is read once: its ids are tagged, one aggregate per id tells
    which sets an id is in, and that table is written once; every subset is
    a filter of it.
    """
    spark = posts.sparkSession
    sources = {
        "in_category": posts.filter(F.col("category") == category).select("id")
        .unionByName(comments_in_category(comments, posts, category)),
        "matched": matches, "gold": gold_ids, "annotated": annotated_ids}
    tagged = None
    for name, ids in sources.items():
        one = ids.select("id", *[F.lit(name == n).alias(n) for n in sources])
        tagged = one if tagged is None else tagged.unionByName(one)
    t = written(spark, tagged.groupBy("id").agg(*[F.max(n).alias(n) for n in sources]), "subset-ids")
    random_fails = written(spark, take_k(t.filter("in_category AND NOT matched").select("id"), n_random_fails, "kfails"), "kfails")
    eligible = t.filter("in_category AND matched AND NOT gold AND NOT annotated").select("id")
    llm = (t.filter("gold OR annotated").select("id")
           .unionByName(take_k(random_fails, n_fails_for_llm, "llm_fails"))
           .unionByName(take_k(eligible, n_passed_for_llm, "llm_passed")).distinct())
    rows = (t.filter("gold").select("id", F.lit("gold_label").alias("subset"))
            .unionByName(random_fails.withColumn("subset", F.lit("random_kfails")))
            .unionByName(llm.withColumn("subset", F.lit("gpt_random_set"))))
    return rows.withColumn("date_created", F.lit(date_created))


def text_lookup(ids: DataFrame, posts: DataFrame, comments: DataFrame, missing: str = "") -> DataFrame:
    """Post text (title, blank line, selftext) if the id is a post, else the
    comment body, else ``missing``; ``source_type`` says which side matched."""
    p = posts.select("id", F.concat_ws("\n\n", F.coalesce("title", F.lit("")), F.coalesce("selftext", F.lit(""))).alias("_pt"))
    c = comments.select("id", F.col("body").alias("_cb"))
    j = ids.join(p, "id", "left").join(c, "id", "left")
    return j.select(
        "id",
        F.coalesce("_pt", "_cb", F.lit(missing)).alias("text"),
        F.when(F.col("_pt").isNotNull(), F.lit("post")).when(F.col("_cb").isNotNull(), F.lit("comment"))
        .alias("source_type"))


def pending(rows: DataFrame, done: DataFrame, key: str = "id") -> DataFrame:
    """Rows whose key is not done yet (resume support)."""
    return rows.join(done.select(key).distinct(), key, "left_anti")


def compile_relevant(frames: list[DataFrame], rel_col: str = "relevance", keep=1) -> DataFrame:
    """Union the frames that have a relevance column; keep relevance == keep."""
    have = [f for f in frames if rel_col in f.columns]
    if not have:
        raise ValueError("no input has a relevance column")
    out = have[0]
    for f in have[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out.filter(F.col(rel_col) == keep)


def upsert(old: DataFrame, new: DataFrame, key_cols: list[str], batch_col: str = "batch") -> DataFrame:
    """Insert-or-replace on ``key_cols``: the row of the latest batch wins (of
    a key twice in one batch, the one with the largest values).

    One aggregation with ``max_by`` (partial aggregation keeps a hot key
    cheap). Write the result to a new path, then swap it in.
    """
    u = old.unionByName(new, allowMissingColumns=True)
    vals = [c for c in u.columns if c not in key_cols]
    latest = u.groupBy(*key_cols).agg(F.max_by(F.struct(*vals), F.struct(F.col(batch_col), *vals)).alias("_v"))
    return latest.select(*key_cols, *[F.col(f"_v.{c}").alias(c) for c in vals])
