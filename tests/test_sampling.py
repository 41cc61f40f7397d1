"""Samplers against brute force on small inputs; properties."""

import hashlib
import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from tagloom.operators import sampling as SA


def md5(s):
    return hashlib.md5(s.encode()).hexdigest()


def test_top_n_per_group_equals_window(spark):
    df = spark.range(0, 5000).select(F.col("id"), (F.col("id") % 3).alias("g"), (F.col("id") * 7919 % 1000).alias("v"))
    got = SA.top_n_per_group(df, ["g"], [F.col("v").desc(), F.col("id")], 25, "rk", salts=16)
    w = Window.partitionBy("g").orderBy(F.col("v").desc(), F.col("id"))
    exp = df.withColumn("rk", F.row_number().over(w)).filter("rk <= 25")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, exp.collect()))


def test_bottom_k_fraction_exact(spark):
    df = spark.range(0, 3001).select(F.col("id"), (F.col("id") % 2).alias("label"))
    out = SA.split_train_test(df, "id", "label", 0.2, 42).collect()
    for lab in (0, 1):
        ids = [r.id for r in out if r.label == lab]
        k = math.ceil(len(ids) * 0.2)
        exp = set(sorted(ids, key=lambda i: (md5(f"42|{i}"), i))[:k])
        assert {r.id for r in out if r.label == lab and r.is_test == 1} == exp


def brute_greedy(rows, n, seed=42):
    seen, out = set(), []
    for g in sorted({g for g, _ in rows}):
        cand = sorted({i for gg, i in rows if gg == g}, key=lambda i: (md5(f"{seed}|{g}|{i}"), i))
        took = [i for i in cand if i not in seen][:n]
        out += [(g, i) for i in took]
        seen.update(took)
    return out


def test_stratified_sample_matches_brute_force(spark):
    rows = [(f"k{(i * 7) % 13}", i % 97) for i in range(900)] + [("hot", i) for i in range(300)]
    df = spark.createDataFrame(rows, "keyword string, id long")
    out = SA.stratified_sample(df, "keyword", "id", 5, 42).collect()
    got = sorted((r.keyword, r.id) for r in out)
    assert got == sorted(brute_greedy(rows, 5))
    # the draw order is global
    assert [(r.keyword, r.id) for r in sorted(out, key=lambda r: r.sample_order)] == brute_greedy(rows, 5)
    ids = [i for _, i in got]
    assert len(ids) == len(set(ids))


def test_starved_groups_get_longer_prefixes(spark):
    """Late groups whose ids are nearly all drawn by earlier ones."""
    rows = [(f"a{i % 40:02}", i) for i in range(400)] + [("z", i) for i in range(420)] + [("zz", i) for i in range(405)] + [(None, 7), ("y", None), ("y", 3), ("y", 3)]
    df = spark.createDataFrame(rows, "keyword string, id long").repartition(6)
    want = brute_greedy([(g, i) for g, i in rows if g is not None and i is not None], 10)
    for prefix in (0.5, 4.0):
        out = SA.stratified_sample(df, "keyword", "id", 10, 42, prefix=prefix).collect()
        assert [(r.keyword, r.id) for r in sorted(out, key=lambda r: r.sample_order)] == want


def test_ten_thousand_groups_in_tens_of_rounds(spark):
    import random
    r = random.Random(5)
    rows = [(f"g{int(10_000 * r.random() ** 2):05}", r.randrange(10_000)) for _ in range(40_000)]
    df = spark.createDataFrame(rows, "g string, id long").distinct().withColumn("h", SA.md5_rank_key(42, F.col("g"), F.col("id")))
    drawn, rounds = SA.deferred_acceptance(SA.written(spark, df, "pairs-test"), "g", "id", "h", 5)
    assert sorted((x.g, x.id) for x in drawn.collect()) == sorted(brute_greedy(rows, 5))
    assert rounds < 50


def test_stratified_sample_runs_no_python(spark):
    df = spark.range(200).select((F.col("id") % 7).cast("string").alias("k"), "id")
    plan = SA.stratified_sample(df, "k", "id", 3)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_sample_per_group_all_when_fewer(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "f string, id long")
    out = SA.sample_per_group(df, "f", "id", 5).collect()
    assert sorted(r.id for r in out) == [1, 2, 3]


def test_rare_keyword_sample_whole_files(spark):
    rows = [("f1", 1, ["x"]), ("f1", 2, ["y"]), ("f2", 3, ["x"]), ("f3", 4, ["x"])]
    df = spark.createDataFrame(rows, "file string, id long, kws array<string>")
    out = sorted(r.id for r in SA.rare_keyword_sample(df, "file", "kws", ["x"], 2).collect())
    assert out == [1, 3]


def test_null_groups_take_part_in_the_cut(spark):
    df = spark.createDataFrame([(i, None) for i in range(10)] + [(100 + i, 1) for i in range(10)], "id long, label int")
    out = SA.split_train_test(df, "id", "label", 0.2, 42).collect()
    assert sum(r.is_test for r in out if r.label is None) == 2 and sum(r.is_test for r in out if r.label == 1) == 2


def test_cut_by_broadcast_and_by_join_agree(spark, monkeypatch):
    df = spark.range(0, 900).select(F.col("id"), (F.col("id") % 7).alias("label"))
    want = sorted(map(tuple, SA.split_train_test(df, "id", "label", 0.3, 1).collect()))
    monkeypatch.setattr(SA, "MAX_BROADCAST_GROUPS", 0)
    assert sorted(map(tuple, SA.split_train_test(df, "id", "label", 0.3, 1).collect())) == want


def test_ordinal_counts_and_sums_in_order(spark):
    rows = [(f"k{i * 37 % 500:04}", i % 4) for i in range(500)]
    df = spark.createDataFrame(rows, "k string, n int").repartition(7)
    got = {r.k: (r.at, r.before) for r in SA.ordinal(SA.ordinal(df, ["k"], "at"), ["k"], "before", "n").collect()}
    total = 0
    for i, (k, n) in enumerate(sorted(rows)):
        assert got[k] == (i, total)
        total += n
    assert SA.ordinal(df.limit(0), ["k"], "at").count() == 0


def test_uncertain_top_k_of_repeated_texts(spark):
    pool = spark.createDataFrame([(3, "a", 0.5), (1, "a", 0.9), (2, "b", 0.6), (4, "c", 0.5)], "id long, text string, p double")
    known = spark.createDataFrame([("c",)], "text string")
    got = sorted((r.id, r.text, r.uncertainty) for r in SA.uncertain_top_k(pool, known, "id", "text", "p", 5).collect())
    assert got == [(1, "a", 0.1), (2, "b", 0.4)]
