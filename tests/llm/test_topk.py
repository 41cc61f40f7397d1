import random

from pyspark.sql import functions as F

from tagloom.llm import topk
from tests.llm import brute

SCHEMA = "vec_id long, embedding array<float>, score long, shard int, id string"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2, "x") for i, v in rows], SCHEMA).repartition(3)


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def test_random_vectors(spark):
    r = random.Random(1)
    rows = [(i, [r.uniform(-1, 1) for _ in range(8)]) for i in range(230)]
    import numpy as np
    rows = [(i, [float(np.float32(x)) for x in v]) for i, v in rows]
    got = rows_of(topk.search(spark, table(spark, rows), F.col("id") % 10 == 0))
    assert got == sorted(brute.topk(rows, 10, 5))


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [0.5, 0.5]), (0, [0.25, 0.5]), (1, [0.5, 0.5]), (1, [0.5, 0.5]), (2, [0.5, 0.5]), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, None), (6, [None, 1.0]),
            (7, []), (8, [1.0]), (10, [1.0]), (9, [-0.001, 0.999]), (None, [1.0, 1.0]), (20, [0.0, -0.0]), (30, None)]
    got = rows_of(topk.search(spark, table(spark, rows), F.col("id") % 10 == 0))
    assert got == sorted(brute.topk(rows, 10, 5))


def test_ties_go_to_the_smaller_id(spark):
    rows = [(i, [1.0, 0.0]) for i in range(300)]
    got = rows_of(topk.search(spark, table(spark, rows), F.col("id") % 100 == 0))
    assert got == sorted(brute.topk(rows, 100, 5))


def test_sums_beyond_double_precision(spark):
    rows = [(i, [2.0 ** 22 + i * 4, 2.0 ** 20 - i, 1.0 / 256]) for i in range(30)]
    rows += [(50, [1e30, 1.0, 0.0]), (51, [3e30, 0.0, 0.0])]
    import numpy as np
    rows = [(i, [float(np.float32(x)) for x in v]) for i, v in rows]
    got = rows_of(topk.search(spark, table(spark, rows), F.col("id") % 10 == 0))
    assert got == sorted(brute.topk(rows, 10, 5))


def test_many_small_shards_merge_as_a_tree(spark):
    r = random.Random(2)
    rows = [(i, [r.choice([-1.0, 0.0, 1.0]) for _ in range(4)]) for i in range(400)]
    got = rows_of(topk.search(spark, table(spark, rows), F.col("id") % 50 == 0, shard_rows=1))
    assert got == sorted(brute.topk(rows, 50, 5))


def test_shards_are_bounded_by_bytes_not_by_cores():
    assert topk.shards_for(1_000_000, 1_000_000 * 768 * 8, 8) * topk.SHARD_BYTES >= 1_000_000 * 768 * 8
    assert topk.shards_for(50_000, 50_000 * 64 * 8, 5_000) == 25 and topk.shards_for(10, 80, 5_000) == 1 and topk.shards_for(0, 0, 8) == 1


def test_one_id_on_most_rows_is_spread_over_shards(spark, monkeypatch):
    monkeypatch.setattr(topk, "SHARD_BYTES", 64)
    r = random.Random(3)
    rows = [(7, [float(r.randint(-4, 4)), float(r.randint(-4, 4))]) for _ in range(150)] + [(i, [1.0, float(i % 5)]) for i in range(40)]
    got = rows_of(topk.search(spark, table(spark, rows), F.col("id") % 10 == 0))
    assert got == sorted(brute.topk(rows, 10, 5))


def test_empty_table(spark):
    assert topk.search(spark, table(spark, []), F.col("id") % 10 == 0).count() == 0
