import random

from tagloom.llm import substring_dedup
from tests.llm import brute


def same(got, want):
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_odd_rows_match_brute_force(spark, odd, pairs):
    same([tuple(r) for r in substring_dedup.dedup(spark, odd).collect()], brute.substring_dedup(pairs))


def test_random_overlaps_match_brute_force(spark):
    """Passages of every length around the threshold, spliced at random."""
    r = random.Random(9)
    pool = [f"w{i}" for i in range(400)]
    stock = [[r.choice(pool) for _ in range(r.choice([49, 50, 51, 60, 90, 130]))] for _ in range(12)]
    rows = []
    for d in range(80):
        w = []
        for _ in range(r.randint(1, 4)):
            s = r.choice(stock)
            a = r.randrange(0, 30)
            w += s[a:a + r.randint(20, 120)] + [r.choice(pool) for _ in range(r.randint(0, 20))]
        rows.append((r.randrange(60), " ".join(w)))
    got = substring_dedup.dedup(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()
    same([tuple(x) for x in got], brute.substring_dedup(rows))


def test_small_alphabet_and_short_windows(spark):
    """Ties in the winnowing and repeats inside documents; another threshold."""
    r = random.Random(10)
    rows = [(d, " ".join(r.choice("ab") for _ in range(r.randint(0, 60)))) for d in range(40)] + [(41, "a " * 80), (40, "a " * 90)]
    got = substring_dedup.dedup(spark, spark.createDataFrame(rows, "doc_id long, text string"), least=10, q=3).collect()
    same([tuple(x) for x in got], brute.substring_dedup(rows, 10))


def test_kept_text(spark, odd, pairs):
    rows = substring_dedup.dedup(spark, odd, with_text=True).collect()
    for r in rows:
        assert (r["kept"] is None) == (r["n_removed"] == 0)
        if r["kept"] is not None:
            assert len(brute.WORDS.findall(r["kept"])) == r["n_words"] - r["n_removed"]


def test_empty_table(spark, none):
    assert substring_dedup.dedup(spark, none).count() == 0


def test_ranges_of_repeated_rows_are_listed_once(spark):
    ranges = spark.range(3000).selectExpr("id % 1 + 1 AS doc_id", "id % 1 + 2 AS digest", "CAST(id % 3 * 10 AS int) AS s", "CAST(id % 3 * 10 + 5 AS int) AS e")
    out = substring_dedup.merge_ranges(ranges)
    assert [tuple(r) for r in out.collect()] == [(1, 2, [0, 10, 20], [5, 15, 25], 15)]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate [") == 2  # the ranges, then a list of them
