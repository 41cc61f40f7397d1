import random

import pytest

from tagloom.llm import decontaminate
from tests.conftest import SF_SMALL
from tests.llm import brute
from tests.llm.conftest import sentence

ITEMS = "item_id long, text string, doc_id string, n int, hashes string"


def got(df):
    return {(r["doc_id"], r["item_id"]): round(r["containment"], 9) for r in df.collect()}


def want(found):
    return {k: round(v, 9) for k, v in found.items()}


@pytest.fixture(scope="module")
def items():
    r = random.Random(1)
    rows = [(i, sentence(900 + i, n)) for i, n in enumerate([1, 2, 3, 4, 5, 6, 7, 9, 14, 20, 33, 60, 120])]
    rows += [(50, rows[9][1]), (51, rows[9][1].upper() + "!"), (52, None), (53, "?!"), (54, ""), (None, rows[10][1]), (55, "a b a b a b a b a b a b")]
    return rows


@pytest.fixture(scope="module")
def docs(items):
    r = random.Random(2)
    rows = []
    for d in range(120):
        words = sentence(2000 + d, r.randint(0, 150)).split()
        for _ in range(r.randint(0, 2)):
            w = (r.choice(items)[1] or "").split()
            for _ in range(r.choice([0, 0, 1, 2])):  # a few words changed: at or below the threshold
                if w:
                    w[r.randrange(len(w))] = "changed"
            at = r.randint(0, len(words))
            words[at:at] = w
        rows.append((d, " ".join(words)))
    return rows + [(None, items[10][1]), (None, None), (3, items[11][1]), (3, items[11][1]), (200, ""), (201, "b a b a b a b a b"), (202, sentence(1, 30000) + " " + items[12][1] + "." + sentence(2, 30000))]


def frame(spark, rows, schema="doc_id long, text string, item string, digest string, item_id string, n string"):
    width = schema.count(",") - 1
    return spark.createDataFrame([(*r, *[None] * width) for r in rows], schema).repartition(3)


def item_frame(spark, rows):
    return spark.createDataFrame([(*r, "d", 1, "h") for r in rows], ITEMS)


@pytest.mark.parametrize("most", [0, 500_000])
def test_matches_brute_force(spark, docs, items, most, monkeypatch):
    """With every table broadcast, and with none."""
    monkeypatch.setattr(decontaminate, "MOST", most)
    df = decontaminate.pairs_of(spark, frame(spark, docs), item_frame(spark, items))
    assert got(df) == want(brute.contained(docs, items)) and len(got(df)) > 40


@pytest.mark.parametrize("threshold,width", [(0.5, 5), (1.0, 5), (0.8, 3), (0.3, 2)])
def test_other_thresholds(spark, docs, items, threshold, width):
    df = decontaminate.pairs_of(spark, frame(spark, docs), item_frame(spark, items), threshold, width)
    assert got(df) == want(brute.contained(docs, items, threshold, width))


def test_whole_table(spark):
    docs, items = (spark.read.parquet(f"{SF_SMALL}/{t}.parquet") for t in ("documents", "benchmark"))
    df = decontaminate.pairs_of(spark, docs, items)
    assert got(df) == want(brute.contained([(r["doc_id"], r["text"]) for r in docs.collect()], [(r["item_id"], r["text"]) for r in items.collect()]))


def test_sketch_of_a_partition_always_meets_a_contaminated_document(spark):
    """Any way of losing the share that the threshold allows leaves a sketch hash."""
    rows = decontaminate.item_table(item_frame(spark, [(n, sentence(n, n + 4)) for n in range(1, 90)]), 5, "item_id", "text")
    size = {r["item"]: len(r["hashes"]) for r in rows.collect()}
    sketch = {r["item"]: r["count"] for r in decontaminate.sketches(rows, 0.8).groupBy("item").count().collect()}
    for item, n in size.items():
        lost = n - -(-8 * n // 10)
        assert sketch[item] > lost


def test_keep_clean(spark, docs, items):
    table = frame(spark, docs)
    kept = decontaminate.keep_clean(spark, table, item_frame(spark, items))
    assert kept.columns == table.columns
    bad = {d for d, _ in brute.contained([(i, t) for i, (_, t) in enumerate(docs)], items)}
    assert sorted(str((r["doc_id"], r["text"])) for r in kept.collect()) == sorted(str(x) for i, x in enumerate(docs) if i not in bad)


def test_empty_tables(spark, docs, items, none):
    assert decontaminate.pairs_of(spark, none, item_frame(spark, items)).count() == 0
    assert decontaminate.pairs_of(spark, frame(spark, docs), item_frame(spark, [])).count() == 0
    assert decontaminate.keep_clean(spark, none, item_frame(spark, items)).count() == 0


def test_no_python_in_the_plan(spark, docs, items):
    plan = decontaminate.pairs_of(spark, frame(spark, docs), item_frame(spark, items))._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "Cartesian", "NestedLoop"))


def test_broadcasts_are_admitted_by_bytes(spark, monkeypatch):
    wide = spark.createDataFrame([(i, "x" * 1000) for i in range(50)], "item long, s string")

    def hinted(df):
        return "broadcast" in decontaminate.small(df)._jdf.queryExecution().logical().toString()

    assert hinted(wide) and hinted(wide.limit(0))
    monkeypatch.setattr(decontaminate, "MOST_BYTES", 40_000)
    assert not hinted(wide) and hinted(wide.select("item"))


def test_repeated_rows_and_many_items_a_document(spark):
    """A document's shingles count once, however often its row repeats, for each of many items."""
    parts = [sentence(3000 + i, 12) for i in range(60)]
    text = " ".join(parts)
    df = decontaminate.pairs_of(spark, frame(spark, [(1, text)] * 40 + [(2, text)]), item_frame(spark, list(enumerate(parts))))
    assert got(df) == want(brute.contained([(1, text), (2, text)], list(enumerate(parts)))) and df.count() == 120
