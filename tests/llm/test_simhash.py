import random

import numpy as np
import pytest

from tagloom.llm import simhash
from tests.conftest import SF_SMALL
from tests.llm import brute


def key(t):
    return tuple((x is None, x or 0) for x in t)


def test_odd_rows_match_brute_force(spark, odd, pairs):
    got = [tuple(r) for r in simhash.near_duplicates(spark, odd).collect()]
    assert sorted(got, key=lambda t: (str(t))) == sorted(brute.near_duplicates(pairs), key=lambda t: str(t))


def test_whole_table_matches_brute_force(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    got = sorted(tuple(r) for r in simhash.near_duplicates(spark, docs).collect())
    assert got == sorted(brute.near_duplicates([(r["doc_id"], r["text"]) for r in docs.collect()]))


def test_empty_table(spark, none):
    assert simhash.near_duplicates(spark, none).count() == 0
    assert simhash.keep_one(spark, none).count() == 0


@pytest.mark.parametrize("tile", [4, 4096])
def test_tiles_keep_every_link(spark, tile):
    """A cluster far above the tile: the same components, no pair lost."""
    r = random.Random(5)
    centre = [r.getrandbits(64) for _ in range(6)]
    fps = sorted({c ^ sum(1 << b for b in r.sample(range(64), r.randint(0, 5))) for c in centre for _ in range(40)})
    classes = spark.createDataFrame([(simhash.signed(f),) for f in fps], "fp long")
    links = simhash.near_links(spark, classes, 4, tile)
    assert links.count() <= 15 * len(fps) * (1 if tile > len(fps) else len(fps))
    for a, b in links.collect():
        assert bin((a ^ b) & (2 ** 64 - 1)).count("1") <= 4
    root = {x["node"]: x["root"] for x in simhash.components(spark, links).collect()}
    group = brute.components(fps)
    mine = [root.get(simhash.signed(f), simhash.signed(f)) for f in fps]
    assert len(set(zip(mine, group))) == len(set(mine)) == len(set(group))


def test_pivot_filter_never_discards_a_near_pair():
    r = random.Random(6)
    for _ in range(300):
        a = r.getrandbits(64)
        b = a ^ sum(1 << i for i in r.sample(range(64), 4))
        assert all(abs(bin(a ^ p).count("1") - bin(b ^ p).count("1")) <= 4 for p in simhash.PIVOTS)


def test_one_group_returns_a_forest():
    fp = np.arange(16, dtype=np.uint64)  # all within 4 bits of one another
    links = simhash.links_of(np.zeros(16, np.int64), np.zeros(16, np.int32), fp, np.zeros((16, 16), np.int8), 4)
    assert len(links) == 15


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 499)], "a long, b long")
    got = {r["node"]: r["root"] for r in simhash.components(spark, edges).collect()}
    assert got == {i: 0 for i in range(1, 201)} | {500: 499}


def test_keep_one_row_of_each_group(spark, odd, pairs):
    kept = simhash.keep_one(spark, odd)
    assert kept.columns == odd.columns
    want = brute.near_duplicates(pairs)
    groups = {(g if g is not None else f) for _, f, g in want}
    rows = kept.collect()
    assert len(rows) == len(groups)
    ids = {g for _, _, g in want if g is not None}
    assert {r["doc_id"] for r in rows if r["doc_id"] is not None} == ids


def test_repeats_of_a_kept_row_meet_map_side(spark, odd):
    plan = simhash.keep_one(spark, odd)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "partial_first" in plan
