import random
import re
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from tagloom.llm import phrases, queries
from tagloom.llm.common import read
from tests.llm.brute import ascii_lower


def pieces(text):
    return [re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0A-\x0D]", ascii_lower(text or ""))]


def counts(rows, longest=4):
    f, n = {}, {}
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for w in pieces(text):
            n[lang] = n.get(lang, 0) + len(w)
            for k in range(1, longest + 1):
                for i in range(len(w) - k + 1):
                    g = (lang, tuple(w[i:i + k]))
                    f[g] = f.get(g, 0) + 1
    return f, n


def brute(rows, least=30, longest=4, first=2000):
    f, n = counts(rows, longest)
    out = {}
    candidates = {g: a for g, a in f.items() if len(g[1]) > 1 and a >= least}
    gone = set()
    for (lang, w), a in candidates.items():
        for k in range(2, len(w)):
            for i in range(len(w) - k + 1):
                if 100 * a >= 80 * f[lang, w[i:i + k]]:
                    gone.add((lang, w[i:i + k]))
    for (lang, w), a in candidates.items():
        if (lang, w) not in gone:
            score, k = min((2000000 * a // (f[lang, w[:k]] + f[lang, w[k:]]), k) for k in range(1, len(w)))
            out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]]))
    return sorted((lang, i, p.decode(), -a, l, r, n[lang], -s) for lang, xs in out.items() for i, (s, a, p, l, r) in enumerate(sorted(xs)[:first], 1))


def got(spark, rows, **options):
    df = spark.createDataFrame([(*r, 1, "x", 2, 3) for r in rows], "lang string, text string, f long, phrase string, length int, range int").repartition(5)
    return sorted(tuple(r) for r in phrases.collocations(spark, df, **options).collect())


def corpus(seed, docs=120):
    r = random.Random(seed)
    words = ["a", "B", "the", "New", "york", "é", "ß", "\u3000", "x\x1cy", "City", "of"]
    out = []
    for _ in range(docs):
        text = ""
        for _ in range(r.randint(0, 60)):
            text += r.choice(words[:r.choice([3, 11])]) + r.choice([" ", " ", "  ", "\t", ", ", ". ", "\n", ":", ";!", "\u0085"])
        out.append((r.choice(["en", "de", None, "und", ""]), text))
    return out + [("en", None), (None, None), ("de", ""), ("en", " \t\n .,")]


@pytest.mark.parametrize("seed, least, share", [(1, 30, 0.2), (2, 5, 0.5), (3, 30, 0.0), (4, 8, 1.0), (5, 1, 0.3)])
def test_against_brute_force(spark, seed, least, share):
    """Any sample gives the exact result: none at all, a part, or everything."""
    rows = corpus(seed)
    assert got(spark, rows, least=least, share=share) == brute(rows, least)


def test_ties_hot_rows_and_a_cut_report(spark):
    rows = [("en", "one two three four five. one two three four")] * 400 + [("en", "b a c")] * 30 + [("en", "d e f")] * 30 + [("en", "x y")] * 29
    assert got(spark, rows) == brute(rows)
    assert got(spark, rows, first=3) == brute(rows, first=3)
    assert got(spark, rows, longest=2) == brute(rows, longest=2)


def test_a_long_text_and_an_empty_table(spark, monkeypatch):
    rows = [("en", "alpha beta gamma " * 20_000), ("en", "beta gamma, " * 500)]
    assert got(spark, rows) == brute(rows)
    assert got(spark, []) == []


def test_a_full_table_of_bits_only_counts_more(spark, monkeypatch):
    """A table far too small for its phrases lets too much through, no less."""
    monkeypatch.setattr(phrases, "TABLE_BITS", 64)
    rows = corpus(6)
    assert got(spark, rows, least=10, share=0.3) == brute(rows, 10)


def test_passes_and_counts_on_the_documents(spark):
    docs = read(spark, "/root/testdata/sf0.01", "documents")
    rows = [tuple(r) for r in docs.select("lang", "text").collect()]
    f, n = counts(rows)
    found, totals, passes = phrases.frequent(spark, docs)
    assert {(r.lang, tuple(r.phrase.split(" "))): r.f for r in found.collect()} == {g: a for g, a in f.items() if a >= 30}
    assert found.groupBy("lang", "phrase").count().where("count > 1").isEmpty()
    assert {r.lang: r.n for r in totals.collect()} == n and passes in (1, 2)
    assert sorted(tuple(r) for r in queries.op13_phrases(spark, "/root/testdata/sf0.01").collect()) == brute(rows)


def test_counts_beyond_64_bits_stay_exact(spark):
    big = 9_000_000_000_000_000_000
    row = spark.createDataFrame([(big, big, big - 1)], "a long, l long, r long")
    assert row.select(phrases.score()).first()[0] == 2000000 * big // (2 * big - 1)


def test_hash_of_a_phrase_is_that_of_the_count():
    texts = ["Hello big world, hello big"]
    for rows, _, names, hashes, length in phrases.counted(texts, "en", 4, None, None):
        for r, h in zip(rows.tolist(), hashes.tolist()):
            if length:
                assert phrases.phrase_hash("en", b" ".join(names[i] for i in r).decode()) == h


def test_a_sample_is_counted_by_hash(spark):
    """The hashes of a sample are those of its phrases, with their counts."""
    docs = spark.createDataFrame([("en", "a b c a b. a b"), ("de", "a b"), ("en", "")], "lang string, text string")
    want = {(phrases.phrase_hash(r.lang, r.phrase), r.f) for r in phrases.count_phrases(docs, 4).where("phrase <> ''").collect()}
    assert {(r.h % 2**64, r.f) for r in phrases.count_hashes(docs, 4).collect()} == want and len(want) > 8
    table = phrases.table_of(spark, phrases.count_hashes(docs, 4).select("h")).value
    assert table.has(__import__("numpy").array([h for h, _ in want], "uint64")).all()


def test_a_run_holds_no_object_a_word():
    """The words of a run are numbers in an array, not one object each."""
    text = " ".join(f"w{i % 3000}" for i in range(200_000))
    tracemalloc.start()
    ids, names = phrases.words_of([text, "", "A\t b.; c"])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 8 * len(text)
    words = [names[i] for i in ids.tolist()]
    assert words[:2] == [b"w0", b"w1"] and [w for w in words[200_000:] if w != b"\n"] == [b"a", b"b", b"c"]
    assert words[-2:] == [b"\n", b"c"] and b"" not in words


def test_rows_are_added_up_after_the_shuffle_only(spark):
    """No task holds a table of the rows it sends: nearly all are distinct."""
    docs = spark.createDataFrame([("en", "a b c a b. a b"), ("de", "a b"), ("en", "")], "lang string, text string")
    for counts in (phrases.count_hashes(docs, 4), phrases.count_phrases(docs, 4)):
        after, before = counts._jdf.queryExecution().executedPlan().toString().split("Exchange", 1)
        assert "HashAggregate" in after and "HashAggregate" not in before and "MapInArrow" in before


def table_with(*of):
    """A bit table of phrases of one language."""
    s = phrases.slots(np.array([phrases.phrase_hash("en", p) for p in of], np.uint64), 1 << 16)
    words = np.zeros(1 << 10, np.uint64)
    np.bitwise_or.at(words, (s >> np.uint64(6)).astype(np.int64), np.uint64(1) << (s & np.uint64(63)))
    return type("Shared", (), {"value": phrases.Table(1 << 16, words)})


def test_a_border_is_counted_by_number(spark):
    """Words travel for what the table holds alone; a border is its hashes."""
    docs = spark.createDataFrame([("en", "a b c a b. a b d"), ("en", "a b"), ("en", "")], "lang string, text string")
    rows = phrases.count_phrases(docs, 4, table_with("a", "b", "c", "a b")).collect()
    assert {(r.lang, r.phrase): r.f for r in rows if r.h is None} == {("en", ""): 10, ("en", "a"): 4, ("en", "b"): 4, ("en", "c"): 1, ("en", "a b"): 4}
    assert {r.h % 2**64: (r.phrase, r.f) for r in rows if r.h is not None} == {phrases.phrase_hash("en", p): (None, f) for p, f in (("d", 1), ("b c", 1), ("c a", 1))}


def test_an_expansion_counts_what_the_border_left_open(spark):
    """By their words: failures, and all that comes of them; nothing counted before."""
    docs = spark.createDataFrame([("en", "a b c a b. a b d"), ("en", "a b")], "lang string, text string")
    rows = phrases.count_phrases(docs, 4, table_with("a", "b", "c", "a b"), table_with("c a", "d")).collect()
    assert {(r.phrase, r.h): r.f for r in rows} == {(p, None): 1 for p in ("c a", "d", "b d", "a b d", "c a b")}


def test_long_phrases_of_a_sample_come_of_its_pairs(spark):
    """Counting long phrases of frequent pairs alone proposes the same phrases."""
    docs = spark.createDataFrame([r for r in corpus(7) if r[0] and r[1]], "lang string, text string")
    one = {r.h for r in phrases.count_hashes(docs, 4).where("f >= 9").collect()}
    pairs = phrases.count_hashes(docs, 2).where("f >= 9").select("h")
    longer = phrases.count_hashes(docs, 4, phrases.table_of(spark, pairs))
    assert {r.h for r in pairs.collect()} | {r.h for r in longer.where("f >= 9").collect()} == one
    assert 10 * longer.count() < phrases.count_hashes(docs, 4).count()


def test_phrases_are_told_apart_by_words_of_any_number():
    """Numbers of four words in one: also where they pass 64 bits."""
    r = np.random.default_rng(8)
    for size in (7, 1 << 16, 1 << 30):
        ids = (r.integers(0, 3, 400) * (size // 3)).astype(np.int32)
        at = np.flatnonzero(r.random(390) < 0.7)
        for length in (1, 2, 3, 4) if size < 1 << 30 else (2, 3, 4):
            want = {}
            for i in at.tolist():
                want[tuple(ids[i:i + length])] = want.get(tuple(ids[i:i + length]), 0) + 1
            rows, first, count = phrases.distinct(ids, at, length, size)
            assert dict(zip(map(tuple, rows), count)) == want
            assert (ids[at[first][:, None] + np.arange(length)] == rows).all()
