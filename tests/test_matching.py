"""Whole-word phrase matching: parity with Python's re \\b search, quirks."""

import random
import re

from pyspark.sql import functions as F

from tagloom import lexicon as L
from tagloom.functions.text import boundary_regex, first_token
from tagloom.operators import matching as M


def py_matches(text, phrases):
    out = []
    for p in dict.fromkeys(phrases):
        if re.search(rf"\b{re.escape(p)}\b", text.lower(), re.IGNORECASE):
            out.append(p)
    return out


def run(spark, texts, phrases):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string")
    got = {r.id: r.keywords for r in M.keyword_match(df, "text", phrases, keep_empty=True).collect()}
    return [got[i] for i in range(len(texts))]


def test_overlapping_phrases_both_reported(spark):
    got = run(spark, ["I tried OG Kush and kush again", "og-kush", "Bubba Kush!"], ["kush", "OG Kush", "Bubba Kush"])
    assert got == [["kush", "OG Kush"], ["kush"], ["kush", "Bubba Kush"]]


def test_punctuated_and_curly_quote_phrases(spark):
    texts = ["delta-8 works", "delta 8 works", "delta-88 no", "Charlotte’s Web tincture", "2-AG levels", "x2-AG no"]
    phrases = ["delta-8", "delta 8", "Charlotte’s Web", "2-AG"]
    assert run(spark, texts, phrases) == [py_matches(t, phrases) for t in texts]


def test_accents_and_combining_marks_are_word_characters(spark):
    texts = ["thé noir", "the noir", "éthe", "thé", "naïve the", "_the_", "the_"]
    assert run(spark, texts, ["the"]) == [py_matches(t, ["the"]) for t in texts]


def test_duplicate_lexicon_entries_are_reported_once(spark):
    assert run(spark, ["HHC vape"], ["HHC", "THC", "HHC"]) == [["HHC"]]


def test_random_texts_match_python(spark):
    rng = random.Random(7)
    words = ["thc", "THC", "cbd", "delta", "8", "-", "og", "kush", "é", "x", "’", "web", "charlotte", "_", "2", "ag"]
    seps = [" ", "", "-", ".", "\n", "’", "é"]
    texts = ["".join(rng.choice(words) + rng.choice(seps) for _ in range(rng.randint(1, 12))) for _ in range(400)]
    phrases = ["THC", "CBD", "delta 8", "delta-8", "OG Kush", "kush", "Charlotte’s Web", "2-AG"]
    assert run(spark, texts, phrases) == [py_matches(t, phrases) for t in texts]


def test_full_filtering_lexicon_on_documents(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    got = {r.doc_id: r.keywords for r in M.keyword_match(d, "text", L.FILTERING_PHRASES).collect()}
    for r in d.collect():
        assert got.get(r.doc_id, []) == py_matches(r.text, L.FILTERING_PHRASES)


def test_join_plan_equals_inline_plan(spark, monkeypatch):
    texts = ["OG Kush and thc", "delta-8 thc", "nothing here", "charlotte’s web"]
    phrases = ["THC", "OG Kush", "kush", "delta-8", "Charlotte’s Web"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string")
    inline = {r.id: r.keywords for r in M.keyword_match(df, "text", phrases).collect()}
    lex = L.lexicon_df(spark, "custom", phrases)
    monkeypatch.setattr(M, "MAX_INLINE", 2)
    joined = {r.id: r.keywords for r in M.keyword_match(df, "text", lex).collect()}
    assert joined == inline


def test_boundary_regex_shapes():
    assert first_token("Charlotte’s Web") == "charlotte"
    assert first_token("-x") is None
    assert boundary_regex("2-AG").endswith("(?![\\p{L}\\p{N}_])")


def test_title_first_rule(spark):
    df = spark.createDataFrame([("THC in title", "cbd body"), ("plain title", "cbd body"), ("x", "y")], "title string, body string")
    out = M.title_first_match(df, "title", "body", ["THC", "CBD"]).collect()
    assert [r.keywords for r in out] == [["THC"], ["CBD"]]


def test_dosage_percent_quirk(spark):
    df = spark.createDataFrame([("5mg thc", ""), ("5% thc", ""), ("5%thc", ""), ("2.5 ml cbd", ""), ("10 mgs thc", "")],
                               "body string, t string")
    got = [r.body for r in M.dosage_filter(df, None, "body", ["THC", "CBD"], L.DOSAGE_PATTERN).collect()]
    assert got == ["5mg thc", "5%thc", "2.5 ml cbd"]
    fixed = [r.body for r in M.dosage_filter(df, None, "body", ["THC", "CBD"], L.DOSAGE_PATTERN, percent_fix=True).collect()]
    assert "5% thc" in fixed


def test_mark_keywords_sequential(spark):
    df = spark.createDataFrame([("THC and thc, not thcv", ["thc"])], "text string, kws array<string>")
    assert df.select(M.mark_keywords(F.col("text"), F.col("kws")).alias("m")).first().m == \
        "<mark>THC</mark> and <mark>thc</mark>, not thcv"


def test_regex_label_match_sorted_distinct(spark):
    df = spark.createDataFrame([("The pain and the sleep",)], "text string")
    out = M.regex_label_match(df, "text", [("pain", "pain"), ("sleep", "sleep"), ("ache|pain", "pain")]).first()
    assert out.keyword == "pain; sleep"


def test_phrases_opening_with_punctuation_both_plans(spark, monkeypatch):
    texts = ["x.5mg dose", " .5mg dose", "a-thc", "-thc alone", "ok #weed now", "a#weed"]
    phrases = [".5mg", "-thc", "#weed", "dose"]
    want = [py_matches(t, phrases) for t in texts]
    assert run(spark, texts, phrases) == want
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string")
    monkeypatch.setattr(M, "MAX_INLINE", 2)
    got = {r.id: r.keywords for r in M.keyword_match(df, "text", L.lexicon_df(spark, "custom", phrases), keep_empty=True).collect()}
    assert [got[i] for i in range(len(texts))] == want


def big_lexicon(n):
    """n phrases: single words, multi-word, punctuated, punctuation-first and -only, overlapping, a duplicate."""
    rng = random.Random(n)
    words = ["".join(rng.choice("abcdeghinorst") for _ in range(rng.randint(2, 4))) for _ in range(400)]
    make = [lambda: rng.choice(words), lambda: rng.choice(words) + " " + rng.choice(words), lambda: rng.choice(words) + "-" + rng.choice(words).title(),
            lambda: "." + rng.choice(words), lambda: "#" + rng.choice(words) + " " + rng.choice(words), lambda: "’".join(rng.sample(words, 2))]
    out = ["-", "--", "’"] + [rng.choice(make)() for _ in range(n - 4)]
    return out + [out[0]], words


def test_one_behaviour_at_any_lexicon_size(spark, monkeypatch):
    """5, 131 and 5,000 phrases: in-row, joined by broadcast and joined by a salted shuffle."""
    for n in (5, 131, 5000):
        phrases, words = big_lexicon(n)
        rng = random.Random(1)
        texts = ["".join(rng.choice(words) + rng.choice([" ", "-", ".", "#", "’", " #", "--", " "]) for _ in range(30)) + rng.choice(phrases) for _ in range(60)]
        texts += [texts[0], "", None]
        want = [py_matches(t, phrases) if t else [] for t in texts]
        assert sum(map(len, want)) > 40 if n > 5 else True
        df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string")
        lexicons = [phrases, M.lexicon_frame(spark, phrases)]
        for inline, broadcast in ((20_000, 200_000), (2, 200_000), (2, 2)):
            monkeypatch.setattr(M, "MAX_INLINE", inline)
            monkeypatch.setattr(M, "MAX_BROADCAST_LEXICON", broadcast)
            for lex in lexicons:
                got = {r.id: r.keywords for r in M.keyword_match(df, "text", lex, keep_empty=True).collect()}
                assert [got[i] for i in range(len(texts))] == want, (n, inline, broadcast)


def test_title_first_and_dosage_with_a_joined_lexicon(spark, monkeypatch):
    monkeypatch.setattr(M, "MAX_INLINE", 1)
    test_title_first_rule(spark)
    test_dosage_percent_quirk(spark)


def test_duplicates_can_be_kept(spark, monkeypatch):
    df = spark.createDataFrame([("HHC vape",)], "text string")
    for inline in (20_000, 1):
        monkeypatch.setattr(M, "MAX_INLINE", inline)
        assert M.keyword_match(df, "text", ["HHC", "vape", "HHC"], dedupe=False).first().keywords == ["HHC", "vape", "HHC"]
