"""Statistics, agreement, evaluation and span operators on hand-made rows."""

import math
import re

import pytest
from pyspark.sql import functions as F

from tagloom.operators import agreement as AG
from tagloom.operators import evaluation as EV
from tagloom.operators import spans as SP
from tagloom.operators import stats as ST
from tagloom.operators import subsets as SU


def test_hit_rates_count_non_null_and_empty_keyword_group(spark):
    df = spark.createDataFrame([(1, "a;b", 1), (2, None, 0), (3, "a", None)], "id int, keyword string, label int")
    ex = ST.explode_keywords(df, "keyword", "semicolon")
    r = {x.keyword: (x["count"], x.hit_rate) for x in ST.hit_rates(ex, "keyword", "label").collect()}
    assert r == {"a": (1, 1.0), "b": (1, 1.0), "": (1, 0.0)}


def test_kappa_single_label_is_null_and_zero_rows(spark):
    m = spark.createDataFrame([(1, 1), (1, 1)], "label_1 int, label_2 int")
    r = AG.cohen_kappa(m).first()
    assert (r.n, r.agreement, r.agreement_rate, r.kappa) == (2, 2, 1.0, None)
    e = AG.cohen_kappa(spark.createDataFrame([], "label_1 int, label_2 int")).first()
    assert (e.n, e.agreement_rate, e.kappa) == (0, 0.0, None)


def test_kappa_value(spark):
    rows = [(1, 1)] * 20 + [(1, 0)] * 5 + [(0, 1)] * 10 + [(0, 0)] * 15
    r = AG.cohen_kappa(spark.createDataFrame(rows, "label_1 int, label_2 int")).first()
    po, pe = 35 / 50, (25 / 50) * (30 / 50) + (25 / 50) * (20 / 50)
    assert abs(r.kappa - (po - pe) / (1 - pe)) < 1e-9


def test_gold_eval_zero_denominators(spark):
    preds = spark.createDataFrame([(1, "gpt", 0), (2, "gpt", 0)], "id int, model string, relevance_pred int")
    gold = spark.createDataFrame([(1, 0, 1), (2, 0, 1)], "id int, relevance_true int, is_test int")
    r = EV.gold_eval(preds, gold).first()
    assert (r.precision, r.recall, r.f1, r.correct) == (0.0, 0.0, 0.0, 2)


def test_classical_models_only_see_test_rows(spark):
    preds = spark.createDataFrame([(1, "logreg", 1), (2, "logreg", 1)], "id int, model string, relevance_pred int")
    gold = spark.createDataFrame([(1, 1, 1), (2, 1, 0)], "id int, relevance_true int, is_test int")
    assert EV.gold_eval(preds, gold).first().n_eval == 1


def test_mode_ties_take_lowest(spark):
    p = spark.createDataFrame([(1, 0), (1, 1), (2, 1), (2, 1), (2, 0)], "id int, predicted_label int")
    r = {x.id: (x.mode_label, x.disagreeing_models) for x in EV.model_disagreement(p).collect()}
    assert r == {1: (0, 1), 2: (1, 1)}


def test_merge_spans_touching_and_priority(spark):
    s = spark.createDataFrame([(1, 0, 3), (1, 3, 5), (1, 7, 9), (1, 8, 12)], "id int, start int, end int")
    m = sorted((r.start, r.end) for r in SP.merge_spans(s, ["id"]).collect())
    assert m == [(0, 5), (7, 12)]
    k = s.withColumn("kind", F.lit("b"))
    p = sorted((r.start, r.end) for r in SP.span_priority(k, ["id"], "kind").collect())
    assert p == [(0, 3), (3, 5), (7, 9)]


def test_keyword_context_merges_ranges(spark):
    text = "A. B thc. C. D. E. F. G. H thc. I."
    df = spark.createDataFrame([(1, text, ["THC"])], "id int, text string, kws array<string>")
    r = [(x.range_start, x.range_end) for x in SP.keyword_context(df, "id", "text", "kws").orderBy("range_no").collect()]
    assert r == [(0, 4), (5, 9)]


def test_annotation_rows_running_number(spark):
    e = spark.createDataFrame([(1, [{"c": "x"}, {"c": "y"}]), (2, []), (3, [{"c": "z"}])],
                              "id long, ann array<struct<c:string>>")
    out = sorted((r.annotation_id, r.no_annotations) for r in SP.annotation_rows(e, "id", "ann", "id", ["c"]).collect())
    assert out == [("1_0", False), ("1_1", False), ("2_0", True), ("3_2", False)]


def test_upsert_is_idempotent(spark):
    old = spark.createDataFrame([(1, "m", "v", 0, 1), (2, "m", "v", 1, 1)], "id int, model string, version string, label int, batch int")
    new = spark.createDataFrame([(1, "m", "v", 1, 2)], "id int, model string, version string, label int, batch int")
    once = SU.upsert(old, new, ["id", "model", "version"])
    twice = SU.upsert(once, new, ["id", "model", "version"])
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect())) == [(1, "m", "v", 1, 2), (2, "m", "v", 1, 1)]


def test_relevant_irrelevant_sum(spark):
    df = spark.createDataFrame([("a", 1), ("a", 0), ("a", None), ("a", 1)], "keyword string, label int")
    r = {x.label: x["count"] for x in ST.relevant_irrelevant_long(df, ["keyword"], "label").collect()}
    assert r == {"relevant": 2, "irrelevant": 1}


def test_equal_spans_keep_the_highlight(spark):
    rows = [(1, 0, 5, "bold"), (1, 0, 5, "highlight"), (1, 0, 3, "highlight"), (1, 5, 6, "bold"), (1, 5, 6, "other")]
    p = sorted((r.start, r.end, r.kind) for r in SP.span_priority(spark.createDataFrame(rows, "id int, start int, end int, kind string"), ["id"], "kind").collect())
    assert p == [(0, 5, "highlight"), (5, 6, "bold")]


def test_highlight_and_bold_sources(spark):
    df = spark.createDataFrame([(1, "Pain, painful PAIN and thc", "pain", None, ["pain", "thc", "and t"])],
                               "id int, text string, source_symptom string, source_compound string, kws array<string>")
    s = SP.highlight_and_bold(df, ["id"], "text", ["source_symptom", "source_compound"], "kws")
    got = sorted((r.start, r.end, r.kind, r.field) for r in s.collect())
    assert got == [(0, 4, "bold", None), (0, 4, "highlight", "symptom"), (6, 10, "highlight", "symptom"),
                   (14, 18, "bold", None), (14, 18, "highlight", "symptom"), (23, 26, "bold", None)]


def test_kappa_with_labels_on_one_side_only(spark):
    rows = [(1, 2)] * 3 + [(3, 3)] * 4 + [(1, 1)] * 2
    r = AG.cohen_kappa(spark.createDataFrame(rows, "label_1 int, label_2 int")).first()
    po, pe = 6 / 9, (5 * 2 + 0 * 3 + 4 * 4) / 81
    assert r.agreement == 6 and abs(r.kappa - (po - pe) / (1 - pe)) < 1e-9


def test_null_predictions_differ_from_the_mode(spark):
    p = spark.createDataFrame([(1, 0), (1, None), (1, 0), (2, None)], "id int, predicted_label int")
    r = [(x.id, x.mode_label, x.disagreeing_models, x.total_models) for x in EV.model_disagreement(p).collect()]
    assert r == [(1, 0, 1, 2)]


def test_self_metrics(spark):
    full = spark.createDataFrame([(1, 1), (2, 0), (3, 1), (4, None)], "id int, relevance int")
    r = EV.self_metrics(full, full.filter("id < 3")).first()
    assert (r.total, r.relevant, r.all_relevant, r.precision, r.recall, r.f1) == (2, 1, 2, 0.5, 0.5, 0.5)


def test_scorer_errors_stay_with_their_row(spark):
    from tagloom.operators import ml as ML

    def scorer(texts):
        if "bad" in texts:
            raise ValueError("no")
        return [t.upper() for t in texts]

    df = spark.createDataFrame([("a",), ("bad",), ("c",)], "text string").coalesce(1)
    got = sorted((r.text, r.score, r.error) for r in ML.score_texts(df, scorer).collect())
    assert got == [("a", "A", None), ("bad", None, "ValueError: no"), ("c", "C", None)]


def test_upsert_of_a_key_twice_in_one_batch_is_defined(spark):
    rows = [(1, 0, 2), (1, 5, 2), (1, 9, 1)]
    df = spark.createDataFrame(rows, "id int, label int, batch int")
    assert SU.upsert(df.limit(0), df, ["id"]).first().label == 5


def _terms_corpus(spark, seed=3):
    import random
    r = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(words[int(400 * r.random() ** 3)] for _ in range(r.randint(0, 80)))) for i in range(400)] + [(900, None), (901, "")]
    return spark.createDataFrame(rows, "id long, text string").repartition(6)


def test_sketched_vocabulary_equals_the_counted_one(spark, monkeypatch):
    """With any width, thus also where collisions fill the sketch or the first
    threshold is wrong, no term is lost and every count is exact."""
    from tagloom.operators import ml as ML
    terms = ML.term_lists(_terms_corpus(spark), "id", "text", 2, False)
    want = {k: [tuple(r) for r in ML.vocabulary(terms, "_t", k, 0).collect()] for k in (5, 60, 1_000_000)}
    monkeypatch.setattr(ML, "SKETCH_FROM", 0)
    for k, width in ((5, 1 << 12), (5, 64), (60, 64), (60, 1 << 14), (60, None), (1_000_000, 1 << 12)):
        assert [tuple(r) for r in ML.vocabulary(terms, "_t", k, 1, width).orderBy(F.desc("tf"), "term").collect()] == want[k]


def test_sketch_keeps_rare_terms_out_of_the_exact_count(spark):
    from tagloom.operators import ml as ML
    from tagloom.session import written
    terms = ML.term_lists(_terms_corpus(spark), "id", "text", 2, False)
    sketch = written(spark, ML.term_sketch(terms, "_t", 1 << 14), "sketch")
    counts = {r.term: r.tf for r in ML.exact_counts(terms, "_t").collect()}
    kept = {r.term: r.tf for r in ML.exact_counts(ML.heavy_terms(terms, "_t", sketch, 1 << 14, 50), "_t").collect()}
    assert {t for t, n in counts.items() if n >= 50} <= set(kept) and len(kept) < len(counts) / 5
    assert all(counts[t] == n for t, n in kept.items()) and sketch.agg(F.sum("n")).first()[0] == 2 * sum(counts.values())
    assert ML.vocabulary(ML.term_lists(_terms_corpus(spark).limit(0), "id", "text", 2, True), "_t", 5, ML.SKETCH_FROM).count() == 0


def test_phrase_spans_equal_finditer_and_run_no_python(spark):
    import re
    from tagloom.operators import spans as SP
    r = __import__("random").Random(4)
    alphabet = "aAbB cC.-é É_9ßſ😀İ$(\\"
    rows = [(i, "".join(r.choice(alphabet) for _ in range(r.randint(0, 60))), ["".join(r.choice(alphabet) for _ in range(r.randint(1, 3))) for _ in range(4)] + ["a", "A", "a", "", None]) for i in range(250)]
    rows += [(900, None, ["a"]), (901, "aaa", None), (902, "ab" * 3000 + " a", ["a", "ab"]), (903, "x.y x.y", ["x.y", "."]), (903, "x.y", ["y"])]
    df = spark.createDataFrame(rows, "id long, text string, ps array<string>")
    for whole in (False, True):
        edge = r"\b" if whole else ""
        want = sorted((i, p, m.start(), m.end()) for i, t, ps in rows for p in dict.fromkeys(ps or ()) if t is not None and p
                      for m in re.finditer(edge + re.escape(p) + edge, t, re.IGNORECASE))
        got = SP.phrase_spans(df, "text", "ps", whole_word=whole)
        assert sorted((x.id, x.keyword, x.start, x.end) for x in got.collect()) == want
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_abbreviations_are_learnt(spark):
    text = "Dr. Smith took 5 mg. daily. It helped a lot. Then Dr. Jones, e.g. on Monday, took it. We saw it. The end was near. So it was."
    texts = [text] * 40 + ["A daily lot was near them all and it was so."] * 5 + [None, "", "... 12. !"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {r["abbreviation"]: (r["n_with"], r["n_without"], r["score"]) for r in SP.abbreviations(df, "text").collect()}
    assert {"dr", "mg", "e.g"} <= set(got) and not {"it", "end", "lot", "was", "near", "daily"} & set(got)

    counts = {}  # from the definition, token by token
    for t in texts:
        for token in (t or "").lower().split():
            m = re.fullmatch(r"[\"'(\[{]*([^\W\d_]+(?:\.[^\W\d_]+)*)(\.?)[\"',;:!?)\]}]*", token)
            if m:
                counts.setdefault(m[1], [0, 0])[not m[2]] += 1
    share = sum(a for a, _ in counts.values()) / sum(a + n for a, n in counts.values())
    want = {}
    for w, (a, n) in counts.items():
        ratio = 2 * (a * math.log(0.99 / share) + n * math.log(0.01 / (1 - share)))
        letters = len(w.replace(".", ""))
        score = ratio * math.exp(-letters) * (w.count(".") + 1) * letters ** -n
        if a and score >= 0.3:
            want[w] = (a, n, pytest.approx(score))
    assert got == want
    assert SP.abbreviations(df.limit(0), "text").count() == 0


def test_no_sentence_ends_behind_an_abbreviation(spark, monkeypatch):
    abbrevs = spark.createDataFrame([("dr",), ("mg",), ("e.g",)], "abbreviation string")
    texts = ["Seen by Dr. Smith. He took 5 mg. daily.\n It helped, e.g. a lot! Yes. ", "no break", "", None, "Dr. ", "(Dr. X) x.y. Z", "a mg.\t\n b? c", "mg mgs. Mg. m"]
    want = {"Seen by Dr. Smith. He took 5 mg. daily.\n It helped, e.g. a lot! Yes. ": ["Seen by Dr. Smith.", "He took 5 mg. daily.", "It helped, e.g. a lot!", "Yes.", ""], "no break": ["no break"], "": [""], None: None,
            "Dr. ": ["Dr. "], "(Dr. X) x.y. Z": ["(Dr. X) x.y.", "Z"], "a mg.\t\n b? c": ["a mg.\t\n b?", "c"], "mg mgs. Mg. m": ["mg mgs.", "Mg. m"]}
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    for most in (20_000, 0):  # in the plan, and joined
        monkeypatch.setattr(SP, "MOST_INLINE_ABBREVIATIONS", most)
        assert {r["text"]: r["_s"] for r in SP.learnt_sentences(df, "text", abbrevs).collect()} == want
    none = {r["text"]: r["_s"] for r in SP.learnt_sentences(df, "text", abbrevs.limit(0)).collect()}
    plain = {r["text"]: r["s"] for r in df.select("text", SP.sentences(F.col("text")).alias("s")).collect()}
    assert none == plain


def test_merge_spans_without_a_window(spark):
    """Packed spans against a plain walk: nested, touching, empty, repeated and
    null spans, null keys; no task sorts a row per span."""
    r = __import__("random").Random(7)
    rows = [(r.choice([1, 2, None]), s := r.randint(0, 400), s + r.randint(0, 6)) for _ in range(300)] + [(3, 5, 5), (3, 5, 5), (3, 5, 9), (4, None, 7), (4, None, 2), (4, 3, 9), (4, 11, None), (5, None, None)]
    got = SP.merge_spans(spark.createDataFrame(rows, "id int, start int, end int"), ["id"])
    want = []
    for k in (1, 2, None, 3):
        at = len(want)
        for _, s, e in sorted((x for x in rows if x[0] == k), key=lambda x: x[1:]):
            if len(want) > at and s <= want[-1][2]:
                want[-1] = (k, want[-1][1], max(e, want[-1][2]))
            else:
                want.append((k, s, e))
    want += [(4, 3, 9), (4, 11, None), (5, None, None)]  # a null start opens no island behind an end
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
    assert got.dtypes == [("id", "int"), ("start", "int"), ("end", "int")]
    assert "Window" not in got._jdf.queryExecution().executedPlan().toString()


def test_tokens_are_counted_before_they_are_taken_apart(spark):
    texts = ["Dr. Who", "dr. x (dr.) dr", None, "", "Dr. Who"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    out = SP.abbreviations(df, "text", -1e9)
    assert {(r.abbreviation, r.n_with, r.n_without) for r in out.collect()} == {("dr", 4, 1)}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [_t#" in plan
    # the last token of a piece says what the whole piece says
    pieces = ["Seen by (Dr.\t", "x e.g. \r\n", "a\rb.\n ", "no 5. ", "\"Mr. ", "end! ", "a.b.c. ", "1st. ", "é. ", ".. ", "u\u2028v. "]
    for p in pieces:
        row = spark.createDataFrame([(p + "Z", )], "t string")
        whole = row.select(F.regexp_extract(F.lower(F.lit(p)), SP.LAST_ABBREVIATION, 1)).first()[0]
        known = spark.createDataFrame([(whole or "none",)], "abbreviation string")
        assert len(SP.learnt_sentences(row, "t", known).first()["_s"]) == (1 if whole else 2), p


def test_span_priority_steps_once_a_span(spark):
    """Many spans of one key, empty and null ones, are picked without an array
    that is copied for each; the texts of both kinds are read once."""
    rows = [(1, i * 2, i * 2 + 3, "bold") for i in range(20_000)] + [(2, 4, 4, "bold"), (2, 4, 4, "highlight"), (2, 4, 4, "bold"), (2, None, 9, "bold"), (2, 5, None, "bold"), (2, 7, 8, "bold")]
    out = SP.span_priority(spark.createDataFrame(rows, "id int, start int, end int, kind string"), ["id"], "kind")
    got = sorted(map(tuple, out.where("id = 1").collect()))
    assert got == [(1, i * 4, i * 4 + 3, "bold") for i in range(10_000)]
    assert sorted(map(str, map(tuple, out.where("id = 2").collect()))) == sorted(map(str, [(2, 4, 4, "highlight"), (2, 4, 4, "bold"), (2, 5, None, "bold")]))
    assert "aggregate(" not in out._jdf.queryExecution().executedPlan().toString()
    df = spark.createDataFrame([(1, "a b a", "a", None), (1, None, "a", ["b"])], "id int, text string, source_x string, kws array<string>")
    both = SP.highlight_and_bold(df, ["id"], "text", ["source_x"], "kws")
    assert sorted((r.start, r.end, r.field, r.phrase, r.kind) for r in both.collect()) == [(0, 1, "x", "a", "highlight"), (4, 5, "x", "a", "highlight")]
    assert "Union" not in both._jdf.queryExecution().executedPlan().toString()


def test_terms_are_counted_by_batches(spark):
    from collections import Counter
    from tagloom.operators import ml as ML
    texts = ["aa bb aa", None, "", "bb cc the", "x aa", "Éa É_9 aa bb"] * 40
    terms = ML.term_lists(spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(3), "id", "text", 2, True)
    tf, df = Counter(), Counter()
    for r in terms.collect():
        tf.update(r["_t"] or ()), df.update(set(r["_t"] or ()))
    out = ML.exact_counts(terms, "_t")
    assert {r.term: (r.tf, r.df) for r in out.collect()} == {t: (n, df[t]) for t, n in tf.items()}
    assert "MapInArrow" in out._jdf.queryExecution().executedPlan().toString()
