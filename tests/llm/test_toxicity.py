import math
import re
import zlib

import numpy as np
import xxhash
from pyspark.sql import functions as F

from tagloom.llm import queries, toxicity
from tests.llm.conftest import row

SF_ACCURACY = "/root/testdata/sf0.1"  # enough labels for the rare terms


def fold(i, of):
    return zlib.crc32(str(i).encode()) % of


def plain_grams(text):
    w = [xxhash.xxh3_64_intdigest(x) for x in re.findall(r"[^\W_]+", (text or "").lower())]
    m = [int(x) for x in toxicity.MIX]
    cut = lambda x: x & (2 ** 64 - 1)
    mixed = [cut(a * m[0]) for a in w] + [cut(a * m[1]) ^ cut(b * m[2]) for a, b in zip(w, w[1:])] + [cut(a * m[3]) ^ cut(b * m[4]) for a, b in zip(w, w[2:])]
    return [cut((x ^ (x >> 29)) * m[0]) >> 34 for x in mixed]


def plain_fit(rows, p):
    """FTRL-proximal with one dict entry a coordinate."""
    z, n = {}, {}

    def weight(i):
        zi, l1 = z.get(i, 0.0), 0.0 if i == -1 else p.l1
        return 0.0 if abs(zi) <= l1 else (math.copysign(l1, zi) - zi) / ((p.beta + math.sqrt(n.get(i, 0.0))) / p.alpha + p.l2)

    for _ in range(p.epochs):
        for x, y in rows:
            at = [*x, -1]
            w = {i: weight(i) for i in at}
            g = 1 / (1 + math.exp(-max(-35.0, min(35.0, sum(w.values()))))) - y
            for i in at:
                s = (math.sqrt(n.get(i, 0.0) + g * g) - math.sqrt(n.get(i, 0.0))) / p.alpha
                z[i], n[i] = z.get(i, 0.0) + g - s * w[i], n.get(i, 0.0) + g * g
    return {i: weight(i) for i in z if i != -1 and weight(i)}, weight(-1)


def test_grams():
    for t in (None, "", "!?", "One", "one two", "Ä one_two THREE four 5"):
        assert toxicity.grams(t).tolist() == plain_grams(t)


def test_fit_is_ftrl_proximal():
    r = np.random.default_rng(1)
    rows = [(np.unique(r.integers(0, 60, 8)), int(r.random() < 0.4)) for _ in range(200)]
    p = toxicity.Params(alpha=0.5, l1=0.7, l2=0.3, epochs=3)
    m = toxicity.fit(rows, p)
    weights, bias = plain_fit([(x.tolist(), y) for x, y in rows], p)
    assert m.index.tolist() == sorted(weights) and math.isclose(m.bias, bias, rel_tol=1e-9)
    assert np.allclose(m.weight, [weights[i] for i in sorted(weights)])
    assert 0 < len(m.index) < 60  # L1 leaves coordinates out


def test_held_out_accuracy_and_scores(spark):
    got = {r["doc_id"]: r for r in queries.op2_toxicity(spark, SF_ACCURACY).collect()}
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{SF_ACCURACY}/labels.parquet").collect()}
    insults = {"trash", "pathetic", "idiot", "worthless", "disgusting", "stupid", "clown", "scum", "loser", "moron"}
    planted = {r["doc_id"] for r in spark.read.parquet(f"{SF_ACCURACY}/documents.parquet").collect() if len(insults & set(re.findall(r"\w+", (r["text"] or "").lower()))) >= 3}
    held = [d for d, r in got.items() if r["held_out"]]
    assert all(got[d]["held_out"] == (fold(d, 3) == 1) for d in got)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in got.values())
    clean = [d for d in held if labels.get(d) == 0]
    assert sum(got[d]["predicted"] for d in clean) <= 0.02 * len(clean)
    toxic = [d for d in held if d in planted]
    assert sum(got[d]["predicted"] for d in toxic) >= 0.95 * len(toxic)


def test_odd_rows_and_labels(spark, odd, none):
    labels = spark.createDataFrame([(10, 1, "a"), (10, 0, "a"), (11, 0, "a"), (None, 1, "a"), (30, None, "a"), (31, 7, "a"), (999, 1, "a"), (40, 0, "a")], "doc_id long, toxic int, text string")
    model = toxicity.train(odd, labels)
    rows = toxicity.score(spark, odd, model).collect()
    assert len(rows) == odd.count()
    by_id = {r["doc_id"]: r["score"] for r in rows}
    empty = 1 / (1 + math.exp(-model.bias))
    assert by_id[20] == by_id[21] == by_id[22] == empty and by_id[10] == by_id[11]
    kept = toxicity.keep_clean(spark, odd, model, 2.0)
    assert kept.columns == odd.columns and kept.count() == odd.count()
    assert toxicity.keep_clean(spark, odd, model, 0.0).count() == 0
    assert toxicity.score(spark, none, model).count() == 0


def test_nothing_to_learn_from(spark, odd, none):
    empty = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.train(odd, empty)
    assert {r["score"] for r in toxicity.score(spark, odd, model).collect()} == {0.5}
    labels = spark.createDataFrame([(10, 1)], "doc_id long, toxic int")
    assert toxicity.train(none, labels).bias == 0.0
    one = spark.createDataFrame([row(1, "spam")], odd.schema)
    assert toxicity.train(one, spark.createDataFrame([(1, 1)], "doc_id long, toxic int")).bias > 0


def test_sample_is_bounded(spark):
    docs = spark.createDataFrame([(i, f"text {i % 7}") for i in range(3000)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 7 == 0)) for i in range(3000)], "doc_id long, toxic int")
    m = toxicity.train(docs, labels, params=toxicity.Params(max_train_rows=300, l1=0.5))
    scored = {r["doc_id"]: r["score"] for r in toxicity.score(spark, docs, m).collect()}
    assert scored[0] > 0.7 and scored[1] < 0.3


def test_rare_term_of_a_larger_sample(spark):
    # 4 of 12,000 labelled rows hold the term: enough for a weight, but not what half of the rows hold
    rare = {9, 18, 20, 32}
    docs = spark.createDataFrame([(i, f"text {i % 7}" + " vile" * (i in rare)) for i in range(12_000)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i in rare)) for i in range(12_000)], "doc_id long, toxic int")
    m = toxicity.train(docs, labels)
    assert set(toxicity.grams("vile").tolist()) <= set(m.index.tolist())


def test_leaving_out_rare_slots_changes_no_weight(spark):
    r = np.random.default_rng(2)
    texts = [(i, " ".join(f"w{k}" for k in r.zipf(1.3, 12) % 400)) for i in range(300)]
    toxic = {i: int(" w1 w2" in t or "w5" in t.split()) for i, t in texts}
    m = toxicity.train(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(list(toxic.items()), "doc_id long, toxic int"))
    rows = sorted((xxhash.xxh64_intdigest(str(i)), np.unique(toxicity.grams(t)), toxic[i]) for i, t in texts)
    whole = toxicity.fit([(x, y) for _, x, y in rows], toxicity.Params())
    assert len(m.index) and m.index.tolist() == whole.index.tolist()
    assert np.allclose(m.weight, whole.weight) and math.isclose(m.bias, whole.bias)


def test_a_null_id_is_in_no_fold(spark, tmp_path):
    given = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    odd_one = given.limit(1).withColumn("doc_id", F.lit(None).cast("long"))
    given.unionByName(odd_one).write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet("/root/testdata/sf0.001/labels.parquet").write.parquet(str(tmp_path / "labels.parquet"))
    rows = queries.op2_toxicity(spark, str(tmp_path)).where("doc_id IS NULL").collect()
    assert [r["held_out"] for r in rows] == [False]


def test_one_labelled_id_on_many_rows(spark):
    """A row that repeats is one example, and other texts of one id are drawn from, too."""
    p = toxicity.Params(max_train_rows=400)
    labels = spark.createDataFrame([(i, i % 2) for i in range(100)], "doc_id long, toxic int")
    one = [(i, ("vile awful " if i % 2 else "kind gentle ") + f"words {i}") for i in range(100)]
    plain = toxicity.train(spark.createDataFrame(one, "doc_id long, text string"), labels, params=p)
    hot = toxicity.train(spark.createDataFrame(one + [one[7]] * 5000, "doc_id long, text string").repartition(8), labels.union(labels), params=p)
    assert plain.bias == hot.bias and list(plain.index) == list(hot.index) and list(plain.weight) == list(hot.weight)

    many = spark.createDataFrame(one + [(7, f"text {k} of an id") for k in range(5000)], "doc_id long, text string")
    sizes, fit = [], toxicity.releasable
    try:
        toxicity.releasable = lambda examples, params: (sizes.append(examples.count()), fit(examples, params))[1]
        toxicity.train(many, labels, params=p)
    finally:
        toxicity.releasable = fit
    assert 200 < sizes[0] < 600
