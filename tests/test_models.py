"""Models by their values: held-out accuracy, recomputed probabilities, save and load, SVD."""

import math
import re
import uuid

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from tagloom.operators import ml as ML
from tagloom.plans import catalog
from tagloom.session import checkpoint_path, written
from tests.conftest import SF_CHECK


@pytest.fixture(scope="module")
def fitted(spark):
    """Texts labelled by a thing that is in them (English or not), a fold held out."""
    docs = spark.read.parquet(f"{SF_CHECK}/documents.parquet").where("length(text) > 0")
    data = docs.select("doc_id", "text", (F.col("lang") == "en").cast("int").alias("label"), F.pmod(F.xxhash64("doc_id"), F.lit(4)).alias("fold"))
    data = written(spark, data.withColumn("text", F.substring("text", 1, 400)), "labelled")
    tf = ML.fit_tfidf(data.where("fold > 0"), "text", 300, 2)
    feats = written(spark, tf.transform(data).select("doc_id", "text", "label", "fold", "features"), "features")
    train = feats.where("fold > 0")
    models = {"logreg": ML.train_logreg(train, balanced=True), "svm": ML.train_svm(train.where("fold > 1"), train.where("fold = 1")), "gbt": ML.train_gbt(train, max_iter=10, max_depth=4)}
    return tf, feats, models


def test_held_out_accuracy(fitted):
    _, feats, models = fitted
    test = feats.where("fold = 0")
    n = test.count()
    share = test.where("label = 1").count() / n
    for name, m in models.items():
        out = m.transform(test)
        assert out.where("prediction = label").count() / n >= 0.95 > max(share, 1 - share) + 0.1, name
        assert set(test.columns) | {"rawPrediction", "probability", "prediction"} == set(out.columns), name


def test_logistic_probabilities_by_hand(fitted):
    """From a text's words and the saved numbers to the probability, without Spark."""
    tf, feats, models = fitted
    m = models["logreg"]
    w, place, drop = m.coefficients.toArray(), {t: i for i, t in enumerate(tf.vocab)}, set(ML.STOP_WORDS)
    for r in m.transform(feats.where("fold = 0").orderBy("doc_id").limit(40)).collect():
        words = [x for x in re.findall(r"[^\W]{2,}", r.text.lower()) if x not in drop]
        x = np.zeros(len(w))
        for t in words + [f"{a} {b}" for a, b in zip(words, words[1:])]:
            if t in place:
                x[place[t]] += tf.idf[place[t]]
        x /= np.linalg.norm(x) or 1.0
        assert abs(1 / (1 + math.exp(-(x @ w + m.intercept))) - r.probability[1]) < 1e-9


def test_svm_confidence_by_hand(fitted):
    _, feats, models = fitted
    svm, _, platt, _ = models["svm"].stages
    for r in models["svm"].transform(feats.where("fold = 0").orderBy("doc_id").limit(40)).collect():
        margin = svm.coefficients.toArray() @ r.features.toArray() + svm.intercept
        assert abs(1 / (1 + math.exp(-(platt.coefficients[0] * margin + platt.intercept))) - r.probability[1]) < 1e-9


def test_one_saved_model_each(spark, fitted):
    tf, feats, models = fitted
    texts = feats.where("fold = 0").select("doc_id", "text")
    for name, m in models.items():
        path = checkpoint_path(spark, f"model-{uuid.uuid4().hex}")
        ML.text_model(tf, m).write().save(path)
        got = {r.doc_id: (r.prediction, r.probability[1]) for r in PipelineModel.load(path).transform(texts).collect()}
        want = {r.doc_id: (r.prediction, r.probability[1]) for r in m.transform(feats.where("fold = 0")).collect()}
        assert got == want, name


def test_feature_weights_are_the_outermost(spark, fitted):
    tf, _, models = fitted
    pairs = sorted(zip(models["logreg"].coefficients.toArray().tolist(), tf.vocab), key=lambda x: (-x[0], x[1]))
    got = ML.feature_weights(spark, tf.vocab, models["logreg"].coefficients, 5).collect()
    assert [(r.weight, r.feature) for r in got if r.side == "positive"] == pairs[:5]
    assert [r.weight for r in got if r.side == "negative"] == [x for x, _ in reversed(pairs[-5:])]


def test_semantic_vectors_equal_an_exact_svd(spark, fitted):
    _, feats, _ = fitted
    rows = written(spark, feats.select("doc_id", "label", "fold", "features").repartition(3), "svd")
    basis = ML.semantic_basis(rows, k=4, extra=16, rounds=12)
    x = np.array([r[0] for r in rows.select(vector_to_array("features")).collect()])
    right = np.linalg.svd(x, full_matrices=False)[2][:4]
    for k in range(4):
        assert abs(abs(basis[:, k] @ right[k]) - 1) < 1e-3  # the same direction
    assert np.allclose(basis.T @ basis, np.eye(4), atol=1e-8) and (basis[np.abs(basis).argmax(axis=0), range(4)] > 0).all()
    for r in ML.semantic_vectors(rows, basis).limit(50).collect():
        y = r.features.toArray() @ basis
        assert np.allclose(r.embedding, y / (np.linalg.norm(y) or 1.0), atol=1e-9)
    # the vectors carry the classes
    f = ML.embedding_features(ML.semantic_vectors(rows, basis).drop("features"))
    out = ML.train_logreg(f.where("fold > 0")).transform(f.where("fold = 0"))
    assert out.where("prediction = label").count() / out.count() > 0.9


def test_semantic_basis_with_empty_tasks_and_dense_rows(spark):
    """Five rows in eight partitions, sparse and dense, with stored zeros."""
    x = [[1.0, 0, 2, 0], [0, 3, 0, 1], [2, 0, 4.5, 0], [0, 0, 0, 0], [0, 1, 0, 2]]
    rows = [(i, Vectors.dense(v) if i % 2 else Vectors.sparse(4, range(4), v)) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, ["id", "features"]).repartition(8)
    basis = ML.semantic_basis(df, k=2, extra=2, rounds=8)
    right = np.linalg.svd(np.array(x), full_matrices=False)[2][:2]
    assert all(abs(abs(basis[:, k] @ right[k]) - 1) < 1e-6 for k in range(2))
    got = {r.id: r.embedding for r in ML.semantic_vectors(df, basis).collect()}
    for i, v in enumerate(x):
        y = np.array(v) @ basis
        assert np.allclose(got[i], y / (np.linalg.norm(y) or 1.0))


def test_training_rows_are_spread(spark, tmp_path):
    """Some thousand gold rows are much work for a tree: they make more than one file."""
    ids = spark.range(6000)
    ids.select(F.col("id").alias("doc_id"), F.concat(F.lit("word"), F.col("id") % 7, F.lit(" other")).alias("text"), F.lit("en").alias("lang"),
               F.lit("s").alias("source"), F.lit(11).alias("n_chars")).write.parquet(f"{tmp_path}/documents.parquet")
    ids.select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("quality"), F.lit(0).alias("toxic")).write.parquet(f"{tmp_path}/labels.parquet")
    _, feats = catalog._text_model(spark, str(tmp_path))
    assert len(feats.inputFiles()) >= 3 and feats.count() == 6000
