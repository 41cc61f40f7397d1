"""Boosted trees: Spark's own where no two splits are equal, the same however the rows are dealt."""

import uuid

import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagloom.operators import boosting
from tagloom.operators import ml as ML
from tagloom.session import checkpoint_path


@pytest.fixture(autouse=True)
def sparse(monkeypatch, request):
    """All sizes go to ``boosting``, but in a test of where it begins."""
    if "from" not in request.node.name:
        monkeypatch.setattr(ML, "SPARSE_FROM", -1)


def frame(spark, rows: list):
    """Rows (label, features)."""
    return spark.createDataFrame(rows, T.StructType([T.StructField("label", T.IntegerType()), T.StructField("features", VectorUDT())]))


def made(spark, rows: int, width: int, twins: bool, seed: int = 7):
    """Sparse rows with negative values; ``twins``: the second half of the
    features splits the rows exactly as the first half does."""
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((rows, width)) * (rng.random((rows, width)) < 0.4)
    x[:, width // 2:] = x[:, :width // 2] * 3 if twins else x[:, width // 2:]
    y = (x[:, 0] + x[:, 1] * x[:, 2] - x[:, 3] + rng.standard_normal(rows) > 0.8).astype(int)
    vectors = [Vectors.dense(v) if i % 3 == 0 else Vectors.sparse(width, [(int(j), float(v[j])) for j in np.flatnonzero(v)]) for i, v in enumerate(x)]
    return frame(spark, [(int(c), v) for c, v in zip(y, vectors)]).withColumn("id", F.monotonically_increasing_id())


def trees(model) -> list[str]:
    return model.toDebugString.split("\n")[1:]


def test_same_model_as_spark(spark):
    df = made(spark, 900, 12, False).repartition(3, "id")
    got = ML.train_gbt(df, max_iter=8, max_depth=2)
    n = {r.label: r["count"] for r in df.groupBy("label").count().collect()}
    weighted = df.withColumn("weight", F.when(F.col("label") == 1, F.lit(n[0] / n[1])).otherwise(1.0))
    want = GBTClassifier(weightCol="weight", maxIter=8, maxDepth=2, stepSize=0.3, seed=42).fit(weighted)
    p, q = ([r[0] for r in m.transform(df).orderBy("id").select(vector_to_array("probability")[1]).collect()] for m in (got, want))
    assert np.allclose(p, q, atol=1e-7)
    assert np.allclose(got.featureImportances.toArray(), want.featureImportances.toArray(), atol=1e-7)
    assert got.treeWeights == want.treeWeights and got.numFeatures == 12
    assert {k.name: v for k, v in got.extractParamMap().items() if k.name != "seed"} == {k.name: v for k, v in want.extractParamMap().items() if k.name != "seed"}
    a, b = (np.array([(r.id, r.rawCount, r.impurity, r.gain, *r.impurityStats) for r in nodes(spark, m)]) for m in (got, want))
    assert np.allclose(a, b, atol=1e-6)


def nodes(spark, model) -> list:
    """Of the fourth tree, as saved."""
    path = checkpoint_path(spark, f"gbt-test-{uuid.uuid4().hex}")
    model.write().save(path)
    return spark.read.parquet(f"{path}/data").where("treeID = 3").select("nodeData.*").orderBy("id").collect()


def test_equal_splits_do_not_depend_on_the_deal(spark):
    df = made(spark, 3000, 24, True)
    one, many = ML.train_gbt(df.repartition(1), max_iter=2), ML.train_gbt(df.repartition(7, "id"), max_iter=2)
    assert trees(one) == trees(many)
    assert not {int(f) for m in (one, many) for f in m.featureImportances.indices} & set(range(12, 24))  # the first of equals


def test_same_trees_in_small_pieces(spark, monkeypatch):
    """Many chunks a task, few entries and few nodes at once, bins
    met after a shuffle, margins kept anew every other tree."""
    df = made(spark, 2000, 10, False).repartition(3, "id")
    want = trees(ML.train_gbt(df, max_iter=3, max_depth=4))
    for name, v in (("DEALT_ROWS", 64), ("CHUNK_ROWS", 128), ("BLOCK", 100), ("NODES_AT_ONCE", 3), ("FOLD", 2), ("SMALL", 0)):
        monkeypatch.setattr(boosting, name, v)
    assert trees(ML.train_gbt(df, max_iter=3, max_depth=4)) == want


def test_an_entry_costs_no_width(spark):
    """A row of three entries among a hundred thousand features: its cells are three."""
    rng = np.random.default_rng(1)
    rows = [(int(c), Vectors.sparse(100_000, [(0, float(c + rng.random()))] + [(int(j), 1.0) for j in sorted(rng.choice(np.arange(1, 100_000), 2, replace=False))])) for c in rng.integers(0, 2, 200)]
    df = frame(spark, rows)
    splits = [[1.0]] + [[0.5]] * 99_999
    plan = boosting.Plan(np.zeros(100_000, int), np.ones(100_000, int), 1.0, 2.0 ** 30, 32, 0.3, 1000)
    chunks = boosting.chunked(df, "features", "label", splits, plan, 2).collect()
    assert sum(len(c.rows) for c in chunks) <= 600 and sum(len(c.positive) for c in chunks) == 200


def test_constant_features_and_one_class(spark):
    rows = [(1, Vectors.dense([2.0, 0.0])) for _ in range(20)]
    m = ML.train_gbt(frame(spark, rows), max_iter=2, max_depth=2)
    assert m.getNumTrees == 2 and all(t.numNodes == 1 for t in m.trees)


@pytest.mark.parametrize("labels", [[0, 1, None], [0, 1, 2]])
def test_labels_must_be_two(spark, labels):
    df = frame(spark, [(c, Vectors.dense([1.0])) for c in labels])
    with pytest.raises(ValueError):
        ML.train_gbt(df)


def test_sparse_rows_from_a_size_on(spark, monkeypatch):
    df, asked = made(spark, 120, 4, False), []
    monkeypatch.setattr(boosting, "fit", lambda train, gbt, pos, neg, w: asked.append((pos + neg, round(w * pos, 6) == neg)))
    assert ML.train_gbt(df, max_iter=1, max_depth=1).getNumTrees == 1 and not asked
    monkeypatch.setattr(ML, "SPARSE_FROM", 119)
    ML.train_gbt(df, max_iter=1, max_depth=1)
    assert asked == [(120, True)]
