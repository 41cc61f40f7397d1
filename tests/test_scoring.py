"""Durable scoring: every row once, also when a run ends half-way."""

import os
import time
import uuid

import pytest
from pyspark.errors import StreamingQueryException

from tagloom.session import checkpoint_path
from tagloom.streaming import scoring


@pytest.fixture
def root(spark):
    return checkpoint_path(spark, f"scoring-{uuid.uuid4().hex}")


def logging_scorer(log, die_after=None, fails=()):
    """Upper-cases; notes every text; ends its process at the first call after
    ``die_after`` texts were noted, once."""
    def score(texts):
        done = sum(1 for _ in open(log)) if os.path.exists(log) else 0
        if die_after is not None and done >= die_after and not os.path.exists(log + ".died"):
            open(log + ".died", "w").close()
            os._exit(1)
        if any(t in fails for t in texts):
            raise ValueError("no answer")
        with open(log, "a") as f:
            f.write("".join(f"{t}\n" for t in texts))
        return [t.upper() for t in texts]
    return score


def results(df):
    return sorted((r.id, r.score, r.error) for r in df.collect())


def test_a_run_that_dies_goes_on_behind_its_last_commit(spark, root, tmp_path):
    rows = spark.createDataFrame([(i, f"t{i}") for i in range(200)] + [(None, "none"), (5, "t5"), (7, "zz")], "id long, text string")
    log = str(tmp_path / "calls")
    with pytest.raises(StreamingQueryException):
        scoring.score_pending(spark, rows, root, logging_scorer(log, die_after=100), rows_per_batch=25, tasks=1)
    first = open(log).read().split()
    committed = spark.read.parquet(f"{root}/scores/*/*").count()
    assert os.path.exists(log + ".died") and 100 <= len(first) < 200 and committed >= 75
    got = scoring.score_pending(spark, rows, root, logging_scorer(log, die_after=100), rows_per_batch=25, tasks=1)
    assert results(got) == [(i, f"T{i}", None) for i in range(200)]
    # no text of a committed batch was scored again
    calls = open(log).read().split()
    assert sorted(set(calls)) == sorted(f"t{i}" for i in range(200)) and len(calls) - 200 <= 25


def test_a_second_call_scores_what_is_new_or_failed(spark, root, tmp_path):
    log = str(tmp_path / "calls")
    one = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id long, text string")
    got = scoring.score_pending(spark, one, root, logging_scorer(log, fails=("b",)), rows_per_batch=2)
    assert results(got) == [(1, "A", None), (2, None, "ValueError: no answer"), (3, "C", None)]
    more = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, "d")], "id long, text string")
    assert results(scoring.score_pending(spark, more, root, logging_scorer(log), rows_per_batch=2)) == [(1, "A", None), (2, "B", None), (3, "C", None), (4, "D", None)]
    assert sorted(open(log).read().split()) == ["a", "b", "c", "d"]
    assert results(scoring.score_pending(spark, more, root, logging_scorer(log))) == [(1, "A", None), (2, "B", None), (3, "C", None), (4, "D", None)]
    assert len(open(log).read().split()) == 4


def test_no_rows(spark, root):
    assert scoring.score_pending(spark, spark.createDataFrame([], "id long, text string"), root, str.upper).collect() == []


def test_pace(monkeypatch):
    slept = []
    now = [0.0]
    monkeypatch.setattr(time, "monotonic", lambda: now[0])
    monkeypatch.setattr(time, "sleep", lambda s: (slept.append(s), now.__setitem__(0, now[0] + s)))
    call = scoring.paced(lambda texts: texts, 4)
    for texts in (["a"] * 8, ["b"], ["c"] * 2):
        assert call(texts) == texts
    assert slept == [2.0, 0.25]
    assert scoring.paced(str.upper, None) is str.upper
