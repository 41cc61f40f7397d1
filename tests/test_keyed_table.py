"""The keyed table: merges against a dict, versions, and runs that end early."""

import os
import random
import uuid

import pytest
from pyspark.sql import functions as F

from tagloom.session import checkpoint_path
from tagloom.sources.keyed_table import KeyedTable

SCHEMA = "id long, model string, label int, batch int"


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture
def root(spark):
    return checkpoint_path(spark, f"keyed-{uuid.uuid4().hex}")


def rows_of(spark, root, version=None):
    return sorted(((r.id, r.model, r.label, r.batch) for r in KeyedTable.open(spark, root, version).read().collect()), key=str)


def test_batches_equal_a_dict(spark, root):
    r = random.Random(3)
    KeyedTable.create(spark, root, frame(spark, []).schema, ["id", "model"], 8)
    held, history = {}, [[]]
    for batch in range(1, 5):
        rows = [(r.choice([None, *range(25)]), r.choice(["a", "b", None]), r.randrange(5), batch) for _ in range(30)]
        table = KeyedTable.open(spark, root)
        if batch == 3:
            table.insert_new(frame(spark, rows), "batch")
            for row in sorted(rows, key=lambda x: x[2:], reverse=True):  # the smallest of a new key
                if row[:2] not in held or held[row[:2]][1] == 3:
                    held[row[:2]] = (row[2], row[3])
        else:
            table.upsert(frame(spark, rows), "batch")
            for row in sorted(rows, key=lambda x: x[2:]):
                held[row[:2]] = (row[2], row[3])
        history.append(sorted(((*k, *v) for k, v in held.items()), key=str))
        assert rows_of(spark, root) == history[-1]
    gone = [k for k in held][:9]
    KeyedTable.open(spark, root).delete(spark.createDataFrame(gone, "id long, model string"))
    assert rows_of(spark, root) == [x for x in history[-1] if x[:2] not in gone]
    for version, want in enumerate(history):  # earlier versions stay readable
        assert rows_of(spark, root, version) == want


def test_only_touched_buckets_are_rewritten(spark, root):
    KeyedTable.create(spark, root, frame(spark, []).schema, ["id"], 16)
    first = KeyedTable.open(spark, root).upsert(frame(spark, [(i, "m", 0, 1) for i in range(400)]), "batch")
    second = first.upsert(frame(spark, [(7, "m", 1, 2)]), "batch")
    assert len(first.places) == 16 and len([b for b in second.places if second.places[b] != first.places[b]]) == 1
    written = spark.read.parquet(f"{root}/rows/{[p for p in second.places.values() if p not in first.places.values()][0]}")
    assert 1 < written.count() < 100 and second.read().count() == 400
    assert second.upsert(frame(spark, []), "batch") is second


def test_a_hot_key_and_a_removed_bucket(spark, root):
    KeyedTable.create(spark, root, frame(spark, []).schema, ["id"], 4)
    table = KeyedTable.open(spark, root).upsert(spark.range(3000).select(F.lit(1).cast("long").alias("id"), F.lit("m").alias("model"), F.col("id").cast("int").alias("label"), F.lit(1).alias("batch")), "batch")
    assert rows_of(spark, root) == [(1, "m", 2999, 1)]
    assert table.delete(spark.createDataFrame([(1,), (2,)], "id long")).places == {} and rows_of(spark, root) == []


@pytest.mark.parametrize("leftover", [False, True])
def test_a_run_that_ends_before_the_swap_changes_nothing(spark, root, monkeypatch, leftover):
    KeyedTable.create(spark, root, frame(spark, []).schema, ["id"], 4)
    KeyedTable.open(spark, root).upsert(frame(spark, [(i, "m", 0, 1) for i in range(20)]), "batch")
    before = rows_of(spark, root)

    def killed(self, places):
        if leftover:  # the manifest was being written, too
            os.makedirs(f"{root}/versions/{self.version + 1:012d}/_temporary/0")
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(KeyedTable, "_commit", killed)
        with pytest.raises(KeyboardInterrupt):
            KeyedTable.open(spark, root).upsert(frame(spark, [(3, "m", 9, 2), (99, "m", 9, 2)]), "batch")
    assert rows_of(spark, root) == before and KeyedTable.open(spark, root).version == 1
    KeyedTable.open(spark, root).upsert(frame(spark, [(3, "m", 8, 2)]), "batch")
    assert rows_of(spark, root) == sorted([x for x in before if x[0] != 3] + [(3, "m", 8, 2)], key=str)


def test_a_taken_version_is_not_written_over(spark, root):
    old = KeyedTable.create(spark, root, frame(spark, []).schema, ["id"], 4)
    old.upsert(frame(spark, [(1, "m", 1, 1)]), "batch")
    with pytest.raises(RuntimeError):
        old.upsert(frame(spark, [(2, "m", 2, 1)]), "batch")
    assert rows_of(spark, root) == [(1, "m", 1, 1)]
    with pytest.raises(ValueError):
        KeyedTable.open(spark, root, 9)
