import hashlib

import corpus_pipeline
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tagloom.llm import queries, secrets
from tests.conftest import SF_SMALL
from tests.llm import brute


def test_stages(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "secrets", "encoding"]
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)

    scores = {r["doc_id"]: r["score"] for r in queries.op2_toxicity(spark, SF_SMALL).collect()}
    clean = stages["toxicity"](spark, docs, SF_SMALL)
    assert clean.columns == columns
    assert {r["doc_id"] for r in clean.collect()} == {d for d, s in scores.items() if s < 0.7}

    clean = spark.createDataFrame(clean.collect(), clean.schema)
    single = stages["near_duplicates"](spark, clean, SF_SMALL)
    assert single.columns == columns
    assert sorted(r["doc_id"] for r in single.collect()) == sorted({g for _, _, g in brute.near_duplicates([(r["doc_id"], r["text"]) for r in clean.collect()])})

    single = spark.createDataFrame(single.collect(), single.schema)
    kept = stages["decontamination"](spark, single, SF_SMALL)
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").collect()]
    bad = {d for d, _ in brute.contained([(r["doc_id"], r["text"]) for r in single.collect()], items)}
    assert kept.columns == columns
    assert {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in single.collect()} - bad

    kept = spark.createDataFrame(kept.collect(), kept.schema)
    safe = stages["secrets"](spark, kept, SF_SMALL)
    assert safe.columns == columns
    before, model = {r["doc_id"]: r for r in kept.collect()}, secrets.train(kept)
    for r in safe.collect():
        old = before.pop(r["doc_id"])
        assert r["text"] == secrets.masked(old["text"], model)
        assert not [s for s in brute.base_spans(r["text"]) if s[0] != "assign"] and r["n_chars"] == len(r["text"])
    assert not before

    library = Tokenizer.from_file(queries.tokenizer())
    last = {r["doc_id"]: r for r in stages["encoding"](spark, safe, SF_SMALL).collect()}
    for r in safe.collect():
        assert last[r["doc_id"]]["n_tokens"] == len(library.encode(r["text"], add_special_tokens=False).ids)
        assert last[r["doc_id"]]["decoded_sha256"] == hashlib.sha256(r["text"].encode()).hexdigest()


def test_run_applies_all_stages(spark):
    out = corpus_pipeline.run(spark, SF_SMALL)
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    assert 0 < out.count() < docs.count()
    assert out.join(docs, "doc_id").count() == out.count()


def test_stages_take_odd_rows(spark, odd, none):
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, SF_SMALL).count() == 0, name
        out = stage(spark, odd, SF_SMALL)
        assert 0 < out.count() <= odd.count(), name
        if name != "encoding":
            assert out.columns == odd.columns
            assert out.where(F.col("doc_id") == 22).count() <= 1
