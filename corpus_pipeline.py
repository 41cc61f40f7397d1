"""A training-data pipeline over ``documents``: five stages, each one operator.

Every stage reads all that its predecessor kept, written as Parquet under the
shared checkpoint folder. The first four return the columns of documents.

* toxicity: documents scored 0.7 or more go (learnt without the held-out fold).
* near_duplicates: one document of each SimHash group stays.
* decontamination: documents that hold a benchmark item go.
* secrets: the values of found secrets are masked, all documents stay.
* encoding: every text as BPE ids and back, with counts and digests.

SQL cannot express the learnt models, XXH64 fingerprints or BPE, so there is
no oracle; tests hold each stage against a brute-force version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tagloom.llm import bpe, decontaminate, secrets, simhash, toxicity
from tagloom.llm.common import read, staged
from tagloom.llm.queries import TOXIC_FROM, tokenizer, toxicity_model


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.keep_clean(spark, docs, toxicity_model(spark, docs, sf_dir), TOXIC_FROM)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(spark, docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.keep_clean(spark, docs, read(spark, sf_dir, "benchmark"))


def secret_masking(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(spark, docs, secrets.train(docs))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode(spark, docs, tokenizer())


STAGES = [("toxicity", toxic), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("secrets", secret_masking), ("encoding", encoding)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; the result of the last."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(spark, stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
