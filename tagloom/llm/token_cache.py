"""Token counts through a digest cache.

The cache is a Parquet table (content digest, n_tokens) in a folder for each
tokenizer version. The content digest is the SHA-256 of the normalised text
(null as empty; a byte-level tokenizer keeps every byte, so nothing else may
be folded). The version digest covers the tokenizer file's bytes, the
library's version and the options. ``count`` joins the digests of all rows to
the cache, encodes each distinct miss once, appends the new counts, and joins
again. A group of equal texts collapses before the shuffle; the last join
carries digests only, and AQE may split a digest that holds many rows.

Defined results: a null text counts as the empty text (0 bytes); repeated rows
get a row each; null ids stay null; texts are encoded whole; concurrent or
repeated appends of a digest are harmless, as equal contents have equal
counts; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_path
from .common import batch_of, pieces, staged, text_runs

RUN_CHARS = 1 << 18  # characters given to the library at once; its encodings take many times that
CACHE = "digest binary, n_tokens long"
_LOADED: dict[str, object] = {}


def fresh(spark: SparkSession) -> str:
    """A new, empty cache folder under the shared checkpoint folder."""
    return checkpoint_path(spark, f"token-cache-{uuid.uuid4().hex}")


def version_digest(path: str) -> str:
    """Digest of everything that decides a count besides the text."""
    if path.endswith(".json"):
        import tokenizers as library
    else:
        import sentencepiece as library
    with open(path, "rb") as f:
        return hashlib.sha256(f.read() + f"|{library.__name__} {library.__version__}|plain".encode()).hexdigest()


def counter(path: str, version: str, content: bytes):
    """texts -> token counts, by the file's own library; once a worker."""
    if version not in _LOADED:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        if path.endswith(".json"):
            from tokenizers import Tokenizer
            t = Tokenizer.from_str(content.decode())
            t.no_truncation()
            t.no_padding()
            _LOADED[version] = lambda texts: [len(e) for e in t.encode_batch_fast(texts, add_special_tokens=False)]
        else:
            from sentencepiece import SentencePieceProcessor
            s = SentencePieceProcessor(model_proto=content)
            _LOADED[version] = lambda texts: [len(x) for x in s.encode(texts, num_threads=1)]
    return _LOADED[version]


def digests(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.unhex(F.sha2(text, 256)).alias("digest"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))


def count(spark: SparkSession, docs: DataFrame, path: str, cache: str, *, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for every row; ``cache`` is a
    folder that all executors share, made on first use."""
    version = version_digest(path)
    with open(path, "rb") as f:
        content = spark.sparkContext.broadcast(f.read())
    table = f"{cache.rstrip('/')}/version={version}"
    spark.createDataFrame([], CACHE).write.mode("append").parquet(table)  # the folder exists from here on
    rows = digests(docs, id_col, text_col)
    known = spark.read.schema(CACHE).parquet(table)
    misses = rows.select("digest", "text").join(known.select("digest"), "digest", "left_anti").dropDuplicates(["digest"])
    schema = pa.schema([("digest", pa.binary()), ("n_tokens", pa.int64())])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = counter(path, version, content.value)
        for b in pieces(batches):
            texts = b.column("text").to_pylist()
            for run in text_runs(texts, RUN_CHARS):
                yield batch_of(schema, [b.column("digest").slice(run[0], len(run)), of([texts[i] for i in run])])

    misses.mapInArrow(encode, CACHE).write.mode("append").parquet(table)
    # written, so that the join below stands alone and AQE can split a hot digest
    counts = staged(spark, spark.read.schema(CACHE).parquet(table).groupBy("digest").agg(F.min("n_tokens").alias("n_tokens")), "counts")
    return rows.select("doc_id", "digest", "n_bytes").join(counts, "digest").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
