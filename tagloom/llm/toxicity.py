"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams.

Features of a text are the distinct unigrams, bigrams and skip-grams (two
words with one between them) of its lower-cased words, hashed to 30 bits.
``train`` fits FTRL-proximal with per-coordinate learning rates and L1: most
coordinates end at exactly zero, so the model is a short (index, weight) list
that fits in a broadcast. ``score`` is one pass over the texts, no shuffle.

Training reads a bounded sample: about ``max_train_rows`` labelled rows, drawn
by a hash of doc_id. Features are built in parallel, and coordinates that L1 can
never release (most of them) are counted and left out by Spark. What remains of
the sample's index lists (bounded by that parameter) is fitted in one task, since
FTRL is a sequential learner. Scoring and counting of labels cover all rows.

Defined results: null or wordless texts have no feature and score
``sigmoid(bias)``; labels other than 0 / 1 (null too) and documents without a
label are not learnt from; a doc_id with several label rows or text rows gives
one example per pair; without any example every score is 0.5; repeated rows
get equal scores; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Memo, batch_of, pieces, staged

WORD = re.compile(r"[^\W_]+")
SPACE = np.uint64(64 - 30)
SLOTS = 1 << 24
MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]
WORD_HASH = Memo(lambda w: xxhash.xxh3_64_intdigest(w))


@dataclass(frozen=True)
class Params:
    """FTRL-proximal settings; ``max_train_rows`` bounds the sample fitted."""

    alpha: float = 2.0
    beta: float = 1.0
    l1: float = 8.0
    l2: float = 1.0
    epochs: int = 4
    max_train_rows: int = 12_000


@dataclass(frozen=True)
class Model:
    bias: float
    index: np.ndarray  # int64, ascending
    weight: np.ndarray  # float64


def grams(text: str | None) -> np.ndarray:
    """Hashed indexes of all n-grams of a text, repeats included."""
    words = WORD.findall((text or "").lower())
    h = np.fromiter(map(WORD_HASH.__getitem__, words), np.uint64, len(words))
    parts = [h * MIX[0]]
    if len(h) > 1:
        parts.append((h[:-1] * MIX[1]) ^ (h[1:] * MIX[2]))
    if len(h) > 2:
        parts.append((h[:-2] * MIX[3]) ^ (h[2:] * MIX[4]))
    x = np.concatenate(parts)
    return (((x ^ (x >> np.uint64(29))) * MIX[0]) >> SPACE).astype(np.int64)


def fit(rows: list[tuple[np.ndarray, int]], p: Params) -> Model:
    """FTRL-proximal over (distinct indexes, label) examples, in their order."""
    if not rows:
        return Model(0.0, np.empty(0, np.int64), np.empty(0))
    index, flat = np.unique(np.concatenate([x for x, _ in rows]), return_inverse=True)
    ends = np.cumsum([len(x) for x, _ in rows])
    # the last coordinate is the bias, which L1 leaves alone
    z, n = np.zeros(len(index) + 1), np.zeros(len(index) + 1)
    l1 = np.full(len(index) + 1, p.l1)
    l1[-1] = 0.0

    def weights(at):
        zz = z[at]
        return np.where(np.abs(zz) <= l1[at], 0.0, (np.sign(zz) * l1[at] - zz) / ((p.beta + np.sqrt(n[at])) / p.alpha + p.l2))

    for _ in range(p.epochs):
        for (x, y), end in zip(rows, ends):
            at = np.append(flat[end - len(x):end], len(index))
            w = weights(at)
            g = 1.0 / (1.0 + math.exp(-max(-35.0, min(35.0, float(w.sum()))))) - y
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / p.alpha
            z[at] += g - sigma * w
            n[at] += g * g
    w = weights(np.arange(len(index) + 1))
    keep = np.flatnonzero(w[:-1])
    return Model(float(w[-1]), index[keep].astype(np.int64), w[keep])


def releasable(examples: DataFrame, p: Params) -> np.ndarray:
    """A bit for each hashed slot: does it hold a coordinate that may get a weight?

    A coordinate's |z| grows by less than 1 an example and epoch until L1 lets
    it have a weight. So one that too few examples hold can never get one. The
    counts of slots may only be too high; SLOTS / 64 words reach the driver.
    """
    slots = examples.select(F.explode("x").alias("x")).select(F.col("x").bitwiseAND(F.lit(SLOTS - 1)).alias("s")).groupBy("s").count()
    often = slots.where(F.col("count") * p.epochs > p.l1)
    words = often.groupBy(F.shiftright("s", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, s & 63)")).alias("m")).toArrow()
    bits = np.zeros(SLOTS >> 6, np.int64)
    bits[words.column("w").to_numpy()] = words.column("m").to_numpy()
    return bits


def only(x: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """The indexes whose slot has its bit set."""
    s = x & (SLOTS - 1)
    return x[(bits[s >> 6] >> (s & 63)) & 1 == 1]


def train(docs: DataFrame, labels: DataFrame, wanted: Column | None = None, params: Params = Params(), *,
          id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Fit on labelled documents whose ``doc_id`` satisfies ``wanted`` (a
    condition on a column named doc_id)."""
    marked = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y")).where("y IN (0, 1) AND doc_id IS NOT NULL")
    marked = marked if wanted is None else marked.where(wanted)
    marked = marked.distinct()
    # an example is a labelled id with one of its texts, counted once however often the row repeats
    text = F.col(text_col)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("digest"), text.alias("text"))
    total = texts.select("doc_id", "digest").join(marked, "doc_id").agg(F.approx_count_distinct(F.xxhash64("doc_id", "digest", "y")).alias("n")).first()["n"]
    share = min(1.0, params.max_train_rows / max(total, 1))
    # a hash threshold, no sort: about max_train_rows examples whatever the table's size
    drawn = texts.where(F.pmod(F.xxhash64("doc_id", "digest", F.lit("toxicity")), F.lit(1 << 30)) < int(share * (1 << 30)))
    rows = drawn.join(marked, "doc_id").groupBy("doc_id", "digest", "y").agg(F.first("text").alias("text"))
    listed = pa.schema([("doc_id", pa.int64()), ("y", pa.int32()), ("x", pa.list_(pa.int32()))])

    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            yield batch_of(listed, [b.column("doc_id"), b.column("y"), [np.unique(grams(t)).astype(np.int32) for t in b.column("text").to_pylist()]])

    found = pa.schema([("i", pa.int64()), ("w", pa.float64())])

    def learn(table: pa.Table) -> pa.Table:
        got = sorted(zip(table.column("doc_id").to_pylist(), table.column("y").to_pylist(), table.column("x").combine_chunks().to_numpy(zero_copy_only=False)),
                     key=lambda r: (xxhash.xxh64_intdigest(str(r[0])), r[1], len(r[2]), r[2].tobytes()))
        m = fit([(x, y) for _, y, x in got], params)
        return pa.table([pa.array([-1, *m.index], pa.int64()), pa.array([m.bias, *m.weight], pa.float64())], schema=found)

    examples = staged(docs.sparkSession, rows.mapInArrow(featurise, "doc_id long, y int, x array<int>"), "examples")
    shared = docs.sparkSession.sparkContext.broadcast(releasable(examples, params))

    def thin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            yield batch_of(listed, [b.column("doc_id"), b.column("y"), [only(x, shared.value) for x in b.column("x").to_numpy(zero_copy_only=False)]])

    out = examples.mapInArrow(thin, "doc_id long, y int, x array<int>").withColumn("fit", F.lit(0)).groupBy("fit").applyInArrow(learn, "i long, w double").collect()
    pairs = sorted((r["i"], r["w"]) for r in out)
    bias = pairs[0][1] if pairs else 0.0
    return Model(bias, np.array([i for i, _ in pairs[1:]], np.int64), np.array([w for _, w in pairs[1:]]))


class Scorer:
    """Scores texts with a model: a bit table drops almost every n-gram, the
    rest is looked up in the sorted weight list."""

    BITS = 20

    def __init__(self, m: Model):
        self.m = m
        self.seen = np.zeros(1 << self.BITS, bool)
        self.seen[m.index & ((1 << self.BITS) - 1)] = True

    def __call__(self, text: str | None) -> float:
        x = grams(text)
        x = np.unique(x[self.seen[x & ((1 << self.BITS) - 1)]])
        total = self.m.bias
        if len(x):
            at = np.minimum(np.searchsorted(self.m.index, x), len(self.m.index) - 1)
            total += float(self.m.weight[at][self.m.index[at] == x].sum())
        return 1.0 / (1.0 + math.exp(-max(-35.0, min(35.0, total))))


def score(spark: SparkSession, docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) for every row."""
    shared = spark.sparkContext.broadcast(model)
    out = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = Scorer(shared.value)
        for b in pieces(batches):
            yield batch_of(out, [b.column("doc_id"), [of(t) for t in b.column("text").to_pylist()]])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, score double")


def keep_clean(spark: SparkSession, docs: DataFrame, model: Model, threshold: float = 0.7, *, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose text scores below the threshold."""
    shared = spark.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = Scorer(shared.value)
        for b in pieces(batches):
            yield b.filter(pa.array([of(t) < threshold for t in b.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
