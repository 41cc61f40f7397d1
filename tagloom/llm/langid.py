"""Language ID with bit-sliced Bloom filters over language bitmasks.

The filter has one word of bits a slot, bit l for language l (more words a
slot beyond 64 languages). An n-gram sets the bits of all its languages in k
slots; ANDing its k slots returns, at once, every language that contains it.
For a text the bits are summed over all its n-grams, a popcount for each
language; each is corrected for false positives by the filter's fill for that
language, (hits - N f) / (1 - f) with f = fill^k; the largest decides.

N-grams are three letters (lower-case code points; whatever is no letter is a
word edge). ``train`` reads about ``max_train_rows`` labelled rows, drawn by a
hash of doc_id, at least a part of them from every language. Every n-gram of
these rows is stored for its language, so a language of one row knows that
row. The filter has 16 slots for each n-gram of the largest language, up to
``max_slots_log2``; beyond that only the false positives grow, which are
corrected. N-grams are counted once each, by an aggregate over (language,
n-gram): no row is ranked, no language is one task's.

Defined results: ``und`` and score 0 for a null text, one without a letter, or
with nothing learnt; equal counts go to the language with fewer n-grams, then
the one with more training rows, then the smaller name; score is the winner's part of all corrected counts (0
when no n-gram is known, and then the language with most training rows). Repeated rows get equal results; rows with a null id are predicted and never
learnt from; texts of any length are read whole; an empty table learns nothing
and gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batch_of, pieces

MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]
EDGE = np.uint64(32)


@dataclass(frozen=True)
class Params:
    max_train_rows: int = 12_000
    slots_log2: int | None = None  # None: by the n-grams
    max_slots_log2: int = 24
    hashes: int = 3


@dataclass(frozen=True)
class Model:
    langs: list[str]  # by bit; also the order in which ties are broken
    slots: np.ndarray  # uint64[slots, words]
    false_rate: np.ndarray  # by bit
    params: Params


@lru_cache(1)
def letters() -> np.ndarray:
    """Lower-case code point of each letter, 32 for everything else."""
    return np.array([ord(chr(c).lower()[0]) if chr(c).isalpha() else 32 for c in range(0x110000)], np.uint64)


def grams(text: str | None) -> np.ndarray:
    """A hash for every n-gram of a text; empty if it has no letter."""
    c = letters()[np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), "<u4")]
    c = np.concatenate([[EDGE], c, [EDGE]])
    keep = c != EDGE
    keep[1:] |= c[:-1] != EDGE
    keep[0] = True
    c = c[keep]
    if len(c) < 3:
        return np.empty(0, np.uint64)
    x = c[:-2] * MIX[0] + c[1:-1] * MIX[1] + c[2:] * MIX[2]
    return (x ^ (x >> np.uint64(31))) * MIX[1]


def places(g: np.ndarray, p: Params) -> list[np.ndarray]:
    """The k slots of each n-gram hash."""
    second = (g >> np.uint64(32)) | np.uint64(1)
    return [((g + np.uint64(i) * second) >> np.uint64(7)) & np.uint64((1 << p.slots_log2) - 1) for i in range(p.hashes)]


def build(langs: list[str], members: list[tuple[int, int]], p: Params) -> Model:
    """The filter from (n-gram hash, language bit) pairs."""
    if p.slots_log2 is None:
        most = max(Counter(bit for _, bit in members).values(), default=1)
        p = replace(p, slots_log2=min(p.max_slots_log2, max(12, (16 * most - 1).bit_length())))
    slots = np.zeros((1 << p.slots_log2, max(1, -(-len(langs) // 64))), np.uint64)
    by_lang = defaultdict(list)
    for g, bit in members:
        by_lang[bit].append(g)
    fill = np.zeros(len(langs))
    for bit, gs in by_lang.items():
        at = np.unique(np.concatenate(places(np.array(gs, np.int64).view(np.uint64), p)))
        slots[at, bit // 64] |= np.uint64(1 << (bit % 64))
        fill[bit] = len(at) / len(slots)
    return Model(langs, slots, fill ** p.hashes, p)


def predict_one(text: str | None, m: Model) -> tuple[str, float]:
    g = grams(text)
    if not len(g) or not m.langs:
        return "und", 0.0
    at = places(g, m.params)
    mask = m.slots[at[0]]
    for x in at[1:]:
        mask = mask & m.slots[x]
    hits = np.array([np.count_nonzero(mask[:, b // 64] & np.uint64(1 << (b % 64))) for b in range(len(m.langs))], float)
    fixed = np.maximum(0.0, (hits - len(g) * m.false_rate) / (1.0 - np.minimum(m.false_rate, 0.999)))
    most = np.round(fixed, 6) == np.round(fixed.max(), 6)
    # of equal counts the one from fewer n-grams says more; with none known the first language
    best = int(np.flatnonzero(most)[m.false_rate[most].argmin()]) if fixed.max() > 0 else 0
    total = float(fixed.sum())
    return m.langs[best], float(fixed[best] / total) if total > 0 else 0.0


def train(docs: DataFrame, wanted: Column | None = None, params: Params = Params(), *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Learn from text and language of rows whose ``doc_id`` satisfies ``wanted``."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("lang IS NOT NULL AND doc_id IS NOT NULL")
    rows = rows if wanted is None else rows.where(wanted)
    by_lang = rows.groupBy("lang").count().collect()
    langs = [r["lang"] for r in sorted(by_lang, key=lambda r: (-r["count"], r["lang"]))]
    if not langs:
        return build([], [], params)
    share = min(1.0, params.max_train_rows / sum(r["count"] for r in by_lang))
    # a language of few rows is read whole: the bound is shared out by language
    least = params.max_train_rows // (4 * len(langs))
    cut = {r["lang"]: int(max(share, min(1.0, least / r["count"])) * (1 << 30)) for r in by_lang}
    pick = F.create_map([F.lit(x) for k in cut.items() for x in k])[F.col("lang")]
    rows = rows.where(F.pmod(F.xxhash64("doc_id", F.lit("langid")), F.lit(1 << 30)) < pick)
    bit = {x: i for i, x in enumerate(langs)}
    schema = pa.schema([("bit", pa.int32()), ("g", pa.int64())])

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            parts = defaultdict(list)
            for t, x in zip(b.column("text").to_pylist(), b.column("lang").to_pylist()):
                parts[bit[x]].append(grams(t))
            for k, gs in parts.items():
                g = np.unique(np.concatenate(gs))
                yield batch_of(schema, [np.full(len(g), k, np.int32), g.view(np.int64)])

    found = rows.select("text", "lang").mapInArrow(members, "bit int, g long").distinct().toArrow()  # bounded by the sample
    return build(langs, list(zip(found.column("g").to_pylist(), found.column("bit").to_pylist())), params)


def predict(spark: SparkSession, docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) for every row."""
    shared = spark.sparkContext.broadcast(model)
    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            got = [predict_one(t, shared.value) for t in b.column("text").to_pylist()]
            yield batch_of(schema, [b.column("doc_id"), [x for x, _ in got], [y for _, y in got]])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double")
