"""Substring dedup: seed and extend over winnowed anchors.

A passage is repeated if ``least`` (50) consecutive words of a document also
start in a document of a smaller doc_id.

Seeds: every q-gram of words is hashed, and winnowing keeps the leftmost
smallest hash of every least - q + 1 neighbours; so any two equal windows of
``least`` words hold the same anchor at the same offset, and about one word in
twenty carries one. Joining: an anchor matters if two documents hold it.

Extending: around an anchor, every window that holds it lies within
least - q words to either side; its digest, the context, tells whether two
occurrences extend the same way over that whole reach.

* An occurrence whose (anchor, context) is also in an earlier document is
  repeated over its whole reach. That takes an aggregate and a join, no pairs.
* The first document of a context may still share a part of the reach with an
  earlier document whose context differs. Only for those, and only if the
  anchor has several contexts, the windows are spelled out and grouped by a
  128-bit digest: the smallest doc_id of each tells which are repeats.

Overlapping ranges are merged into maximal repeats for each document. Texts
are shuffled only for documents that need their windows or their kept words; a
``Sieve`` of fixed size keeps the others out.

Defined results: null texts have no word; a document below ``least`` words is
kept; repeats inside one document, or among rows of one doc_id, do not count;
a null doc_id is neither earlier nor later than another, its text is kept and
removes nothing; rows equal in doc_id and text get equal results; other columns
are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Sieve, batch_of, keyed, pieces, staged

LEAST, Q = 50, 12
KEY = ["doc_id", "digest"]


def words_of(text: str) -> tuple[list[bytes], bytes, np.ndarray, np.ndarray]:
    """(words, words joined by one space, start and end byte of each)."""
    words = text.encode().split()  # bytes: ASCII white space only
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    return words, b" ".join(words), np.concatenate([[0], ends[:-1] + 1])[:len(words)], ends


def long(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def seeds(text: str, least: int, q: int) -> tuple[int, str, list[int], list[int], list[int]]:
    """(words, their digest, anchor positions, anchor hashes, contexts)."""
    words, joined, start, end = words_of(text)
    n, reach = len(words), least - q
    whole = hashlib.sha256(joined).hexdigest()
    if n < least:
        return n, whole, [], [], []
    a, b = start.tolist(), end.tolist()
    h = np.array([xxhash.xxh3_64_intdigest(joined[x:y]) for x, y in zip(a, b[q - 1:])], np.uint64)
    at = np.unique(np.lib.stride_tricks.sliding_window_view(h, reach + 1).argmin(axis=1) + np.arange(n - least + 1)).tolist()
    contexts = []
    for p in at:
        left, right = min(p, reach), min(n - p - q, reach)
        contexts.append(long(xxhash.xxh3_64_intdigest(joined[a[p - left]:b[p + q - 1 + right]], left << 32 | right)))
    return n, whole, at, h[at].view(np.int64).tolist(), contexts


def seed_table(docs: DataFrame, least: int, q: int) -> DataFrame:
    """A row a document: (doc_id, digest, n_words, whole, pos, a, c)."""
    ints, longs = pa.list_(pa.int32()), pa.list_(pa.int64())
    schema = pa.schema([("doc_id", pa.int64()), ("digest", pa.int64()), ("n_words", pa.int64()), ("whole", pa.string()), ("pos", ints), ("a", longs), ("c", longs)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            got = [seeds(t, least, q) for t in b.column("text").to_pylist()]
            yield batch_of(schema, [b.column("doc_id"), b.column("digest"), *map(list, zip(*got))] if got else [[]] * 7)

    return docs.mapInArrow(run, "doc_id long, digest long, n_words long, whole string, pos array<int>, a array<long>, c array<long>")


def windows_at(text: str, positions: list[int], least: int, q: int) -> tuple[list[int], list[bytes]]:
    """Starts and 128-bit digests of the windows that hold one of the anchors."""
    words, joined, start, end = words_of(text)
    last = len(words) - least
    starts = sorted({s for p in positions for s in range(max(0, p - (least - q)), min(p, last) + 1)})
    return starts, [xxhash.xxh3_128_digest(joined[start[s]:end[s + least - 1]]) for s in starts]


def window_table(docs: DataFrame, positions: DataFrame, least: int, q: int) -> DataFrame:
    """(doc_id, digest, start, w0, w1) of the windows at the anchors of ``positions``."""
    schema = pa.schema([("doc_id", pa.int64()), ("digest", pa.int64()), ("start", pa.int32()), ("w0", pa.int64()), ("w1", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            for d, g, t, at in zip(*(b.column(n).to_pylist() for n in ("doc_id", "digest", "text", "at"))):
                starts, digests = windows_at(t, at, least, q)
                w = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
                yield batch_of(schema, [np.full(len(starts), d), np.full(len(starts), g), np.array(starts, np.int32), w[:, 0].copy(), w[:, 1].copy()])

    return docs.join(positions, KEY).select(*KEY, "text", "at").mapInArrow(run, "doc_id long, digest long, start int, w0 long, w1 long")


def merged(starts: list[int], ends: list[int]) -> tuple[list[int], list[int]]:
    """Maximal ranges of a union of ranges."""
    a: list[int] = []
    b: list[int] = []
    for s, e in sorted(zip(starts, ends)):
        if b and s <= b[-1]:
            b[-1] = max(b[-1], e)
        else:
            a.append(s)
            b.append(e)
    return a, b


def merge_ranges(ranges: DataFrame) -> DataFrame:
    """(doc_id, digest, s, e, n_removed): the maximal ranges of each document.
    A document's ranges are as many as its words at most."""
    ints = pa.list_(pa.int32())
    schema = pa.schema([("doc_id", pa.int64()), ("digest", pa.int64()), ("s", ints), ("e", ints), ("n_removed", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [merged(s, e) for s, e in zip(b.column("s").to_pylist(), b.column("e").to_pylist())]
            yield batch_of(schema, [b.column("doc_id"), b.column("digest"), [s for s, _ in got], [e for _, e in got], [sum(e) - sum(s) for s, e in got]])

    # rows that repeat with their doc_id and text add the same ranges
    lists = ranges.distinct().groupBy(*KEY).agg(F.collect_list(F.struct("s", "e")).alias("r")).select(*KEY, "r.s", "r.e")
    return lists.mapInArrow(run, "doc_id long, digest long, s array<int>, e array<int>, n_removed long")


def repeats(spark: SparkSession, docs: DataFrame, seeded: DataFrame, least: int = LEAST, q: int = Q) -> DataFrame:
    """(doc_id, digest, s, e, n_removed): the maximal repeats of the ``keyed``
    documents that have any, as word ranges, ends exclusive."""
    reach = least - q
    occurrences = seeded.where("doc_id IS NOT NULL AND size(pos) > 0").select(*KEY, "n_words", F.explode(F.arrays_zip("pos", "a", "c")).alias("o")).select(*KEY, "n_words", "o.pos", "o.a", "o.c")
    anchors = occurrences.groupBy("a").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.min("c").alias("c0"), F.max("c").alias("c1"))
    anchors = staged(spark, anchors.where("lo < hi").select("a", (F.col("c0") != F.col("c1")).alias("several")), "anchors")
    joined = staged(spark, Sieve(spark, anchors, "a").keep(occurrences, "a").join(anchors, "a"), "occurrences")
    # written, so that the join below stands alone and AQE can split a hot passage
    classes = staged(spark, joined.groupBy("a", "c").agg(F.min("doc_id").alias("first")), "classes")
    classed = staged(spark, joined.join(classes, ["a", "c"]).where("first < doc_id OR several").select(*KEY, "n_words", "pos", (F.col("first") < F.col("doc_id")).alias("later")), "classed")
    whole = classed.where("later").select(*KEY, F.greatest(F.col("pos") - reach, F.lit(0)).alias("s"), F.least(F.col("pos") + q + reach, F.col("n_words")).cast("int").alias("e"))

    positions = staged(spark, classed.where("NOT later").groupBy(*KEY).agg(F.collect_set("pos").alias("at")), "positions")
    windows = staged(spark, window_table(Sieve(spark, positions, *KEY).keep(docs, *KEY), positions, least, q), "windows")
    common = staged(spark, windows.groupBy("w0", "w1").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select("w0", "w1", "first"), "common")
    part = Sieve(spark, common, "w0", "w1").keep(windows, "w0", "w1").join(common, ["w0", "w1"]).where("first < doc_id").select(*KEY, F.col("start").alias("s"), (F.col("start") + least).alias("e"))
    return staged(spark, merge_ranges(whole.unionByName(part)), "repeats")


def kept_words(text: str, s: list[int], e: list[int]) -> bytes:
    words = text.encode().split()
    at, out = 0, []
    for a, b in zip(s, e):
        out += words[at:a]
        at = b
    return b" ".join(out + words[at:])


def dedup(spark: SparkSession, docs: DataFrame, least: int = LEAST, q: int = Q, *, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) for every row; with
    ``with_text`` also ``kept``, the kept words where any word was removed."""
    rows = keyed(docs, id_col, text_col)
    seeded = staged(spark, seed_table(rows, least, q), "seeds")
    found = repeats(spark, rows, seeded, least, q)
    counts = seeded.select(*KEY, "n_words", "whole")
    # a document that goes whole needs no text: its kept words are empty
    cut = found.join(counts.select(*KEY, "n_words").distinct(), KEY)
    partly = staged(spark, cut.where("n_removed < n_words").select(*KEY, "s", "e"), "partly")
    schema = pa.schema([("doc_id", pa.int64()), ("digest", pa.int64()), ("kept", pa.string()), ("sha", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            got = [kept_words(t, s, e) for t, s, e in zip(*(b.column(n).to_pylist() for n in ("text", "s", "e")))]
            yield batch_of(schema, [b.column("doc_id"), b.column("digest"), [x.decode() if with_text else None for x in got], [hashlib.sha256(x).hexdigest() for x in got]])

    texts = Sieve(spark, partly, *KEY).keep(rows, *KEY).join(partly, KEY).select(*KEY, "text", "s", "e")
    changed = texts.mapInArrow(run, "doc_id long, digest long, kept string, sha string").dropDuplicates(KEY)
    empty = hashlib.sha256(b"").hexdigest()
    gone = found.select(*KEY, "n_removed").join(changed, KEY, "left")
    out = counts.join(gone, KEY, "left")
    sha = F.when(F.col("n_removed").isNull(), F.col("whole")).otherwise(F.coalesce("sha", F.lit(empty)))
    kept = [F.when(F.col("n_removed").isNotNull(), F.coalesce("kept", F.lit(""))).alias("kept")] if with_text else []
    return out.select("doc_id", "n_words", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"), sha.alias("kept_sha256"), *kept)
