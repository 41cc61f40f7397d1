"""Phrase collocations by Toivonen's sampling.

``frequent`` finds every phrase of up to ``longest`` words that occurs at
least ``least`` times, with its exact count:

1. A sample of the documents is counted, words and pairs first, then longer
   phrases of the pairs that did well; phrases that reach a lowered threshold
   are proposed. Their hashes go into a bit table.
2. One full pass counts the proposed phrases, by their words, and their
   negative border, by hash alone: every single word, and every phrase whose
   first part (all words but the last) and last part (all but the first) are
   proposed. Nearly all of a border is rare, and phrases that share a hash have
   their counts added up, so no frequent one stays below ``least``.
3. A border hash that proves frequent is a failure of the sample: its phrase
   has no words yet, and phrases that extend it were not counted. An expansion
   pass counts, by their words, the phrases of such hashes, what has become
   countable by them, and what extends those in turn; it numbers words only at
   the places where they occur. So one expansion closes the set, whatever the
   sample was: a frequent phrase has frequent parts, each of them is proposed, a
   failure, or counted anew, and so it was itself counted in one of the two
   passes. Failures occur little more than ``least`` times each, thus the
   expansion adds few rows.

The bit table may hold a phrase too many (then it counts one for nothing),
never one too few. It has 16 bits a phrase up to ``TABLE_BITS``; beyond that
it only lets more through. A pass looks every place of a run of texts up by
hash, and adds up inside the run: phrases with words by exact word numbers,
the border by hash. Spark sums, so a hot word or passage is one row a run. Most
other phrases of a run are rare: adding up again before the shuffle joins few
rows and holds a table of nearly all rows of a task, so rows are dealt out
first and added up once.

``collocations`` scores the phrases with exact decimals, drops what a longer
candidate explains, and ranks per language.

Defined results: a null text is empty, a null language counts as ``und``;
document ids play no part, so null ids and repeated rows count as any other;
ties are ranked by phrase, in byte order; texts are read whole; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batch_of, staged

LEAST, LONGEST, FIRST = 30, 4, 2000
SAMPLE_SHARE = 0.2  # of the documents
SAMPLE_LEAST = 0.5  # lowered threshold: this part of the expected count
EXPLAINED = (80, 100)  # a longer phrase with this part of the count explains a shorter one
TABLE_BITS = 1 << 30
RUN_BYTES = 3 << 20  # text counted at once
BREAKS = b".,;:!?\n\x0b\x0c\r"
FOLD = bytes.maketrans(string.ascii_uppercase.encode() + b"\t" + BREAKS, string.ascii_lowercase.encode() + b" " + b"\n" * len(BREAKS))
MIX = np.uint64(0x9E3779B97F4A7C15)


def words_of(texts: list[str]) -> tuple[np.ndarray, list[bytes]]:
    """Words of the texts in order, as numbers, and the words by number; a
    newline stands for the end of a piece. Arrow cuts and numbers them: no
    Python object a word is held."""
    joined = b"\n".join([t.encode("utf-8", "surrogatepass") for t in texts]).translate(FOLD).replace(b"\n", b" \n ")
    words = pc.split_pattern(pa.array([joined], pa.large_binary()), " ").values.dictionary_encode()
    ids, names = words.indices.to_numpy(), words.dictionary
    names = pc.binary_join(pa.LargeListArray.from_arrays([0, len(names)], names), pa.scalar(b" ", names.type))[0].as_py().split(b" ")  # no word has a space
    return (ids[ids != names.index(b"")] if b"" in names else ids), names


def mixed(h: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hash of a phrase from that of its first part and of its last word."""
    x = (h ^ (word + MIX)) * np.uint64(0xBF58476D1CE4E5B9)
    return (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)


class Table:
    """A set of phrase hashes as bits; two bits a phrase."""

    def __init__(self, bits: int, words: np.ndarray):
        self.bits, self.words = np.uint64(bits - 1), words

    def has(self, h: np.ndarray) -> np.ndarray:
        out = np.ones(len(h), bool)
        for shift in (np.uint64(0), np.uint64(32)):
            s = ((h >> shift) * MIX >> np.uint64(17)) & self.bits
            out &= self.words[(s >> np.uint64(6)).astype(np.int64)] >> (s & np.uint64(63)) & np.uint64(1) == 1
        return out


def slots(h: np.ndarray, bits: int) -> np.ndarray:
    return np.concatenate([((h >> np.uint64(shift)) * MIX >> np.uint64(17)) & np.uint64(bits - 1) for shift in (0, 32)])


def occurrences(ids: np.ndarray, names: list[bytes], lang: str, longest: int, table: Table | None, new: Table | None = None, closing: int | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Countable phrases of a run, an occurrence at a time: for each length
    (length, where they start, their hashes, which of them are known).

    No table: all phrases, all known. A table: single words, and phrases whose
    first and last part are in it; those in it are known. ``closing``: it holds
    phrases up to this length, and longer ones all pass for known. With ``new``,
    an expansion: only what the pass with the table alone does not know, and of
    that what is in ``new`` or comes of it.
    """
    seed = xxhash.xxh64_intdigest(lang.encode("utf-8", "surrogatepass"))
    word_hash = np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in names), np.uint64, len(names))
    is_word = np.ones(len(names), bool)
    if b"\n" in names:
        is_word[names.index(b"\n")] = False
    word = word_hash[ids]
    h = word.copy()  # of the phrase that starts at each place; only those of open phrases are read
    known, opened = np.zeros(len(ids), bool), np.zeros(len(ids), bool)
    for length in range(1, longest + 1):
        if length == 1:
            at = np.flatnonzero(is_word[ids])
            mine, reached = word[at], np.ones(len(at), bool)
        else:  # parts that are open and overlap, or are two words side by side, lie in one piece
            at = np.flatnonzero(opened[:-1] & opened[1:])
            mine, reached = mixed(h[at], word[at + (length - 1)]), known[at] & known[at + 1]
        if length > 1 and not len(at):
            return
        if table is None or (closing is not None and length > closing):
            held = reached
        elif length == 1:
            held = table.has(word_hash)[ids[at]]
        else:
            held = reached & table.has(mine)
        h[at] = mine
        known[:] = opened[:] = False
        known[at] = opened[at] = held
        if new is None:
            yield length, at, mine, held
            continue
        rest = np.flatnonzero(~held)
        rest = rest[~reached[rest] | new.has(mine[rest])]
        opened[at[rest]] = True
        yield length, at[rest], mine[rest], held[rest]


def distinct(ids: np.ndarray, at: np.ndarray, length: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct phrases among those that start at ``at``: their word
    numbers (below ``size``), a place of each in ``at``, and their counts. No
    hashes: equal are only phrases of equal words."""
    key, most = ids[at].astype(np.int64), size
    if length == 1:  # words have their numbers already
        count, first = np.bincount(key, minlength=size), np.empty(size, np.int64)
        first[key] = np.arange(len(key))
        held = np.flatnonzero(count)
        return held[:, None], first[held], count[held]
    for i in range(1, length):
        if most > (1 << 62) // size:  # numbers anew, so that they stay below 2^63: a run has below 2^31 words
            unique, key = np.unique(key, return_inverse=True)
            most = len(unique)
        key, most = key * size + ids[at + i], most * size
    _, first, count = np.unique(key, return_index=True, return_counts=True)
    return ids[at[first][:, None] + np.arange(length)], first, count


def counted(texts: list[str], lang: str, longest: int, table: Table | None, new: Table | None) -> Iterator[tuple[np.ndarray, np.ndarray, list[bytes], np.ndarray, int]]:
    """Phrases of a run of texts: for each length (word numbers of each
    distinct phrase, its count, the words by number, its hash, length). The
    phrase of no words stands for all words: its count is n.

    No table: all phrases. A table: the phrases in it, and of length -1, with
    no words, the border (countable phrases that are not in it) by hash only.
    With ``new``, an expansion: what the pass with the table alone has not
    counted by its words, and is in ``new`` or comes of it.
    """
    ids, names = words_of(texts)
    none = np.zeros((1, 0), np.int64)
    for length, at, hashes, known in occurrences(ids, names, lang, longest, table, new):
        if length == 1 and new is None:
            yield none, np.array([len(at)]), names, hashes[:0], 0  # n
        if new is None and not known.all():
            border, count = np.unique(hashes[~known], return_counts=True)
            yield none, count, names, border, -1
            at, hashes = at[known], hashes[known]
        if len(at):
            rows, first, count = distinct(ids, at, length, len(names))
            yield rows, count, names, hashes[first], length


def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[str]]]:
    """Texts of one language, about RUN_BYTES at a time (a longer text alone)."""
    held: dict[str, list[str]] = {}
    size: dict[str, int] = {}
    for b in batches:
        for lang, text in zip(b.column("lang"), b.column("text")):
            lang, text = lang.as_py(), text.as_py()
            held.setdefault(lang, []).append(text)
            size[lang] = size.get(lang, 0) + len(text)
            if size[lang] >= RUN_BYTES or sum(size.values()) >= 4 * RUN_BYTES:
                most = max(size, key=size.get)
                yield most, held.pop(most)
                del size[most]
    yield from held.items()


def count_phrases(docs: DataFrame, longest: int, table=None, new=None) -> DataFrame:
    """(lang, phrase, h, f): phrases counted over all rows of ``docs``; the
    empty phrase has n. The border of a table has its hash h alone, all else
    has its words: nearly all of a border is rare, and a number is cheaper to
    move and to add up than a text."""
    schema = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("h", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, more = table and table.value, new and new.value
        for lang, texts in runs(batches):
            for rows, count, names, hashes, length in counted(texts, lang, longest, now, more):
                word = pa.array(names, pa.binary()).cast(pa.string()) if length > 0 else None
                for lo in range(0, len(count), 1 << 16):
                    n = count[lo:lo + (1 << 16)]
                    if length < 0:
                        yield batch_of(schema, [pa.nulls(len(n), pa.string()), pa.nulls(len(n), pa.string()), hashes[lo:lo + (1 << 16)].view(np.int64), n])
                        continue
                    part = rows[lo:lo + (1 << 16)]
                    text = pc.binary_join_element_wise(*(word.take(pa.array(part[:, i])) for i in range(length)), " ") if length else pa.array([""])
                    yield batch_of(schema, [pa.repeat(lang, len(n)), text, pa.nulls(len(n), pa.int64()), n])

    return docs.mapInArrow(run, "lang string, phrase string, h long, n long").repartition("lang", "phrase", "h").groupBy("lang", "phrase", "h").agg(F.sum("n").alias("f"))


def count_hashes(docs: DataFrame, longest: int, table=None) -> DataFrame:
    """(h, f): phrases counted by hash over all rows of ``docs``. A bit
    table needs no more, and numbers are far cheaper to add up than texts;
    phrases that share a hash are proposed together, so none is lost. A table
    of words and pairs: only longer phrases, of pairs that are in it."""
    schema = pa.schema([("h", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = table and table.value
        for lang, texts in runs(batches):
            ids, names = words_of(texts)
            for length, _, hashes, _ in occurrences(ids, names, lang, longest, pairs, closing=2):
                if pairs is None or length > 2:
                    hashes, count = np.unique(hashes, return_counts=True)
                    for lo in range(0, len(hashes), 1 << 16):
                        yield batch_of(schema, [hashes[lo:lo + (1 << 16)].view(np.int64), count[lo:lo + (1 << 16)]])

    return docs.mapInArrow(run, "h long, n long").repartition("h").groupBy("h").agg(F.sum("n").alias("f"))


def table_of(spark: SparkSession, hashes: DataFrame):
    """Rows (h) as a broadcast bit table. Only its words reach the driver:
    TABLE_BITS at most, sized by the count."""
    bits = min(TABLE_BITS, 1 << max(16, (16 * hashes.count()).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("w", pa.int64()), ("m", pa.int64())])
        for b in batches:
            s = slots(b.column("h").to_numpy(zero_copy_only=False).view(np.uint64), bits)
            yield batch_of(schema, [pa.array((s >> np.uint64(6)).astype(np.int64)), pa.array((np.uint64(1) << (s & np.uint64(63))).view(np.int64))])

    words = hashes.mapInArrow(run, "w long, m long").groupBy("w").agg(F.bit_or("m").alias("m")).toArrow()
    out = np.zeros(bits >> 6, np.int64)
    out[words.column("w").to_numpy()] = words.column("m").to_numpy()
    return spark.sparkContext.broadcast(Table(bits, out.view(np.uint64)))


def phrase_hash(lang: str, phrase: str) -> int:
    """The hash that ``counted`` gives a phrase."""
    seed = xxhash.xxh64_intdigest(lang.encode("utf-8", "surrogatepass"))
    words = np.array([xxhash.xxh64_intdigest(w, seed) for w in phrase.encode("utf-8", "surrogatepass").split(b" ")], np.uint64)
    h = words[:1]
    for i in range(1, len(words)):
        h = mixed(h, words[i:i + 1])
    return int(h[0])


def frequent(spark: SparkSession, docs: DataFrame, *, least: int = LEAST, longest: int = LONGEST, share: float = SAMPLE_SHARE,
             lang_col: str = "lang", text_col: str = "text") -> tuple[DataFrame, DataFrame, int]:
    """((lang, phrase, f) of all phrases with f >= least, (lang, n):
    all words of a language, the number of full passes)."""
    rows = docs.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    sample = rows.sample(float(share), 13)  # by row, so that copies are sampled like other rows; any sample gives the same result
    enough = F.col("f") >= max(1, int(least * share * SAMPLE_LEAST))
    # most long phrases of a sample are rare, and so is then a pair in them: words and pairs first
    proposed = staged(spark, count_hashes(sample, min(2, longest)).where(enough).select("h"), "phrases-pairs")
    if longest > 2:
        pairs = table_of(spark, proposed)
        proposed = proposed.unionByName(staged(spark, count_hashes(sample, longest, pairs).where(enough).select("h"), "phrases-longer"))
        pairs.unpersist()
    table = table_of(spark, proposed)
    counts = staged(spark, count_phrases(rows, longest, table).where((F.col("phrase") == "") | (F.col("f") >= least)), "phrases-counted")
    totals = counts.where("phrase = ''").select("lang", F.col("f").alias("n"))
    found = counts.where("phrase <> ''").select("lang", "phrase", "f")
    failures = counts.where("phrase is null").select("h")
    if failures.isEmpty():
        return found, totals, 1
    more = staged(spark, count_phrases(rows, longest, table, table_of(spark, failures)).where(F.col("f") >= least).select("lang", "phrase", "f"), "phrases-expansion")
    return found.unionByName(more), totals, 2


def length_of() -> Column:
    return F.size(F.split("phrase", " ", -1))


def score() -> Column:
    """floor(2000000 * a / (l + r)), exact beyond 64 bits."""
    return F.expr("(cast(2000000 as decimal(7,0)) * cast(a as decimal(20,0))) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))")


def collocations(spark: SparkSession, docs: DataFrame, *, least: int = LEAST, longest: int = LONGEST, first: int = FIRST, share: float = SAMPLE_SHARE,
                 lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score), the first of each language."""
    counts, totals, _ = frequent(spark, docs, least=least, longest=longest, share=share, lang_col=lang_col, text_col=text_col)
    wide = "decimal(20,0)"
    candidates = counts.select("lang", "phrase", F.col("f").alias("a"), F.split("phrase", " ", -1).alias("w"), length_of().alias("length")).where("length > 1")
    # what explains a shorter phrase: the most frequent longer candidate around it
    spans = [(n, i) for n in range(2, longest) for i in range(1, longest - n + 2)]
    inside = F.array(*(F.when(F.col("length") > max(n, i + n - 2), F.array_join(F.slice("w", i, n), " ")) for n, i in spans)) if spans else F.array().cast("array<string>")
    around = (candidates.select("lang", "a", F.explode(F.array_distinct(F.filter(inside, lambda p: p.isNotNull()))).alias("phrase"))
              .groupBy("lang", "phrase").agg(F.max("a").alias("longer")))
    kept = (candidates.join(around, ["lang", "phrase"], "left")
            .where(F.col("longer").isNull() | (F.col("longer").cast(wide) * EXPLAINED[1] < F.col("a").cast(wide) * EXPLAINED[0])))
    # each cut looks the counts of its two parts up; all parts are frequent
    cut = kept.select("lang", "phrase", "a", "w", F.explode(F.sequence(F.lit(1), F.col("length") - 1)).alias("k"), "length")
    cut = cut.select("lang", "phrase", "a", "k", F.array_join(F.slice("w", F.lit(1), F.col("k")), " ").alias("head"), F.array_join(F.slice("w", F.col("k") + 1, F.col("length")), " ").alias("rest"))
    part = counts.select("lang", F.col("phrase").alias("part"), "f")
    cut = (cut.join(part.withColumnsRenamed({"part": "head", "f": "l"}), ["lang", "head"]).join(part.withColumnsRenamed({"part": "rest", "f": "r"}), ["lang", "rest"]))
    best = (cut.withColumn("score", score()).groupBy("lang", "phrase")
            .agg(F.min(F.struct("score", "k", "a", "l", "r")).alias("b")).select("lang", "phrase", "b.score", "b.a", "b.l", "b.r"))
    return ranked(spark, best, first).join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def ranked(spark: SparkSession, scored: DataFrame, first: int) -> DataFrame:
    """The first rows of each language, numbered from 1. Rows are range-sorted,
    numbered inside a range, and moved by what stands in earlier ranges (a
    count a range and language, summed on the driver): no task sees a language."""
    schema = pa.schema([("lang", pa.string()), ("range", pa.int32()), ("at", pa.int64()), ("phrase", pa.string()), *((c, pa.int64()) for c in ("a", "l", "r", "score"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, int] = {}
        for b in batches:
            at = []
            for lang in b.column("lang").to_pylist():
                seen[lang] = seen.get(lang, 0) + 1
                at.append(seen[lang])
            yield batch_of(schema, [at if f.name == "at" else b.column(f.name) for f in schema])

    order = ["lang", F.desc("score"), F.desc("a"), "phrase"]
    numbered = staged(spark, scored.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("range", F.spark_partition_id())
                      .mapInArrow(run, "lang string, range int, at long, phrase string, a long, l long, r long, score long"), "phrases-ranked")
    counts = sorted((r["lang"], r["range"], r["n"]) for r in numbered.groupBy("lang", "range").agg(F.count("*").alias("n")).collect())
    before, total = [], {}
    for lang, at, n in counts:
        before.append((lang, at, total.get(lang, 0)))
        total[lang] = total.get(lang, 0) + n
    base = F.broadcast(spark.createDataFrame(before, "lang string, range int, before long"))
    return numbered.where(F.col("at") <= first).join(base, ["lang", "range"]).withColumn("rank", F.col("before") + F.col("at")).where(F.col("rank") <= first)
