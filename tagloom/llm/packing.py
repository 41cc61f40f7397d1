"""Packing documents into training sequences along a Hilbert curve.

1. One pass encodes every whole text and places it: signed counts of hashed
   token ids are damped, scaled to length one and projected on a few Gaussian
   directions; the grid cell of the projection has a Hilbert key, so that
   documents with like words get keys near each other. Written once.
2. The rows are range-sorted by (key, doc_id, row) and written with their
   running token count inside the range. ``row`` numbers the rows of the
   written table, so equal keys, equal documents and repeated rows still have
   one order, and a hot key is spread over many ranges.
3. The ranges' totals (one number a range, collected) give each range its
   first position. Neighbours on the curve are then laid end to end, and the
   stream is cut every ``size`` ids. What is left over at the end is cut at
   falling powers of two, which need no padding, so nothing is padded at all.

Each document is its ids and one end id; a document cut by a border goes on
in the next sequence. Ids come from a BPE file of the tokenizers library. Its
merges run through tiktoken where rank order and id order agree (checked);
otherwise, and for a text that tiktoken refuses, through the library itself.

Defined results: a null text is the empty text (its end id only); a null
doc_id stays null; repeated rows are packed as often as they occur; texts of
any length are packed whole; an empty table gives no pieces; other columns
are ignored. Which of several equal rows comes first is not defined, all else
about them is equal.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe
from .common import batch_of, pieces, staged, text_runs

SIZE = 2048
END_ID = 1
DIMS, BITS = 4, 15  # the key has DIMS * BITS = 60 bits
SLOTS = 1 << 12
RANGE_BYTES = 32 << 20  # ids a range holds, about
PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"

_CODERS: dict[str, object] = {}


def coder(version: str, content: str, vocab: bpe.Vocab):
    """text -> ids (uint32 array), once a worker process."""
    if version not in _CODERS:
        import tiktoken
        from tokenizers import Tokenizer
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        plain = Tokenizer.from_str(content)
        plain.no_truncation()
        plain.no_padding()
        fast = None
        if len(vocab.merged) and np.all(np.diff(vocab.merged) > 0):  # lowest id = earliest merge
            ranks = {t: i for i, t in enumerate(vocab.token_bytes) if t and t.decode("utf-8", "replace") not in vocab.special}
            fast = tiktoken.Encoding("packing", pat_str=bpe.SPLIT, mergeable_ranks=ranks, special_tokens=vocab.special)

        def encode(text: str) -> np.ndarray:
            if fast is not None:
                try:
                    return fast.encode_to_numpy(text, allowed_special="all")
                except Exception:  # e.g. a run of white space beyond its regex's stack: the library decides
                    pass
            return np.array(plain.encode(text, add_special_tokens=False).ids, np.uint32)

        _CODERS[version] = encode
    return _CODERS[version]


def directions(dims: int = DIMS, slots: int = SLOTS) -> np.ndarray:
    """Fixed Gaussian directions, one column a dimension."""
    return np.random.default_rng(11).standard_normal((slots, dims)).astype(np.float32)


def project(docs: list[np.ndarray], to: np.ndarray) -> np.ndarray:
    """Each document's place, about normal in every dimension; no ids: 0."""
    slots = len(to)
    vectors = np.zeros((len(docs), slots), np.float32)
    for row, ids in zip(vectors, docs):
        h = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        sign = np.where(h & np.uint64(1 << 20), 1.0, -1.0)
        row += np.bincount((h >> np.uint64(40)).astype(np.int64) % slots, weights=sign, minlength=slots)
    vectors = np.sign(vectors) * np.sqrt(np.abs(vectors))
    return (vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)) @ to


def cells(places: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Grid coordinates; the logistic curve spreads normal places evenly."""
    return np.minimum((1 << bits) / (1 + np.exp(-1.702 * places.astype(np.float64))), (1 << bits) - 1).astype(np.int64)


def hilbert_key(grid: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Position of each cell (rows of ``grid``) on the Hilbert curve: undo the
    turns of the sub-cubes from the largest down, Gray-code, interleave."""
    axes = [grid[:, i].astype(np.int64).copy() for i in range(grid.shape[1])]
    for level in range(bits - 1, 0, -1):
        low = (1 << level) - 1
        for a in axes:
            upper = (a >> level) & 1 == 1
            swap = np.where(upper, 0, (axes[0] ^ a) & low)
            axes[0] ^= np.where(upper, low, swap)
            if a is not axes[0]:
                a ^= swap
    for before, a in zip(axes, axes[1:]):
        a ^= before
    turn = np.zeros_like(axes[0])
    for level in range(bits - 1, 0, -1):
        turn ^= np.where((axes[-1] >> level) & 1, (1 << level) - 1, 0)
    key = np.zeros_like(turn)
    for b in range(bits - 1, -1, -1):
        for a in axes:
            key = key << 1 | ((a ^ turn) >> b & 1)
    return key


def placed(spark: SparkSession, docs: DataFrame, path: str, id_col: str, text_col: str) -> tuple[DataFrame, str]:
    """Every row's ids and key, written; and the type that holds an id."""
    with open(path, encoding="utf-8") as f:
        content = f.read()
    vocab = bpe.load(path)
    version = hashlib.sha256(content.encode()).hexdigest()
    wide = "<u2" if max(END_ID, len(vocab.token_bytes) - 1) < 1 << 16 else "<u4"
    shared = spark.sparkContext.broadcast((content, vocab))
    schema = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("n", pa.int64()), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, to = coder(version, *shared.value), directions()
        for b in pieces(batches, 512):
            doc_ids, texts = b.column("doc_id"), b.column("text").to_pylist()
            for rows in text_runs(texts):
                ids = [encode(texts[i]) for i in rows]
                raw = [np.append(x, np.uint32(END_ID)).astype(wide).tobytes() for x in ids]
                yield batch_of(schema, [doc_ids.slice(rows[0], len(rows)), hilbert_key(cells(project(ids, to))), [len(x) + 1 for x in ids], raw])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    table = rows.mapInArrow(run, "doc_id long, key long, n long, ids binary")
    return staged(spark, table.withColumn("row", F.monotonically_increasing_id()), "packing-placed", "zstd"), wide


def along_curve(spark: SparkSession, rows: DataFrame, wide: str) -> tuple[DataFrame, np.ndarray]:
    """The rows in curve order with their position inside their range, and
    each range's first position (the last entry is the number of ids)."""
    total = rows.agg(F.sum("n")).first()[0] or 0
    ranges = max(spark.sparkContext.defaultParallelism, -(-total * np.dtype(wide).itemsize // RANGE_BYTES))
    schema = pa.schema([("range", pa.int32()), ("at", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int64()), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = 0
        for b in batches:
            n = b.column("n").to_numpy()
            ends = at + np.cumsum(n)
            yield batch_of(schema, [b.column("range"), ends - n, b.column("doc_id"), b.column("n"), b.column("ids")])
            at = int(ends[-1]) if len(n) else at

    sort = ["key", "doc_id", "row"]
    ordered = rows.repartitionByRange(int(ranges), *sort).sortWithinPartitions(*sort)
    ordered = staged(spark, ordered.withColumn("range", F.spark_partition_id()).mapInArrow(run, "range int, at long, doc_id long, n long, ids binary"), "packing-ordered", "zstd")
    totals = ordered.groupBy("range").agg(F.sum("n").alias("n")).toArrow()  # one row a range
    sums = np.zeros(1 + max([-1, *totals.column("range").to_pylist()]), np.int64)
    sums[totals.column("range").to_numpy()] = totals.column("n").to_numpy()
    return ordered, np.concatenate([[0], np.cumsum(sums)])


def borders(total: int, size: int) -> np.ndarray:
    """Starts of the sequences in the tail that fills no whole sequence, and
    its end: falling powers of two."""
    left, at, out = total % size, total - total % size, []
    while left:
        step = 1 << left.bit_length() - 1
        out.append(at)
        at, left = at + step, left - step
    return np.array(out + [at], np.int64)


def cuts(first: int, n: int, size: int, tail: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(start, length, sequence, offset) of the pieces of a document whose ids
    stand at first .. first + n of the stream."""
    whole, out, at = int(tail[0]), [], first
    while at < first + n:
        if at < whole:
            sequence, begin = divmod(at, size)[0], at - at % size
            end = begin + size
        else:
            k = int(np.searchsorted(tail, at, "right")) - 1
            sequence, begin, end = whole // size + k, int(tail[k]), int(tail[k + 1])
        upto = min(end, first + n)
        out.append((at - first, upto - at, sequence, at - begin))
        at = upto
    return out


def pack(spark: SparkSession, docs: DataFrame, path: str, *, size: int = SIZE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of all documents: (doc_id, start, length, ids, doc_tokens,
    sequence_id, offset); ``ids`` are little-endian unsigned 32-bit integers."""
    rows, wide = placed(spark, docs, path, id_col, text_col)
    ordered, first = along_curve(spark, rows, wide)
    base, tail = spark.sparkContext.broadcast(first), borders(int(first[-1]), size)
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, 512):
            begin = base.value[b.column("range").to_numpy()] + b.column("at").to_numpy()
            out: list[tuple] = []
            for doc_id, n, at, raw in zip(b.column("doc_id").to_pylist(), b.column("n").to_pylist(), begin.tolist(), b.column("ids")):
                ids = np.frombuffer(raw.as_buffer(), wide).astype("<u4").tobytes()
                out += [(doc_id, s, m, ids[4 * s:4 * (s + m)], n, q, o) for s, m, q, o in cuts(at, n, size, tail)]
            if out:
                yield batch_of(schema, list(zip(*out)))

    return ordered.mapInArrow(run, PIECES)


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences themselves: (sequence_id, n, ids binary, doc_ids in
    order). A group is one sequence, thus at most ``size`` ids."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "doc_id", "ids")))
    return (packed.groupBy("sequence_id").agg(F.sum("length").alias("n"), parts.alias("p"))
            .select("sequence_id", "n", F.expr("aggregate(p.ids, cast('' as binary), (a, x) -> a || x)").alias("ids"), F.col("p.doc_id").alias("doc_ids")))
