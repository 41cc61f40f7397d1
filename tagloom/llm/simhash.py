"""SimHash near-duplicate groups with pivot distance tables.

1. ``fingerprints``: one pass over whole texts, 4-word shingles, XXH64.
2. Equal fingerprints collapse to one class (map-side first, so copies of one
   text cost nothing after that).
3. Pairs of classes that can be within 4 bits: two 64-bit words that differ in
   at most 4 bits agree on at least 2 of 6 blocks, so each class is dealt to
   the 15 pairs of blocks (exact, no recall to tune). Pivot distances alone
   cannot index random fingerprints: the difference of two distances to one
   pivot is within 4 for over half of all pairs.
4. The pivot distance table: the Hamming distances of each class to 16
   reference fingerprints, computed once, travel with it. Inside a bucket a
   pair whose distances differ by more than 4 for any pivot is discarded
   (triangle inequality); survivors are verified bit by bit.
5. A bucket above ``TILE`` classes is cut into tiles, one group for each pair
   of tiles: a task holds two tiles at most. A group returns a spanning forest
   of its links, never all pairs.
6. Components by large-star / small-star rounds over staged tables.

Defined results: null and wordless texts have fingerprint zero, linked like
any other; a text of fewer than 4 words is one shingle; a null doc_id gets a
fingerprint, and its component is the smallest non-null doc_id reachable (null
if there is none); repeated rows get a row each; an empty table gives no row;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batch_of, keyed, pieces, staged

TILE = 4096
#: (shift, bits) of the 6 blocks
BLOCKS = [(0, 11), (11, 11), (22, 11), (33, 11), (44, 10), (54, 10)]
PIVOTS = [xxhash.xxh64_intdigest(str(i), 42) for i in range(16)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprint(text: str | None, width: int = 4) -> int:
    """Bit b is 1 if it is set in over half of the shingles' XXH64 values."""
    words = (text or "").encode().lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(words) - width + 1)
    last = ends[width - 1:] if len(words) >= width else ends[-1:]
    h = np.array([xxhash.xxh64_intdigest(joined[a:b], 42) for a, b in zip(starts[:n].tolist(), last.tolist())], "<u8")
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 14):
        part = h[at:at + (1 << 14)]
        ones += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = 4, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, digest, fp) for every row, fp as a signed long."""
    schema = pa.schema([("doc_id", pa.int64()), ("digest", pa.int64()), ("fp", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            yield batch_of(schema, [b.column("doc_id"), b.column("digest"), [signed(fingerprint(t, width)) for t in b.column("text").to_pylist()]])

    return keyed(docs, id_col, text_col).mapInArrow(run, "doc_id long, digest long, fp long")


def pivot_table(classes: DataFrame) -> DataFrame:
    """``classes`` with the distances to the 16 pivots, 7 bits each, in two longs."""
    d = [F.bit_count(F.col("fp").bitwiseXOR(F.lit(signed(p)))).cast("long") for p in PIVOTS]
    pack = [sum((F.shiftleft(x, 7 * i) for i, x in enumerate(d[h:h + 8])), F.lit(0).cast("long")) for h in (0, 8)]
    return classes.withColumns({"p0": pack[0], "p1": pack[1]})


def buckets(classes: DataFrame) -> DataFrame:
    """(k, fp, p0, p1): each class under the 15 pairs of blocks."""
    part = [F.shiftrightunsigned("fp", s).bitwiseAND(F.lit((1 << n) - 1)) for s, n in BLOCKS]
    keys = [F.shiftleft(F.lit(t).cast("long"), 24).bitwiseOR(F.shiftleft(part[i], 11)).bitwiseOR(part[j]) for t, (i, j) in enumerate(combinations(range(6), 2))]
    return classes.select(F.explode(F.array(*keys)).alias("k"), "fp", "p0", "p1")


def unpacked(p: np.ndarray) -> np.ndarray:
    """Pivot distances of packed rows: int8[rows, 8]."""
    return ((p[:, None] >> (7 * np.arange(8))) & 127).astype(np.int8)


class Forest:
    """Union-find over row numbers; keeps the links that joined two trees."""

    def __init__(self, n: int):
        self.up = np.arange(n)  # between calls every row points at its root
        self.links: list[tuple[int, int]] = []

    def root(self, x: int) -> int:
        while self.up[x] != x:
            x = int(self.up[x])
        return x

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        new = self.up[i] != self.up[j]
        if not new.any():
            return
        for a, b in zip(i[new].tolist(), j[new].tolist()):
            ra, rb = self.root(a), self.root(b)
            if ra != rb:
                self.up[rb] = ra
                self.links.append((a, b))
        while True:
            nearer = self.up[self.up]
            if (nearer == self.up).all():
                return
            self.up = nearer


def links_of(group: np.ndarray, side: np.ndarray, fp: np.ndarray, pivots: np.ndarray, bits: int) -> list[tuple[int, int]]:
    """Spanning forest of the pairs within ``bits`` bits, over rows sorted by
    group: row i meets row i + s while both are of one group. In a group of
    two tiles (sides 1 and 2) only rows of different sides meet."""
    forest, n = Forest(len(fp)), len(fp)
    live = np.arange(n)
    s = 1
    while True:
        live = live[live + s < n]
        live = live[group[live] == group[live + s]]
        if not len(live):
            return forest.links
        i, j = live, live + s
        if side.any():
            apart = (side[i] == 0) | (side[i] != side[j])
            i, j = i[apart], j[apart]
        near = (np.abs(pivots[i] - pivots[j]) <= bits).all(axis=1)  # the pivot filter
        i, j = i[near], j[near]
        close = np.bitwise_count(fp[i] ^ fp[j]) <= bits  # the verification
        forest.add(i[close], j[close])
        s += 1


def near_links(spark: SparkSession, classes: DataFrame, bits: int = 4, tile: int = TILE) -> DataFrame:
    """(a, b): links between class fingerprints that span every component."""
    if bits > 4:
        raise ValueError("the 15 block pairs are exact up to 4 bits")
    rows = buckets(pivot_table(classes))
    hot = rows.groupBy("k").count().where(F.col("count") > tile).select("k", F.ceil(F.col("count") / tile).cast("int").alias("tiles"))
    mine = F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int")
    # (low tile, high tile, side): side 0 where both are the same tile
    meets = F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda t: F.struct(F.least(t, F.col("mine")).alias("u"), F.greatest(t, F.col("mine")).alias("v"), F.when(t == F.col("mine"), 0).when(t > F.col("mine"), 1).otherwise(2).alias("side")))
    dealt = (rows.join(hot, "k", "left").withColumn("tiles", F.coalesce("tiles", F.lit(1))).withColumn("mine", mine)
             .select("k", "fp", "p0", "p1", F.explode(meets).alias("m")).select(F.xxhash64("k", "m.u", "m.v").alias("g"), F.col("m.side").cast("int").alias("side"), "fp", "p0", "p1"))
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cols in whole_groups(batches):
            g, side, fp = cols["g"], cols["side"], cols["fp"]
            pivots = np.concatenate([unpacked(cols["p0"]), unpacked(cols["p1"])], axis=1)
            links = links_of(g, side, fp.view(np.uint64), pivots, bits)
            if links:
                i, j = np.array(links).T
                yield batch_of(schema, [fp[i], fp[j]])

    return dealt.repartition("g").sortWithinPartitions("g").mapInArrow(run, "a long, b long")


def whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, np.ndarray]]:
    """Columns of runs of rows sorted by ``g`` that hold whole groups; at most
    a batch and one group are held."""
    rest = None
    for b in batches:
        new = {n: b.column(n).to_numpy(zero_copy_only=False) for n in b.schema.names}
        cols = new if rest is None else {n: np.concatenate([rest[n], new[n]]) for n in new}
        g = cols["g"]
        cut = int(np.searchsorted(g, g[-1])) if len(g) else 0
        if cut:
            yield {n: c[:cut] for n, c in cols.items()}
        rest = {n: c[cut:] for n, c in cols.items()}
    if rest is not None and len(rest["g"]):
        yield rest


def components(spark: SparkSession, edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root): root is the smallest node of each component, from edges
    (a, b). Large-star and small-star in turn until the edges stay the same."""
    edges = staged(spark, edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")

    def sums(e: DataFrame):
        # a whole-table check value; sums of hashes, as decimals to be exact
        r = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        return tuple(r)

    before = sums(edges)
    for _ in range(max_rounds):
        if not before[0]:
            break
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        low = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        small_low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(small_low, "a")
        edges = staged(spark, small.select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").where("a <> b").distinct(), "edges")
        now = sums(edges)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def grouped(spark: SparkSession, docs: DataFrame, bits: int, width: int, id_col: str, text_col: str, tile: int) -> tuple[DataFrame, DataFrame]:
    """(rows, classes): (doc_id, digest, fp) for every row, and (fp, first,
    root) for every fingerprint; first is its smallest (no id, doc_id, digest)."""
    rows = staged(spark, fingerprints(docs, width, id_col=id_col, text_col=text_col), "fingerprints")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "digest"))
    classes = staged(spark, rows.groupBy("fp").agg(first.alias("first")), "classes")
    roots = components(spark, near_links(spark, classes.select("fp"), bits, tile))
    return rows, classes.join(roots, classes["fp"] == roots["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))


def near_duplicates(spark: SparkSession, docs: DataFrame, bits: int = 4, width: int = 4, *, id_col: str = "doc_id", text_col: str = "text", tile: int = TILE) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row."""
    rows, classes = grouped(spark, docs, bits, width, id_col, text_col, tile)
    least = classes.groupBy("root").agg(F.min("first")["doc_id"].alias("component_id"))
    named = classes.select("fp", "root").join(least, "root").select("fp", "component_id")
    return rows.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(spark: SparkSession, docs: DataFrame, bits: int = 4, width: int = 4, *, id_col: str = "doc_id", text_col: str = "text", tile: int = TILE) -> DataFrame:
    """``docs``, all columns, with one row of each group: the one of the
    smallest doc_id (null last), then of the smallest text digest; of rows
    equal in both any one."""
    _, classes = grouped(spark, docs, bits, width, id_col, text_col, tile)
    winners = classes.groupBy("root").agg(F.min("first").alias("w")).select(F.col("w.doc_id").alias("__llm_id"), F.col("w.digest").alias("__llm_digest"))
    digest = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    rows = docs.withColumns({"__llm_own": F.col(id_col).cast("long"), "__llm_sum": digest})
    kept = rows.join(winners, F.col("__llm_own").eqNullSafe(F.col("__llm_id")) & (F.col("__llm_sum") == F.col("__llm_digest")), "left_semi")
    # one whole row of each repeated one; repeats meet map-side, not in one task
    one = kept.groupBy("__llm_own", "__llm_sum").agg(F.first(F.struct(*[F.col(f"`{c}`") for c in docs.columns])).alias("__llm_row"))
    return one.select(*[F.col("__llm_row").getField(c).alias(c) for c in docs.columns])
