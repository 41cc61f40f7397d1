"""Benchmark decontamination: size-partitioned MinHash containment search.

Finds the documents that hold at least ``threshold`` of a test item's distinct
word shingles, however long the document. Column functions and joins only.

Words are the lower-cased runs of letters and digits; shingles are ``width``
consecutive words (an item of fewer words is one shingle of its own length).
Items are partitioned by their number of distinct shingles (powers of two).
The MinHash sketch of an item is its k smallest shingle hashes. k is set for
each size partition, from its upper bound u, as u - ceil(threshold u) + 1: a
document that lacks at most the share the threshold allows must hold one of
any k shingles, so the search loses no pair. Sketches are short and the search
is one-sided: every shingle hash of a document is looked up, in place, without
a shuffle of shingles or texts. Candidate pairs are verified by exact
containment of the shingles as strings: a document with candidates is split
once, whatever their number, and its shingles look the items' shingles up.

The sketch table, the item shingles and the candidate list are broadcast only
if their counted rows and bytes stay below ``MOST`` and ``MOST_BYTES``; beyond
either they are joined by a shuffle, with the same results.

Defined results: null and wordless texts hold nothing and, as items, are in
nothing; items with equal text are reported each; a doc_id on several rows is
reported once an item, with its best containment; a null doc_id or item_id is
kept as null; an empty table gives no row; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.matching import fence
from .common import keyed, staged

#: rows and bytes of values up to which a table is broadcast
MOST = 500_000
MOST_BYTES = 32 << 20


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), 0)


def shingle_hashes(hashed: Column, n: int) -> Column:
    """Hashes of n consecutive words, from the array of word hashes."""
    last = F.size(hashed) - n
    each = F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(F.lit(n), *[F.get(hashed, i + k) for k in range(n)]))
    return F.when(last >= 0, each).otherwise(F.array().cast("array<bigint>"))


def shingles(w: Column, n: Column) -> Column:
    """The distinct shingles of n consecutive words as strings."""
    each = F.transform(F.sequence(F.lit(0), F.size(w) - n), lambda i: F.array_join(F.slice(w, i + 1, n), " "))
    return F.when(F.size(w) >= n, F.array_distinct(each)).otherwise(F.array().cast("array<string>"))


def small(df: DataFrame) -> DataFrame:
    """``df`` marked for broadcast if a count says that it has few rows and bytes."""
    wide = [F.coalesce(F.octet_length(c), F.lit(0)) if t == "string" else F.lit(8) for c, t in df.dtypes]
    rows, size = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(sum(wide, F.lit(0)).cast("long")), F.lit(0))).first()
    return F.broadcast(df) if rows <= MOST and size <= MOST_BYTES else df


def item_table(items: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    """(item_id, item, n, hashes, shingles): words a shingle, its distinct
    shingles; items of equal words share the digest ``item``."""
    rows = items.select(F.col(id_col).alias("item_id"), words(F.coalesce(F.col(text_col), F.lit(""))).alias("w"))
    rows = rows.withColumn("n", F.least(F.size("w"), F.lit(width))).where("n > 0").withColumn("hw", F.transform("w", lambda x: F.xxhash64(x)))
    hashes = F.coalesce(*[F.when(F.col("n") == n, shingle_hashes(F.col("hw"), n)) for n in range(1, width + 1)])
    return rows.select("item_id", F.xxhash64("w").alias("item"), "n", F.array_distinct(hashes).alias("hashes"), shingles(F.col("w"), F.col("n")).alias("shingles"))


def sketches(item: DataFrame, threshold: float) -> DataFrame:
    """(h, item): the k smallest shingle hashes of each item text."""
    size = F.size("hashes")
    upper = F.pow(F.lit(2), F.floor(F.log2(size)) + 1) - 1  # of the item's size partition
    k = F.least(size, (upper - F.ceil(upper * F.lit(threshold) - 1e-9) + 1).cast("int"))
    return item.select("item", F.explode(F.slice(F.array_sort("hashes"), 1, k)).alias("h")).distinct()


def contained(spark: SparkSession, docs: DataFrame, items: DataFrame, threshold: float = 0.8, width: int = 5, *, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, digest, item_id, n_shingles, n_shared, containment) for each
    document (doc_id and text digest) and item it holds."""
    if not 0 < threshold <= 1:
        raise ValueError("threshold is a share above 0")
    item = staged(spark, item_table(items, width, item_id, item_text), "items")
    rows = keyed(docs, id_col, text_col)
    lengths = sorted(r["n"] for r in item.select("n").distinct().collect())  # at most ``width`` numbers
    if not lengths:
        lengths = [width]
    hashed = fence(rows, F.transform(words(F.col("text")), lambda x: F.xxhash64(x)), "hw")
    probes = hashed.select("doc_id", "digest", F.explode(F.concat(*[shingle_hashes(F.col("hw"), n) for n in lengths])).alias("h"))
    found = probes.join(small(staged(spark, sketches(item, threshold), "sketches")), "h").select("doc_id", "digest", "item").distinct()
    pairs = staged(spark, found, "candidates")

    # each item's shingles, numbered, and of how many words it has them
    first = item.groupBy("item").agg(F.first("shingles").alias("wanted"))
    wanted = staged(spark, first.select("item", F.size("wanted").alias("n_shingles"), F.posexplode("wanted").alias("k", "s")), "wanted")
    mine = small(pairs.select(F.col("doc_id").alias("own"), F.col("digest").alias("sum")).distinct())
    held = rows.join(mine, rows["doc_id"].eqNullSafe(mine["own"]) & (rows["digest"] == mine["sum"]), "left_semi")
    # fenced: what comes below would split the text again for each shingle
    held = fence(held, words(F.col("text")), "w").select("doc_id", "digest", F.explode(F.concat(*[shingles(F.col("w"), F.lit(n)) for n in lengths])).alias("s"))
    hits = held.join(small(wanted), "s").select("doc_id", "digest", "item", "n_shingles", "k").distinct()
    shared = hits.groupBy("doc_id", "digest", "item").agg(F.first("n_shingles").alias("n_shingles"), F.count(F.lit(1)).cast("int").alias("n_shared"))
    held = shared.where(F.col("n_shared") >= F.ceil(F.col("n_shingles") * F.lit(threshold) - 1e-9))
    ids = small(item.select("item", "item_id"))
    return held.join(ids, "item").select("doc_id", "digest", "item_id", "n_shingles", "n_shared", (F.col("n_shared") / F.col("n_shingles")).alias("containment"))


def pairs_of(spark: SparkSession, docs: DataFrame, items: DataFrame, threshold: float = 0.8, width: int = 5) -> DataFrame:
    """(doc_id, item_id, n_shingles, n_shared, containment), a row a pair of ids."""
    best = contained(spark, docs, items, threshold, width).groupBy("doc_id", "item_id").agg(F.max(F.struct("containment", "n_shared", "n_shingles")).alias("b"))
    return best.select("doc_id", "item_id", "b.n_shingles", "b.n_shared", "b.containment")


def keep_clean(spark: SparkSession, docs: DataFrame, items: DataFrame, threshold: float = 0.8, width: int = 5) -> DataFrame:
    """``docs``, all columns, without the rows that hold an item."""
    bad = staged(spark, contained(spark, docs, items, threshold, width).select("doc_id", "digest").distinct(), "contaminated")
    bad = small(bad.select(F.col("doc_id").alias("__llm_id"), F.col("digest").alias("__llm_digest")))
    own, digest = F.col("doc_id").cast("long"), F.xxhash64(F.coalesce(F.col("text"), F.lit("")))
    return docs.join(bad, own.eqNullSafe(F.col("__llm_id")) & (digest == F.col("__llm_digest")), "left_anti")


def sql(threshold: float = 0.8, width: int = 5) -> str:
    """The same pairs in DuckDB SQL over ``documents`` and ``benchmark``."""
    w = "regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}]+')"
    cut = "array_to_string(w[i + 1:i + n], ' ')"
    return f"""
WITH items AS (SELECT item_id, {w} AS w, least(len({w}), {width}) AS n FROM benchmark),
want AS (SELECT DISTINCT item_id, n, {cut} AS s FROM (SELECT item_id, w, n, unnest(range(0, len(w) - n + 1)) AS i FROM items WHERE n > 0)),
lengths AS (SELECT DISTINCT n FROM items WHERE n > 0),
have AS (SELECT DISTINCT doc_id, rn, n, {cut} AS s FROM (SELECT doc_id, rn, w, n, unnest(range(0, len(w) - n + 1)) AS i
         FROM (SELECT doc_id, row_number() OVER () AS rn, {w} AS w FROM documents), lengths)),
total AS (SELECT item_id, count(*) AS n_shingles FROM want GROUP BY item_id),
shared AS (SELECT doc_id, rn, item_id, count(*) AS n_shared FROM have JOIN want USING (n, s) GROUP BY doc_id, rn, item_id)
SELECT doc_id, item_id, n_shingles::INTEGER AS n_shingles, max(n_shared)::INTEGER AS n_shared, max(n_shared) / n_shingles AS containment
FROM shared JOIN total USING (item_id) WHERE n_shared >= ceil(n_shingles * {threshold} - 1e-9) GROUP BY doc_id, item_id, n_shingles""".strip()
