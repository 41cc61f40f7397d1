"""Exact top-k search: tiled products of queries and shards.

Candidates are dealt to shards by a hash of id and vector, so that an id on
many rows is many shards' work. A shard has about ``SHARD_BYTES`` of doubles,
counted from the vectors' lengths; small inputs are cut into smaller shards
for as many tasks as run at once. Every query goes to every shard (queries are the smaller side: a stated set, in blocks, so the
rows moved are queries x shards, never queries x candidates). A task holds one
shard as a matrix, streams the query rows past it in tiles, and keeps k rows a
query and tile by partial selection. The short lists are merged as a tree:
rounds of ranking over ``FAN`` lists at a time until one is left.

Scores are integers: components are floor(scale * x). Sums below 2^53 are
exact in double precision; a tile whose bound is higher is multiplied with
Python integers. A score outside 64 bits is clipped to them, then ranked.

Defined results: vectors that are null, empty or hold a null or non-finite
component take no part, rows with a null id neither; only vectors of equal
length are compared; a candidate with the query's own id is left out; an id
on several rows counts once a query, with its best score; ties go to the
smaller id; fewer than k candidates give fewer rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import batch_of

#: vectors a shard and its bytes (a task holds them up to three times), bytes
#: of a shard worth a task of its own, scores a tile, lists merged at once
SHARD, SHARD_BYTES, LEAST_BYTES, TILE, FAN = 131_072, 32 << 20, 1 << 20, 1 << 22, 16


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, v, dim) of the vectors that take part, v as doubles."""
    v = F.col("v")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return (vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
            .where(F.col("id").isNotNull() & v.isNotNull() & (F.size(v) > 0)).where(finite).withColumn("dim", F.size(v)))


def best_of(scores: np.ndarray, ids: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, id, score) of the k best of each row of a tile. ``ids`` are
    ascending; the lowest of equal ids' columns stands for them all."""
    first = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
    if len(first) < len(ids):
        scores, ids = np.maximum.reduceat(scores, first, axis=1), ids[first]
    rows = np.arange(len(own))
    at = np.searchsorted(ids, own)
    mine = (at < len(ids)) & (ids[np.minimum(at, len(ids) - 1)] == own)
    # every candidate that reaches the k-th best score (one more for the own row)
    most = min(k + 1, scores.shape[1])
    floor = np.partition(scores, scores.shape[1] - most, axis=1)[:, scores.shape[1] - most]
    level = scores == floor[:, None]
    for r in np.flatnonzero(level.sum(axis=1) > most):  # of equal scores the smaller ids are enough
        level[r, np.flatnonzero(level[r])[most:]] = False
    q, c = np.nonzero((scores > floor[:, None]) | level)
    keep = ~(mine[q] & (c == at[q]))
    q, c = q[keep], c[keep]
    s = scores[q, c]
    order = np.lexsort((ids[c], -s, q))
    q, c, s = q[order], c[order], s[order]
    rank = np.arange(len(q)) - np.searchsorted(q, rows)[q]
    top = rank < k
    return q[top], ids[c[top]], s[top]


def product(queries: np.ndarray, shard: np.ndarray) -> np.ndarray:
    """Integer inner products as int64, whatever their size."""
    bound = float(np.abs(queries).max(initial=0)) * float(np.abs(shard).max(initial=0)) * shard.shape[1]
    if bound < 2 ** 53:
        return (queries @ shard.T).astype(np.int64)
    whole = np.frompyfunc(int, 1, 1)
    exact = whole(queries) @ whole(shard).T
    return np.clip(exact, -(1 << 63), (1 << 63) - 1).astype(np.int64)


def shards_for(rows: int, size: int, cores: int, shard_rows: int = SHARD) -> int:
    """How many shards hold so many rows of so many bytes; only shards that
    are worth a task are added for the cores, so queries are not copied for each."""
    return max(1, -(-rows // shard_rows), -(-size // SHARD_BYTES), min(2 * cores, -(-size // LEAST_BYTES)))


def search(spark: SparkSession, vectors: DataFrame, is_query: Column, k: int = 5, scale: float = 256.0, *, id_col: str = "vec_id", vec_col: str = "embedding", shard_rows: int = SHARD) -> DataFrame:
    """(query_id, rank, vec_id, score); ``is_query`` is a condition on ``id``."""
    rows = usable(vectors, id_col, vec_col)
    n, numbers = rows.agg(F.count("*"), F.sum("dim")).first()
    shards = shards_for(n, 8 * (numbers or 0), spark.sparkContext.defaultParallelism, shard_rows)
    candidates = rows.select(F.pmod(F.xxhash64("id", "v"), F.lit(shards)).cast("int").alias("shard"), F.lit(0).alias("asks"), "id", "v", "dim")
    queries = rows.where(is_query).select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(1).alias("asks"), "id", "v", "dim")
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64()), ("shard", pa.int32())])

    def tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, ids, matrix = None, [], None, None
        for b in batches:
            shard, dim, asks = (b.column(n).to_numpy() for n in ("shard", "dim", "asks"))
            keys = np.stack([shard, dim, asks], axis=1)
            cuts = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]).any(axis=1)])).tolist() + [len(keys)]
            for lo, hi in zip(cuts, cuts[1:]):
                if hi == lo:
                    continue
                part, key = b.slice(lo, hi - lo), (int(shard[lo]), int(dim[lo]))
                got = np.floor(part.column("v").flatten().to_numpy(zero_copy_only=False).reshape(hi - lo, key[1]) * scale)
                own = part.column("id").to_numpy()
                if key != at:
                    at, held, ids, matrix = key, [], None, None
                if not asks[lo]:
                    held.append((own, got))
                    continue
                if matrix is None:
                    if not held:
                        continue
                    ids, matrix = np.concatenate([x for x, _ in held]), np.concatenate([y for _, y in held])
                    order = np.argsort(ids, kind="stable")
                    ids, matrix, held = ids[order], matrix[order], [(None, None)]
                step = max(1, TILE // len(ids))
                for t in range(0, len(own), step):
                    q, c, s = best_of(product(got[t:t + step], matrix), ids, own[t:t + step], k)
                    yield batch_of(schema, [own[t:t + step][q], c, s, np.full(len(q), key[0], np.int32)])

    lists = (candidates.unionByName(queries).repartition(shards, "shard").sortWithinPartitions("shard", "dim", "asks")
             .mapInArrow(tiles, "query_id long, vec_id long, score long, shard int"))
    order = (F.desc("score"), F.asc("vec_id"))
    while True:
        shards = -(-shards // FAN)
        merged = lists.withColumn("shard", (F.col("shard") / FAN).cast("int")).groupBy("query_id", "shard", "vec_id").agg(F.max("score").alias("score"))
        lists = merged.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "shard").orderBy(*order))).where(F.col("rank") <= k)
        if shards == 1:
            return lists.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
        lists = lists.drop("rank")
