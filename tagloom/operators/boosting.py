"""Boosted trees over sparse rows, as a model of Spark's own.

The trees are those of Spark's GBTClassifier (log loss, variance impurity, 32
bins, split candidates from the same share of the rows, the first tree whole
and the others times the step). Only how a level is found differs:

* Spark keeps a row in full width and adds up every feature of every row. Here
  rows lie by (feature, bin) and hold what is not zero; what the bin of zero
  holds is the node's total less the other bins.
* Tasks send the bins that have rows, dealt by feature; the best split of a
  range of features is found where its bins meet, and only that reaches the
  driver (with few rows, their bins do).
* Weighted residuals are rounded to a grid on which any sum of them is exact,
  so a tree does not depend on how the rows are dealt out, and of equal splits
  the first feature's, then the lowest, always wins.

A task holds a chunk of rows and NODES_AT_ONCE nodes' bins; the driver holds
the trees.
"""

from __future__ import annotations

import json
import math
import time
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.serializers import CPickleSerializer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint_path

SPLIT_ROWS = 10_000  # rows that Spark finds split candidates from (or bins squared, if more)
DEALT_ROWS, CHUNK_ROWS = 2_048, 32_768  # rows dealt to a task together, and lying together in it
BLOCK = 1 << 17  # entries added up at a time: what is between the steps stays in the processor's cache
PART_ROWS = 262_144  # rows of a task, where there are enough of them for all cores
NODES_AT_ONCE = 32
SMALL = 3_000_000  # entries of all rows up to which their bins (20 bytes each at most) meet in the driver: half the time of a shuffle
FOLD = 10  # trees after which the rows' margins are kept anew
BASE = float(1 << 26)  # positives in the upper half of a count, so one sum counts both classes
NODE = ("struct<id:int,prediction:double,impurity:double,impurityStats:array<double>,rawCount:bigint,gain:double,leftChild:int,rightChild:int,"
        "split:struct<featureIndex:int,leftCategoriesOrThreshold:array<double>,numCategories:int>>")


def sparse_parts(features: str, part: str):
    """Places ("i") or values ("x") of the entries of a vector that are not 0.
    A sparse vector is read as it is, never written out in full width."""
    v = F.unwrap_udt(features)
    places = F.coalesce(v["indices"], F.sequence(F.lit(0), F.size(v["values"]) - 1))  # a dense vector has none
    entries = F.filter(F.arrays_zip(places.cast("array<long>").alias("i"), v["values"].alias("x")), lambda e: e["x"] != 0)
    return F.transform(entries, lambda e: e[part])


@dataclass
class Chunk:
    """Rows by cell: cell = feature * bins + bin; rows[starts[k]:starts[k + 1]]
    are those of cells[k]. No entry is kept in the bin of its feature's zero."""
    cells: np.ndarray
    starts: np.ndarray
    rows: np.ndarray
    positive: np.ndarray
    margin: np.ndarray


@dataclass
class Tree:
    """Nodes as in a heap: 2 k + 1 and 2 k + 2 are below k. feature is -1 in a
    leaf; zero_right says where a row without the feature goes."""
    feature: np.ndarray
    bin: np.ndarray
    zero_right: np.ndarray
    value: np.ndarray

    @classmethod
    def empty(cls, depth: int) -> Tree:
        n = (2 << depth) - 1
        return cls(np.full(n, -1, np.int32), np.zeros(n, np.int16), np.zeros(n, bool), np.zeros(n))


@dataclass
class Plan:
    """What every task needs: the bin of zero and the number of splits of each
    feature, weight of a positive row, residuals' grid, bins, step, and how
    many entries are added up at a time."""
    zero: np.ndarray
    n_splits: np.ndarray
    weight: float
    grid: float
    bins: int
    step: float
    block: int


def split_values(values: list, weights: list, total: float, most: int) -> list:
    """Split candidates of one feature from its sorted distinct values other
    than zero, as Spark finds them; ``total``: weight of all rows."""
    rest = total - math.fsum(weights)
    if rest > np.finfo(float).eps * len(values) * 100:
        at = int(np.searchsorted(values, 0.0))
        values, weights = values[:at] + [0.0] + values[at:], weights[:at] + [rest] + weights[at:]
    if len(values) - 1 <= most:
        return [(a + b) / 2 for a, b in zip(values, values[1:])]
    stride = total / (most + 1)
    seen, target, found = weights[0], stride, []
    for k in range(1, len(values)):
        before, seen = seen, seen + weights[k]
        if abs(before - target) < abs(seen - target):
            found.append((values[k - 1] + values[k]) / 2)
            target += stride
    return found


def split_candidates(rows: DataFrame, features: str, label: str, width: int, n: int, total: float, weight: float, bins: int, seed: int) -> list:
    """Split values of each feature."""
    share, tasks = min(1.0, max(bins * bins, SPLIT_ROWS) / n), rows.sparkSession.sparkContext.defaultParallelism

    def run(batches):
        got = [(b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2).to_numpy(zero_copy_only=False)) for b in batches]
        if not got:
            return
        i, x, w = (np.concatenate(c) for c in zip(*got))
        order = np.lexsort((x, i))
        i, x, w = i[order], x[order], np.where(w[order], weight, 1.0)
        first = np.flatnonzero(np.r_[True, (i[1:] != i[:-1]) | (x[1:] != x[:-1])])
        w, i, x = np.add.reduceat(w, first), i[first], x[first]
        ends = np.r_[np.flatnonzero(np.r_[True, i[1:] != i[:-1]]), len(i)]
        found = [split_values(x[a:b].tolist(), w[a:b].tolist(), share * total, min(bins, n) - 1) for a, b in zip(ends, ends[1:])]
        yield pa.RecordBatch.from_arrays([pa.array(i[ends[:-1]], pa.int64()), pa.array(found, pa.list_(pa.float64()))], ["i", "t"])

    some = rows if share == 1 else rows.sample(False, share, seed)
    entries = some.select(F.explode(F.arrays_zip(sparse_parts(features, "i").alias("i"), sparse_parts(features, "x").alias("x"))).alias("e"), (F.col(label) == 1).alias("w"))
    splits = [[]] * width
    for r in entries.select("e.i", "e.x", "w").repartition(tasks, "i").mapInArrow(run, "i long, t array<double>").collect():  # bins - 1 numbers a feature at most
        splits[r["i"]] = r["t"]
    return splits


def chunked(rows: DataFrame, features: str, label: str, splits, plan: Plan, tasks: int):
    """The rows as an RDD of chunks, dealt evenly to so many tasks, kept."""
    sc, dumps, loads = rows.sparkSession.sparkContext, CPickleSerializer().dumps, CPickleSerializer().loads
    shared, bins = sc.broadcast((splits, plan.zero)), plan.bins
    few, many = DEALT_ROWS, CHUNK_ROWS

    def pack(b):
        splits, zero = shared.value
        size = np.diff(b.column(0).offsets.to_numpy())
        i, x = (b.column(k).flatten().to_numpy() for k in (0, 1))
        if b.column(0).null_count or not np.isfinite(x).all():
            raise ValueError("a training row has no features, or features without a finite value")
        row = np.repeat(np.arange(len(size), dtype=np.uint16), size)
        order = np.argsort(i, kind="stable")
        i, x, row = i[order], x[order], row[order]
        cell = i * bins
        for f, first, end in zip(*(v.tolist() for v in _runs(i))):
            cell[first:end] += np.searchsorted(splits[f], x[first:end])
        kept = cell != i * bins + zero[i]
        return by_cell(cell[kept], row[kept], b.column(2).to_numpy(zero_copy_only=False))

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, few):
                yield pa.RecordBatch.from_arrays([pa.array([dumps(pack(b.slice(at, few)))], pa.binary())], ["chunk"])

    def merged(part):
        held = []
        for _, chunk in part:
            held.append(chunk)
            if sum(len(c.positive) for c in held) + few > many:
                yield joined(held)
                held = []
        if held:
            yield joined(held)

    parts = rows.select(sparse_parts(features, "i").alias("i"), sparse_parts(features, "x").alias("x"), (F.col(label) == 1).alias("y")).mapInArrow(run, "chunk binary").rdd
    dealt = parts.mapPartitionsWithIndex(lambda k, part: ((k + j, loads(bytes(r[0]))) for j, r in enumerate(part)))
    return dealt.partitionBy(tasks, int).mapPartitions(merged).persist(StorageLevel.MEMORY_AND_DISK)


def by_cell(cell: np.ndarray, row: np.ndarray, positive: np.ndarray) -> Chunk:
    order = np.argsort(cell, kind="stable")
    cells, first, _ = _runs(cell[order])
    return Chunk(cells, np.r_[first, len(cell)], row[order], positive.astype(bool), np.zeros(len(positive)))


def joined(chunks: list) -> Chunk:
    at = np.cumsum([0] + [len(c.positive) for c in chunks])
    return by_cell(np.concatenate([np.repeat(c.cells, np.diff(c.starts)) for c in chunks]), np.concatenate([c.rows + np.uint16(k) for c, k in zip(chunks, at)]), np.concatenate([c.positive for c in chunks]))


def _runs(x: np.ndarray) -> tuple:
    """(values, first places, places after the last) of the runs of a sorted array."""
    first = np.flatnonzero(np.r_[True, x[1:] != x[:-1]]) if len(x) else np.zeros(0, np.int64)
    return x[first], first, np.r_[first[1:], len(x)] if len(x) else first


def node_of(chunk: Chunk, tree: Tree, bins: int) -> np.ndarray:
    """The node that each row ends in."""
    node, inner = np.zeros(len(chunk.positive), np.int32), np.flatnonzero(tree.feature >= 0)
    cell = tree.feature[inner].astype(np.int64) * bins
    low, mid, high = (chunk.starts[np.searchsorted(chunk.cells, c)] for c in (cell, cell + tree.bin[inner] + 1, cell + bins))
    at = 0
    for level in range(len(tree.feature).bit_length()):
        side, begun = tree.zero_right[node].astype(np.int32), at
        while at < len(inner) and inner[at] < (2 << level) - 1:
            k = inner[at]
            rows = chunk.rows[low[at]:mid[at]] if tree.zero_right[k] else chunk.rows[mid[at]:high[at]]
            side[rows[node[rows] == k]] = not tree.zero_right[k]
            at += 1
        if at == begun:
            break
        node = np.where(tree.feature[node] >= 0, 2 * node + 1 + side, node)
    return node


def margin_of(chunk: Chunk, trees: list, plan: Plan) -> np.ndarray:
    margin = chunk.margin
    for tree, weight in trees:
        margin = margin + weight * tree.value[node_of(chunk, tree, plan.bins)]
    return margin


def residuals(chunk: Chunk, margin: np.ndarray, first: bool) -> np.ndarray:
    """What the next tree learns: the label itself, then the loss's slope."""
    y = np.where(chunk.positive, 1.0, -1.0)
    return y if first else 4 * y / (1 + np.exp(2 * y * margin))


def histograms(chunks, plan: Plan, done: list, tree: Tree, nodes: np.ndarray, first: bool, edges: np.ndarray):
    """(range of features, its cells that have rows, their negatives, positives
    and residuals, the nodes' totals) of a task's rows."""
    k, width = len(nodes), len(plan.zero)
    slot_of = np.full(len(tree.feature), -1, np.int64)
    slot_of[nodes] = np.arange(k)
    found, totals = None, np.zeros((4, k))  # places (cell * k + slot), counts, sums
    for chunk in chunks:
        g = residuals(chunk, margin_of(chunk, done, plan), first)
        w = np.where(chunk.positive, plan.weight, 1.0)
        wg, code = np.rint(w * g * plan.grid) / plan.grid, np.where(chunk.positive, BASE, 1.0)
        slot = slot_of[node_of(chunk, tree, plan.bins)]
        here = slot >= 0
        whole = here.all()
        for at, v in enumerate((~chunk.positive, chunk.positive, wg, w * g * g)):
            totals[at] += np.bincount(slot[here], v[here], k)
        pieces, low = [], 0
        while low < len(chunk.cells):  # whole cells, so a place comes once
            high = max(low + 1, int(np.searchsorted(chunk.starts, chunk.starts[low] + plan.block, "right")) - 1)
            rows = chunk.rows[chunk.starts[low]:chunk.starts[high]].astype(np.intp)
            place = np.repeat(np.arange(high - low) * k, np.diff(chunk.starts[low:high + 1]))
            if not whole:
                kept = here.take(rows)
                place, rows = place[kept], rows[kept]
            place += slot.take(rows)
            count, added = np.bincount(place, code.take(rows), (high - low) * k), np.bincount(place, wg.take(rows), (high - low) * k)
            at = np.flatnonzero(count)
            pieces.append((chunk.cells[low + at // k] * k + at % k, count[at], added[at]))
            low = high
        if not pieces:
            continue
        own = [np.concatenate(p) for p in zip(*pieces)]
        if found is None:
            found = own
        else:  # more than one chunk: added up in full width
            if len(found) == 3:
                counts, sums = np.zeros((2, width * plan.bins * k))
                counts[found[0]], sums[found[0]] = found[1:]
                found = [counts, sums]
            found[0][own[0]] += own[1]
            found[1][own[0]] += own[2]
    if found is None:
        found = [np.zeros(0, np.int64), np.zeros(0), np.zeros(0)]
    if len(found) == 2:
        at = np.flatnonzero(found[0])
        found = [at, found[0][at], found[1][at]]
    at, count, added = found[0], found[1].astype(np.int64), found[2]
    borders = np.searchsorted(at, edges * plan.bins * k)
    for r, (low, high) in enumerate(zip(borders, borders[1:])):
        here = slice(low, high)
        yield r, ((at[here] - edges[r] * plan.bins * k).astype(np.uint32), (count[here] & (int(BASE) - 1)).astype(np.uint32), (count[here] >> 26).astype(np.uint32), added[here], totals)


def best_splits(parts, plan: Plan, k: int, edges: np.ndarray):
    """Of one range of features, for each node: (gain, feature, bin, negatives,
    positives and residuals on the left) of the best split, and the totals. A
    split at a bin without rows parts them as the one before it does, so only
    bins with rows are looked at."""
    parts = iter(parts)
    head = next(parts, None)
    if head is None:
        return
    low, high = edges[head[0]:head[0] + 2].tolist()
    cells = (high - low) * plan.bins
    stats, totals = [np.zeros(cells * k, t) for t in (np.int64, np.int64, float)], np.zeros((4, k))
    while head is not None:
        at, *values, part = head[1]
        for s, v in zip(stats, values):
            s[at] += v
        totals += part
        head = next(parts, None)
    # by node, feature, bin; whole numbers from here on
    total = [totals[0].astype(np.int64), totals[1].astype(np.int64), np.rint(totals[2] * plan.grid).astype(np.int64)]
    stats = [np.ascontiguousarray(s.reshape(cells, k).T).reshape(-1) for s in (stats[0], stats[1], np.rint(stats[2] * plan.grid).astype(np.int64))]
    groups, first, _ = _runs(np.flatnonzero(stats[0] + stats[1]) // plan.bins)
    node, feature = groups // (high - low), groups % (high - low) + low
    at = np.flatnonzero(stats[0] + stats[1])
    for s, t in zip(stats, total):
        s[groups * plan.bins + plan.zero[feature]] = t[node] - (np.add.reduceat(s[at], first) if len(at) else 0)
    at = np.flatnonzero(stats[0] + stats[1])
    groups, first, end = _runs(at // plan.bins)
    node, feature, size = groups // (high - low), groups % (high - low) + low, end - first
    left = []
    for s in stats:
        run = np.cumsum(s[at])
        left.append(run - np.repeat(run[first] - s[at[first]], size))
    node, feature = np.repeat(node, size), np.repeat(feature, size)
    right = [t[node] - v for t, v in zip(total, left)]
    cl, cr = (v[0] + plan.weight * v[1] for v in (left, right))
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = cl * cr / (cl + cr) ** 2 * (left[2] / plan.grid / cl - right[2] / plan.grid / cr) ** 2
    gain[~((right[0] + right[1] >= 1) & (cl > 0) & (cr > 0) & (at % plan.bins < plan.n_splits[feature]))] = -1.0
    out = (np.full(k, -1.0), np.zeros(k, np.int64), np.zeros(k, np.int64), np.zeros((3, k)), totals)
    for slot, a, b in zip(*(v.tolist() for v in _runs(node))):
        j = a + int(gain[a:b].argmax())
        out[0][slot], out[1][slot], out[2][slot], out[3][:, slot] = gain[j], feature[j], at[j] % plan.bins, (left[0][j], left[1][j], left[2][j] / plan.grid)
    yield out


def grow(chunks, plan: Plan, done: list, first: bool, depth: int, shared, edges: np.ndarray, small: bool) -> tuple[Tree, dict]:
    """One tree, level by level; and (negatives, positives, gain) of its nodes."""
    tree, known, active = Tree.empty(depth), {}, np.zeros(1, np.int64)
    for level in range(depth):
        below = []
        for at in range(0, len(active), NODES_AT_ONCE):
            nodes, so_far = active[at:at + NODES_AT_ONCE], tree

            def sent(part, nodes=nodes, tree=so_far):
                return histograms(part, shared.value, done, tree, nodes, first, edges)

            def best(part, k=len(nodes)):
                return best_splits(part, shared.value, k, edges)

            if small:
                parts = chunks.mapPartitions(sent).collect()
                found = [x for r in range(len(edges) - 1) for x in best_splits([p for p in parts if p[0] == r], plan, len(nodes), edges)]
            else:
                job = chunks.mapPartitions(sent).partitionBy(len(edges) - 1, int).mapPartitions(best)
                found = job.collect()
                job.cleanShuffleDependencies()
            gains = np.array([x[0] for x in found])
            totals = found[0][4]
            for k, node in enumerate(nodes.tolist()):
                r = int(gains[:, k].argmax())
                gain, f, b, side = found[r][0][k], int(found[r][1][k]), int(found[r][2][k]), found[r][3][:, k]
                total, weight = totals[:3, k], totals[0, k] + plan.weight * totals[1, k]
                mean_square = totals[3, k] / weight if weight else 0.0
                tree.value[node] = total[2] / weight if weight else 0.0
                known[node] = (int(total[0]), int(total[1]), -1.0)
                if not gain > 1e-14 * mean_square or mean_square - tree.value[node] ** 2 <= 1e-13 * mean_square:
                    continue
                below.append((node, f, b, gain))
                known[node] = (*known[node][:2], float(gain))
                for child, own in ((2 * node + 1, side), (2 * node + 2, total - side)):
                    c = own[0] + plan.weight * own[1]
                    tree.value[child], known[child] = own[2] / c, (int(own[0]), int(own[1]), -1.0)
        tree = Tree(tree.feature.copy(), tree.bin.copy(), tree.zero_right.copy(), tree.value)
        for node, f, b, _ in below:
            tree.feature[node], tree.bin[node], tree.zero_right[node] = f, b, plan.zero[f] > b
        active = np.array([c for node, *_ in below for c in (2 * node + 1, 2 * node + 2) if sum(known[c][:2]) > 1], np.int64)
        if not len(active):
            break
    return tree, known


def square_sums(chunks, plan: Plan, trees: list) -> np.ndarray:
    """Weighted squares of the residuals in each leaf of each tree."""
    out = np.zeros((len(trees), len(trees[0][0].feature)))
    for chunk in chunks:
        chunk = Chunk(chunk.cells, chunk.starts, chunk.rows, chunk.positive, np.zeros(len(chunk.positive)))
        w = np.where(chunk.positive, plan.weight, 1.0)
        for k, (tree, weight) in enumerate(trees):
            g, node = residuals(chunk, chunk.margin, k == 0), node_of(chunk, tree, plan.bins)
            out[k] += np.bincount(node, w * g * g, out.shape[1])
            chunk.margin = chunk.margin + weight * tree.value[node]
    return out


def saved_nodes(tree: Tree, known: dict, squares: np.ndarray, splits: list, weight: float) -> list[tuple]:
    """The nodes as Spark's model files have them, numbered from the root down,
    the left side first."""
    out = []

    def put(node: int) -> tuple[int, float]:
        k = len(out)
        out.append(None)
        neg, pos, gain = known[node]
        c, below, split, square = neg + weight * pos, (-1, -1), (-1, [], -1), float(squares[node])
        if tree.feature[node] >= 0:
            (left, a), (right, b) = put(2 * node + 1), put(2 * node + 2)
            f = int(tree.feature[node])
            below, split, square = (left, right), (f, [float(splits[f][tree.bin[node]])], -1), a + b
        else:
            gain = -1.0
        value = float(tree.value[node])
        out[k] = (k, value, max(0.0, square / c - value * value) if c else 0.0, [float(c), float(value * c), square], neg + pos, gain, *below, split)
        return k, square

    put(0)
    return out


def as_model(spark, gbt: GBTClassifier, trees: list, nodes: list, width: int) -> GBTClassificationModel:
    """The trees written in the layout of Spark's own model files, and loaded."""
    path = checkpoint_path(spark, f"gbt-{uuid.uuid4().hex}")
    both = [{p.name: v for p, v in m.items()} for m in (gbt._paramMap, gbt._defaultParamMap)]

    def meta(kind: str, uid: str, own: list, **more) -> str:
        return json.dumps({"class": f"org.apache.spark.ml.{kind}", "timestamp": int(time.time() * 1000), "sparkVersion": spark.version, "uid": uid, "paramMap": own[0], "defaultParamMap": own[1], **more})

    of_tree = [{k: v for k, v in m.items() if k in ("featuresCol", "labelCol", "maxDepth", "seed", "weightCol", "predictionCol", "impurity", "maxBins", "leafCol")} for m in both]
    tree_meta = [(k, meta("regression.DecisionTreeRegressionModel", f"dtr_{uuid.uuid4().hex[:12]}", of_tree), float(w)) for k, (_, w) in enumerate(trees)]
    spark.createDataFrame([(meta("classification.GBTClassificationModel", gbt.uid, both, numFeatures=width, numTrees=len(trees)),)], "value string").coalesce(1).write.text(f"{path}/metadata")
    spark.createDataFrame(tree_meta, "_1 int, _2 string, _3 double").coalesce(1).write.parquet(f"{path}/treesMetadata")
    spark.createDataFrame([(k, n) for k, own in enumerate(nodes) for n in own], f"treeID int, nodeData {NODE}").write.parquet(f"{path}/data")
    return GBTClassificationModel.load(path)


def fit(train: DataFrame, gbt: GBTClassifier, positives: int, negatives: int, weight: float) -> GBTClassificationModel:
    """What ``gbt`` fits to rows labelled 0 or 1, positives weighted by ``weight``."""
    spark, sc = train.sparkSession, train.sparkSession.sparkContext
    features, label, depth, rounds = gbt.getFeaturesCol(), gbt.getLabelCol(), gbt.getMaxDepth(), gbt.getMaxIter()
    n, bins = positives + negatives, gbt.getMaxBins()
    v = F.unwrap_udt(features)
    width = train.select(F.coalesce(v["size"], F.size(v["values"]))).first()[0]
    tasks = max(sc.defaultParallelism, -(-n // PART_ROWS))
    rows = train.select(features, label)
    splits = split_candidates(rows, features, label, width, n, negatives + weight * positives, weight, bins, gbt.getSeed())
    most = max(1.0, weight) * 4 * n
    plan = Plan(np.array([np.searchsorted(s, 0.0) for s in splits]), np.array([len(s) for s in splits]), weight, 2.0 ** (51 - math.ceil(math.log2(most))), bins, gbt.getStepSize(), BLOCK)
    shared = sc.broadcast(plan)
    ranges = min(width, max(sc.defaultParallelism, -(-width // 5000)))
    edges = np.linspace(0, width, ranges + 1).astype(np.int64)
    chunks, trees, known, kept = chunked(rows, features, label, splits, plan, tasks), [], [], 0
    try:
        small = chunks.map(lambda c: len(c.rows)).sum() <= SMALL
        for m in range(rounds):
            if m and m % FOLD == 0:
                older, new = chunks, trees[kept:]
                chunks = older.map(lambda c, new=new: Chunk(c.cells, c.starts, c.rows, c.positive, margin_of(c, new, shared.value))).persist(StorageLevel.MEMORY_AND_DISK)
                chunks.count()
                older.unpersist()
                kept = m
            tree, own = grow(chunks, plan, trees[kept:], m == 0, depth, shared, edges, small)
            trees.append((tree, plan.step if m else 1.0))
            known.append(own)
        squares = sum(chunks.mapPartitions(lambda part: [square_sums(part, shared.value, trees)]).collect())
    finally:
        chunks.unpersist()
    return as_model(spark, gbt, trees, [saved_nodes(t, k, s, splits, weight) for (t, _), k, s in zip(trees, known, squares)], width)
