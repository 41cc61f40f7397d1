"""Byte-level BPE encoding and decoding with segment trees.

A pre-token starts as its bytes. A segment tree holds the ranks of its
adjacent pairs; the root gives the lowest rank, and the descent to the left
whenever the left child holds that rank gives its leftmost place. The pair is
merged, its right half is unlinked, and the at most three ranks that changed
are updated from their leaves up. This goes on until the root says that no
pair can be merged. The trees of many distinct pre-tokens are rows of one
array, so that each step is one numpy operation over all of them; pre-tokens
met before come from a bounded memo.

Tokenizer files are read by the driver (the path is a parameter) and
broadcast. Special strings of the file's ``added_tokens`` inside a text are
taken as their ids, as the tokenizers library does by default.

Defined results: a null text is the empty text: no tokens, digests of empty
input. Repeated rows get equal results, null ids stay null, texts of any
length are encoded whole, other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batch_of, pieces, text_runs

#: The fixed split pattern of the byte-level pre-tokenizer.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
NONE = np.int32(np.iinfo(np.int32).max)


def byte_chars() -> list[str]:
    """The character that a byte-level vocabulary writes for each byte:
    printable ones stand for themselves, the rest from U+0100 on in order."""
    own = [b for r in (range(0x21, 0x7F), range(0xA1, 0xAD), range(0xAE, 0x100)) for b in r]
    rest = [b for b in range(256) if b not in set(own)]
    return [chr(b) if b in set(own) else chr(256 + rest.index(b)) for b in range(256)]


@dataclass(frozen=True)
class Vocab:
    """Merge ranks and token bytes of one tokenizer file."""

    first: np.ndarray  # int32[256]: id of each single byte
    pairs: np.ndarray  # int64, ascending: left id << 32 | right id
    ranks: np.ndarray  # int32, beside pairs
    merged: np.ndarray  # int32 by rank: id of the merged token
    token_bytes: list[bytes]  # by id
    special: dict[str, int]


def load(path: str) -> Vocab:
    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    model, chars = file["model"], byte_chars()
    if model["type"] != "BPE" or file["pre_tokenizer"]["type"] != "ByteLevel" or file["pre_tokenizer"]["add_prefix_space"] or file["normalizer"]:
        raise ValueError("a byte-level BPE file without normalizer or prefix space is needed")
    ids, back = model["vocab"], {c: b for b, c in enumerate(chars)}
    special = {t["content"]: t["id"] for t in file["added_tokens"]}
    tokens = [b""] * (max([*ids.values(), *special.values()]) + 1)
    for t, i in ids.items():
        tokens[i] = bytes(back[c] for c in t)
    for t, i in special.items():
        tokens[i] = t.encode()
    merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    keys = np.array([ids[a] << 32 | ids[b] for a, b in merges], np.int64)
    order = np.argsort(keys, kind="stable")
    return Vocab(np.array([ids[c] for c in chars], np.int32), keys[order], order.astype(np.int32), np.array([ids[a + b] for a, b in merges], np.int32), tokens, special)


def pair_ranks(v: Vocab, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Rank of each adjacent pair; NONE where an end is missing (-1) or no merge exists."""
    key = (left.astype(np.int64) << 32) | right.astype(np.int64)
    at = np.minimum(np.searchsorted(v.pairs, key), len(v.pairs) - 1)
    return np.where((left >= 0) & (right >= 0) & (v.pairs[at] == key), v.ranks[at], NONE)


def merge_all(v: Vocab, words: list[bytes]) -> list[bytes]:
    """Ids (little-endian uint32 bytes) of each pre-token; one tree a row."""
    out: list[bytes] = [b""] * len(words)
    by_depth: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        if w:
            by_depth.setdefault(max(1, (len(w) - 1).bit_length()), []).append(i)
    for depth, members in by_depth.items():
        most = max(1, (1 << 20) >> depth)  # trees at once: bounded memory at any word length
        for lo in range(0, len(members), most):
            _merge_trees(v, words, members[lo:lo + most], 1 << depth, out)
    return out


def _merge_trees(v: Vocab, words: list[bytes], members: list[int], width: int, out: list[bytes]) -> None:
    rows = len(members)
    raw = np.zeros((rows, width), np.uint8)
    size = np.array([len(words[i]) for i in members])
    raw[np.arange(width) < size[:, None]] = np.frombuffer(b"".join(words[i] for i in members), np.uint8)
    place = np.arange(width)
    ids = np.where(place < size[:, None], v.first[raw], np.int32(-1))
    # the pair (i, next[i]) lives in leaf i; unlinked places have id -1
    after = np.where(place + 1 < size[:, None], place + 1, -1).astype(np.int32)
    before = np.broadcast_to(place - 1, (rows, width)).astype(np.int32).copy()
    tree = np.full((rows, 2 * width), NONE, np.int32)
    tree[:, width:2 * width - 1] = pair_ranks(v, ids[:, :-1], ids[:, 1:])
    level = width
    while level > 1:
        half = level >> 1
        tree[:, half:level] = np.minimum(tree[:, level:2 * level:2], tree[:, level + 1:2 * level:2])
        level = half
    live = np.flatnonzero(tree[:, 1] != NONE)
    while len(live):
        rank = tree[live, 1]
        node = np.ones(len(live), np.int64)
        while node[0] < width:  # every row's leaf is at the same depth
            node = 2 * node + (tree[live, 2 * node] != rank)
        at = node - width
        right = after[live, at].astype(np.int64)
        beyond = after[live, right].astype(np.int64)
        ids[live, at] = v.merged[rank]
        ids[live, right] = -1
        after[live, at] = beyond
        has = beyond >= 0
        before[live[has], beyond[has]] = at[has]
        prior = before[live, at].astype(np.int64)
        had = prior >= 0
        # three leaves change: the merged place, the unlinked one, the one before
        tree[live, width + right] = NONE
        tree[live, width + at] = np.where(has, pair_ranks(v, ids[live, at], ids[live, np.maximum(beyond, 0)]), NONE)
        tree[live[had], width + prior[had]] = pair_ranks(v, ids[live[had], prior[had]], ids[live[had], at[had]])
        for row, leaf in ((live, right), (live, at), (live[had], prior[had])):
            node = (width + leaf) >> 1
            while len(node) and node[0] >= 1:
                tree[row, node] = np.minimum(tree[row, 2 * node], tree[row, 2 * node + 1])
                node >>= 1
        live = live[tree[live, 1] != NONE]
    kept = ids >= 0
    flat, ends = ids[kept].astype("<u4").tobytes(), np.cumsum(kept.sum(axis=1)) * 4
    start = 0
    for i, end in zip(members, ends.tolist()):
        out[i] = flat[start:end]
        start = end


class Encoder:
    """Encodes texts; ``memo`` keeps at most ``most`` distinct pre-tokens."""

    def __init__(self, v: Vocab, most: int = 1 << 17):
        self.v, self.most, self.memo = v, most, {}
        self.split = regex.compile(SPLIT)
        special = sorted(v.special, key=lambda t: (-len(t), t))
        self.specials = regex.compile("(" + "|".join(map(regex.escape, special)) + ")") if special else None
        self.marks = special

    def pieces(self, text: str) -> list[str]:
        """Pre-tokens in order; special strings stand as themselves."""
        if not any(m in text for m in self.marks):
            return self.split.findall(text)
        found: list[str] = []
        for k, part in enumerate(self.specials.split(text)):
            found += [part] if k % 2 else self.split.findall(part)
        return found

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        split = [self.pieces(t) for t in texts]
        if len(self.memo) > self.most:
            self.memo.clear()
        if not self.memo:
            self.memo.update({t: int(i).to_bytes(4, "little") for t, i in self.v.special.items()})
        memo = self.memo
        new = list({p for s in split for p in s if p not in memo})
        for p, ids in zip(new, merge_all(self.v, [p.encode("utf-8", "surrogatepass") for p in new])):
            memo[p] = ids
        return [b"".join([memo[p] for p in s]) for s in split]

    def decode(self, ids: bytes) -> str:
        token = self.v.token_bytes
        return b"".join([token[i] for i in np.frombuffer(ids, "<u4").tolist()]).decode("utf-8", "replace")


_ENCODERS: dict[str, Encoder] = {}


def encoder_of(path: str, shared) -> Encoder:
    """One encoder a worker process and tokenizer file: its memo stays warm."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(shared.value)
    return _ENCODERS[path]


def encode(spark: SparkSession, docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Encode and decode every whole text: (doc_id, n_tokens, ids_sha256,
    decoded_sha256), with ``with_ids`` also ids (array of int) and decoded."""
    shared = spark.sparkContext.broadcast(load(path))
    key = f"{path}:{len(shared.value.pairs)}"
    fields = [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
    schema = pa.schema(fields + [("ids", pa.list_(pa.int32())), ("decoded", pa.string())] if with_ids else fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder_of(key, shared)
        for b in pieces(batches, 4096):
            doc_ids, texts = b.column("doc_id"), b.column("text").to_pylist()
            for rows in text_runs(texts):
                ids = coder.encode([texts[i] for i in rows])
                decoded = [coder.decode(x) for x in ids]
                cols = [doc_ids.slice(rows[0], len(rows)), [len(x) // 4 for x in ids], [hashlib.sha256(x).hexdigest() for x in ids], [hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest() for x in decoded]]
                yield batch_of(schema, cols + [[np.frombuffer(x, "<i4") for x in ids], decoded] if with_ids else cols)

    ddl = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded string" if with_ids else "")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInArrow(run, ddl)
