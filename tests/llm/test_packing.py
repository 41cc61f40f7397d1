import itertools
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tagloom.llm import bpe, packing, queries
from tagloom.llm.common import read


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(queries.tokenizer())
    t.no_truncation()
    t.no_padding()
    return lambda text: t.encode(text or "", add_special_tokens=False).ids + [packing.END_ID]


@pytest.mark.parametrize("dims, bits", [(2, 1), (2, 4), (3, 3), (4, 2)])
def test_curve_visits_every_cell_in_steps_of_one(dims, bits):
    grid = np.array(list(itertools.product(range(1 << bits), repeat=dims)))
    key = packing.hilbert_key(grid, bits)
    assert sorted(key.tolist()) == list(range(len(grid)))
    assert (np.abs(np.diff(grid[np.argsort(key)], axis=0)).sum(axis=1) == 1).all()


def test_key_of_the_finest_grid_is_not_negative():
    grid = packing.cells(np.array([[-9.0] * 4, [9.0] * 4, [0.0] * 4]))
    assert grid.min() >= 0 and grid.max() < 1 << packing.BITS and (packing.hilbert_key(grid) >= 0).all()


@pytest.mark.parametrize("total, size", [(0, 8), (5, 8), (16, 8), (37, 8), (8 * 3 + 7, 8), (23, 6)])
def test_tail_is_cut_at_powers_of_two(total, size):
    tail = packing.borders(total, size)
    steps = np.diff(tail).tolist()
    assert tail[0] == total - total % size and tail[-1] == total and all(s & (s - 1) == 0 for s in steps) and steps == sorted(set(steps), reverse=True)


def check(pieces, pairs, library, size):
    """Every id in one piece, sequences gapless and unpadded; ids as the library gives them."""
    docs, seqs = {}, {}
    for p in pieces:
        docs.setdefault(p.doc_id, []).append(p)
        seqs.setdefault(p.sequence_id, []).append(p)
    assert sorted(seqs) == list(range(len(seqs)))
    for s in seqs.values():
        at = 0
        for p in sorted(s, key=lambda p: p.offset):
            assert p.offset == at and p.length > 0
            at += p.length
        assert at == size or at & (at - 1) == 0
    assert sum(p.length for p in pieces) == sum(len(library(t)) for _, t in pairs)
    texts = {}
    for i, t in pairs:
        texts.setdefault(i, []).append(np.array(library(t), "<u4"))
    assert set(docs) == set(texts)
    for i, mine in docs.items():
        want = sorted((a, len(x) if a is None else a, x.tobytes()) for x in texts[i] for a in [0])
        # rows that share an id: every piece belongs to one of its texts, and all of their ids are there
        assert sum(p.length for p in mine) == sum(len(x) for x in texts[i]) and want
        for p in mine:
            assert any(len(x) == p.doc_tokens and bytes(p.ids) == x[p.start:p.start + p.length].tobytes() for x in texts[i])
        if len(texts[i]) == 1:
            at = 0
            for p in sorted(mine, key=lambda p: p.start):
                assert p.start == at
                at += p.length


@pytest.mark.parametrize("size", [2048, 64, 100])
def test_odd_rows(spark, odd, pairs, library, size):
    check(packing.pack(spark, odd, queries.tokenizer(), size=size).collect(), pairs, library, size)


def test_whole_table(spark, library):
    docs = read(spark, "/root/testdata/sf0.01", "documents")
    pairs = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    check(packing.pack(spark, docs, queries.tokenizer()).collect(), pairs, library, 2048)
    got = queries.op11_packing(spark, "/root/testdata/sf0.01")
    assert got.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    text = dict(pairs)
    for p in got.where("doc_id % 50 = 0").collect():
        assert p.ids_crc32 == zlib.crc32(np.array(library(text[p.doc_id]), "<u4")[p.start:p.start + p.length].tobytes())


def test_neighbours_share_a_language(spark):
    """The point of the curve: a sequence holds like documents, not any."""
    docs = read(spark, "/root/testdata/sf0.01", "documents")
    lang = {r[0]: r[1] for r in docs.select("doc_id", "lang").collect()}
    share = len([1 for x in lang.values() if x == "en"]) / len(lang)
    mixed = [len({lang[i] for i in r.doc_ids}) > 1 for r in packing.sequences(packing.pack(spark, docs, queries.tokenizer())).collect() if len(set(r.doc_ids)) > 1]
    whole = docs.select("doc_id").orderBy(F.xxhash64("doc_id")).collect()
    at_random = [lang[a[0]] != lang[b[0]] for a, b in zip(whole, whole[1:])]
    assert 0.2 < share < 0.9 and sum(mixed) / len(mixed) < 0.6 * sum(at_random) / len(at_random)


def test_sequences_hold_the_ids_in_order(spark, odd, pairs, library):
    got = packing.sequences(packing.pack(spark, odd, queries.tokenizer(), size=64)).collect()
    assert sum(r.n for r in got) == sum(len(library(t)) for _, t in pairs) and all(len(r.ids) == 4 * r.n for r in got)


def test_empty_table(spark, none):
    assert packing.pack(spark, none, queries.tokenizer()).collect() == []


def test_refused_text_goes_to_the_library(library):
    path = queries.tokenizer()
    with open(path, encoding="utf-8") as f:
        encode = packing.coder("test", f.read(), bpe.load(path))
    for text in ("\n" * 1_200_000, "", "a<|endoftext|>b", " x 　y ", "\U0001f600 é" * 50):
        assert encode(text).tolist() == library(text)[:-1]
