import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tagloom.llm import bpe, token_cache
from tests.llm import brute

PATH = public_tokenizers.path("byte_bpe_50k.json")
MARK = "<|endoftext|>"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def vocab():
    return bpe.load(PATH)


def odd_texts():
    r = random.Random(3)
    texts = ["", "a", MARK, f" {MARK}x{MARK}{MARK} y", "a" * 5000, "ab" * 3000 + " " * 50 + "\n\n \t x", "'s 'll don't I'VE", "²½Ⅷ٣ x१२३", "日本語テキスト123", "👩‍👩‍👧‍👦 emojí", "\x00\x01 \x0b\x0c\r\n\x1c\x85  "]
    return texts + ["".join(chr(r.choice([r.randrange(32, 127), r.randrange(0, 0x2FFF), r.randrange(0x10000, 0x1FFFF)])) for _ in range(r.randrange(1, 200))) for _ in range(200)]


def test_ids_and_decoding_are_the_librarys(library, vocab):
    coder = bpe.Encoder(vocab, most=50)  # a small memo: it is cleared in between
    for t in odd_texts():
        ids = library.encode(t, add_special_tokens=False).ids
        got = coder.encode([t])[0]
        assert np.frombuffer(got, "<u4").tolist() == ids
        assert coder.decode(got) == library.decode(ids, skip_special_tokens=False)


def test_trees_merge_as_one_pair_at_a_time(vocab):
    """Segment trees against plain scanning, on words of every length."""
    r = random.Random(4)
    token = vocab.token_bytes
    ranks = {(token[k >> 32], token[k & 0xFFFFFFFF]): int(rank) for k, rank in zip(vocab.pairs.tolist(), vocab.ranks)}
    words = [bytes(r.choice(b"abcdehinorst the") for _ in range(n)) for n in list(range(1, 70)) * 3] + [b"a" * 333, b"the" * 100]
    for w, ids in zip(words, bpe.merge_all(vocab, words)):
        assert [token[i] for i in np.frombuffer(ids, "<u4").tolist()] == brute.merge_words(ranks, w)


def test_table(spark, odd, pairs, library):
    got = sorted(str(tuple(r)) for r in bpe.encode(spark, odd, PATH).collect())
    want = []
    for d, t in pairs:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((d, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(map(str, want))
    for r in bpe.encode(spark, odd, PATH, with_ids=True).collect():
        assert len(r["ids"]) == r["n_tokens"] and hashlib.sha256(r["decoded"].encode()).hexdigest() == r["decoded_sha256"]


def test_empty_table(spark, none):
    assert bpe.encode(spark, none, PATH).count() == 0
    assert token_cache.count(spark, none, PATH, token_cache.fresh(spark)).count() == 0


def counted(spark, df, path, cache):
    return sorted(str(tuple(r)) for r in token_cache.count(spark, df, path, cache).collect())


def test_token_counts(spark, odd, pairs, library):
    want = sorted(str((d, len((t or "").encode()), n, n > 512)) for d, t in pairs for n in [len(library.encode(t or "", add_special_tokens=False).ids)])
    cache = token_cache.fresh(spark)
    assert counted(spark, odd, PATH, cache) == want
    table = f"{cache}/version={token_cache.version_digest(PATH)}"
    stored = spark.read.parquet(table)
    distinct = len({t or "" for _, t in pairs})
    assert stored.count() == distinct  # each distinct text once
    assert counted(spark, odd, PATH, cache) == want
    assert spark.read.parquet(table).count() == distinct  # nothing was encoded again
    more = odd.limit(0).union(odd.selectExpr("doc_id", "concat(text, ' more') as text", *[f"`{c}`" for c in odd.columns[2:]]))
    token_cache.count(spark, more, PATH, cache).collect()
    assert spark.read.parquet(table).count() > distinct


def test_stored_counts_are_used(spark, odd):
    cache = token_cache.fresh(spark)
    rows = token_cache.digests(odd, "doc_id", "text").selectExpr("digest", "7L as n_tokens")
    rows.write.mode("append").parquet(f"{cache}/version={token_cache.version_digest(PATH)}")
    assert {r["n_tokens"] for r in token_cache.count(spark, odd, PATH, cache).collect()} == {7}


def test_sentencepiece_counts(spark, odd, pairs):
    from sentencepiece import SentencePieceProcessor
    path = public_tokenizers.path("piece_bpe_32k.model")
    s = SentencePieceProcessor(model_file=path)
    want = sorted(str((d, len((t or "").encode()), n, n > 512)) for d, t in pairs for n in [len(s.encode(t or ""))])
    assert counted(spark, odd, path, token_cache.fresh(spark)) == want
