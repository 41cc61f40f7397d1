"""What a task hands to the tokenizer library at once is bounded."""

from tagloom.llm import token_cache
from tagloom.llm.common import text_runs


def test_runs_are_small():
    texts = ["x" * 1000] * 1000 + ["y" * 400_000] + ["z"] * 3
    runs = list(text_runs(texts, token_cache.RUN_CHARS))
    assert [i for r in runs for i in r] == list(range(len(texts)))
    assert all(sum(len(texts[i]) for i in r) <= 1 << 18 or len(r) == 1 for r in runs)
