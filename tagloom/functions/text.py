"""Column expressions for text: boundaries, keyword lists, answer parsing.

Everything here returns a ``Column`` built from Spark built-ins, so it stays
inside whole-stage codegen or, for higher-order functions, on the JVM.
"""

from __future__ import annotations

import string
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..lexicon import CONF_HIGH, CONF_MEDIUM

# A word character, as Python's ``\w`` sees it: letters, digits, underscore.
WORD = r"[\p{L}\p{N}_]"
NOT_WORD = r"[^\p{L}\p{N}_]"
# Python's str.strip() whitespace (ASCII part), for Java regexes.
WS = "[ \\t\\n\\r\\f\\u000B]"
_PUNCT = set(string.punctuation)


def is_word_char(ch: str) -> bool:
    return ch == "_" or unicodedata.category(ch)[0] in "LN"


def java_quote(s: str) -> str:
    """Escape ASCII punctuation so ``s`` is a literal in a Java regex."""
    return "".join("\\" + c if c in _PUNCT else c for c in s)


def boundary_regex(phrase: str) -> str:
    """Java regex equal to Python ``\\b<escaped phrase>\\b`` on lowered text.

    ``\\b`` before a word character means "no word character before"; before a
    non-word character it means "a word character before". Same at the end.
    """
    p = phrase.lower()
    if not p:
        return "(?!)"
    head = f"(?<!{WORD})" if is_word_char(p[0]) else f"(?<={WORD})"
    tail = f"(?!{WORD})" if is_word_char(p[-1]) else f"(?={WORD})"
    return head + java_quote(p) + tail


def tokens_of(phrase: str) -> list[str]:
    """Maximal runs of word characters of the lower-cased phrase."""
    out, cur = [], []
    for ch in phrase.lower():
        if is_word_char(ch):
            cur.append(ch)
        elif cur:
            out.append("".join(cur))
            cur = []
    if cur:
        out.append("".join(cur))
    return out


def first_token(phrase: str) -> str | None:
    """The phrase's first whole token, or None when it starts with a non-word char."""
    p = phrase.lower()
    if not p or not is_word_char(p[0]):
        return None
    return tokens_of(p)[0]


def is_single_token(phrase: str) -> bool:
    p = phrase.lower()
    return bool(p) and all(is_word_char(c) for c in p)


def word_tokens(text: Column) -> Column:
    """Distinct whole tokens of a (lower-cased) text column.

    Splitting on runs of non-word characters is about twice as fast as
    extracting the word runs; it can add one "" (text starting or ending
    with a non-word character), which never equals a lexicon token.
    """
    return F.array_distinct(F.split(text, f"{NOT_WORD}+"))


def py_strip(c: Column) -> Column:
    """Python ``str.strip()`` for ASCII whitespace (Spark's trim strips spaces only)."""
    return F.regexp_replace(c, f"^{WS}+|{WS}+$", "")


def is_json_object(c: Column) -> Column:
    """True for a string that is one whole JSON object, with nothing after it.

    The JSON parser stops after the first value, so the string is put inside
    an array and inside an object: text after the object breaks one of them.
    """
    in_array = F.json_array_length(F.concat(F.lit("["), c, F.lit("]"))) == 1
    in_object = F.size(F.json_object_keys(F.concat(F.lit('{"a":'), c, F.lit("}")))) == 1
    return F.coalesce(c.rlike(r"^\s*\{") & in_array & in_object, F.lit(False))


# ---------------------------------------------------------------------------
# keyword multi-value encodings
# ---------------------------------------------------------------------------

def keyword_array_parse(c: Column, encoding: str) -> Column:
    """Decode a keyword list column into ARRAY<STRING>.

    encoding:
      ``pylist``           Python list repr, e.g. ``['THC', "Mary Jane"]``
      ``semicolon_space``  split on ``"; "``, values kept as they are
      ``semicolon``        null -> "", split on ``;``, strip, lower
      ``comma``            null -> "", split on ``,``, strip, lower
    """
    if encoding == "pylist":
        items = F.regexp_extract_all(c, F.lit(r"""('(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")"""), 1)
        return F.transform(items, lambda x: F.regexp_replace(x.substr(F.lit(2), F.length(x) - 2), r"""\\(['"\\])""", "$1"))
    if encoding == "semicolon_space":
        return F.split(c, "; ")
    if encoding in ("semicolon", "comma"):
        sep = ";" if encoding == "semicolon" else ","
        return F.transform(F.split(F.coalesce(c, F.lit("")), sep), lambda x: F.lower(py_strip(x)))
    raise ValueError(f"unknown keyword encoding {encoding!r}")


def compose_text(cols: list[Column], sep: str, nulls: str = "skip") -> Column:
    """Join text parts with ``sep``.

    nulls="skip": null parts are left out (concat_ws); nulls="empty": a null
    part counts as "" (the ``fillna('')`` callers); nulls="null": any null
    part makes the result null (plain ``+`` of strings).
    """
    if nulls == "skip":
        return F.concat_ws(sep, *cols)
    if nulls == "empty":
        return F.concat_ws(sep, *[F.coalesce(c, F.lit("")) for c in cols])
    if nulls == "null":
        parts = []
        for i, c in enumerate(cols):
            if i:
                parts.append(F.lit(sep))
            parts.append(c)
        return F.concat(*parts)
    raise ValueError(nulls)


# ---------------------------------------------------------------------------
# scores and answers
# ---------------------------------------------------------------------------

_NUMBER = r"^[ \t\n\r]*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?[ \t\n\r]*$"


def try_double(c: Column) -> Column:
    """``float(x)`` for plain decimal strings, else null."""
    s = c.cast("string")
    return F.when(s.rlike(_NUMBER), s.cast("double"))


def confidence_bin(c: Column, medium: float = CONF_MEDIUM, high: float = CONF_HIGH) -> Column:
    """High / Medium / Low by thresholds; a non-numeric value passes through."""
    s = c.cast("string")
    x = try_double(s)
    return (
        F.when(c.isNull(), F.lit(None).cast("string"))
        .when(x.isNull(), s)
        .when(x >= high, F.lit("High"))
        .when(x >= medium, F.lit("Medium"))
        .otherwise(F.lit("Low"))
    )


def parse_score(c: Column, allowed=(0, 1, 2)) -> Column:
    """``int(answer.strip())`` kept only if it is in ``allowed``, else null."""
    s = py_strip(c)
    v = F.when(s.rlike(r"^[+-]?[0-9]{1,9}$"), s.cast("int"))
    return F.when(v.isin(list(allowed)), v)


def parse_text_label(c: Column, allowed=("0", "1")) -> Column:
    """Answer stripped; kept only if it is one of ``allowed`` strings, else ""."""
    s = py_strip(c)
    return F.when(s.isin(list(allowed)), s).otherwise(F.lit(""))


_LINE_SPLIT = "\\r\\n|[\\n\\r\\u000B\\f\\u001C\\u001D\\u001E\\u0085\\u2028\\u2029]"


def _value_after_colon(line: Column) -> Column:
    after = F.when(F.instr(line, ":") > 0, line.substr(F.instr(line, ":") + 1, F.lit(1 << 30))).otherwise(line)
    return F.coalesce(py_strip(after), F.lit(""))


def parse_label_block(c: Column) -> Column:
    """Parse "Label: ..\\nConfidence: ..\\nReasoning: .." answers.

    Per line (case-insensitive): a line containing "label" sets the label,
    else one containing "confidence" sets the confidence, else "reasoning"
    sets the reasoning. The value is what follows the first ":" (the whole
    line if there is none), stripped. The last such line wins, so a reasoning
    line that mentions "label" overwrites the label. Missing values are "".
    Returns STRUCT<label, confidence, reasoning>.
    """
    lines = F.split(py_strip(c), _LINE_SPLIT)

    def last(pred) -> Column:
        return _value_after_colon(F.try_element_at(F.filter(lines, pred), F.lit(-1)))

    def has(line, word):
        return F.lower(line).contains(word)

    lab = last(lambda l: has(l, "label"))
    conf = last(lambda l: ~has(l, "label") & has(l, "confidence"))
    rea = last(lambda l: ~has(l, "label") & ~has(l, "confidence") & has(l, "reasoning"))
    return F.struct(lab.alias("label"), conf.alias("confidence"), rea.alias("reasoning"))


def parse_label_block_strict(c: Column) -> Column:
    """Anchored variant: only lines that *start* with the key count."""
    lines = F.split(py_strip(c), _LINE_SPLIT)

    def last(word) -> Column:
        return _value_after_colon(F.try_element_at(
            F.filter(lines, lambda l: F.lower(py_strip(l)).startswith(word)), F.lit(-1)))

    return F.struct(last("label").alias("label"), last("confidence").alias("confidence"),
                    last("reasoning").alias("reasoning"))
