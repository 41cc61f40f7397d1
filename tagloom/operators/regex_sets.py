"""Dictionaries of many regexes: run only those whose required literals occur.

A regex that matches must find certain characters in the text. ``required``
derives such a condition from the pattern: a few literals, one of which is in
every match. All literals of a dictionary go into a literal hash table of the
plan, under their first three characters. A text looks its distinct trigrams up
in it, and runs the regexes whose literal it holds, so the cost follows the
text and not the dictionary. Regexes without a usable literal run on each text.
One narrow projection: no shuffle, no Python on the workers.

Matching ignores case, and so does the test of literals: letters A to Z, and
the four other characters that equal one of them when case is ignored, are
folded, and only ASCII literals are used. The result is that of running all.
"""

from __future__ import annotations

import json
import re
import zlib
from re import _constants as C
from re import _parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .matching import fence, regex_labels

#: A-Z, and what else matches a letter with case ignored: Kelvin sign, long s, dotted and dotless i
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZKſİı"
LOWER = "abcdefghijklmnopqrstuvwxyzksii"
MOST_EXACT = 16      # alternatives that are written out
PIECE = re.compile("[a-z0-9_]{3,}")
TRIGRAM = "(?=([a-z0-9_]{3}))"  # every position, in linear time
TABLE = "array<array<struct<ord:int,tri:string,piece:string,rx:string,label:string>>>"
PREFILTER_FROM = 32  # rules from which the table pays; results are equal either way


def exact(items) -> set[str] | None:
    """All strings that the parsed items match, folded, if they are few."""
    out = {""}
    for op, arg in items:
        if op is C.LITERAL:
            ends = {chr(arg).lower()} if arg < 128 else None
        elif op in (C.AT, C.ASSERT, C.ASSERT_NOT):
            ends = {""}
        elif op is C.IN and all(o is C.LITERAL and a < 128 for o, a in arg):
            ends = {chr(a).lower() for _, a in arg}
        elif op is C.SUBPATTERN:
            ends = exact(arg[-1])
        elif op is C.BRANCH:
            each = [exact(b) for b in arg[1]]
            ends = None if None in each else set().union(*each)
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT) and arg[1] == 1:
            ends = exact(arg[2])
            ends = ends if ends is None or arg[0] else ends | {""}
        else:
            ends = None
        if ends is None or len(out) * len(ends) > MOST_EXACT:
            return None
        out = {a + b for a in out for b in ends}
    return out


def clauses(items) -> list[set[str]]:
    """Sets of strings; every match holds one string of each set."""
    out, run = [], {""}
    for item in items:
        ends = exact([item])
        if ends is not None and len(run) * len(ends) <= MOST_EXACT:
            run = {a + b for a in run for b in ends}
            continue
        out.append(run)
        run = {""} if ends is None else ends
        op, arg = item
        if ends is not None:
            continue
        if op is C.SUBPATTERN:
            out += clauses(arg[-1])
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT) and arg[0] >= 1:
            out += clauses(arg[2])
        elif op is C.ATOMIC_GROUP:
            out += clauses(arg)
        elif op is C.BRANCH:
            each = [best(clauses(b)) for b in arg[1]]
            if all(each):
                out.append(set().union(*each))
    return [*out, run]


def best(sets: list[set[str]]) -> set[str]:
    """The most selective set, as runs of word characters; empty if none is usable."""
    usable = []
    for strings in sets:
        pieces = [max(PIECE.findall(s), key=len, default="") for s in strings]
        if pieces and all(pieces):
            least = sorted(p for p in set(pieces) if not any(q != p and q in p for q in pieces))
            usable.append((min(map(len, least)), -len(least), least))
    return set(max(usable)[2]) if usable else set()


def required(pattern: str) -> set[str]:
    """Lower-case pieces of three or more word characters, one of which is in
    the folded text of every match; empty if there is no such condition."""
    try:
        return best(clauses(_parser.parse(pattern)))
    except (re.error, OverflowError, RecursionError):
        return set()  # syntax of Java alone: the regex runs on each text


def table_of(rules: list[tuple[str, str]]) -> tuple[list[list[dict]], list[tuple[str, str]]]:
    """(buckets of entries by trigram, rules that run on each text)."""
    entries, rest = [], []
    for i, (rx, label) in enumerate(rules):
        pieces = required(rx)
        entries += [{"ord": i, "tri": p[:3], "piece": p, "rx": "(?iu)" + rx, "label": label} for p in sorted(pieces)]
        if not pieces:
            rest.append((rx, label))
    buckets: list[list[dict]] = [[] for _ in range(1 << max(1, (2 * len(entries)).bit_length()))]
    for e in entries:
        buckets[zlib.crc32(e["tri"].encode()) % len(buckets)].append(e)
    return buckets, rest


def label_hits(folded: Column, trigrams: Column, text: Column, rules: list[tuple[str, str]]) -> Column:
    buckets, rest = table_of(rules)
    table = F.from_json(F.lit(json.dumps(buckets)), TABLE)
    size = len(buckets)

    def of_trigram(t: Column) -> Column:
        held = F.filter(F.get(table, (F.crc32(t.cast("binary")) % size).cast("int")), lambda e: (e["tri"] == t) & folded.contains(e["piece"]))
        return F.transform(held, lambda e: F.struct(e["ord"], e["rx"], e["label"]))

    held = F.array_distinct(F.flatten(F.transform(trigrams, of_trigram)))
    found = F.transform(F.filter(held, lambda e: F.regexp_like(text, e["rx"])), lambda e: e["label"])
    found = F.coalesce(found, F.array().cast("array<string>"))
    return F.array_sort(F.array_distinct(F.concat(found, regex_labels(text, rest)) if rest else found))


def regex_dictionary_match(df: DataFrame, text_col: str, rules: list[tuple[str, str]], out_col: str = "keyword", sep: str = "; ",
                           prefilter: bool | None = None) -> DataFrame:
    """Rows whose text hits any regex of ``rules`` (regex, label); ``out_col``
    holds the labels, distinct, sorted, joined by ``sep``. A null text hits
    nothing; no rules, no rows. ``prefilter`` overrides the choice by size."""
    if not (len(rules) >= PREFILTER_FROM if prefilter is None else prefilter):
        labelled = fence(df, regex_labels(F.col(text_col), rules) if rules else F.array().cast("array<string>"), "_labs")
    else:
        low = fence(df, F.translate(F.col(text_col), UPPER, LOWER), "_low")
        low = fence(low, F.array_distinct(F.regexp_extract_all("_low", F.lit(TRIGRAM), 1)), "_tri")
        labelled = fence(low, label_hits(F.col("_low"), F.col("_tri"), F.col(text_col), rules), "_labs").drop("_low", "_tri")
    return labelled.filter(F.size("_labs") > 0).withColumn(out_col, F.array_join("_labs", sep)).drop("_labs")
