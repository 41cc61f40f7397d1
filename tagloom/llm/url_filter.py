"""URL filters: site rules first, then a weighted URL vocabulary.

``split_url`` and ``rule_of`` are plain column expressions. The vocabulary
runs as one Aho-Corasick automaton per task over the lower-cased url, on the
Arrow path: a term counts only where no letter or digit (A-Z, a-z, 0-9) stands
next to it. Every strict term weighs the whole threshold, a soft term a part
of it; each distinct term counts once; a url whose weights reach the threshold
is rejected. So one strict term or ``soft_hits`` different soft terms reject.

Defined results: a null url, or one without ``://``, has empty host and path,
so no rule fits it; a null url has no hit and is allowed. Rules of equal length
that both fit: the smaller rule string. Repeated rows give repeated results;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batch_of

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: (host, path) rules of the query: what to do, and where.
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


@dataclass(frozen=True)
class Vocabulary:
    """Terms of lower-case letters, digits and inner hyphens."""

    strict: tuple[str, ...] = ("casino", "porn", "xxx", "escort", "viagra", "payday", "malware", "phishing", "warez", "torrent", "gambling", "ads-track")
    soft: tuple[str, ...] = ("free", "win", "bet", "bets", "cheap", "pills", "ads", "track", "click", "bonus", "deal", "deals", "adult", "dating", "loan", "loans", "sale", "promo", "prize", "crypto", "poker", "slots", "jackpot", "download")
    soft_hits: int = 2
    weights: dict[str, int] = field(init=False, repr=False, compare=False)

    def __post_init__(self):
        object.__setattr__(self, "weights", {t: 1 for t in self.soft} | {t: self.soft_hits for t in self.strict})


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path) of a url; both empty when it is null or has no ``://``."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.regexp_extract(rest, r"(?s)^([^?#]*)", 1)
    host = F.substring_index(rest, "/", 1)
    return ascii_lower(host), F.substring(rest, F.length(host) + 1, F.length(rest))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, action) of the longest rule that fits; nulls when none does."""
    ranked = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]))

    def fits(r):
        return ((host == r[1]) | host.endswith("." + r[1])) & path.startswith(r[2])

    def pick(value):
        return F.coalesce(*[F.when(fits(r), F.lit(value(r))) for r in ranked]) if ranked else F.lit(None).cast("string")

    return pick(lambda r: r[1] + r[2]), pick(lambda r: r[0])


class Matcher:
    """Aho-Corasick over a vocabulary with boundary checks."""

    def __init__(self, v: Vocabulary):
        self.v = v
        self.automaton = ahocorasick.Automaton()
        for t in v.weights:
            self.automaton.add_word(t, t)
        if v.weights:
            self.automaton.make_automaton()

    def __call__(self, url: str) -> set[str]:
        """Distinct terms that stand free in a lower-cased url."""
        if not self.v.weights:
            return set()
        return {t for end, t in self.automaton.iter(url)
                if not (end + 1 < len(url) and self.edge(url[end + 1])) and not (end >= len(t) and self.edge(url[end - len(t)]))}

    @staticmethod
    def edge(c: str) -> bool:
        return c.isascii() and c.isalnum()


def judge(pages: DataFrame, vocabulary: Vocabulary = Vocabulary(), rules=RULES, *, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict, strict_hits, soft_hits) per row."""
    host, path = split_url(F.col("url"))
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url")).select("page_id", ascii_lower(F.col("url")).alias("lowered"), host.alias("host"), path.alias("path"))
    out = "page_id long, host string, path string, strict_hits int, soft_hits int, rejected boolean"
    schema = pa.schema([("page_id", pa.int64()), ("host", pa.string()), ("path", pa.string()), ("strict_hits", pa.int32()), ("soft_hits", pa.int32()), ("rejected", pa.bool_())])
    strict = set(vocabulary.strict)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = Matcher(vocabulary)
        for b in batches:
            hits = [find(u) if u else set() for u in b.column("lowered").to_pylist()]
            yield batch_of(schema, [b.column("page_id").cast(pa.int64()), b.column("host"), b.column("path"), [len(h & strict) for h in hits], [len(h - strict) for h in hits],
                                    [sum(vocabulary.weights[t] for t in h) >= vocabulary.soft_hits for h in hits]])

    rule, action = rule_of(F.col("host"), F.col("path"), rules)
    return rows.mapInArrow(scan, out).select("page_id", "host", "path", rule.alias("rule"), F.coalesce(action, F.when(F.col("rejected"), "block").otherwise("allow")).alias("verdict"), "strict_hits", "soft_hits")


def sql(vocabulary: Vocabulary = Vocabulary(), rules=RULES) -> str:
    """The same judgement in DuckDB SQL over ``pages``."""
    ranked = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]))
    fits = {r: f"((host = '{r[1]}' OR ends_with(host, '.{r[1]}')) AND starts_with(path, '{r[2]}'))" for r in ranked}
    count = lambda terms: " + ".join(f"CAST(regexp_matches(coalesce(lowered, ''), '(^|[^a-z0-9]){t}([^a-z0-9]|$)') AS INTEGER)" for t in terms) or "0"
    lower = f"translate({{}}, '{UPPER}', '{LOWER}')"
    return f"""
WITH cut AS (SELECT page_id, {lower.format('url')} AS lowered,
       CASE WHEN url IS NOT NULL AND instr(url, '://') > 0 THEN regexp_extract(substr(url, instr(url, '://') + 3), '(?s)^([^?#]*)', 1) ELSE '' END AS rest FROM pages),
parts AS (SELECT page_id, lowered, {lower.format("split_part(rest, '/', 1)")} AS host, substr(rest, length(split_part(rest, '/', 1)) + 1) AS path FROM cut),
hits AS (SELECT page_id, host, path, ({count(vocabulary.strict)})::INTEGER AS strict_hits, ({count(vocabulary.soft)})::INTEGER AS soft_hits FROM parts)
SELECT page_id, host, path, CASE {' '.join(f"WHEN {fits[r]} THEN '{r[1]}{r[2]}'" for r in ranked)} END AS rule,
       CASE {' '.join(f"WHEN {fits[r]} THEN '{r[0]}'" for r in ranked)} WHEN strict_hits > 0 OR soft_hits >= {vocabulary.soft_hits} THEN 'block' ELSE 'allow' END AS verdict,
       strict_hits, soft_hits FROM hits""".strip()
