"""Phrase and regex matching over text columns.

Whole-word phrase matching (``keyword_match``) has one rule at any lexicon
size: same phrases, same (lexicon) order, same treatment of duplicates, no
key columns asked for. Two physical plans carry it out:

* **in-row** (lexicons counted up to ``MAX_INLINE`` phrases): the lexicon is a
  literal hash table in the plan. The text is lowered once; each distinct
  token is hashed to its bucket of phrases, and a phrase of several tokens is
  verified only if its anchor token is there. Cost follows the text, not the
  lexicon. A single narrow projection: no shuffle, the row keeps all columns.
* **token join** (larger lexicons): distinct tokens joined to the lexicon on
  the anchor (broadcast only if the lexicon's count is below a bound, else
  salted against hot tokens), verified, and joined back by a digest of the
  text, so equal texts are matched once.

The anchor is a token that every match must hold as a whole: the phrase's
first run of word characters, or, for a phrase of punctuation alone, the
phrase itself as a run of non-word characters.

A phrase matches when Python's ``\\b<phrase>\\b`` would match it in the
lower-cased text; word characters are ``[\\p{L}\\p{N}_]``.
"""

from __future__ import annotations

import json
import zlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import (
    WORD, boundary_regex, is_single_token, java_quote, tokens_of, word_tokens,
)

MAX_INLINE = 20_000        # phrases of a lexicon that is carried in the plan
MAX_BROADCAST_LEXICON = 200_000  # rows of a joined lexicon that may be broadcast
SALTS = 16                 # copies of a joined lexicon that may not: hot tokens are split
BUCKETS = ("array<array<struct<ord:int,term:string,low:string,anchor:string,"
           "single:boolean,pattern:string>>>")


@dataclass(frozen=True)
class Phrase:
    ord: int
    term: str
    anchor: str
    single: bool
    pattern: str


def anchor_of(phrase: str) -> str:
    """The token a text must hold for the phrase to match."""
    words = tokens_of(phrase)
    return words[0] if words else phrase.lower()


def prepare(terms, dedupe: bool = True) -> list[Phrase]:
    """Lexicon entries in list order; duplicates dropped (first kept) by default."""
    seen, out = set(), []
    for t in terms:
        if t is None or t == "":
            continue
        if dedupe and t in seen:
            continue
        seen.add(t)
        out.append(Phrase(len(out), t, anchor_of(t), is_single_token(t), boundary_regex(t)))
    return out


def _terms_of(lexicon) -> list[str] | None:
    """The terms of a lexicon that the plan may carry, None when it must be joined."""
    if isinstance(lexicon, (list, tuple)):
        return list(lexicon) if len(lexicon) <= MAX_INLINE else None
    # DataFrame (ord, term): bounded check before pulling it to the driver
    if lexicon.limit(MAX_INLINE + 1).count() > MAX_INLINE:
        return None
    return [r["term"] for r in lexicon.select("ord", "term").orderBy("ord").collect()]


def lexicon_frame(spark: SparkSession, terms) -> DataFrame:
    """(ord, term) of a list of phrases."""
    return spark.createDataFrame([(i, t) for i, t in enumerate(terms)], "ord int, term string")


def lexicon_buckets(entries: list[Phrase]) -> tuple[Column, int]:
    """The lexicon as a literal hash table: buckets of entries by crc32 of the anchor."""
    n = 1 << max(4, len(entries).bit_length())
    table: list[list[dict]] = [[] for _ in range(n)]
    for e in entries:
        table[zlib.crc32(e.anchor.encode()) % n].append(
            {"ord": e.ord, "term": e.term, "low": e.term.lower(), "anchor": e.anchor, "single": e.single, "pattern": e.pattern})
    return F.from_json(F.lit(json.dumps(table)), BUCKETS), n


def match_tokens(low: Column, punctuation: bool) -> Column:
    """Distinct runs of word characters; of other characters too if asked for."""
    words = word_tokens(low)
    return F.concat(words, F.array_distinct(F.split(low, f"{WORD}+"))) if punctuation else words


def phrase_hits(low: Column, tokens: Column, entries: list[Phrase]) -> Column:
    """ARRAY<STRING> of matched phrases, in lexicon order (in-row plan)."""
    table, n = lexicon_buckets(entries)

    def of_token(t):
        return F.filter(F.get(table, (F.crc32(t.cast("binary")) % n).cast("int")),
                        lambda e: (e["anchor"] == t) & (e["single"] | (low.contains(e["low"]) & F.regexp_like(low, e["pattern"]))))

    found = F.flatten(F.transform(tokens, of_token))
    return F.coalesce(F.transform(F.array_sort(found), lambda e: e["term"]), F.array().cast("array<string>"))


def fence(df: DataFrame, expr: Column, name: str) -> DataFrame:
    """Add ``expr`` as column ``name`` behind a one-row Generate.

    Catalyst pushes a filter on a projected column down through the Project
    by inlining the expression. For the match expression that would repeat
    the tokenizer once per lexicon entry. A filter cannot pass a Generate
    that produces the column it tests, so the expression runs exactly once.
    """
    cols = [c for c in df.columns if c != name]
    return df.select(*cols, F.explode(F.array(expr)).alias(name))


def keyword_match(df: DataFrame, text_col: str, lexicon, out_col: str = "keywords",
                  dedupe: bool = True, keep_empty: bool = False) -> DataFrame:
    """Add ``out_col`` = phrases of ``lexicon`` found whole-word in ``text_col``.

    ``lexicon`` is a list of phrases or a DataFrame ``(ord, term)`` of any
    size. Rows without a match are dropped unless ``keep_empty``. A phrase
    listed twice is reported once, at its first place, unless ``dedupe`` is off.
    """
    terms = _terms_of(lexicon)
    if terms is None:
        out = keyword_match_join(df, text_col, lexicon, out_col, dedupe)
    else:
        entries = prepare(terms, dedupe)
        punctuation = any(not tokens_of(e.term) for e in entries)
        staged = (
            df.withColumn("_low", F.lower(F.col(text_col)))
            .withColumn("_tok", match_tokens(F.col("_low"), punctuation))
        )
        out = fence(staged, phrase_hits(F.col("_low"), F.col("_tok"), entries), out_col).drop("_low", "_tok")
    if not keep_empty:
        out = out.filter(F.size(out_col) > 0)
    return out


def _lexicon_columns(lex: DataFrame, dedupe: bool) -> DataFrame:
    """Spark-side anchor / single flag / boundary regex of a lexicon DataFrame."""
    lex = lex.select("ord", "term").filter(F.col("term").isNotNull() & (F.col("term") != ""))
    if dedupe:
        lex = lex.groupBy("term").agg(F.min("ord").alias("ord"))
    low = F.lower(F.col("term"))
    esc = F.regexp_replace(low, r"([\p{Punct}])", r"\\$1")
    head = F.when(low.rlike(f"^{WORD}"), F.lit(f"(?<!{WORD})")).otherwise(F.lit(f"(?<={WORD})"))
    tail = F.when(low.rlike(f"{WORD}$"), F.lit(f"(?!{WORD})")).otherwise(F.lit(f"(?={WORD})"))
    return lex.select(
        "ord", "term", low.alias("low"),
        F.coalesce(F.nullif(F.regexp_extract(low, f"({WORD}+)", 1), F.lit("")), low).alias("anchor"),
        low.rlike(f"^{WORD}+$").alias("single"),
        F.concat(head, esc, tail).alias("pattern"),
    )


def keyword_match_join(df: DataFrame, text_col: str, lexicon, out_col: str, dedupe: bool = True) -> DataFrame:
    """Token-join plan for lexicons too large to carry in the plan."""
    if isinstance(lexicon, (list, tuple)):
        lexicon = lexicon_frame(df.sparkSession, lexicon)
    lex = _lexicon_columns(lexicon, dedupe)
    keyed = df.withColumn("_d", F.md5(F.lower(F.col(text_col))))
    texts = keyed.select("_d", F.lower(F.col(text_col)).alias("_low"))
    toks = texts.select("_d", F.explode(match_tokens(F.col("_low"), True)).alias("tok"))
    if lexicon.limit(MAX_BROADCAST_LEXICON + 1).count() <= MAX_BROADCAST_LEXICON:
        by_tok = toks.join(F.broadcast(lex), F.col("tok") == F.col("anchor"))
    else:
        salted = lex.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        by_tok = toks.withColumn("_t", F.pmod(F.xxhash64("_d"), F.lit(SALTS)).cast("int")) \
            .join(salted, (F.col("tok") == F.col("anchor")) & (F.col("_t") == F.col("_s")))
    single = by_tok.filter("single").select("_d", "ord", "term")
    # phrases of several tokens need the text: it moves once, with all its candidates
    need = by_tok.filter(~F.col("single")).groupBy("_d").agg(F.collect_set(F.struct("ord", "term", "low", "pattern")).alias("_c"))
    holds = F.filter("_c", lambda e: F.col("_low").contains(e["low"]) & F.regexp_like(F.col("_low"), e["pattern"]))
    verified = texts.join(need, "_d").select("_d", F.explode(holds).alias("_e")).select("_d", "_e.ord", "_e.term")
    hits = (single.unionByName(verified)
            .groupBy("_d")
            .agg(F.array_sort(F.collect_set(F.struct("ord", "term"))).alias("_h"))
            .select("_d", F.transform("_h", lambda s: s["term"]).alias(out_col)))
    return keyed.drop(out_col).join(hits, "_d", "left").drop("_d").withColumn(
        out_col, F.coalesce(F.col(out_col), F.array().cast("array<string>")))


def title_first_match(df: DataFrame, title_col: str, body_col: str, lexicon,
                      out_col: str = "keywords", from_title: str | None = None) -> DataFrame:
    """Submissions: the title's matches if it has any, else the body's (which
    is matched only then); with ``from_title`` a column of that name tells
    which."""
    t = keyword_match(df, title_col, lexicon, "_th", keep_empty=True)
    t = t.withColumn("_body", F.when(F.size("_th") == 0, F.col(body_col)))
    b = keyword_match(t, "_body", lexicon, "_bh", keep_empty=True)
    flag = {from_title: F.size("_th") > 0} if from_title else {}
    return (b.withColumns({out_col: F.when(F.size("_th") > 0, F.col("_th")).otherwise(F.col("_bh"))} | flag)
            .drop("_th", "_bh", "_body").filter(F.size(out_col) > 0))


# ---------------------------------------------------------------------------
# regex lexicons, dosage pattern, substring matrix, marking
# ---------------------------------------------------------------------------

def regex_labels(text: Column, regex_to_label: list[tuple[str, str]]) -> Column:
    """Distinct labels whose regex is found (case-insensitive), sorted."""
    parts = [F.when(text.rlike("(?iu)" + rx), F.lit(lab)) for rx, lab in regex_to_label]
    return F.array_sort(F.array_distinct(F.filter(F.array(*parts), lambda x: x.isNotNull())))


def regex_label_match(df: DataFrame, text_col: str, regex_to_label, out_col: str = "keyword",
                      sep: str = "; ") -> DataFrame:
    """Rows whose text hits any regex; labels distinct, sorted, joined by ``sep``."""
    return (fence(df, regex_labels(F.col(text_col), regex_to_label), "_labs")
            .filter(F.size("_labs") > 0)
            .withColumn(out_col, F.array_join("_labs", sep)).drop("_labs"))


def dosage_found(text_lower: Column, pattern: str) -> Column:
    return text_lower.rlike(pattern)


def dosage_filter(df: DataFrame, title_col: str | None, body_col: str, compounds,
                  dose_pattern: str, percent_fix: bool = False, out_col: str = "keywords") -> DataFrame:
    """Dose found (title or body) AND a compound match (title first)."""
    pat = dose_pattern
    if percent_fix:
        pat = r"\b\d+(\.\d+)?\s?(mg|g|ml)\b|\b\d+(\.\d+)?\s?%"
    body_l = F.lower(F.col(body_col))
    dose = body_l.rlike(pat)
    if title_col is not None:
        dose = dose | F.lower(F.col(title_col)).rlike(pat)
    hit = df.filter(dose)
    if title_col is None:
        return keyword_match(hit, body_col, compounds, out_col)
    return title_first_match(hit, title_col, body_col, compounds, out_col)


def keyword_presence_long(df: DataFrame, id_col: str, text_col: str, phrases) -> DataFrame:
    """(id, keyword, present): substring test of each phrase in lower(text).

    Phrases are *not* lowered (as in the original matrix), so a phrase with
    capitals is never found.
    """
    low = F.col("_low")
    found = F.array(*[F.struct(F.lit(p).alias("keyword"), low.contains(p).cast("int").alias("present")) for p in phrases])
    # the text is tested where it is; only (phrase, 0 / 1) pairs are exploded
    tested = df.select(id_col, F.lower(F.col(text_col)).alias("_low")).select(id_col, found.alias("_f"))
    return tested.select(id_col, F.explode("_f").alias("_p")).select(id_col, "_p.keyword", "_p.present")


def mark_keywords(text: Column, keywords: Column, tag: str = "mark") -> Column:
    """Wrap each keyword (case-insensitive, not inside a word) in ``<tag>``.

    Keywords are applied one after another, as the labelling screen does, so
    a later keyword can match inside an earlier inserted tag.
    """
    def step(acc, kw):
        pat = F.concat(F.lit("(?iu)(?<![\\p{L}\\p{N}_])("),
                       F.regexp_replace(kw, r"([\p{Punct}])", r"\\$1"),
                       F.lit(")(?![\\p{L}\\p{N}_])"))
        return F.when((kw.isNull()) | (kw == ""), acc).otherwise(
            F.regexp_replace(acc, pat, F.lit(f"<{tag}>$1</{tag}>")))
    return F.when(text.isNull() | (text == "") | keywords.isNull() | (F.size(keywords) == 0), text) \
        .otherwise(F.aggregate(keywords, text, step))


def dose_regex_sql() -> str:
    """The dosage test spelled for RE2 (no lookaround, ASCII-only ``\\b``)."""
    return (r"(?:^|[^\p{L}\p{N}_])[0-9]+(?:\.[0-9]+)?\s?(?:(?:mg|g|ml)(?:[^\p{L}\p{N}_]|$)|%[\p{L}\p{N}_])")


__all__ = [
    "Phrase", "prepare", "keyword_match", "keyword_match_join", "title_first_match",
    "regex_labels", "regex_label_match", "dosage_filter", "keyword_presence_long",
    "mark_keywords", "java_quote", "MAX_INLINE",
]
