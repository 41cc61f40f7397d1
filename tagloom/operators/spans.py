"""Text spans: phrase occurrences, merging, priority, sentence context, marks."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .matching import WORD, fence
from .sampling import ordinal

BLOCK = 256  # running sums are made inside blocks of so many, then over the blocks


def running_sums(df: DataFrame, values: Column, out_col: str) -> DataFrame:
    """Add the running sums of an int array, in the row: inside blocks, then
    over the blocks' totals, so that long arrays are not copied once an entry."""
    def sums(xs):
        return F.aggregate(xs, F.array().cast("array<int>"), lambda acc, x: F.concat(acc, F.array(F.coalesce(F.get(acc, F.size(acc) - 1), F.lit(0)) + x)))

    starts = F.when(F.size("_v") > 0, F.sequence(F.lit(0), F.size("_v") - 1, F.lit(BLOCK))).otherwise(F.array().cast("array<int>"))
    d = fence(df, values, "_v")
    d = fence(d, F.transform(starts, lambda b: sums(F.slice("_v", b + 1, F.lit(BLOCK)))), "_blocks")
    d = fence(d, sums(F.transform("_blocks", lambda x: F.get(x, F.size(x) - 1))), "_totals")
    whole = F.flatten(F.transform("_blocks", lambda x, k: F.transform(x, lambda v: v + F.when(k > 0, F.get("_totals", k - 1)).otherwise(0))))
    return d.withColumn(out_col, whole).drop("_v", "_blocks", "_totals")


def literal_pattern(phrase: Column, whole_word: bool) -> Column:
    """A case-insensitive regex for a phrase; with ``whole_word`` the characters
    at its ends and those beside them must not be both word characters or none."""
    body = F.regexp_replace(phrase, r"([\p{Punct}])", r"\\$1")
    if not whole_word:
        return F.concat(F.lit("(?iu)"), body)
    head = F.when(phrase.rlike(f"^{WORD}"), F.lit(f"(?<!{WORD})")).otherwise(F.lit(f"(?<={WORD})"))
    tail = F.when(phrase.rlike(f"{WORD}$"), F.lit(f"(?!{WORD})")).otherwise(F.lit(f"(?={WORD})"))
    # the phrase is looked for first: few places are left for the costlier look behind
    return F.concat(F.lit("(?iu)(?="), body, F.lit(")"), head, body, tail)


def phrase_spans(df: DataFrame, text_col: str, phrases_col: str, out_col: str = "keyword",
                 whole_word: bool = False) -> DataFrame:
    """One row per occurrence: the input columns (minus text and phrases) +
    ``out_col`` (the phrase), start, end. Occurrences of a phrase are literal,
    case-insensitive and do not overlap; with ``whole_word`` an occurrence
    must not touch a word character on either side.

    Positions come from the plan: the text is split at the phrase, and the
    running sum of the parts' lengths is where the occurrences lie. A text is
    read where it is, only lengths go on. Null texts, null and empty phrases
    give no rows; a phrase listed twice counts once.
    """
    keep = [c for c in df.columns if c not in (text_col, phrases_col)]
    return _occurrences(df, keep, _gaps(F.col(text_col), F.col(phrases_col), whole_word), {out_col: "p"}).select(*keep, out_col, "start", "end")


def _gaps(text: Column, phrases: Column, whole_word: bool) -> Column:
    """For each phrase the lengths of the parts that it splits the text into."""
    phrases = F.array_distinct(F.filter(phrases, lambda p: p.isNotNull() & (p != "")))
    return F.transform(phrases, lambda p: F.struct(p.alias("p"), F.transform(F.split(text, literal_pattern(p, whole_word), -1), lambda x: F.length(x)).alias("gaps")))


def _occurrences(df: DataFrame, keep: list[str], found: Column, fields: dict[str, str]) -> DataFrame:
    """(keep, start, end and ``fields`` of each entry of ``found``), a row per occurrence."""
    d = df.select(*keep, F.explode(F.filter(found, lambda f: F.size(f["gaps"]) > 1)).alias("_f"))
    d = d.select(*keep, *(F.col(f"_f.{f}").alias(c) for c, f in fields.items()), F.col("_f.p").alias("_p"), F.col("_f.gaps").alias("_g"))
    # an occurrence ends where the parts before it and the phrase as often as it came end
    ends = F.transform(F.slice("_g", F.lit(1), F.size("_g") - 1), lambda g: g + F.length("_p"))
    d = running_sums(d, ends, "_ends").select(*keep, *fields, "_p", F.explode("_ends").alias("end"))
    return d.select(*keep, *fields, (F.col("end") - F.length("_p")).alias("start"), "end")


def highlight_and_bold(df: DataFrame, key_cols: list[str], text_col: str, source_cols: list[str],
                       keywords_col: str) -> DataFrame:
    """Spans to render, before overlaps are resolved: (keys, kind, field, phrase, start, end).

    ``source_*`` columns hold the phrases an annotator marked: every
    occurrence is a "highlight" of that field. Keywords are "bold" where
    they stand as whole words.
    """
    def of(kind, field, phrases, whole_word):
        found = F.transform(_gaps(F.col(text_col), phrases, whole_word), lambda f: F.struct(
            F.lit(kind).alias("kind"), F.lit(field).cast("string").alias("field"), f["p"].alias("p"), f["gaps"].alias("gaps")))
        return F.coalesce(found, F.array().cast("array<struct<kind:string,field:string,p:string,gaps:array<int>>>"))

    # one pass over the texts for both kinds
    found = F.concat(*(of("highlight", c.removeprefix("source_"), F.array(c), False) for c in source_cols), of("bold", None, F.col(keywords_col), True))
    return _occurrences(df, key_cols, found, {"field": "field", "phrase": "p", "kind": "kind"}).select(*key_cols, "field", "phrase", "start", "end", "kind")


def merge_spans(spans: DataFrame, key_cols: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """Merge spans of each key when the next start <= the current end.

    Gaps and islands: a span opens a new island when its start is beyond
    every earlier end of its key. A span travels as one number, start before
    end, in its key's array: eight bytes where a sorted row takes about sixty.
    """
    kinds = dict(spans.dtypes)
    code = F.shiftleft(F.coalesce(F.col(start).cast("int"), F.lit(NO_START)).cast("long"), 32).bitwiseOR(F.coalesce(F.col(end).cast("int"), F.lit(-1)).cast("long") + 1)
    packed = spans.groupBy(*key_cols).agg(F.collect_list(code).alias("_a"))
    islands = packed.select(*key_cols, F.explode(_islands("_a")).alias("_x"))
    first, last = F.shiftright("_x", 32).cast("int"), F.col("_x").bitwiseAND(F.lit((1 << 32) - 1)) - 1
    return islands.select(*key_cols, F.nullif(first, F.lit(NO_START)).cast(kinds[start]).alias(start), F.nullif(last, F.lit(-1).cast("long")).cast(kinds[end]).alias(end))


NO_START = -1 << 31  # a null start: before all others, it opens no island behind an end


@F.pandas_udf(T.ArrayType(T.LongType()))
def _islands(codes: pd.Series) -> pd.Series:
    none, low = -1 << 31, (1 << 32) - 1
    out = []
    for a in codes:
        a = np.sort(a)
        s, e = a >> 32, (a & low) - 1
        top = np.maximum.accumulate(e)[:-1]
        at = np.flatnonzero(np.concatenate([[True], (top < 0) | ((s[1:] > top) & (s[1:] != none))]))
        s = np.minimum.reduceat(np.where(s == none, low, s), at)
        out.append((np.where(s == low, none, s) << 32) | (np.maximum.reduceat(e, at) + 1))
    return pd.Series(out, dtype=object)


SPAN_KINDS = ["highlight", "bold"]  # on equal spans the earlier kind stays


def span_priority(spans: DataFrame, key_cols: list[str], kind_col: str, kinds: list[str] = SPAN_KINDS) -> DataFrame:
    """Greedy non-overlapping pick per key: by start ascending, end descending,
    then by the order of ``kinds`` (others last, by name); a span overlapping
    an already kept one is skipped. Runs in-row over the key's sorted span
    array, one step a span, no second shuffle."""
    rank = F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(k) for k in kinds]), F.col(kind_col)), F.lit(0)),
                      F.lit(len(kinds) + 1)).cast("int")
    packed = spans.groupBy(*key_cols).agg(
        F.array_sort(F.collect_set(F.struct(F.col("start").alias("s"), (-F.col("end")).alias("ne"),
                                            rank.alias("r"), F.col(kind_col).alias("k")))).alias("_a"))
    places = _picked(F.transform("_a", lambda x: x["s"]), F.transform("_a", lambda x: -x["ne"]))
    picked = packed.withColumn("_p", places).select(*key_cols, F.explode(F.transform("_p", lambda i: F.get("_a", i))).alias("_x"))
    return picked.select(*key_cols, F.col("_x.s").alias("start"), (-F.col("_x.ne")).alias("end"),
                         F.col("_x.k").alias(kind_col))


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _picked(starts: pd.Series, ends: pd.Series) -> pd.Series:
    """Places of the spans that start at or behind the end of the one kept before."""
    out = []
    for s, e in zip(starts, ends):
        last, kept = -1, []
        for i, (a, b) in enumerate(zip(s.tolist(), e.tolist())):
            if a >= last:  # never behind a NaN, which stands for null
                kept.append(i)
                last = b
        out.append(kept)
    return pd.Series(out, dtype=object)


SENTENCE_BREAK = r"([.!?])[ \t\r\n]+"


def sentences(text: Column) -> Column:
    """Split after . ! ? followed by whitespace (the whitespace is dropped)."""
    return F.split(F.regexp_replace(text, SENTENCE_BREAK, "$1\u0001"), "\u0001")


#: a token: opening marks, a word that may hold periods, a period, closing marks
ABBREVIATION_TOKEN = r"^[\"'(\[{]*(\p{L}+(?:\.\p{L}+)*)(\.?)[\"',;:!?)\]}]*$"
#: the same word with its period before a possible break; of a piece's last token alone, the same by LAST_TOKEN
LAST_TOKEN = r"^[\"'(\[{]*(\p{L}+(?:\.\p{L}+)*)\.$"
LAST_ABBREVIATION = r"(?:^|[ \t\r\n])[\"'(\[{]*(\p{L}+(?:\.\p{L}+)*)\.[ \t\r\n]*$"
MIN_ABBREVIATION_SCORE = 0.3
MOST_INLINE_ABBREVIATIONS = 20_000  # beyond it they are joined, with the same result


def abbreviations(df: DataFrame, text_col: str, min_score: float = MIN_ABBREVIATION_SCORE) -> DataFrame:
    """(abbreviation, n_with, n_without, score): lower-case words that are
    written with a period so often that it belongs to them.

    Unsupervised, after Kiss and Strunk (2006): the log-likelihood ratio of
    "the word and its period belong together" (0.99) against "a period follows
    any word", times a preference for short words, for inner periods, and
    against words that are often written without one. Tokens are counted as
    they stand, so that a token is taken apart once; then come the counts for
    each word, and their totals. Null and wordless texts count nothing; a
    text counts as often as its row repeats.
    """
    tokens = df.select(F.explode(F.split(F.lower(F.col(text_col)), "[ \\t\\r\\n]+")).alias("_t"))
    parts = tokens.groupBy("_t").agg(F.count("*").alias("_c")).select(F.regexp_extract("_t", ABBREVIATION_TOKEN, 1).alias("abbreviation"), F.regexp_extract("_t", ABBREVIATION_TOKEN, 2).alias("_p"), "_c").where("abbreviation <> ''")
    words = parts.groupBy("abbreviation").agg(F.sum(F.when(F.col("_p") == ".", F.col("_c")).otherwise(0)).alias("n_with"), F.sum(F.when(F.col("_p") == "", F.col("_c")).otherwise(0)).alias("n_without"))
    total = words.agg(F.sum(F.col("n_with") + F.col("n_without")).alias("_n"), F.sum("n_with").alias("_b"))
    a, n = F.col("n_with").cast("double"), F.col("n_without").cast("double")
    p = F.least(F.col("_b") / F.col("_n"), F.lit(1 - 1e-9))
    ratio = 2 * (a * (F.lit(math.log(0.99)) - F.log(p)) + n * (F.lit(math.log(0.01)) - F.log(1 - p)))
    inner = F.length("abbreviation") - F.length(F.replace("abbreviation", F.lit("."), F.lit("")))
    letters = (F.length("abbreviation") - inner).cast("double")
    scored = words.where("n_with > 0").crossJoin(F.broadcast(total))  # one row
    scored = scored.withColumn("score", ratio * F.exp(-letters) * (inner + 1) * F.pow(letters, -n))
    return scored.where(F.col("score") >= min_score).select("abbreviation", "n_with", "n_without", "score")


def learnt_sentences(df: DataFrame, text_col: str, abbrevs: DataFrame, out_col: str = "_s") -> DataFrame:
    """Add ``out_col``: the sentences as in ``sentences``, but without a break
    behind a word of ``abbrevs`` (abbreviation, lower case). A null text has null."""
    text = F.regexp_replace(F.col(text_col), r"([.!?][ \t\r\n]+)", "$1\u0001")
    # the last token of a piece, cut off before the regex: it would try every word
    token = lambda x: F.substring_index(F.translate(F.rtrim(x, F.lit(" \t\r\n")), "\t\r\n", "   "), " ", -1)
    pieces = F.transform(F.split(text, "\u0001"), lambda x: F.struct(x.alias("x"), F.regexp_extract(F.lower(token(x)), LAST_TOKEN, 1).alias("w")))
    d = fence(df, pieces, "_pieces")
    if abbrevs.limit(MOST_INLINE_ABBREVIATIONS + 1).count() <= MOST_INLINE_ABBREVIATIONS:
        known = [r["abbreviation"] for r in abbrevs.select("abbreviation").collect()]
        own = lambda p: p["w"].isin(known) if known else F.lit(False)
    else:  # each text gets the abbreviations among its own words; texts that are equal share them
        d = d.withColumn("_d", F.md5(F.col(text_col)))
        asked = d.select("_d", F.explode(F.array_distinct(F.transform("_pieces", lambda p: p["w"]))).alias("abbreviation")).where("abbreviation <> ''").distinct()
        held = asked.join(abbrevs.select("abbreviation"), "abbreviation").groupBy("_d").agg(F.collect_set("abbreviation").alias("_own"))
        d = d.join(held, "_d", "left").withColumn("_own", F.coalesce("_own", F.array().cast("array<string>")))
        own = lambda p: F.array_contains("_own", p["w"])
    kept = F.transform("_pieces", lambda p, i: F.when((i == F.size("_pieces") - 1) | own(p), p["x"]).otherwise(F.concat(F.regexp_replace(p["x"], r"[ \t\r\n]+$", ""), F.lit("\u0001"))))
    return fence(d, F.split(F.array_join(kept, ""), "\u0001"), out_col).drop("_pieces", "_d", "_own")


def keyword_context(df: DataFrame, id_col: str, text_col: str, kw_col: str, window: int = 2, abbrevs: DataFrame | None = None) -> DataFrame:
    """Sentences that hold a keyword (substring, case-insensitive) with ``window``
    sentences around them; overlapping or touching ranges merged; one row per
    range: (id, range_start, range_end, context). With ``abbrevs`` (see
    ``abbreviations``) no sentence ends behind one of them.

    All in-row: the sentence array, the matched indices and the merged
    ranges are higher-order functions over the row's own arrays.
    """
    # each sentence is lowered once, and the fences keep Catalyst from
    # computing an array again for every element of a function over it
    d = fence(df.select(id_col, text_col, kw_col), F.transform(kw_col, lambda k: F.lower(k)), "_k")
    d = fence(d, sentences(F.col(text_col)), "_s") if abbrevs is None else learnt_sentences(d, text_col, abbrevs)
    d = d.select(id_col, "_s", "_k")
    n = F.size("_s")
    tested = F.transform(F.transform("_s", lambda x: F.lower(x)),
                         lambda x, i: F.struct(i.alias("i"), F.exists("_k", lambda k: x.contains(k)).alias("hit")))
    d = fence(d, F.transform(F.filter(tested, lambda e: e["hit"]), lambda e: e["i"]), "_m")
    # equal windows in order: a range starts where the gap to the match
    # before is too wide to touch, and ends where the gap after is
    apart = 2 * window + 1
    starts = F.filter("_m", lambda x, j: (j == 0) | (x - F.get("_m", j - 1) > apart))
    ends = F.filter("_m", lambda x, j: (j == F.size("_m") - 1) | (F.get("_m", j + 1) - x > apart))
    ranges = F.transform(F.arrays_zip(starts.alias("s"), ends.alias("e")),
                         lambda r: F.struct(F.greatest(F.lit(0), r["s"] - window).alias("a"),
                                            F.least(n, r["e"] + window + 1).alias("b")))
    r = d.select(id_col, "_s", F.posexplode(ranges).alias("range_no", "_r"))
    return r.select(id_col, "range_no", F.col("_r.a").alias("range_start"), F.col("_r.b").alias("range_end"),
                    F.array_join(F.slice("_s", F.col("_r.a") + 1, F.col("_r.b") - F.col("_r.a")), " ").alias("context"))


def annotation_rows(entries: DataFrame, id_col: str, ann_col: str, order_cols, fields: list[str]) -> DataFrame:
    """One row per annotation; annotation_id = id + "_" + a running number over
    all annotations in the order of ``order_cols`` (columns of any type; for
    files, what ``read_annotations`` gives: file, block, line). An entry
    without annotations gives one row "<id>_0" with no_annotations = true."""
    order = [order_cols] if isinstance(order_cols, str) else list(order_cols)
    n = F.greatest(F.coalesce(F.size(ann_col), F.lit(0)), F.lit(0))
    e = ordinal(entries.withColumn("_n", n), order, "_base", "_n")
    x = e.select(id_col, "_base", F.posexplode_outer(ann_col).alias("_pos", "_a"))
    return x.select(
        id_col,
        F.when(F.col("_a").isNull(), F.concat(F.col(id_col).cast("string"), F.lit("_0")))
        .otherwise(F.concat(F.col(id_col).cast("string"), F.lit("_"), (F.col("_base") + F.col("_pos")).cast("string")))
        .alias("annotation_id"),
        *[F.col("_a")[f].alias(f) for f in fields],
        F.col("_a").isNull().alias("no_annotations"))
