"""Stand-in inputs built from the driver's tables (Spark side).

The original pipeline read forum dumps, coder sheets and model outputs that
are not part of the test data. Each function here derives one of those
inputs from the given tables by a fixed rule, so its size grows with the
tables. ``standins_sql`` spells the same rules for the DuckDB oracle.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import lexicon as L
from ..lexicon import FIXTURE_LEXICON
from ..operators.matching import keyword_match
from ..operators.sampling import split_train_test
from ..session import read_table
from .stages import staged

LONG_TEXT = 1500          # "logreg" stand-in: n_chars above this is relevant
MIN_HITS = 3              # "svm" stand-in: at least this many keyword hits
CONF_SCALE = 2000.0       # confidence = least(1, n_chars / CONF_SCALE)
MODELS = ("logreg", "svm", "gpt_zero_shot")

# Stand-in for the absent regex -> label dictionary (our own patterns).
REGEX_LEXICON = [
    ("th(e|is)", "english article"),
    ("d(er|ie|as)", "german article"),
    ("qu(e|i)", "romance pronoun"),
    ("tion", "tion"),
    ("pour|para|por", "for"),
    ("mit|with|avec", "with"),
]

#: each filtering phrase as a regex (words apart by a space, a hyphen or nothing, perhaps a plural), with the rules above
REGEX_DICTIONARY = [("[ -]?".join(re.sub(r"([!-/:-@\[-^`{-~])", r"\\\1", w) for w in p.split()) + "s?", p) for p in L.FILTERING_PHRASES] + REGEX_LEXICON

#: a remark with words that keep their period and with real sentence ends; <k> is the text's first keyword
ABBREVIATED = "Seen by Dr. Smith. The dose of <k> was approx. 5 mg. daily, cf. the notes. It helped. No more than 10 mg. in all, said Dr. Jones."


# Remarks put behind some documents (by doc_id), since the invented prose holds
# no lexicon phrase, dose or removed body: single and multi-word phrases,
# punctuated and overlapping ones, doses that count and doses that do not.
REMARKS = [
    " Took 5mg of THC and 2.5 ml CBD.", " OG Kush at 10 mg, then delta-8.", " THCV 5%thc, no rest.",
    " Charlotte’s Web oil by 20 g and Rick Simpson Oil", " 2-AG levels and CB1 receptor; exo-THC", " dose 5 % cannabis",
    " mg 7 weed 10mgs", " delta 8 THC 100mg pre-rolls / dab rigs", " Mary Jane-like, sticky icky hash.", " Bubba Kush kush OG Kushes",
    " tincture for sleep and pain, 0.5ml", " x2-AG, delta-88, hashing",
]
REMARK_EVERY = 17


def docs(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "documents")


def remarked(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with their remarks: the k-th one where doc_id % 17 = k."""
    at = (F.col("doc_id") % REMARK_EVERY).cast("int")
    remark = F.coalesce(F.get(F.array(*[F.lit(r) for r in REMARKS]), at), F.lit(""))
    return docs(spark, sf).withColumn("text", F.concat("text", remark))


def remarked_posts(spark: SparkSession, sf: str) -> DataFrame:
    """(doc_id, title, body): the first line and the rest of remarked documents."""
    return remarked(spark, sf).select(
        "doc_id", F.substring_index("text", "\n", 1).alias("title"),
        F.when(F.instr("text", "\n") > 0, F.expr("substr(text, instr(text, '\\n') + 1)")).otherwise(F.lit("")).alias("body"))


def hits_all(spark: SparkSession, sf: str) -> DataFrame:
    """Every document with its fixture-lexicon matches (possibly none)."""
    d = docs(spark, sf).select(F.col("doc_id").alias("id"), F.col("source").alias("subreddit"),
                               "text", "lang", "n_chars")
    return keyword_match(d, "text", FIXTURE_LEXICON, keep_empty=True)


def hits(spark: SparkSession, sf: str) -> DataFrame:
    """Keyword hits: (id, subreddit, text, lang, n_chars, keywords) with >= 1 match."""
    return hits_all(spark, sf).filter(F.size("keywords") > 0)


def hit_index(spark: SparkSession, sf: str) -> DataFrame:
    """Every document's matches without its text. Staged: every branch of
    every query reads the same narrow table instead of re-running the matcher."""
    return staged(spark, sf, "hit_index", lambda: hits_all(spark, sf).drop("text"))


def labels(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "labels")


def coded_lines(spark: SparkSession, sf: str, label: str = "quality", inner: bool = False) -> DataFrame:
    """Relevance lines: hit rows with a ";"-joined keyword list and a label."""
    h = hit_index(spark, sf).filter(F.size("keywords") > 0) \
        .select("id", "subreddit", "lang", F.array_join("keywords", ";").alias("keyword"))
    lab = labels(spark, sf).select(F.col("doc_id").alias("id"), F.col(label).alias("label"))
    return h.join(lab, "id", "inner" if inner else "left")


def coder_1(spark, sf):
    return coded_lines(spark, sf, "quality", inner=True)


def coder_2(spark, sf):
    """Second coder: the toxic flag, and no German rows (so coverage differs)."""
    return coded_lines(spark, sf, "toxic", inner=True).filter(F.col("lang") != "de")


def predictions(spark: SparkSession, sf: str, with_text: bool = False) -> DataFrame:
    """Three rule models over every document (the dashboard's full table).

    Without text it is a staged table built on the staged hit index."""
    if with_text:
        return _predictions(hits_all(spark, sf))
    return staged(spark, sf, "predictions", lambda: _predictions(
        hit_index(spark, sf).withColumn("text", F.lit(None).cast("string"))).drop("text"))


def hit_keys(spark: SparkSession, sf: str) -> DataFrame:
    """Hits without text (id, subreddit, lang, n_chars, keywords), from the staged index."""
    return hit_index(spark, sf).filter(F.size("keywords") > 0)


def _predictions(h: DataFrame) -> DataFrame:
    conf = F.least(F.lit(1.0), F.col("n_chars") / F.lit(CONF_SCALE))
    rel = F.array(
        F.struct(F.lit("logreg").alias("model"), (F.col("n_chars") > LONG_TEXT).cast("int").alias("relevance")),
        F.struct(F.lit("svm").alias("model"), (F.size("keywords") >= MIN_HITS).cast("int").alias("relevance")),
        F.struct(F.lit("gpt_zero_shot").alias("model"), (F.col("lang") == "en").cast("int").alias("relevance")),
    )
    return h.select(
        "id", "subreddit", "text",
        F.when(F.size("keywords") > 0, F.array_join("keywords", ",")).alias("keyword"),
        F.when(F.size("keywords") > 0, F.lit("keyword_match")).otherwise(F.lit("random_kfails")).alias("subset"),
        conf.alias("confidence"), F.col("id").alias("ord"),
        F.explode(rel).alias("_m"),
    ).select("id", "subreddit", "text", "keyword", "subset", "confidence", "ord",
             F.col("_m.model").alias("model"), F.col("_m.relevance").alias("relevance"))


def gold(spark: SparkSession, sf: str) -> DataFrame:
    """Gold labels with is_test: candidates (toxic = 0) are split 80/20 per
    class; only their training rows get is_test = 0. Staged."""
    return staged(spark, sf, "gold", lambda: _gold(spark, sf))


def _gold(spark: SparkSession, sf: str) -> DataFrame:
    lab = labels(spark, sf).select(F.col("doc_id").alias("id"), F.col("quality").alias("relevance_true"), "toxic")
    cand = split_train_test(lab.filter(F.col("toxic") == 0), "id", "relevance_true", 0.2, 42)
    train = cand.filter(F.col("is_test") == 0).select("id").withColumn("_train", F.lit(True))
    return lab.join(train, "id", "left").select(
        "id", "relevance_true", F.when(F.col("_train"), 0).otherwise(1).alias("is_test"))


def posts(spark: SparkSession, sf: str) -> DataFrame:
    """Turn 0 of each conversation as a post: id 'p<conv>', title = first line."""
    c = read_table(spark, sf, "conversations").filter(F.col("turn") == 0)
    return c.select(
        F.concat(F.lit("p"), F.col("conv_id").cast("string")).alias("id"),
        F.substring_index("text", "\n", 1).alias("title"),
        F.when(F.instr("text", "\n") > 0, F.expr("substr(text, instr(text, '\\n') + 1)")).otherwise(F.lit("")).alias("selftext"),
        F.col("role").alias("category"), "conv_id")


def comments(spark: SparkSession, sf: str) -> DataFrame:
    """Later turns as comments of the conversation's post."""
    c = read_table(spark, sf, "conversations").filter(F.col("turn") > 0)
    return c.select(
        F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("_"), F.col("turn").cast("string")).alias("id"),
        F.concat(F.lit("p"), F.col("conv_id").cast("string")).alias("post_id"),
        F.col("text").alias("body"), "conv_id", "turn")


def thread_sheet(spark: SparkSession, sf: str) -> DataFrame:
    """One row per turn >= 1: the post repeated on every row, the comment
    repeated on its reply's row, replies on even turns."""
    conv = read_table(spark, sf, "conversations")
    p = conv.filter(F.col("turn") == 0).select("conv_id", F.col("text").alias("_pt"), F.col("role").alias("_prole"))
    com = conv.select("conv_id", F.col("turn").alias("_ct"), F.col("text").alias("comment_body"))
    r = conv.filter(F.col("turn") >= 1).select("conv_id", "turn", F.col("text").alias("_tt"))
    r = r.withColumn("_ct", F.expr("2 * ((turn + 1) div 2) - 1"))
    rows = r.join(p, "conv_id").join(com, ["conv_id", "_ct"], "left")
    return rows.select(
        F.concat(F.lit("sheet_"), F.col("_prole")).alias("file"),
        (F.col("conv_id") * 100 + F.col("turn")).alias("row"),
        F.col("conv_id").alias("post_id"),
        F.substring_index("_pt", "\n", 1).alias("title"),
        F.col("_pt").alias("post_text"),
        (F.col("conv_id") * 100 + F.expr("(turn + 1) div 2")).alias("comment_id"),
        "comment_body",
        F.when(F.col("turn") % 2 == 0, F.col("conv_id") * 100 + 50 + F.col("turn")).alias("reply_id"),
        F.when(F.col("turn") % 2 == 0, F.col("_tt")).alias("reply_body"),
    )


def raw_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Raw dump lines: each document as one JSON line of a per-source file.

    English documents are comments (id, body, created_utc); the others are
    submissions (title = first line, selftext = rest). created_utc is
    derived from n_chars so that some lines fall before 2020. Some
    submissions have a removed body; every 97th line is cut short and every
    89th has text after the object (bad JSON), as in a damaged dump.
    """
    d = docs(spark, sf)
    created = F.lit(1546300800) + F.col("n_chars") * F.lit(40000)
    is_c = F.col("lang") == "en"
    title = F.substring_index("text", "\n", 1)
    body = F.when(F.instr("text", "\n") > 0, F.expr("substr(text, instr(text, '\\n') + 1)")).otherwise(F.lit(""))
    body = F.when(F.col("doc_id") % 11 == 3, F.lit("[deleted]")).when(F.col("doc_id") % 11 == 5, F.lit("[Removed]")).otherwise(body)
    as_json = F.when(is_c, F.to_json(F.struct(F.col("doc_id").cast("string").alias("id"), F.col("text").alias("body"),
                                              created.alias("created_utc")))) \
        .otherwise(F.to_json(F.struct(F.col("doc_id").cast("string").alias("id"), title.alias("title"),
                                      body.alias("selftext"), created.alias("created_utc"))))
    file = F.concat(F.col("source"), F.when(is_c, F.lit("_comments")).otherwise(F.lit("_submissions")), F.lit(".zst"))
    base = d.select("doc_id", file.alias("file"), as_json.alias("_l"))
    line = F.when(F.col("doc_id") % 97 == 0, F.expr("substr(_l, 1, length(_l) - 1)")) \
        .when(F.col("doc_id") % 89 == 1, F.concat("_l", F.lit(" trailing }"))).otherwise(F.col("_l"))
    return base.select("doc_id", "file", line.alias("line"))


def abbreviated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, text, keywords) of the hits, every third with a remark behind its text."""
    remark = F.replace(F.lit(ABBREVIATED), F.lit("<k>"), F.get("keywords", 0))
    text = F.when(F.col("id") % 3 == 0, F.concat_ws(" ", "text", remark)).otherwise(F.col("text"))
    return hits(spark, sf_dir).select("id", text.alias("text"), "keywords")
