"""Registered queries: a Spark builder and (where SQL can say it) a DuckDB oracle.

Every builder reads the driver's tables (or data Spark derives from them)
and runs over the whole tables. Computed columns carry the same names on
both sides; rates are rounded to 9 digits on both sides.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import lexicon as L
from ..functions import text as T
from ..operators import agreement as AG
from ..operators import evaluation as EV
from ..operators import matching as M
from ..operators import regex_sets as RX
from ..operators import sampling as SA
from ..operators import stats as ST
from ..session import checkpoint_path, written
from ..sources import dumps as DU
from ..sources import files as FI
from ..sources import zst as ZS
from ..sources.keyed_table import KeyedTable
from ..streaming.scoring import score_pending
from . import sql as Q
from . import standins as S

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


# ===========================================================================
# scans, parsing, filters, matching
# ===========================================================================

@query("parse_json_lines", f"""WITH {Q.RAW}
SELECT doc_id, kind, bad, CASE WHEN NOT bad THEN created_utc END AS created_utc,
       CASE WHEN NOT bad THEN length(coalesce(body, selftext)) END AS n_text
FROM raw""")
def q_parse_json_lines(spark, sf):
    p = DU.parse_json_lines(S.raw_lines(spark, sf))
    return p.select("doc_id", "kind", "bad", F.when(~F.col("bad"), F.col("created_utc")).alias("created_utc"),
                    F.when(~F.col("bad"), F.length(F.coalesce("body", "selftext"))).alias("n_text"))


@query("date_filter", f"""WITH {Q.RAW}
SELECT doc_id, created_utc, to_timestamp(created_utc)::TIMESTAMP AS created FROM raw
WHERE NOT bad AND created_utc >= 1577836800""")
def q_date_filter(spark, sf):
    p = DU.parse_json_lines(S.raw_lines(spark, sf)).filter(~F.col("bad"))
    return DU.date_filter(p).select("doc_id", "created_utc", "created")


_ROUGH_SQL = f"""{Q.RAW},
live AS (
  SELECT *, NOT bad AND created_utc >= 1577836800 AS ok,
         kind = 'submissions' AND NOT bad AND created_utc >= 1577836800
           AND lower(selftext) IN ('[deleted]', '[removed]') AS removed
  FROM raw),
tagged AS (
  SELECT file, id, bad, removed,
         CASE WHEN kind = 'submissions' THEN lower(title) || ' /// ' || lower(selftext) ELSE lower(body) END AS text,
         CASE WHEN NOT ok OR removed THEN []
              WHEN kind = 'comments' THEN {Q.match_list('body')}
              WHEN len({Q.match_list('title')}) > 0 THEN {Q.match_list('title')}
              ELSE {Q.match_list('selftext')} END AS keywords
  FROM live)"""


@query("keyword_match", f"""WITH {_ROUGH_SQL}
SELECT file, regexp_extract(file, '^([^_]+_[a-zA-Z])', 1) AS short_name, id, text,
       array_to_string(keywords, '; ') AS keywords
FROM tagged WHERE len(keywords) > 0""")
def q_keyword_match(spark, sf):
    """The rough cut: dump lines -> parse -> date -> route -> whole-word match."""
    parsed = DU.parse_json_lines(S.raw_lines(spark, sf))
    hits = DU.rough_filter(parsed, L.FIXTURE_LEXICON)
    return hits.select("file", "short_name", "id", "text", F.array_join("keywords", "; ").alias("keywords"))


@query("scan_line_counts", f"""WITH {_ROUGH_SQL}
SELECT file, count(*) FILTER (WHERE NOT removed) AS total_lines,
       count(*) FILTER (WHERE len(keywords) > 0) AS keyword_lines,
       count(*) FILTER (WHERE bad) AS bad_lines
FROM tagged GROUP BY file""")
def q_scan_line_counts(spark, sf):
    parsed = DU.parse_json_lines(S.raw_lines(spark, sf))
    return DU.scan_line_counts(DU.tag_lines(parsed, L.FIXTURE_LEXICON))


@query("dump_frames", f"""WITH {_ROUGH_SQL}
SELECT file, count(*) FILTER (WHERE NOT removed) AS total_lines,
       count(*) FILTER (WHERE len(keywords) > 0) AS keyword_lines,
       count(*) FILTER (WHERE bad) AS bad_lines
FROM tagged GROUP BY file""")
def q_dump_frames(spark, sf):
    """The raw lines written as zstd files of many frames, read back by runs of
    frames (several tasks a file) and counted by the rough cut."""
    path = checkpoint_path(spark, f"dump-{uuid.uuid4().hex}")
    raw = S.raw_lines(spark, sf).repartitionByRange("file", "doc_id")
    ZS.write_frames(raw.select("file", "line"), path, frame_bytes=1 << 14)
    lines = ZS.read_frames(spark, path).withColumn("file", F.regexp_replace("file", r"-\d+\.zst$", ".zst"))
    return DU.scan_line_counts(DU.tag_lines(DU.parse_json_lines(lines), L.FIXTURE_LEXICON))


@query("title_first_match", f"""WITH d AS (
  SELECT doc_id, split_part(text, chr(10), 1) AS title,
         CASE WHEN strpos(text, chr(10)) > 0 THEN substr(text, strpos(text, chr(10)) + 1) ELSE '' END AS body
  FROM documents),
m AS (SELECT doc_id, {Q.match_list('title')} AS th, {Q.match_list('body')} AS bh FROM d)
SELECT doc_id, array_to_string(CASE WHEN len(th) > 0 THEN th ELSE bh END, '; ') AS keywords,
       len(th) > 0 AS from_title
FROM m WHERE len(th) > 0 OR len(bh) > 0""")
def q_title_first_match(spark, sf):
    d = S.docs(spark, sf).select(
        "doc_id", F.substring_index("text", "\n", 1).alias("title"),
        F.when(F.instr("text", "\n") > 0, F.expr("substr(text, instr(text, '\\n') + 1)")).otherwise(F.lit("")).alias("body"))
    out = M.title_first_match(d, "title", "body", L.FIXTURE_LEXICON, from_title="from_title")
    return out.select("doc_id", F.array_join("keywords", "; ").alias("keywords"), "from_title")


def _re2_quote(s: str) -> str:
    return "".join("\\" + c if c in r"\.^$|?*+()[]{}-" else c for c in s).replace("'", "''")


def _phrase_case_sql(low: str, phrases) -> str:
    seen, parts = set(), []
    for p in phrases:
        if p in seen:
            continue
        seen.add(p)
        pat = f"{Q.WB_L}{_re2_quote(p.lower())}{Q.WB_R}"
        parts.append(f"CASE WHEN regexp_matches({low}, '{pat}') THEN '{p.replace(chr(39), chr(39) * 2)}' END")
    return "list_filter([" + ", ".join(parts) + "], lambda x: x IS NOT NULL)"


_REMARKED = Q.remarked(S.REMARKS, S.REMARK_EVERY)


@query("dosage_filter", f"""WITH {_REMARKED},
f AS (SELECT doc_id, lower(title) AS title, lower(body) AS body FROM remarked_posts
      WHERE regexp_matches(lower(body), '{M.dose_regex_sql()}') OR regexp_matches(lower(title), '{M.dose_regex_sql()}')),
m AS (SELECT doc_id, {_phrase_case_sql('title', L.COMPOUNDS_SHORT)} AS th, {_phrase_case_sql('body', L.COMPOUNDS_SHORT)} AS bh FROM f)
SELECT doc_id, array_to_string(CASE WHEN len(th) > 0 THEN th ELSE bh END, '; ') AS keywords
FROM m WHERE len(th) > 0 OR len(bh) > 0""")
def q_dosage_filter(spark, sf):
    out = M.dosage_filter(S.remarked_posts(spark, sf), "title", "body", L.COMPOUNDS_SHORT, L.DOSAGE_PATTERN)
    return out.select("doc_id", F.array_join("keywords", "; ").alias("keywords"))


def _regex_sql_labels(text_sql: str, rules=S.REGEX_LEXICON) -> str:
    items = ", ".join("{'rx': '(?i)%s', 'lab': '%s'}" % (rx.replace("'", "''"), lab.replace("'", "''")) for rx, lab in rules)
    return (f"list_sort(list_distinct(list_transform(list_filter([{items}], "
            f"lambda e: regexp_matches({text_sql}, e.rx)), lambda e: e.lab)))")


@query("regex_label_match", f"""SELECT doc_id, source AS subreddit, array_to_string({_regex_sql_labels('text')}, '; ') AS keyword
FROM documents WHERE len({_regex_sql_labels('text')}) > 0""")
def q_regex_label_match(spark, sf):
    d = S.docs(spark, sf).select("doc_id", F.col("source").alias("subreddit"), "text")
    return M.regex_label_match(d, "text", S.REGEX_LEXICON).select("doc_id", "subreddit", "keyword")


@query("regex_dictionary_match", f"""WITH {_REMARKED},
m AS (SELECT doc_id, {_regex_sql_labels('body', S.REGEX_DICTIONARY)} AS labs FROM remarked_posts)
SELECT doc_id, array_to_string(labs, '; ') AS keyword FROM m WHERE len(labs) > 0""")
def q_regex_dictionary_match(spark, sf):
    """The filtering phrases as regexes, by their required literals."""
    posts = S.remarked_posts(spark, sf).select("doc_id", "body")
    return RX.regex_dictionary_match(posts, "body", S.REGEX_DICTIONARY).select("doc_id", "keyword")



@query("keyword_matrix", f"""SELECT id, kw AS keyword, CAST(contains(lower(text), kw) AS INTEGER) AS present
FROM (SELECT doc_id AS id, text, unnest({Q.LEX[:-1]}, 'The', 'Der']) AS kw FROM documents)""")
def q_keyword_matrix(spark, sf):
    d = S.docs(spark, sf).select(F.col("doc_id").alias("id"), "text")
    return M.keyword_presence_long(d, "id", "text", L.FIXTURE_LEXICON + ["The", "Der"])


@query("compose_text", f"""WITH {Q.POSTS}
SELECT p.id, p.title || ' /// ' || p.selftext AS slash_text,
       coalesce(p.title, '') || ' | ' || coalesce(p.selftext, '') AS pipe_text,
       p.title || chr(10) || chr(10) || p.selftext AS blank_line_text
FROM posts p""")
def q_compose_text(spark, sf):
    p = S.posts(spark, sf)
    return p.select("id",
                    T.compose_text([F.col("title"), F.col("selftext")], " /// ", "null").alias("slash_text"),
                    T.compose_text([F.col("title"), F.col("selftext")], " | ", "empty").alias("pipe_text"),
                    T.compose_text([F.col("title"), F.col("selftext")], "\n\n", "null").alias("blank_line_text"))


@query("keyword_array_parse", f"""WITH {Q.HITS},
enc AS (SELECT id, keywords,
   '[' || array_to_string(list_transform(keywords, lambda k: '''' || k || ''''), ', ') || ']' AS pylist,
   array_to_string(keywords, '; ') AS semi_space,
   upper(array_to_string(keywords, ' ; ')) AS semi,
   array_to_string(keywords, ' ,') AS comma
  FROM hits)
SELECT id, array_to_string(keywords, '|') AS from_pylist, array_to_string(keywords, '|') AS from_semi_space,
       array_to_string(keywords, '|') AS from_semi, array_to_string(keywords, '|') AS from_comma
FROM enc""")
def q_keyword_array_parse(spark, sf):
    h = S.hit_keys(spark, sf)
    enc = h.select(
        "id",
        F.concat(F.lit("["), F.array_join(F.transform("keywords", lambda k: F.concat(F.lit("'"), k, F.lit("'"))), ", "),
                 F.lit("]")).alias("pylist"),
        F.array_join("keywords", "; ").alias("semi_space"),
        F.upper(F.array_join("keywords", " ; ")).alias("semi"),
        F.array_join("keywords", " ,").alias("comma"))
    return enc.select(
        "id",
        F.array_join(T.keyword_array_parse(F.col("pylist"), "pylist"), "|").alias("from_pylist"),
        F.array_join(T.keyword_array_parse(F.col("semi_space"), "semicolon_space"), "|").alias("from_semi_space"),
        F.array_join(T.keyword_array_parse(F.col("semi"), "semicolon"), "|").alias("from_semi"),
        F.array_join(T.keyword_array_parse(F.col("comma"), "comma"), "|").alias("from_comma"))


@query("posts_comments_union", f"""WITH {Q.POSTS}
SELECT id, 'post' AS source, title, selftext, NULL::VARCHAR AS post_id, NULL::VARCHAR AS body FROM posts
UNION ALL
SELECT id, 'comment' AS source, NULL, NULL, post_id, body FROM comments""")
def q_posts_comments_union(spark, sf):
    p = S.posts(spark, sf).select("id", F.lit("post").alias("source"), "title", "selftext")
    c = S.comments(spark, sf).select("id", F.lit("comment").alias("source"), "post_id", "body")
    return p.unionByName(c, allowMissingColumns=True).select("id", "source", "title", "selftext", "post_id", "body")


# ===========================================================================
# keyword statistics
# ===========================================================================

@query("word_counts", f"""WITH {Q.HITS},
ex AS (SELECT subreddit, unnest(keywords) AS keyword FROM hits),
per AS (SELECT subreddit AS source, keyword, count(*) AS freq FROM ex GROUP BY ALL)
SELECT * FROM per
UNION ALL SELECT 'overall', keyword, CAST(sum(freq) AS BIGINT) FROM per GROUP BY keyword""")
def q_word_counts(spark, sf):
    h = S.hit_keys(spark, sf)
    rep = F.concat(F.lit("["), F.array_join(F.transform("keywords", lambda k: F.concat(F.lit("'"), k, F.lit("'"))), ", "),
                   F.lit("]"))
    ex = h.select("subreddit", F.explode(T.keyword_array_parse(rep, "pylist")).alias("keyword"))
    return ST.keyword_counts(ex, "subreddit", "keyword")


_PIVOT_COLS = ", ".join(f"CAST(count(*) FILTER (WHERE keyword = '{k}') AS BIGINT) AS \"{k}\"" for k in L.FIXTURE_LEXICON)


@query("keyword_by_source_pivot", f"""WITH {Q.HITS},
ex AS (SELECT subreddit, unnest(keywords) AS keyword FROM hits)
SELECT subreddit, {_PIVOT_COLS} FROM ex GROUP BY subreddit""")
def q_keyword_by_source_pivot(spark, sf):
    h = S.hit_keys(spark, sf)
    ex = ST.explode_keywords(h.select("subreddit", F.array_join("keywords", "; ").alias("keyword")),
                             "keyword", "semicolon_space")
    return ST.pivot_counts(ex, "subreddit", "keyword", L.FIXTURE_LEXICON)


@query("crosstab_share", f"""WITH {Q.HITS},
ex AS (SELECT subreddit, unnest(keywords) AS keyword FROM hits),
n AS (SELECT subreddit, keyword, count(*) AS n FROM ex GROUP BY ALL)
SELECT subreddit, keyword, n,
       round(n / sum(n) OVER (PARTITION BY subreddit), 9) AS row_share,
       round(n / sum(n) OVER (PARTITION BY keyword), 9) AS col_share
FROM n""")
def q_crosstab_share(spark, sf):
    h = S.hit_keys(spark, sf)
    ex = h.select("subreddit", F.explode("keywords").alias("keyword"))
    return ST.crosstab_share(ex, "subreddit", "keyword")


_CODED_Q = Q.HITS + ",\n" + """coded AS (
  SELECT h.id, h.subreddit, array_to_string(h.keywords, ';') AS keyword, l.quality AS label
  FROM hits h LEFT JOIN labels l ON l.doc_id = h.id)"""


@query("keyword_hit_rate", f"""WITH {_CODED_Q}
SELECT keyword, count(label) AS count, round(avg(label), 9) AS hit_rate
FROM {Q.explode_semicolon('coded', 'id, subreddit, label')} GROUP BY keyword""")
def q_keyword_hit_rate(spark, sf):
    ex = ST.explode_keywords(S.coded_lines(spark, sf), "keyword", "semicolon")
    return ST.hit_rates(ex, "keyword", "label")


@query("source_hit_rate", f"""WITH {_CODED_Q}
SELECT subreddit, count(label) AS count, round(avg(label), 9) AS hit_rate
FROM {Q.explode_semicolon('coded', 'id, subreddit, label')} GROUP BY subreddit""")
def q_source_hit_rate(spark, sf):
    ex = ST.explode_keywords(S.coded_lines(spark, sf), "keyword", "semicolon")
    return ST.hit_rates(ex, "subreddit", "label")


@query("usefulness", f"""WITH {_CODED_Q},
r AS (SELECT keyword, count(label) AS frequency, avg(label) AS hit_rate
      FROM {Q.explode_semicolon('coded', 'id, subreddit, label')} GROUP BY keyword)
SELECT keyword, frequency, round(hit_rate, 9) AS hit_rate,
       round(coalesce(hit_rate, 0) * ln(frequency + 1), 9) AS usefulness FROM r""")
def q_usefulness(spark, sf):
    ex = ST.explode_keywords(S.coded_lines(spark, sf), "keyword", "semicolon")
    r = ex.groupBy("keyword").agg(F.count("label").alias("frequency"), F.avg("label").alias("hit_rate"))
    return ST.usefulness(r, "frequency", "hit_rate", null_as_zero=True).withColumn("hit_rate", F.round("hit_rate", 9))


@query("keyword_label_matrix", f"""WITH {Q.HITS},
lab AS (SELECT h.id, unnest(h.keywords) AS keyword, l.quality AS label FROM hits h JOIN labels l ON l.doc_id = h.id)
SELECT keyword, count(*) FILTER (WHERE label = 0) AS n_0, count(*) FILTER (WHERE label = 1) AS n_1,
       round(count(*) FILTER (WHERE label = 1) / count(*), 9) AS precision
FROM lab WHERE label IS NOT NULL GROUP BY keyword""")
def q_keyword_label_matrix(spark, sf):
    h = S.hit_keys(spark, sf)
    rep = F.concat(F.lit("["), F.array_join(F.transform("keywords", lambda k: F.concat(F.lit("'"), k, F.lit("'"))), ", "),
                   F.lit("]"))
    lab = S.labels(spark, sf).select(F.col("doc_id").alias("id"), F.col("quality").alias("label"))
    flat = h.join(lab, "id").select(F.explode(T.keyword_array_parse(rep, "pylist")).alias("keyword"), "label")
    return ST.label_matrix(flat, "keyword", "label")


@query("frequency_threshold", f"""WITH {Q.HITS},
ex AS (SELECT subreddit, unnest(keywords) AS keyword FROM hits),
n AS (SELECT subreddit, keyword, count(*) AS n FROM ex GROUP BY ALL)
SELECT keyword, CAST(sum(n) AS BIGINT) AS total FROM n GROUP BY keyword HAVING sum(n) >= 50""")
def q_frequency_threshold(spark, sf):
    h = S.hit_keys(spark, sf)
    n = h.select("subreddit", F.explode("keywords").alias("keyword")).groupBy("subreddit", "keyword").count()
    return ST.threshold_table(n, "keyword", "count", 50)


@query("relevant_irrelevant_long", f"""WITH {_CODED_Q},
ex AS {Q.explode_semicolon('coded', 'id, subreddit, label')},
agg AS (SELECT keyword, subreddit, count(label) AS frequency, CAST(coalesce(sum(label), 0) AS BIGINT) AS relevant
        FROM ex GROUP BY keyword, subreddit)
SELECT keyword, subreddit, frequency, 'relevant' AS label, relevant AS count FROM agg
UNION ALL SELECT keyword, subreddit, frequency, 'irrelevant', frequency - relevant FROM agg""")
def q_relevant_irrelevant_long(spark, sf):
    ex = ST.explode_keywords(S.coded_lines(spark, sf), "keyword", "semicolon")
    return ST.relevant_irrelevant_long(ex, ["keyword", "subreddit"], "label")


# ===========================================================================
# agreement
# ===========================================================================

@query("coder_match", f"""WITH {Q.CODERS}
SELECT a.id, a.subreddit, a.label AS label_1, b.label AS label_2
FROM coder_1 a JOIN coder_2 b ON a.id = b.id AND a.subreddit = b.subreddit""")
def q_coder_match(spark, sf):
    return AG.coder_match(S.coder_1(spark, sf), S.coder_2(spark, sf), ["id", "subreddit"])


@query("disagreement_filter", f"""WITH {Q.CODERS}
SELECT a.id, a.subreddit, a.label FROM coder_1 a
WHERE NOT EXISTS (SELECT 1 FROM coder_2 b WHERE b.id = a.id AND b.subreddit = a.subreddit AND b.label <> a.label)""")
def q_disagreement_filter(spark, sf):
    out = AG.without_disagreement(S.coder_1(spark, sf), S.coder_2(spark, sf), ["id", "subreddit"])
    return out.select("id", "subreddit", "label")


@query("cohen_kappa", f"""WITH {Q.CODERS},
m AS (SELECT a.label AS l1, b.label AS l2 FROM coder_1 a JOIN coder_2 b ON a.id = b.id AND a.subreddit = b.subreddit),
labs AS (SELECT l1 AS k FROM m UNION SELECT l2 FROM m),
per AS (SELECT k, (SELECT count(*) FROM m WHERE l1 = k) AS r, (SELECT count(*) FROM m WHERE l2 = k) AS s,
               (SELECT count(*) FROM m WHERE l1 = k AND l2 = k) AS d FROM labs),
t AS (SELECT sum(r) AS n, sum(d) AS agreement, sum(r * s) AS rs FROM per)
SELECT CAST(coalesce(n, 0) AS BIGINT) AS n, CAST(coalesce(agreement, 0) AS BIGINT) AS agreement,
       CASE WHEN n > 0 THEN round(agreement / n, 9) ELSE 0.0 END AS agreement_rate,
       CASE WHEN n > 0 AND rs / (n * n) <> 1 THEN round((agreement / n - rs / (n * n)) / (1 - rs / (n * n)), 9) END AS kappa
FROM t""")
def q_cohen_kappa(spark, sf):
    return AG.cohen_kappa(AG.coder_match(S.coder_1(spark, sf), S.coder_2(spark, sf), ["id", "subreddit"]))


@query("hit_rate_compare", f"""WITH {Q.CODERS},
r1 AS (SELECT keyword, count(label) AS count_1, round(avg(label), 9) AS hit_rate_1
       FROM {Q.explode_semicolon('coder_1', 'id, subreddit, label')} GROUP BY keyword),
r2 AS (SELECT keyword, count(label) AS count_2, round(avg(label), 9) AS hit_rate_2
       FROM {Q.explode_semicolon('coder_2', 'id, subreddit, label')} GROUP BY keyword)
SELECT coalesce(r1.keyword, r2.keyword) AS keyword, coalesce(count_1, 0) AS count_1, coalesce(hit_rate_1, 0) AS hit_rate_1,
       coalesce(count_2, 0) AS count_2, coalesce(hit_rate_2, 0) AS hit_rate_2,
       round(abs(coalesce(hit_rate_1, 0) - coalesce(hit_rate_2, 0)), 9) AS hit_rate_diff
FROM r1 FULL OUTER JOIN r2 ON r1.keyword = r2.keyword""")
def q_hit_rate_compare(spark, sf):
    return AG.hit_rate_compare(S.coder_1(spark, sf), S.coder_2(spark, sf))


@query("shared_keyword_counts", f"""WITH {Q.CODERS},
k1 AS (SELECT DISTINCT id, subreddit, keyword FROM {Q.explode_semicolon('coder_1', 'id, subreddit')}),
k2 AS (SELECT DISTINCT id, subreddit, keyword FROM {Q.explode_semicolon('coder_2', 'id, subreddit')})
SELECT k1.keyword, count(*) AS n_shared FROM k1 JOIN k2 USING (id, subreddit, keyword) GROUP BY k1.keyword""")
def q_shared_keyword_counts(spark, sf):
    return AG.shared_keyword_counts(S.coder_1(spark, sf), S.coder_2(spark, sf), ["id", "subreddit"])


@query("inconsistent_labels", f"""WITH {Q.HITS},
rows AS (SELECT h.id, h.subreddit, kw.keyword,
                CASE WHEN kw.keyword IN ('the', 'der', 'que') THEN l.toxic ELSE l.quality END AS label
         FROM hits h JOIN labels l ON l.doc_id = h.id, (SELECT unnest(h.keywords) AS keyword) kw)
SELECT id, subreddit, count(*) AS n_rows, count(DISTINCT label) AS n_labels,
       array_to_string(list_sort(list(keyword)), ',') AS rows
FROM rows GROUP BY id, subreddit HAVING count(*) > 1 AND count(DISTINCT label) > 1""")
def q_inconsistent_labels(spark, sf):
    h = S.hit_keys(spark, sf)
    lab = S.labels(spark, sf).select(F.col("doc_id").alias("id"), "quality", "toxic")
    rows = h.join(lab, "id").select("id", "subreddit", F.explode("keywords").alias("keyword"), "quality", "toxic")
    rows = rows.withColumn("label", F.when(F.col("keyword").isin("the", "der", "que"), F.col("toxic"))
                           .otherwise(F.col("quality")))
    return AG.inconsistent_labels(rows, ["id", "subreddit"], "label", "keyword")


# ===========================================================================
# evaluation
# ===========================================================================

@query("gold_eval", f"""WITH {Q.PREDS}, {Q.GOLD},
j AS (SELECT p.model, p.relevance AS relevance_pred, g.relevance_true FROM preds p JOIN gold g ON g.id = p.id
      WHERE lower(p.model) NOT IN ('logreg', 'svm', 'xgboost') OR g.is_test = 1),
a AS (SELECT model, count(*) AS n_eval, count(*) FILTER (WHERE relevance_pred = 1 AND relevance_true = 1) AS tp,
             count(*) FILTER (WHERE relevance_pred = 1) AS pred_pos, count(*) FILTER (WHERE relevance_true = 1) AS actual_pos,
             count(*) FILTER (WHERE relevance_pred = relevance_true) AS correct FROM j GROUP BY model),
b AS (SELECT *, CASE WHEN pred_pos <> 0 THEN tp / pred_pos ELSE 0.0 END AS p,
             CASE WHEN actual_pos <> 0 THEN tp / actual_pos ELSE 0.0 END AS r FROM a)
SELECT model, n_eval, tp, pred_pos, actual_pos, correct, round(p, 9) AS precision, round(r, 9) AS recall,
       round(CASE WHEN p + r <> 0 THEN 2 * p * r / (p + r) ELSE 0.0 END, 9) AS f1 FROM b""")
def q_gold_eval(spark, sf):
    p = S.predictions(spark, sf).select("id", "model", F.col("relevance").alias("relevance_pred"))
    return EV.gold_eval(p, S.gold(spark, sf))


@query("confusion_matrix", f"""WITH {Q.PREDS}, {Q.GOLD},
j AS (SELECT p.model, p.relevance AS pred, g.relevance_true AS tru FROM preds p JOIN gold g ON g.id = p.id),
cells AS (SELECT t.t AS true_label, q.p AS pred_label FROM (VALUES (0), (1)) t(t), (VALUES (0), (1)) q(p)),
models AS (SELECT DISTINCT model FROM j)
SELECT m.model, c.true_label, c.pred_label,
       (SELECT count(*) FROM j WHERE j.model = m.model AND j.tru = c.true_label AND j.pred = c.pred_label) AS count
FROM models m, cells c""")
def q_confusion_matrix(spark, sf):
    p = S.predictions(spark, sf).select("id", "model", "relevance")
    j = p.join(S.gold(spark, sf), "id")
    return EV.confusion_matrix(j, "relevance_true", "relevance", ["model"])


@query("class_report", f"""WITH {Q.PREDS}, {Q.GOLD},
j AS (SELECT p.model, p.relevance AS pred, g.relevance_true AS tru FROM preds p JOIN gold g ON g.id = p.id),
c AS (SELECT model, k.c AS cls, count(*) FILTER (WHERE pred = k.c AND tru = k.c) AS tp,
             count(*) FILTER (WHERE pred = k.c) AS pp, count(*) FILTER (WHERE tru = k.c) AS support
      FROM j, (VALUES (0), (1)) k(c) GROUP BY model, k.c),
per AS (SELECT model, CAST(cls AS VARCHAR) AS class,
               CASE WHEN pp <> 0 THEN tp / pp ELSE 0.0 END AS precision,
               CASE WHEN support <> 0 THEN tp / support ELSE 0.0 END AS recall, support FROM c),
per2 AS (SELECT *, CASE WHEN precision + recall <> 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1 FROM per),
av AS (SELECT model, avg(precision) AS mp, avg(recall) AS mr, avg(f1) AS mf, sum(precision * support) AS wp,
              sum(recall * support) AS wr, sum(f1 * support) AS wf, sum(support) AS n FROM per2 GROUP BY model),
allr AS (
  SELECT model, class, precision, recall, f1, support FROM per2
  UNION ALL SELECT model, 'macro avg', mp, mr, mf, n FROM av
  UNION ALL SELECT model, 'weighted avg', CASE WHEN n <> 0 THEN wp / n ELSE 0.0 END,
                   CASE WHEN n <> 0 THEN wr / n ELSE 0.0 END, CASE WHEN n <> 0 THEN wf / n ELSE 0.0 END, n FROM av)
SELECT model, class, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1,
       CAST(support AS BIGINT) AS support FROM allr""")
def q_class_report(spark, sf):
    p = S.predictions(spark, sf).select("id", "model", "relevance")
    j = p.join(S.gold(spark, sf), "id")
    return EV.class_report(j, "relevance_true", "relevance", ["model"])


_THRESH = dict(min_kw_freq=5, min_kw_hit=0.3, min_kw_score=0.0, min_sub_freq=10, min_sub_hit=0.2, min_sub_score=1.0)

_THRESH_SQL = f"""WITH {Q.PREDS}, {Q.GOLD},
base AS (SELECT * FROM preds WHERE model = 'gpt_zero_shot' AND subset IS DISTINCT FROM 'random_kfails'),
kws AS {Q.explode_comma('base', 'id, subreddit, relevance')},
subs AS (SELECT subreddit, count(relevance) AS f, avg(relevance) AS h FROM kws WHERE subreddit IS NOT NULL GROUP BY subreddit),
keep_subs AS (SELECT subreddit FROM subs WHERE f >= 10 AND h >= 0.2 AND round(h * ln(f + 1), 12) >= 1.0),
kws_sub AS (SELECT * FROM kws WHERE subreddit IN (SELECT subreddit FROM keep_subs)),
kw AS (SELECT keyword, count(relevance) AS f, avg(relevance) AS h FROM kws_sub GROUP BY keyword),
keep_kw AS (SELECT keyword FROM kw WHERE f >= 5 AND h >= 0.3 AND round(h * ln(f + 1), 12) >= 0.0),
ids AS (SELECT DISTINCT id FROM kws_sub WHERE keyword IN (SELECT keyword FROM keep_kw)),
marked AS (SELECT b.id, b.ord, i.id IS NOT NULL AS inc, CASE WHEN i.id IS NOT NULL THEN b.relevance ELSE 0 END AS pred
           FROM base b LEFT JOIN ids i ON i.id = b.id),
first AS (SELECT id, arg_min(pred, (NOT inc, ord)) AS relevance_pred FROM marked GROUP BY id),
j AS (SELECT f.relevance_pred, g.relevance_true FROM first f JOIN gold g ON g.id = f.id),
m AS (SELECT count(*) AS n_eval, count(*) FILTER (WHERE relevance_pred = 1 AND relevance_true = 1) AS tp,
             count(*) FILTER (WHERE relevance_pred = 1) AS pred_pos, count(*) FILTER (WHERE relevance_true = 1) AS actual_pos,
             count(*) FILTER (WHERE relevance_pred = relevance_true) AS correct,
             (SELECT count(*) FROM first) AS total,
             (SELECT CAST(coalesce(sum(relevance_pred), 0) AS BIGINT) FROM first) AS predicted_relevant FROM j),
b AS (SELECT *, CASE WHEN pred_pos <> 0 THEN tp / pred_pos ELSE 0.0 END AS p,
             CASE WHEN actual_pos <> 0 THEN tp / actual_pos ELSE 0.0 END AS r FROM m)
SELECT n_eval, tp, pred_pos, actual_pos, correct, total, predicted_relevant,
       round(p, 9) AS precision, round(r, 9) AS recall,
       round(CASE WHEN p + r <> 0 THEN 2 * p * r / (p + r) ELSE 0.0 END, 9) AS f1 FROM b"""


@query("threshold_filter_eval", _THRESH_SQL)
def q_threshold_filter_eval(spark, sf):
    return EV.threshold_filter_eval(S.predictions(spark, sf), S.gold(spark, sf), "gpt_zero_shot", **_THRESH)


@query("threshold_filter_drop", _THRESH_SQL.replace(
    "FROM base b LEFT JOIN ids i ON i.id = b.id)", "FROM base b JOIN ids i ON i.id = b.id)"))
def q_threshold_filter_drop(spark, sf):
    """The threshold filter with the ids it leaves out dropped instead of counted as 0."""
    return EV.threshold_filter_eval(S.predictions(spark, sf), S.gold(spark, sf), "gpt_zero_shot", excluded="drop", **_THRESH)


@query("self_gold_eval", f"""WITH {Q.PREDS},
base AS (SELECT * FROM preds WHERE model = 'gpt_zero_shot'),
kws AS {Q.explode_comma('base', 'id, relevance')},
keep AS (SELECT keyword FROM kws GROUP BY keyword HAVING count(relevance) >= 5 AND avg(relevance) >= 0.3),
m AS (SELECT count(*) FILTER (WHERE k) AS total, coalesce(sum(relevance) FILTER (WHERE k), 0)::BIGINT AS relevant,
             coalesce(sum(relevance), 0)::BIGINT AS all_relevant FROM (SELECT *, keyword IN (SELECT keyword FROM keep) AS k FROM kws)),
b AS (SELECT *, CASE WHEN total <> 0 THEN relevant / total ELSE 0.0 END AS p,
             CASE WHEN all_relevant <> 0 THEN relevant / all_relevant ELSE 0.0 END AS r FROM m)
SELECT total, relevant, all_relevant, round(p, 9) AS precision, round(r, 9) AS recall,
       round(CASE WHEN p + r <> 0 THEN 2 * p * r / (p + r) ELSE 0.0 END, 9) AS f1 FROM b""")
def q_self_gold_eval(spark, sf):
    """Keyword filter scored by the predictions themselves."""
    kws = ST.explode_keywords(S.predictions(spark, sf).filter(F.col("model") == "gpt_zero_shot").select("id", "keyword", "relevance"),
                              "keyword", "comma")
    rates = kws.groupBy("keyword").agg(F.count("relevance").alias("n"), F.avg("relevance").alias("h"))
    keep = rates.filter((F.col("n") >= 5) & (F.col("h") >= 0.3)).select("keyword")
    return EV.self_metrics(kws, kws.join(keep, "keyword", "left_semi"))


@query("model_disagreement", f"""WITH {Q.PREDS},
c AS (SELECT id, relevance, count(*) AS n FROM preds GROUP BY id, relevance),
mo AS (SELECT id, arg_min(relevance, (-n, relevance)) AS mode_label FROM c WHERE relevance IS NOT NULL GROUP BY id),
x AS (SELECT p.id, mo.mode_label, count(*) FILTER (WHERE p.relevance IS DISTINCT FROM mo.mode_label) AS disagreeing_models,
             count(p.relevance) AS total_models FROM preds p JOIN mo ON mo.id = p.id GROUP BY p.id, mo.mode_label)
SELECT id, mode_label, disagreeing_models, total_models, round(disagreeing_models / total_models, 9) AS disagreement_ratio
FROM x""")
def q_model_disagreement(spark, sf):
    return EV.model_disagreement(S.predictions(spark, sf), "id", "relevance")


def _fulltext(spark, sf) -> DataFrame:
    p = S.predictions(spark, sf)
    g = S.gold(spark, sf)
    j = p.join(g, "id").join(S.docs(spark, sf).select(F.col("doc_id").alias("id"), "text"), "id")
    pr, gl = F.col("relevance"), F.col("relevance_true")
    return j.select("id", "model", pr.alias("predicted_label"), gl.alias("gold_label"), "confidence",
                    (F.col("confidence") < 0.65).cast("int").alias("low_confidence"), "text",
                    ((pr == 1) & (gl == 1)).alias("true_positive"), ((pr == 1) & (gl == 0)).alias("false_positive"),
                    ((pr == 0) & (gl == 1)).alias("false_negative"), ((pr == 0) & (gl == 0)).alias("true_negative"))


@query("example_rows", f"""WITH {Q.PREDS}, {Q.GOLD},
ft AS (SELECT p.id, p.model, p.relevance AS predicted_label, g.relevance_true AS gold_label, p.confidence,
              CAST(p.confidence < 0.65 AS INTEGER) AS low_confidence, p.text
       FROM preds p JOIN gold g ON g.id = p.id),
c AS (SELECT id, predicted_label, count(*) AS n FROM ft GROUP BY ALL),
mo AS (SELECT id, arg_min(predicted_label, (-n, predicted_label)) AS mode_label FROM c WHERE predicted_label IS NOT NULL GROUP BY id),
dr AS (SELECT f.id, count(*) FILTER (WHERE f.predicted_label IS DISTINCT FROM mo.mode_label) / count(f.predicted_label) AS ratio
       FROM ft f JOIN mo ON mo.id = f.id GROUP BY f.id),
d AS (SELECT f.*, dr.ratio,
             CASE WHEN predicted_label = 1 AND gold_label = 1 THEN 'true_positive'
                  WHEN predicted_label = 1 AND gold_label = 0 THEN 'false_positive'
                  WHEN predicted_label = 0 AND gold_label = 1 THEN 'false_negative'
                  WHEN predicted_label = 0 AND gold_label = 0 THEN 'true_negative' END AS base_cat
      FROM ft f LEFT JOIN dr ON dr.id = f.id WHERE predicted_label IS NOT NULL AND gold_label IS NOT NULL),
c1 AS (SELECT *, 'controversial' AS category, row_number() OVER (PARTITION BY model ORDER BY id) AS rownum
       FROM d WHERE ratio > 0.5 AND predicted_label <> gold_label),
c2 AS (SELECT *, 'low_confidence' AS category, row_number() OVER (PARTITION BY model ORDER BY id) AS rownum
       FROM d WHERE low_confidence = 1),
c3 AS (SELECT *, base_cat AS category, row_number() OVER (PARTITION BY model, base_cat ORDER BY id) AS rownum
       FROM d WHERE base_cat IS NOT NULL)
SELECT model, id, predicted_label, confidence, gold_label, text, category, low_confidence, rownum FROM c1 WHERE rownum <= 10
UNION ALL SELECT model, id, predicted_label, confidence, gold_label, text, category, low_confidence, rownum FROM c2 WHERE rownum <= 10
UNION ALL SELECT model, id, predicted_label, confidence, gold_label, text, category, low_confidence, rownum FROM c3 WHERE rownum <= 10""")
def q_example_rows(spark, sf):
    return EV.example_rows(_fulltext(spark, sf), 10, "id")


@query("confidence_bin", f"""WITH {Q.PREDS}
SELECT id, model,
       CASE WHEN subreddit = 'src3' THEN 'n/a'
            WHEN confidence >= 0.85 THEN 'High' WHEN confidence >= 0.65 THEN 'Medium' ELSE 'Low' END AS bin,
       CASE WHEN subreddit = 'src3' THEN 'n/a'
            WHEN confidence >= 0.85 THEN 'High' WHEN confidence >= 0.5 THEN 'Medium' ELSE 'Low' END AS bin_old
FROM preds""")
def q_confidence_bin(spark, sf):
    p = S.predictions(spark, sf)
    raw = F.when(F.col("subreddit") == "src3", F.lit("n/a")).otherwise(F.format_string("%.17g", "confidence"))
    return p.select("id", "model", T.confidence_bin(raw).alias("bin"),
                    T.confidence_bin(raw, L.CONF_MEDIUM_OLD, L.CONF_HIGH).alias("bin_old"))


@query("priority_score", f"""WITH {Q.PREDS},
d AS (SELECT id, subreddit, keyword, relevance,
             CASE WHEN model IN ('gpt_zero_shot', 'gpt_few_shot') THEN 0.5 + 0.5 * confidence ELSE confidence END AS confidence
      FROM preds WHERE subset IS DISTINCT FROM 'gold_label' AND model IS DISTINCT FROM 'xgboost'),
ex AS {Q.explode_comma('d', 'id, subreddit, relevance, confidence')},
g AS (SELECT id, subreddit, keyword, count(*) FILTER (WHERE relevance = 1) AS ones, count(relevance) AS n,
             avg(confidence) AS a FROM ex GROUP BY ALL),
s AS (SELECT *, CASE WHEN n > 0 THEN ones / n ELSE 0.0 END AS p FROM g),
u AS (SELECT *, CAST(p >= 0.3 AND p <= 0.7 AS INTEGER) AS dis,
             CASE WHEN a IS NULL THEN 0.0 WHEN a >= 0.5 AND a < 0.65 THEN 0.5 WHEN a >= 0.65 AND a < 0.75 THEN 1.0 ELSE 0.0 END AS unc
      FROM s)
SELECT id, subreddit, keyword, round(dis + unc, 9) AS priority_score, dis AS disagreement, unc AS uncertainty,
       round(a, 9) AS avg_conf, round(p, 9) AS relevance_split FROM u""")
def q_priority_score(spark, sf):
    return EV.priority_score(S.predictions(spark, sf))


@query("labelling_progress", f"""WITH {Q.HITS},
x AS (SELECT h.id, l.quality AS label FROM hits h LEFT JOIN labels l ON l.doc_id = h.id)
SELECT count(label) AS labelled, count(*) AS total, round(count(label) / count(*), 9) AS share,
       min(id) FILTER (WHERE label IS NULL) AS first_unlabelled FROM x""")
def q_labelling_progress(spark, sf):
    return EV.labelling_progress(S.coded_lines(spark, sf), "label", "id")


# ===========================================================================
# sampling
# ===========================================================================

@query("sample_per_file", f"""WITH {Q.HITS},
r AS (SELECT id, subreddit, row_number() OVER (PARTITION BY subreddit ORDER BY md5('42|' || CAST(id AS VARCHAR)), id) AS rn
      FROM hits)
SELECT id, subreddit AS source_file FROM r WHERE rn <= 7""")
def q_sample_per_file(spark, sf):
    h = S.hit_keys(spark, sf).select("id", "subreddit")
    return SA.sample_per_group(h, "subreddit", "id", 7, 42).select("id", "source_file")


@query("split_train_test", f"""WITH
r AS (SELECT doc_id AS id, quality AS label,
             row_number() OVER (PARTITION BY quality ORDER BY md5('42|' || CAST(doc_id AS VARCHAR)), doc_id) AS rn,
             count(*) OVER (PARTITION BY quality) AS n FROM labels)
SELECT id, label, CAST(rn <= ceil(0.2::DOUBLE * n) AS INTEGER) AS is_test FROM r""")
def q_split_train_test(spark, sf):
    lab = S.labels(spark, sf).select(F.col("doc_id").alias("id"), F.col("quality").alias("label"))
    return SA.split_train_test(lab, "id", "label", 0.2, 42).select("id", "label", "is_test")


# the fixed rare list, and words of the stand-in lexicon so that rows qualify
_RARE = ["she", "une", "los", "mit"] + L.INSUFFICIENT_SAMPLE


@query("rare_keyword_sample", f"""WITH {Q.HITS},
q AS (SELECT id, subreddit, keywords FROM hits WHERE len(list_intersect(keywords, {Q.text_list(_RARE)})) > 0),
pf AS (SELECT subreddit, count(*) AS qn FROM q GROUP BY subreddit),
fs AS (SELECT subreddit, coalesce(sum(qn) OVER (ORDER BY subreddit ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
       FROM pf)
SELECT q.id, q.subreddit AS source_file, array_to_string(q.keywords, '; ') AS keywords
FROM q WHERE subreddit IN (SELECT subreddit FROM fs WHERE before < 370)""")
def q_rare_keyword_sample(spark, sf):
    h = S.hit_keys(spark, sf).select("id", "subreddit", "keywords")
    out = SA.rare_keyword_sample(h, "subreddit", "keywords", _RARE, L.RARE_SAMPLE_ROWS)
    return out.select("id", F.col("subreddit").alias("source_file"), F.array_join("keywords", "; ").alias("keywords"))


@query("unsampled_keywords", f"""WITH {Q.HITS},
r AS (SELECT id, subreddit, keywords, row_number() OVER (PARTITION BY subreddit ORDER BY md5('42|' || CAST(id AS VARCHAR)), id) AS rn
      FROM hits),
s AS (SELECT DISTINCT unnest(keywords) AS keyword FROM r WHERE rn <= 1),
lex AS (SELECT unnest({Q.LEX}) AS keyword)
SELECT keyword FROM lex WHERE keyword NOT IN (SELECT keyword FROM s)""")
def q_unsampled_keywords(spark, sf):
    h = S.hit_keys(spark, sf).select("id", "subreddit", "keywords")
    sample = SA.sample_per_group(h, "subreddit", "id", 1, 42)
    skw = sample.select(F.explode("keywords").alias("keyword"))
    return SA.unsampled_keywords(L.lexicon_df(spark, "fixture"), skw)


@query("uncertain_top_k", f"""WITH {Q.PREDS},
pool AS (SELECT id, text, confidence FROM preds WHERE model = 'logreg'),
firsts AS (SELECT text, min(id) AS id FROM pool GROUP BY text),
p AS (SELECT f.id, f.text, pool.confidence FROM firsts f JOIN pool ON pool.id = f.id AND pool.text = f.text),
rest AS (SELECT * FROM p WHERE text NOT IN (SELECT h.text FROM hits_all h JOIN labels l ON l.doc_id = h.id))
SELECT id, text, confidence, round(1 - greatest(confidence, 1 - confidence), 9) AS uncertainty
FROM rest ORDER BY uncertainty DESC, id LIMIT 100""")
def q_uncertain_top_k(spark, sf):
    p = S.predictions(spark, sf).filter(F.col("model") == "logreg").select("id", "confidence")
    pool = S.docs(spark, sf).select(F.col("doc_id").alias("id"), "text").join(p, "id")
    known = S.docs(spark, sf).select(F.col("doc_id").alias("id"), "text").join(
        S.labels(spark, sf).select(F.col("doc_id").alias("id")), "id", "left_semi").select("text")
    return SA.uncertain_top_k(pool, known, "id", "text", "confidence", 100)


def entry_flagship(spark: SparkSession, sf: str) -> DataFrame:
    return q_keyword_match(spark, sf)


# ===========================================================================
# thread sheets, subsets, lookups, resume, upsert
# ===========================================================================

from ..operators import parsing as PA  # noqa: E402
from ..operators import spans as SP  # noqa: E402
from ..operators import subsets as SU  # noqa: E402
from ..operators import threads as TH  # noqa: E402

_STRIP_SQL = r"regexp_replace({x}, '^[ \t\n\r\f\v]+|[ \t\n\r\f\v]+$', '', 'g')"


def _strip(x: str) -> str:
    return _STRIP_SQL.format(x=x)


@query("match_by_row", f"""WITH {Q.SHEET},
cells AS (
  SELECT file, row, 'title' AS col, CAST(post_id AS VARCHAR) AS id_key, title AS text FROM sheet
  UNION ALL SELECT file, row, 'post_text', CAST(post_id AS VARCHAR), post_text FROM sheet
  UNION ALL SELECT file, row, 'comment_body', CAST(comment_id AS VARCHAR), comment_body FROM sheet
  UNION ALL SELECT file, row, 'reply_body', CAST(reply_id AS VARCHAR), reply_body FROM sheet),
m AS (SELECT *, {_regex_sql_labels('text')} AS labs FROM cells WHERE text IS NOT NULL),
m2 AS (SELECT *, row_number() OVER (PARTITION BY col, id_key ORDER BY file, row) AS rn FROM m WHERE len(labs) > 0),
kept AS (SELECT * FROM m2 WHERE id_key IS NULL OR rn = 1),
per AS (SELECT file, row, array_to_string(list_sort(list_distinct(flatten(list(labs)))), '; ') AS keyword
        FROM kept GROUP BY file, row)
SELECT s.file, s.row, s.post_id, s.comment_id, s.reply_id, per.keyword FROM sheet s JOIN per USING (file, row)""")
def q_match_by_row(spark, sf):
    out = TH.match_by_row(S.thread_sheet(spark, sf), S.REGEX_LEXICON)
    return out.select("file", "row", "post_id", "comment_id", "reply_id", "keyword")


@query("match_by_textid", f"""WITH {Q.SHEET},
units AS (
  SELECT file, row, 'post' AS source, 0 AS ci, CAST(post_id AS VARCHAR) AS id, {_strip("concat_ws(' ', title, post_text)")} AS text FROM sheet
  UNION ALL SELECT file, row, 'comment', 1, CAST(comment_id AS VARCHAR), {_strip('comment_body')} FROM sheet
  UNION ALL SELECT file, row, 'comment', 2, CAST(reply_id AS VARCHAR), {_strip('reply_body')} FROM sheet),
u AS (SELECT * FROM units WHERE id IS NOT NULL AND text IS NOT NULL AND text <> ''),
f AS (SELECT source, id, arg_min(text, (file, row, ci)) AS text, arg_min(file, (file, row, ci)) AS subreddit
      FROM u GROUP BY source, id),
l AS (SELECT *, {_regex_sql_labels('text')} AS labs FROM f)
SELECT id, source, subreddit, text, array_to_string(labs, '; ') AS keyword FROM l WHERE len(labs) > 0""")
def q_match_by_textid(spark, sf):
    return TH.match_by_textid(S.thread_sheet(spark, sf), S.REGEX_LEXICON)


@query("compile_relevant", f"""WITH {Q.PREDS}
SELECT id, model, relevance FROM preds WHERE relevance = 1""")
def q_compile_relevant(spark, sf):
    p = S.predictions(spark, sf)
    frames = [p.filter(F.col("model") == m).select("id", "model", "relevance") for m in S.MODELS]
    frames.append(S.hit_keys(spark, sf).select("id", "subreddit"))  # no relevance column: skipped
    return SU.compile_relevant(frames).select("id", "model", "relevance")


@query("upsert_predictions", f"""WITH {Q.PREDS},
u AS (SELECT id, model, 'v1' AS version, relevance AS label, confidence, 1 AS batch FROM preds
      UNION ALL
      SELECT id, model, 'v1', 1 - relevance, confidence, 2 FROM preds WHERE subreddit IN ('src1', 'src2')),
r AS (SELECT *, row_number() OVER (PARTITION BY id, model, version ORDER BY batch DESC) AS rn FROM u)
SELECT id, model, version, label, confidence, batch FROM r WHERE rn = 1""")
def q_upsert_predictions(spark, sf):
    p = S.predictions(spark, sf)
    old = p.select("id", "model", F.lit("v1").alias("version"), F.col("relevance").alias("label"), "confidence",
                   F.lit(1).alias("batch"))
    new = p.filter(F.col("subreddit").isin("src1", "src2")).select(
        "id", "model", F.lit("v1").alias("version"), (1 - F.col("relevance")).alias("label"), "confidence",
        F.lit(2).alias("batch"))
    return SU.upsert(old, new, ["id", "model", "version"], "batch")


@query("prediction_table", f"""WITH {Q.PREDS},
u AS (SELECT id, model, relevance AS label, confidence, 1 AS batch FROM preds WHERE subreddit <> 'src3'
      UNION ALL SELECT id, model, 1 - relevance, confidence, 2 FROM preds WHERE subreddit IN ('src1', 'src2')
      UNION ALL SELECT id, model, 9, confidence, 3 FROM preds WHERE subreddit IN ('src2', 'src3')),
r AS (SELECT *, row_number() OVER (PARTITION BY id, model ORDER BY CASE batch WHEN 2 THEN 0 ELSE batch END) AS rn FROM u)
SELECT id, model, label, confidence, batch FROM r WHERE rn = 1""")
def q_prediction_table(spark, sf):
    """Predictions kept in a keyed table: written, replaced by a second batch,
    completed by a third that leaves known keys alone, and read back."""
    p = S.predictions(spark, sf)

    def rows(label, batch, *sources):
        return p.where(F.col("subreddit").isin(*sources) if sources else F.col("subreddit") != "src3").select(
            "id", "model", label.alias("label"), "confidence", F.lit(batch).alias("batch"))

    first = rows(F.col("relevance"), 1)
    KeyedTable.create(spark, root := checkpoint_path(spark, f"predictions-{uuid.uuid4().hex}"), first.schema, ["id", "model"], 16)
    KeyedTable.open(spark, root).upsert(first, "batch")
    KeyedTable.open(spark, root).upsert(rows(1 - F.col("relevance"), 2, "src1", "src2"), "batch")
    KeyedTable.open(spark, root).insert_new(rows(F.lit(9), 3, "src2", "src3"), "batch")
    return KeyedTable.open(spark, root).read()


_SUBSET_BASE = f"""{Q.POSTS},
km AS (SELECT id FROM posts WHERE len({Q.match_list("title || ' ' || selftext")}) > 0
       UNION ALL SELECT id FROM comments WHERE len({Q.match_list('body')}) > 0),
cat_comments AS (SELECT c.id FROM comments c JOIN posts p ON c.post_id = p.id WHERE p.category = 'user'),
matched AS (SELECT DISTINCT km.id FROM km LEFT JOIN posts p ON km.id = p.id LEFT JOIN comments c ON km.id = c.id
            LEFT JOIN posts pp ON c.post_id = pp.id WHERE p.category = 'user' OR pp.category = 'user'),
gold AS (SELECT DISTINCT 'p' || CAST(doc_id AS VARCHAR) AS id FROM labels)"""


def _posts_comments_matches(spark, sf):
    posts, comments = S.posts(spark, sf), S.comments(spark, sf)
    pm = M.keyword_match(posts.select("id", F.concat_ws(" ", "title", "selftext").alias("t")), "t", L.FIXTURE_LEXICON)
    cm = M.keyword_match(comments.select("id", "body"), "body", L.FIXTURE_LEXICON)
    return posts, comments, pm.select("id").unionByName(cm.select("id"))


@query("comments_in_category", f"""WITH {_SUBSET_BASE} SELECT id FROM cat_comments""")
def q_comments_in_category(spark, sf):
    return SU.comments_in_category(S.comments(spark, sf), S.posts(spark, sf), "user")


@query("matched_in_category", f"""WITH {_SUBSET_BASE} SELECT id FROM matched""")
def q_matched_in_category(spark, sf):
    posts, comments, km = _posts_comments_matches(spark, sf)
    return SU.matched_in_category(km, posts, comments, "user")


@query("build_subsets", f"""WITH {_SUBSET_BASE},
all_ids AS (SELECT id FROM posts WHERE category = 'user' UNION SELECT id FROM cat_comments),
fails AS (SELECT id FROM all_ids EXCEPT SELECT id FROM matched),
rf AS (SELECT id FROM fails ORDER BY md5('kfails|' || id), id LIMIT {L.NUM_RANDOM_KFAILS}),
ann AS (SELECT id FROM posts WHERE category = 'system'),
elig AS ((SELECT id FROM matched EXCEPT SELECT id FROM gold) EXCEPT SELECT id FROM ann),
llm AS (SELECT id FROM gold
        UNION SELECT id FROM (SELECT id FROM rf ORDER BY md5('llm_fails|' || id), id LIMIT {L.NUM_KFAILS_FOR_GPT})
        UNION SELECT id FROM ann
        UNION SELECT id FROM (SELECT id FROM elig ORDER BY md5('llm_passed|' || id), id LIMIT {L.NUM_PASSED_FOR_GPT}))
SELECT id, 'gold_label' AS subset, '2025-01-01' AS date_created FROM gold
UNION SELECT id, 'random_kfails', '2025-01-01' FROM rf
UNION SELECT id, 'gpt_random_set', '2025-01-01' FROM llm""")
def q_build_subsets(spark, sf):
    posts, comments, km = _posts_comments_matches(spark, sf)
    gold_ids = S.labels(spark, sf).select(F.concat(F.lit("p"), F.col("doc_id").cast("string")).alias("id"))
    ann = posts.filter(F.col("category") == "system").select("id")
    return SU.build_subsets(posts, comments, km, gold_ids, ann, "user", "2025-01-01")


@query("text_lookup", f"""WITH {_SUBSET_BASE},
ids AS (SELECT id FROM km UNION SELECT id FROM gold)
SELECT i.id,
       coalesce(CASE WHEN p.id IS NOT NULL THEN coalesce(p.title, '') || chr(10) || chr(10) || coalesce(p.selftext, '') END,
                c.body, '') AS text,
       CASE WHEN p.id IS NOT NULL THEN 'post' WHEN c.id IS NOT NULL THEN 'comment' END AS source_type
FROM ids i LEFT JOIN posts p ON p.id = i.id LEFT JOIN comments c ON c.id = i.id""")
def q_text_lookup(spark, sf):
    posts, comments, km = _posts_comments_matches(spark, sf)
    gold_ids = S.labels(spark, sf).select(F.concat(F.lit("p"), F.col("doc_id").cast("string")).alias("id"))
    ids = km.unionByName(gold_ids).distinct()
    return SU.text_lookup(ids, posts, comments)


@query("resume_pending", f"""WITH {Q.HITS}
SELECT id, subreddit FROM hits WHERE id NOT IN (SELECT doc_id FROM labels)""")
def q_resume_pending(spark, sf):
    done = S.labels(spark, sf).select(F.col("doc_id").alias("id"))
    return SU.pending(S.hit_keys(spark, sf).select("id", "subreddit"), done)


# ===========================================================================
# answers, prompts, claims
# ===========================================================================

_ANSWER_SQL = r"""CASE doc_id % 5 WHEN 0 THEN ' 1 ' WHEN 1 THEN '2' WHEN 2 THEN '0' || chr(10) WHEN 3 THEN '3' ELSE 'maybe' END"""


def _answers(spark, sf):
    d = S.docs(spark, sf)
    a = (F.when(F.col("doc_id") % 5 == 0, " 1 ").when(F.col("doc_id") % 5 == 1, "2")
         .when(F.col("doc_id") % 5 == 2, "0\n").when(F.col("doc_id") % 5 == 3, "3").otherwise("maybe"))
    return d.select("doc_id", a.alias("answer"))


@query("parse_score", f"""WITH a AS (SELECT doc_id, {_ANSWER_SQL} AS answer FROM documents),
s AS (SELECT doc_id, {_strip('answer')} AS v FROM a)
SELECT doc_id,
       CASE WHEN regexp_matches(v, '^[+-]?[0-9]{{1,9}}$') AND CAST(v AS INTEGER) IN (0, 1, 2) THEN CAST(v AS INTEGER) END AS score,
       CASE WHEN v IN ('0', '1') THEN v ELSE '' END AS relevance
FROM s""")
def q_parse_score(spark, sf):
    a = _answers(spark, sf)
    return a.select("doc_id", T.parse_score(F.col("answer")).alias("score"),
                    T.parse_text_label(F.col("answer")).alias("relevance"))


_BLOCK_SQL = """'Label: ' || CAST(quality AS VARCHAR) || chr(10) || 'Confidence: ' ||
  CASE WHEN toxic = 1 THEN 'Low' ELSE 'High' END || chr(10) || 'Reasoning: ' ||
  CASE WHEN toxic = 1 THEN 'the label is unclear' ELSE 'clear case' END"""


def _after(x: str) -> str:
    inner = f"CASE WHEN strpos({x}, ':') > 0 THEN substr({x}, strpos({x}, ':') + 1) ELSE {x} END"
    return f"coalesce({_strip(inner)}, '')"


@query("parse_label_block", f"""WITH a AS (SELECT doc_id, string_split({_strip(_BLOCK_SQL)}, chr(10)) AS lines FROM labels),
p AS (SELECT doc_id,
        list_filter(lines, lambda l: contains(lower(l), 'label'))[-1] AS lab,
        list_filter(lines, lambda l: NOT contains(lower(l), 'label') AND contains(lower(l), 'confidence'))[-1] AS conf,
        list_filter(lines, lambda l: NOT contains(lower(l), 'label') AND NOT contains(lower(l), 'confidence')
                                     AND contains(lower(l), 'reasoning'))[-1] AS rea
      FROM a)
SELECT doc_id, {_after('lab')} AS label, {_after('conf')} AS confidence, {_after('rea')} AS reasoning FROM p""")
def q_parse_label_block(spark, sf):
    lab = S.labels(spark, sf)
    ans = F.concat(F.lit("Label: "), F.col("quality").cast("string"), F.lit("\nConfidence: "),
                   F.when(F.col("toxic") == 1, "Low").otherwise("High"), F.lit("\nReasoning: "),
                   F.when(F.col("toxic") == 1, "the label is unclear").otherwise("clear case"))
    p = lab.select("doc_id", T.parse_label_block(ans).alias("_p"))
    return p.select("doc_id", "_p.label", "_p.confidence", "_p.reasoning")


_CLAIM_COMPOUNDS = ["CBD", "THC", "CBN", "delta-8", "Unspecified"]
_CLAIM_SYMPTOMS = ["sleep", "pain", "anxiety", "other"]


def _sql_list(xs) -> str:
    return "[" + ", ".join(f"'{x}'" for x in xs) + "]"


_CLAIM_PARTS_SQL = f"""{_sql_list(L.DOSE_BINS)}[doc_id % 6 + 1] AS bin, {_sql_list(_CLAIM_COMPOUNDS)}[(doc_id // 6) % 5 + 1] AS comp,
  {_sql_list(_CLAIM_SYMPTOMS)}[(doc_id // 30) % 4 + 1] AS sym, {_sql_list(L.SUMMARY_SENTIMENTS)}[n_chars % 5 + 1] AS sent"""


def _claim_parts(spark, sf):
    d = S.docs(spark, sf)
    arr = lambda xs: F.array(*[F.lit(x) for x in xs])
    return d.select("doc_id", "n_chars",
                    F.element_at(arr(L.DOSE_BINS), (F.col("doc_id") % 6 + 1).cast("int")).alias("bin"),
                    F.element_at(arr(_CLAIM_COMPOUNDS), (F.floor(F.col("doc_id") / 6) % 5 + 1).cast("int")).alias("comp"),
                    F.element_at(arr(_CLAIM_SYMPTOMS), (F.floor(F.col("doc_id") / 30) % 4 + 1).cast("int")).alias("sym"),
                    F.element_at(arr(L.SUMMARY_SENTIMENTS), (F.col("n_chars") % 5 + 1).cast("int")).alias("sent"))


_CLAIM_ANSWER_SQL = """CASE doc_id % 4
  WHEN 0 THEN 'Here: [{"dosage": "' || bin || '", "compound": "' || comp || '", "symptom": "' || sym ||
              '", "sentiment": "' || sent || '", "brand": null}, {"dosage": "' || bin || '", "compound": "CBD"}] done'
  WHEN 1 THEN '[{"dosage": "' || bin || '", "compound": "' || comp || '"}, 7, "x"]'
  WHEN 2 THEN '{"dosage": "' || bin || '"}'
  ELSE 'no claims found' END"""


def _claim_answers(spark, sf):
    p = _claim_parts(spark, sf)
    m = F.col("doc_id") % 4
    a0 = F.concat(F.lit('Here: [{"dosage": "'), F.col("bin"), F.lit('", "compound": "'), F.col("comp"),
                  F.lit('", "symptom": "'), F.col("sym"), F.lit('", "sentiment": "'), F.col("sent"),
                  F.lit('", "brand": null}, {"dosage": "'), F.col("bin"), F.lit('", "compound": "CBD"}] done'))
    a1 = F.concat(F.lit('[{"dosage": "'), F.col("bin"), F.lit('", "compound": "'), F.col("comp"), F.lit('"}, 7, "x"]'))
    a2 = F.concat(F.lit('{"dosage": "'), F.col("bin"), F.lit('"}'))
    ans = F.when(m == 0, a0).when(m == 1, a1).when(m == 2, a2).otherwise(F.lit("no claims found"))
    return p.select("doc_id", ans.alias("answer"))


@query("parse_claims_json", f"""WITH p AS (SELECT doc_id, {_CLAIM_PARTS_SQL} FROM documents),
a AS (SELECT doc_id, {_CLAIM_ANSWER_SQL} AS answer FROM p),
s AS (SELECT doc_id, CASE WHEN strpos(answer, '[') > 0 AND strpos(answer, ']') > 0
                           AND length(answer) - strpos(reverse(answer), ']') + 1 >= strpos(answer, '[')
                      THEN substr(answer, strpos(answer, '['),
                                  length(answer) - strpos(reverse(answer), ']') + 2 - strpos(answer, '[')) END AS sl
      FROM a),
ok AS (SELECT doc_id, json_extract(sl, '$[*]') AS items FROM s WHERE sl IS NOT NULL AND json_valid(sl)
       AND json_type(sl) = 'ARRAY'),
ex AS (SELECT doc_id, unnest(items) AS it, generate_subscripts(items, 1) - 1 AS item_no FROM ok)
SELECT doc_id, item_no,
       CASE WHEN json_type(it) = 'OBJECT' THEN json_extract_string(it, '$.dosage') END AS dosage,
       CASE WHEN json_type(it) = 'OBJECT' THEN json_extract_string(it, '$.compound') END AS compound,
       CASE WHEN json_type(it) = 'OBJECT' THEN json_extract_string(it, '$.symptom') END AS symptom,
       CASE WHEN json_type(it) = 'OBJECT' THEN json_extract_string(it, '$.sentiment') END AS sentiment,
       CASE WHEN json_type(it) = 'OBJECT' THEN json_extract_string(it, '$.brand') END AS brand,
       CASE WHEN json_type(it) <> 'OBJECT' THEN true END AS false_positive,
       CASE WHEN json_type(it) <> 'OBJECT' THEN 'non-dict object returned' END AS error
FROM ex
UNION ALL
SELECT doc_id, 0, NULL, NULL, NULL, NULL, NULL, true, 'parse error' FROM s
WHERE sl IS NULL OR NOT json_valid(sl) OR json_type(sl) <> 'ARRAY'""")
def q_parse_claims_json(spark, sf):
    return PA.claims_rows(_claim_answers(spark, sf), "doc_id", "answer")


@query("dosage_summary", f"""WITH p AS (SELECT doc_id, {_CLAIM_PARTS_SQL} FROM documents),
c AS (SELECT sym AS symptom, sent AS sentiment, bin AS dosage,
             CASE WHEN doc_id % 7 = 0 THEN 'hash' ELSE comp END AS compound FROM p),
f AS (SELECT * FROM c WHERE symptom IN {tuple(L.SUMMARY_CONDITIONS)} AND sentiment IN {tuple(L.SUMMARY_SENTIMENTS)}
      AND compound IN {tuple(L.SUMMARY_COMPOUNDS)} AND dosage IN {tuple(L.DOSE_BINS)}),
n AS (SELECT symptom, sentiment, compound, dosage, count(*) AS cnt FROM f GROUP BY ALL),
pr AS (SELECT DISTINCT symptom, sentiment, compound FROM n),
g AS (SELECT pr.*, b.dosage FROM pr, (SELECT unnest({_sql_list(L.DOSE_BINS)}) AS dosage) b)
SELECT g.symptom AS condition, g.sentiment, g.dosage, g.compound, CAST(coalesce(n.cnt, 0) AS BIGINT) AS count
FROM g LEFT JOIN n USING (symptom, sentiment, compound, dosage)""")
def q_dosage_summary(spark, sf):
    p = _claim_parts(spark, sf)
    claims = p.select(F.col("sym").alias("symptom"), F.col("sent").alias("sentiment"), F.col("bin").alias("dosage"),
                      F.when(F.col("doc_id") % 7 == 0, F.lit("hash")).otherwise(F.col("comp")).alias("compound"))
    return PA.dosage_summary(claims)


PROMPT_TEMPLATE = ("Decide whether this post discusses health effects.\n\n"
                   "Keyword: {keyword}\nText: {text}\n\nAnswer 1 (relevant) or 0 (not relevant).")


@query("prompt_table", f"""WITH {Q.HITS}
SELECT id, replace(replace('{PROMPT_TEMPLATE.replace(chr(10), "' || chr(10) || '")}', '{{keyword}}', array_to_string(keywords, '; ')),
                   '{{text}}', text) AS prompt FROM hits""")
def q_prompt_table(spark, sf):
    h = S.hits(spark, sf)
    return h.select("id", PA.fill_template(PROMPT_TEMPLATE, keyword=F.array_join("keywords", "; "),
                                           text=F.col("text")).alias("prompt"))


FEW_SHOT_TEMPLATE = ("Decide whether this post discusses health effects.\n\nLabelled examples:\n\n{examples}\n---\n"
                     "Text: {text}\n\nAnswer with a label, a confidence and one sentence.")


def _sql_text(x: str) -> str:
    return "'" + x.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


_FEW_A, _FEW_B, _FEW_C = (_sql_text(x) for x in FEW_SHOT_TEMPLATE.replace("{examples}", "{text}").split("{text}"))


@query("few_shot_prompts", f"""WITH {Q.HITS},
g AS (SELECT l.doc_id AS id, l.quality AS label, d.text FROM labels l JOIN documents d ON d.doc_id = l.doc_id),
drawn AS (SELECT *, md5('42|' || CAST(id AS VARCHAR)) AS h FROM g ORDER BY h, id LIMIT 7),
b AS (SELECT string_agg('Text: ' || text || chr(10) || 'Relevance: ' || CAST(label AS VARCHAR) || chr(10) || chr(10), '' ORDER BY h, id) AS examples FROM drawn)
SELECT hits.id, {_FEW_A} || b.examples || {_FEW_B} || hits.text || {_FEW_C} AS prompt FROM hits, b
WHERE hits.id NOT IN (SELECT doc_id FROM labels)""")
def q_few_shot_prompts(spark, sf):
    """Prompts of the pending hits with seven drawn gold rows as examples."""
    d = S.docs(spark, sf).select(F.col("doc_id").alias("id"), "text")
    gold = d.join(S.labels(spark, sf).select(F.col("doc_id").alias("id"), F.col("quality").alias("label")), "id")
    pend = SU.pending(S.hit_keys(spark, sf).select("id"), S.labels(spark, sf).select(F.col("doc_id").alias("id")))
    return PA.few_shot_prompts(d.join(pend, "id"), gold, FEW_SHOT_TEMPLATE, "id", "text", "label", 7, 42)


# ===========================================================================
# spans and context
# ===========================================================================

_SPANS_SQL = f"""{Q.HITS},
pairs AS (SELECT id, text, unnest(keywords) AS keyword FROM hits),
parts AS (SELECT id, keyword, unnest(string_split(lower(text), keyword)) AS part,
                 generate_subscripts(string_split(lower(text), keyword), 1) AS i,
                 len(string_split(lower(text), keyword)) AS np FROM pairs),
cum AS (SELECT id, keyword, i, np, sum(length(part)) OVER (PARTITION BY id, keyword ORDER BY i) AS c FROM parts),
spans AS (SELECT id, keyword, CAST(c + (i - 1) * length(keyword) AS INTEGER) AS start,
                 CAST(c + i * length(keyword) AS INTEGER) AS "end" FROM cum WHERE i < np)"""


def _spans(spark, sf):
    h = S.hits(spark, sf).select("id", "text", "keywords")
    return SP.phrase_spans(h, "text", "keywords", "keyword")


@query("annotation_spans", f"""WITH {_SPANS_SQL} SELECT id, keyword, start, "end" FROM spans""")
def q_annotation_spans(spark, sf):
    return _spans(spark, sf).select("id", "keyword", "start", "end")


@query("merge_spans", f"""WITH {_SPANS_SQL},
o AS (SELECT id, start, "end", max("end") OVER (PARTITION BY id ORDER BY start, "end"
                                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pm FROM spans),
g AS (SELECT *, sum(CASE WHEN pm IS NULL OR start > pm THEN 1 ELSE 0 END)
                  OVER (PARTITION BY id ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS island FROM o)
SELECT id, min(start) AS start, max("end") AS "end" FROM g GROUP BY id, island""")
def q_merge_spans(spark, sf):
    return SP.merge_spans(_spans(spark, sf).select("id", "start", "end"), ["id"]).select("id", "start", "end")


@query("span_priority", f"""WITH RECURSIVE {Q.HITS},
pairs AS (SELECT id, text, 'highlight' AS kind, unnest([keywords[1], 'an']) AS phrase FROM hits
          UNION ALL SELECT id, text, 'bold', unnest(keywords) FROM hits),
parts AS (SELECT id, text, kind, phrase, unnest(string_split(lower(text), phrase)) AS part,
                 generate_subscripts(string_split(lower(text), phrase), 1) AS i,
                 len(string_split(lower(text), phrase)) AS np FROM pairs),
cum AS (SELECT *, sum(length(part)) OVER (PARTITION BY id, kind, phrase ORDER BY i) AS c FROM parts),
found AS (SELECT id, text, kind, CAST(c + (i - 1) * length(phrase) AS INTEGER) AS start,
                 CAST(c + i * length(phrase) AS INTEGER) AS "end" FROM cum WHERE i < np),
k AS (SELECT DISTINCT id, start, "end", kind FROM found
      WHERE kind = 'highlight' OR NOT (start > 0 AND regexp_matches(substr(text, start, 1), '[\\p{{L}}\\p{{N}}_]'))
                              AND NOT regexp_matches(substr(text, "end" + 1, 1), '[\\p{{L}}\\p{{N}}_]')),
o AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY start, "end" DESC, CASE kind WHEN 'highlight' THEN 0 ELSE 1 END) AS rn FROM k),
walk AS (
  SELECT id, CAST(0 AS BIGINT) AS rn, -1 AS last, false AS took FROM (SELECT DISTINCT id FROM o)
  UNION ALL
  SELECT o.id, o.rn, CASE WHEN o.start >= w.last THEN o."end" ELSE w.last END, o.start >= w.last
  FROM walk w JOIN o ON o.id = w.id AND o.rn = w.rn + 1)
SELECT o.id, o.start, o."end", o.kind FROM walk w JOIN o ON o.id = w.id AND o.rn = w.rn WHERE w.took""")
def q_span_priority(spark, sf):
    """Marked phrases of two fields (highlight) and whole-word keywords (bold),
    overlaps resolved; the first keyword is in both, so equal spans occur."""
    h = S.hits(spark, sf).select("id", "text", "keywords", F.get("keywords", 0).alias("source_compound"), F.lit("an").alias("source_symptom"))
    spans = SP.highlight_and_bold(h, ["id"], "text", ["source_compound", "source_symptom"], "keywords")
    return SP.span_priority(spans, ["id"], "kind")


_CONTEXT_SQL = """x AS (SELECT id, keywords, sents, unnest(sents) AS sent, generate_subscripts(sents, 1) - 1 AS i FROM s),
m AS (SELECT id, sents, i, greatest(0, i - 2) AS a, least(len(sents), i + 3) AS b FROM x
      WHERE len(list_filter(keywords, lambda k: contains(lower(sent), lower(k)))) > 0),
o AS (SELECT *, max(b) OVER (PARTITION BY id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pm FROM m),
g AS (SELECT *, sum(CASE WHEN pm IS NULL OR a > pm THEN 1 ELSE 0 END)
                  OVER (PARTITION BY id ORDER BY i ROWS UNBOUNDED PRECEDING) AS island FROM o),
r AS (SELECT id, island, min(a) AS range_start, max(b) AS range_end, any_value(sents) AS sents FROM g GROUP BY id, island)
SELECT id, CAST(island - 1 AS INTEGER) AS range_no, CAST(range_start AS INTEGER) AS range_start,
       CAST(range_end AS INTEGER) AS range_end, array_to_string(sents[range_start + 1 : range_end], ' ') AS context FROM r"""


@query("keyword_context", f"""WITH {Q.HITS},
s AS (SELECT id, keywords, string_split(regexp_replace(text, '([.!?])[ \\t\\r\\n]+', '\\1' || chr(1), 'g'), chr(1)) AS sents
      FROM hits),
{_CONTEXT_SQL}""")
def q_keyword_context(spark, sf):
    return SP.keyword_context(S.hits(spark, sf), "id", "text", "keywords", 2)


_ABBREVIATED_SQL = f"""{Q.HITS},
said AS (SELECT id, keywords, CASE WHEN id % 3 = 0 THEN concat_ws(' ', text, replace('{S.ABBREVIATED}', '<k>', keywords[1])) ELSE text END AS text FROM hits),
tok AS (SELECT unnest(regexp_split_to_array(lower(text), '[ \\t\\r\\n]+')) AS t FROM said),
part AS (SELECT regexp_extract(t, '{SP.ABBREVIATION_TOKEN.replace(chr(39), chr(39) * 2)}', 1) AS abbreviation,
                regexp_extract(t, '{SP.ABBREVIATION_TOKEN.replace(chr(39), chr(39) * 2)}', 2) AS p FROM tok),
word AS (SELECT abbreviation, count(*) FILTER (p = '.') AS a, count(*) FILTER (p = '') AS n FROM part WHERE abbreviation <> '' GROUP BY 1),
sums AS (SELECT sum(a + n) AS n_all, least(sum(a) / sum(a + n), 1 - 1e-9) AS pr FROM word),
abbr AS (SELECT abbreviation, a AS n_with, n AS n_without,
  2 * (a * (ln(0.99) - ln(pr)) + n * (ln(0.01) - ln(1 - pr))) * exp(-length(replace(abbreviation, '.', '')))
    * (length(abbreviation) - length(replace(abbreviation, '.', '')) + 1) * pow(length(replace(abbreviation, '.', '')), -n) AS score
  FROM word, sums WHERE a > 0)"""


@query("learnt_abbreviations", f"""WITH {_ABBREVIATED_SQL}
SELECT abbreviation, CAST(n_with AS BIGINT) AS n_with, CAST(n_without AS BIGINT) AS n_without, round(score, 6) AS score
FROM abbr WHERE score >= {SP.MIN_ABBREVIATION_SCORE}""")
def q_learnt_abbreviations(spark, sf):
    """Words that keep their period, learnt from the texts of the hits, every
    third of which got a remark with doses and titles."""
    return SP.abbreviations(S.abbreviated(spark, sf), "text").withColumn("score", F.round("score", 6))


@query("keyword_context_learnt", f"""WITH {_ABBREVIATED_SQL},
known AS (SELECT list(abbreviation) AS l FROM abbr WHERE score >= {SP.MIN_ABBREVIATION_SCORE}),
cut AS (SELECT id, keywords, string_split(regexp_replace(text, '([.!?][ \\t\\r\\n]+)', '\\1' || chr(1), 'g'), chr(1)) AS ps FROM said),
s AS (SELECT id, keywords, string_split(array_to_string(list_transform(ps, lambda x, i:
        CASE WHEN i = len(ps) OR coalesce(list_contains(l, regexp_extract(lower(x), '{SP.LAST_ABBREVIATION.replace(chr(39), chr(39) * 2)}', 1)), false) THEN x
             ELSE regexp_replace(x, '[ \\t\\r\\n]+$', '') || chr(1) END), ''), chr(1)) AS sents FROM cut, known),
{_CONTEXT_SQL}""")
def q_keyword_context_learnt(spark, sf):
    said = S.abbreviated(spark, sf)
    return SP.keyword_context(said, "id", "text", "keywords", 2, written(spark, SP.abbreviations(said, "text"), "abbreviations"))


@query("mark_keywords")
def q_mark_keywords(spark, sf):
    c = S.coded_lines(spark, sf)
    j = c.join(S.docs(spark, sf).select(F.col("doc_id").alias("id"), "text"), "id")
    kws = F.transform(F.split(F.col("keyword"), ";"), lambda k: T.py_strip(k))
    return j.select("id", M.mark_keywords(F.col("text"), kws).alias("marked"))


def _annotated(spark, sf):
    h = S.hit_keys(spark, sf)
    ann = F.when(F.size("keywords") == 1, F.array().cast("array<struct<compound:string,source_compound:string>>")) \
        .otherwise(F.transform("keywords", lambda k: F.struct(k.alias("compound"), F.upper(k).alias("source_compound"))))
    return h.select("id", ann.alias("annotations"))


@query("annotation_rows", f"""WITH {Q.HITS},
ann AS (SELECT id, unnest(keywords) AS k, generate_subscripts(keywords, 1) AS pos FROM hits WHERE len(keywords) > 1),
num AS (SELECT id, k, row_number() OVER (ORDER BY id, pos) - 1 AS n FROM ann)
SELECT id, CAST(id AS VARCHAR) || '_' || CAST(n AS VARCHAR) AS annotation_id, k AS compound, upper(k) AS source_compound,
       false AS no_annotations FROM num
UNION ALL
SELECT id, CAST(id AS VARCHAR) || '_0', NULL, NULL, true FROM hits WHERE len(keywords) = 1""")
def q_annotation_rows(spark, sf):
    return SP.annotation_rows(_annotated(spark, sf), "id", "annotations", "id", ["compound", "source_compound"])


@query("annotation_file_rows", f"""WITH {Q.HITS},
ann AS (SELECT id, unnest(keywords) AS k, generate_subscripts(keywords, 1) AS pos FROM hits WHERE len(keywords) > 1),
num AS (SELECT id, k, row_number() OVER (ORDER BY id, pos) - 1 AS n FROM ann)
SELECT 't' || CAST(id AS VARCHAR) AS id, 't' || CAST(id AS VARCHAR) || '_' || CAST(n AS VARCHAR) AS annotation_id, k AS compound,
       false AS no_annotations FROM num
UNION ALL
SELECT 't' || CAST(id AS VARCHAR), 't' || CAST(id AS VARCHAR) || '_0', NULL, true FROM hits WHERE len(keywords) = 1""")
def q_annotation_file_rows(spark, sf):
    """Annotations with text ids written as JSON lines (in id order), read back
    and numbered in the order of the files."""
    h = S.hit_keys(spark, sf)
    ann = F.when(F.size("keywords") > 1, F.transform("keywords", lambda k: F.create_map(F.lit("compound"), k)))
    path = checkpoint_path(spark, f"annotations-{uuid.uuid4().hex}")
    h.select(F.concat(F.lit("t"), F.col("id").cast("string")).alias("id"), ann.alias("annotations"), F.col("id").alias("_o")) \
        .sort("_o").drop("_o").write.json(path)
    return SP.annotation_rows(FI.read_annotations(spark, path), "id", "annotations", ["source_file", "block", "line"], ["compound"])


@query("sheet_folder", f"""WITH {Q.SHEET}
SELECT CAST(post_id AS VARCHAR) AS post_id, CAST(comment_id AS VARCHAR) AS comment_id, CAST(reply_id AS VARCHAR) AS reply_id,
       nullif(title, '') AS title, nullif(post_text, '') AS post_text, nullif(comment_body, '') AS comment_body,
       nullif(reply_body, '') AS reply_body FROM sheet""")
def q_sheet_folder(spark, sf):
    """Thread sheets written as CSV with their columns in another order, one
    folder beside them without the text columns, read back by header."""
    t = S.thread_sheet(spark, sf)
    cols = [F.col(c).cast("string") for c in ("title", "reply_body", "post_id", "comment_body", "reply_id", "post_text", "comment_id")]
    path = checkpoint_path(spark, f"sheets-{uuid.uuid4().hex}")
    FI.write_table(t.select(*cols), path, "csv")
    FI.write_table(t.select(F.col("post_id"), F.lit("x").alias("note")), path, "csv", mode="append")
    names = ["post_id", "comment_id", "reply_id", "title", "post_text", "comment_body", "reply_body"]
    return FI.read_sheet_folder(spark, path).select(*[F.nullif(F.col(c), F.lit("")).alias(c) for c in names])


@query("unreviewed", f"""WITH {Q.HITS},
ann AS (SELECT id, unnest(keywords) AS k, generate_subscripts(keywords, 1) AS pos FROM hits WHERE len(keywords) > 1),
num AS (SELECT id, k, row_number() OVER (ORDER BY id, pos) - 1 AS n FROM ann),
rows AS (SELECT id, CAST(id AS VARCHAR) || '_' || CAST(n AS VARCHAR) AS annotation_id FROM num
         UNION ALL SELECT id, CAST(id AS VARCHAR) || '_0' FROM hits WHERE len(keywords) = 1),
reviewed AS (SELECT r.annotation_id FROM rows r JOIN labels l ON l.doc_id = r.id)
SELECT id, annotation_id FROM rows WHERE annotation_id NOT IN (SELECT annotation_id FROM reviewed)""")
def q_unreviewed(spark, sf):
    rows = SP.annotation_rows(_annotated(spark, sf), "id", "annotations", "id", ["compound"]).select("id", "annotation_id")
    reviewed = rows.join(S.labels(spark, sf).select(F.col("doc_id").alias("id")), "id").select("annotation_id")
    return SU.pending(rows, reviewed, "annotation_id")


# ===========================================================================
# more sampling
# ===========================================================================

@query("stratified_sample", f"""WITH RECURSIVE {Q.HITS},
ex AS (SELECT DISTINCT unnest(keywords) AS keyword, id, subreddit FROM hits),
g AS (SELECT keyword, CAST(dense_rank() OVER (ORDER BY keyword) AS BIGINT) AS gi FROM (SELECT DISTINCT keyword FROM ex)),
c AS (SELECT e.keyword, g.gi, e.id, md5('42|' || e.keyword || '|' || CAST(e.id AS VARCHAR)) AS h FROM ex e JOIN g USING (keyword)),
cl AS (SELECT gi, list(id ORDER BY h, id) AS ids FROM c GROUP BY gi),
walk AS (
  SELECT CAST(0 AS BIGINT) AS gi, CAST([] AS BIGINT[]) AS seen, CAST([] AS BIGINT[]) AS took
  UNION ALL
  SELECT cl.gi,
         list_concat(w.seen, list_filter(cl.ids, lambda x: NOT list_contains(w.seen, x))[1:10]),
         list_filter(cl.ids, lambda x: NOT list_contains(w.seen, x))[1:10]
  FROM walk w JOIN cl ON cl.gi = w.gi + 1),
picked AS (SELECT w.gi, unnest(w.took) AS id, generate_subscripts(w.took, 1) AS pos FROM walk w WHERE len(w.took) > 0)
SELECT g.keyword, p.id, e.subreddit, CAST(row_number() OVER (ORDER BY p.gi, p.pos) - 1 AS BIGINT) AS sample_order
FROM picked p JOIN g ON g.gi = p.gi JOIN ex e ON e.keyword = g.keyword AND e.id = p.id""")
def q_stratified_sample(spark, sf):
    """Greedy draw of up to 10 ids per keyword (keywords in sorted order, an id
    drawn once); the oracle walks the groups with a recursive CTE."""
    ex = S.hit_keys(spark, sf).select("id", "subreddit", F.explode("keywords").alias("keyword"))
    return SA.stratified_sample(ex, "keyword", "id", 10, 42).select("keyword", "id", "subreddit", "sample_order")


@query("stratified_sample_by_source", ORACLE["stratified_sample"]
       .replace("ex AS (SELECT DISTINCT unnest(keywords) AS keyword, id, subreddit FROM hits)", "ex AS (SELECT DISTINCT subreddit AS keyword, id FROM hits)")
       .replace("SELECT g.keyword, p.id, e.subreddit,", "SELECT g.keyword AS subreddit, p.id,"))
def q_stratified_sample_by_source(spark, sf):
    """The same greedy draw with the source as the stratum."""
    return SA.stratified_sample(S.hit_keys(spark, sf).select("id", "subreddit"), "subreddit", "id", 10, 42)


@query("top_k_per_group_union", f"""WITH {Q.PREDS},
d AS (SELECT id, subreddit, keyword, relevance,
             CASE WHEN model IN ('gpt_zero_shot', 'gpt_few_shot') THEN 0.5 + 0.5 * confidence ELSE confidence END AS confidence
      FROM preds WHERE subset IS DISTINCT FROM 'gold_label' AND model IS DISTINCT FROM 'xgboost'),
ex AS {Q.explode_comma('d', 'id, subreddit, relevance, confidence')},
g AS (SELECT id, subreddit, keyword, count(*) FILTER (WHERE relevance = 1) AS ones, count(relevance) AS n,
             avg(confidence) AS a FROM ex GROUP BY ALL),
sc AS (SELECT id, subreddit, keyword,
              round(CAST((CASE WHEN n > 0 THEN ones / n ELSE 0.0 END) BETWEEN 0.3 AND 0.7 AS INTEGER) +
                    CASE WHEN a IS NULL THEN 0.0 WHEN a >= 0.5 AND a < 0.65 THEN 0.5 WHEN a >= 0.65 AND a < 0.75 THEN 1.0 ELSE 0.0 END, 9)
              AS priority_score FROM g),
s AS (SELECT id, lower(trim(subreddit)) AS subreddit, lower(trim(keyword)) AS keyword, priority_score FROM sc),
a AS (SELECT *, 0 AS src, keyword AS grp,
             row_number() OVER (PARTITION BY keyword ORDER BY priority_score DESC, id, keyword, subreddit) AS rk FROM s),
b AS (SELECT *, 1 AS src, subreddit AS grp,
             row_number() OVER (PARTITION BY subreddit ORDER BY priority_score DESC, id, keyword, subreddit) AS rk FROM s),
u AS (SELECT * FROM a WHERE rk <= 5 UNION ALL SELECT * FROM b WHERE rk <= 5)
SELECT id, arg_min(subreddit, (src, grp, rk)) AS subreddit, arg_min(keyword, (src, grp, rk)) AS sampled_keyword,
       arg_min(priority_score, (src, grp, rk)) AS priority_score FROM u GROUP BY id""")
def q_top_k_per_group_union(spark, sf):
    return SA.top_k_per_group_union(EV.priority_score(S.predictions(spark, sf)), 5)


# ===========================================================================
# machine learning (model outputs: rows-only checks, except the feature table)
# ===========================================================================

from ..operators import ml as ML  # noqa: E402
from .stages import kept  # noqa: E402

MAX_FEATURES, NGRAMS = 5000, 2  # the full models' TF-IDF

_TERMS_SQL = f"""w AS (SELECT doc_id, list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}'),
                    lambda x: NOT list_contains({Q.text_list(ML.STOP_WORDS)}, x)) AS w FROM documents),
t AS (SELECT doc_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM w),
tc AS (SELECT term, count(*) AS tf, count(DISTINCT doc_id) AS df FROM t GROUP BY term),
n AS (SELECT count(*) AS n FROM documents),
v AS (SELECT * FROM tc ORDER BY tf DESC, term LIMIT {MAX_FEATURES})"""


@query("tfidf_features", f"""WITH {_TERMS_SQL}
SELECT term, tf, df, round(ln((1 + n) / (1 + df)) + 1, 9) AS idf FROM v, n""")
def q_tfidf_features(spark, sf):
    return ML.document_frequency(S.docs(spark, sf), "doc_id", "text", MAX_FEATURES, NGRAMS, True)


@query("tfidf_vectors", f"""WITH {_TERMS_SQL},
x AS (SELECT doc_id, term, count(*) * any_value(ln((1 + n) / (1 + df)) + 1) AS w FROM t JOIN v USING (term) CROSS JOIN n GROUP BY doc_id, term)
SELECT doc_id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 6) AS weight FROM x""")
def q_tfidf_vectors(spark, sf):
    return ML.tfidf_vectors(S.docs(spark, sf), "doc_id", "text", MAX_FEATURES, NGRAMS, True)


def _text_model(spark, sf) -> tuple:
    """(TF-IDF model fitted on the gold training rows, gold features). The
    features are a staged table in files of about ROWS_PER_PART rows: each
    optimiser iteration and each level of a tree is a job over them, and a row
    costs a tree the whole width of the vocabulary, so few rows are much work.
    Part 2 of the training rows (about a fifth) is held out for calibration."""
    def build():
        d = S.docs(spark, sf).select(F.col("doc_id").alias("id"), "text")
        data = written(spark, d.join(S.gold(spark, sf), "id").withColumnRenamed("relevance_true", "label"), "gold-texts")
        tf = ML.fit_tfidf(data.filter(F.col("is_test") == 0), "text", MAX_FEATURES, NGRAMS)
        part = F.when(F.col("is_test") == 1, 0).when(F.pmod(F.xxhash64("id"), F.lit(5)) == 0, 2).otherwise(1)
        feats = tf.transform(data).select("id", "label", "is_test", part.alias("part"), "features")
        return tf, written(spark, feats.repartition(max(1, -(-data.count() // ROWS_PER_PART))), "gold-features")
    return kept(spark, sf, "text-model", build)


ROWS_PER_PART = 2_000
SEMANTIC_DIMS = 50


def _model(spark, sf, name: str):
    """A classifier fitted once per session on the gold training rows."""
    def build():
        _, feats = _text_model(spark, sf)
        train = feats.filter("part > 0")
        if name == "logreg":
            return ML.train_logreg(train, balanced=True)
        if name == "svm":
            return ML.train_svm(feats.filter("part = 1"), feats.filter("part = 2"))
        return ML.train_gbt(train)
    return kept(spark, sf, f"model-{name}", build)


def _report(spark, sf, name: str) -> DataFrame:
    _, feats = _text_model(spark, sf)
    test = _model(spark, sf, name).transform(feats.filter("is_test = 1"))
    return EV.class_report(test.withColumn("prediction", F.col("prediction").cast("int")), "label", "prediction")


@query("train_logreg")
def q_train_logreg(spark, sf):
    return _report(spark, sf, "logreg")


@query("train_svm")
def q_train_svm(spark, sf):
    return _report(spark, sf, "svm")


@query("train_gbt")
def q_train_gbt(spark, sf):
    return _report(spark, sf, "xgboost")


def _predicted(spark, sf, confidence: str) -> DataFrame:
    tf, _ = _text_model(spark, sf)
    models = {m: _model(spark, sf, m) for m in L.CLASSICAL_MODELS}
    docs = tf.transform(S.docs(spark, sf).select(F.col("doc_id").alias("id"), "text")).select("id", "features")
    return ML.predict_long(docs, models, "id", "v1", confidence)


@query("predict_long")
def q_predict_long(spark, sf):
    """All three models over every document, the larger class probability as confidence."""
    return _predicted(spark, sf, "max")


@query("predict_long_checks", f"""SELECT m AS model, count(*) AS n_rows, count(DISTINCT doc_id) AS n_ids, count(*) AS n_labels,
       count(*) AS n_confident, count(*) AS n_consistent FROM documents, (SELECT unnest({Q.text_list(L.CLASSICAL_MODELS)}) AS m) GROUP BY m""")
def q_predict_long_checks(spark, sf):
    """What must hold of bulk predictions: a row per document and model, 0 / 1
    labels, max probabilities in [0.5, 1], and the label on the side that the
    probability of class 1 (second run) says."""
    top = _predicted(spark, sf, "max").withColumnRenamed("confidence", "top")
    p1 = _predicted(spark, sf, "p1").select("id", "model", F.col("confidence").alias("p1"))
    j = top.join(p1, ["id", "model"])
    side = F.abs(F.col("top") - F.greatest("p1", 1 - F.col("p1"))) < 1e-9
    return j.groupBy("model").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct("id").alias("n_ids"),
        F.count_if(F.col("prediction").isin(0, 1)).alias("n_labels"),
        F.count_if(F.col("top").between(0.5, 1.0)).alias("n_confident"),
        F.count_if(side & ((F.col("p1") > 0.5).cast("int") == F.col("prediction"))).alias("n_consistent"))


@query("saved_models", f"""SELECT m AS model, count(*) AS n_rows, count(*) AS n_same FROM documents, (SELECT unnest({Q.text_list(L.CLASSICAL_MODELS)}) AS m) GROUP BY m""")
def q_saved_models(spark, sf):
    """Text to prediction as one saved model each: loaded again, it gives every
    document the label and the confidence that the fitted model gives."""
    tf, _ = _text_model(spark, sf)
    loaded = {}
    for m in L.CLASSICAL_MODELS:
        path = checkpoint_path(spark, f"model-{m}-{uuid.uuid4().hex}")
        ML.text_model(tf, _model(spark, sf, m)).write().save(path)
        loaded[m] = PipelineModel.load(path)
    texts = S.docs(spark, sf).select(F.col("doc_id").alias("id"), "text")
    again = None
    for m, model in loaded.items():
        one = ML.predict_long(texts, {m: model}, "id", "v1", "p1").select("id", "model", F.col("prediction").alias("again"), F.col("confidence").alias("p"))
        again = one if again is None else again.unionByName(one)
    both = _predicted(spark, sf, "p1").join(again, ["id", "model"])
    same = (F.col("prediction") == F.col("again")) & (F.abs(F.col("confidence") - F.col("p")) < 1e-9)
    return both.groupBy("model").agg(F.count("*").alias("n_rows"), F.count_if(same).alias("n_same"))


@query("semantic_classifier")
def q_semantic_classifier(spark, sf):
    """Text in, class out by way of latent semantic vectors: TF-IDF, a
    truncated SVD fitted on the gold training rows, and a logistic model."""
    tf, feats = _text_model(spark, sf)
    basis = kept(spark, sf, "semantic-basis", lambda: ML.semantic_basis(feats.where("is_test = 0"), k=SEMANTIC_DIMS))

    def build():
        train = ML.embedding_features(ML.semantic_vectors(feats.where("is_test = 0"), basis).drop("features"))
        return ML.train_logreg(written(spark, train.select("id", "label", "features"), "semantic-features"), balanced=True)

    model = kept(spark, sf, "semantic-model", build)
    docs = tf.transform(S.docs(spark, sf).select(F.col("doc_id").alias("id"), "text")).select("id", "features")
    rows = ML.embedding_features(ML.semantic_vectors(docs, basis).drop("features"))
    return ML.predict_long(rows, {"semantic": model}, "id", "v1", "p1").select("id", "prediction", "confidence")


@query("test_supports", f"""WITH {Q.GOLD}
SELECT m AS model, CAST(c AS VARCHAR) AS class, (SELECT count(*) FROM gold JOIN documents d ON d.doc_id = gold.id WHERE is_test = 1 AND relevance_true = c) AS support
FROM (SELECT unnest({Q.text_list(L.CLASSICAL_MODELS)}) AS m), (VALUES (0), (1)) k(c)""")
def q_test_supports(spark, sf):
    """The rows that each model is scored on, from the three reports."""
    out = None
    for m in L.CLASSICAL_MODELS:
        one = _report(spark, sf, m).filter(F.col("class").isin("0", "1")).select(F.lit(m).alias("model"), "class", "support")
        out = one if out is None else out.unionByName(one)
    return out


@query("feature_weights")
def q_feature_weights(spark, sf):
    tf, _ = _text_model(spark, sf)
    return ML.feature_weights(spark, tf.vocab, _model(spark, sf, "logreg").coefficients.toArray(), 20)


@query("embedding_classifier")
def q_embedding_classifier(spark, sf):
    e = spark.read.parquet(f"{sf}/embeddings.parquet")
    e = ML.embedding_features(e).withColumn("label", (F.col("label") == 0).cast("int"))
    e = written(spark, SA.split_train_test(e.withColumnRenamed("vec_id", "id"), "id", "label", 0.2, 42), "embedding-features")
    lr = ML.train_logreg(e.filter(F.col("is_test") == 0))
    p = lr.transform(e).withColumn("_p", ML.vector_to_array("probability"))
    return p.select("id", "label", "is_test", F.col("prediction").cast("int").alias("prediction"),
                    F.round(F.col("_p")[1], 6).alias("p1"))


@query("score_texts", f"""WITH {Q.HITS}
SELECT id, CASE WHEN id % 101 = 0 THEN NULL WHEN length(text) > 1500 AND contains(lower(text), ' the ') THEN '1' ELSE '0' END AS relevance,
       CASE WHEN id % 101 = 0 THEN 'ValueError: no answer' END AS error
FROM hits WHERE id NOT IN (SELECT doc_id FROM labels)""")
def q_score_texts(spark, sf):
    """Pending hits scored by the offline stand-in; it fails on the texts that
    were made unanswerable, and only their rows carry an error."""
    rows = S.hits(spark, sf).select("id", F.when(F.col("id") % 101 == 0, F.lit(ML.UNANSWERABLE)).otherwise(F.col("text")).alias("text"))
    done = S.labels(spark, sf).select(F.col("doc_id").alias("id"))
    pend = SU.pending(rows, done)
    return ML.score_texts(pend, ML.offline_scorer, "text", "relevance").select("id", "relevance", "error")


@query("score_pending", ORACLE["score_texts"])
def q_score_pending(spark, sf):
    """The same rows scored as a stream with a commit for each micro-batch."""
    rows = S.hits(spark, sf).select("id", F.when(F.col("id") % 101 == 0, F.lit(ML.UNANSWERABLE)).otherwise(F.col("text")).alias("text"))
    pend = SU.pending(rows, S.labels(spark, sf).select(F.col("doc_id").alias("id")))
    return score_pending(spark, pend, checkpoint_path(spark, f"scoring-{uuid.uuid4().hex}"), ML.offline_scorer, out_col="relevance").select("id", "relevance", "error")


# ===========================================================================
# the full rough-cut lexicon (131 phrases, multi-word and punctuated ones)
# ===========================================================================

@query("filtering_phrase_match", f"""WITH {_REMARKED}, d AS (SELECT doc_id, source, lower(text) AS low FROM remarked),
m AS (SELECT doc_id, source, {_phrase_case_sql('low', L.FILTERING_PHRASES)} AS kw FROM d)
SELECT doc_id, source, array_to_string(kw, '; ') AS keywords, len(kw) AS n_keywords FROM m WHERE len(kw) > 0""")
def q_filtering_phrase_match(spark, sf):
    d = S.remarked(spark, sf).select("doc_id", "source", "text")
    m = M.keyword_match(d, "text", L.FILTERING_PHRASES)
    return m.select("doc_id", "source", F.array_join("keywords", "; ").alias("keywords"),
                    F.size("keywords").alias("n_keywords"))


# ===========================================================================
# small list / set operators
# ===========================================================================

_SUBSET_KW = ["the", "der", "que", "une"]


@query("keyword_subset", f"""WITH {Q.HITS},
ex AS (SELECT id, subreddit, unnest(keywords) AS keyword FROM hits)
SELECT DISTINCT id, subreddit, keyword FROM ex
WHERE keyword IN {tuple(_SUBSET_KW)} AND id NOT IN (SELECT doc_id FROM labels)""")
def q_keyword_subset(spark, sf):
    ex = S.hit_keys(spark, sf).select("id", "subreddit", F.explode("keywords").alias("keyword")).distinct()
    kept = ex.filter(F.lower("keyword").isin(_SUBSET_KW))
    return SU.pending(kept, S.labels(spark, sf).select(F.col("doc_id").alias("id")))


@query("filter_keywords_subreddits", f"""WITH {Q.PREDS},
ex AS {Q.explode_comma('preds', 'id, subreddit, model, relevance')}
SELECT id, subreddit, model, keyword, relevance FROM ex
WHERE keyword IN ('the', 'and', 'der') AND subreddit IN ('src1', 'src2', 'src3')""")
def q_filter_keywords_subreddits(spark, sf):
    ex = ST.explode_keywords(S.predictions(spark, sf), "keyword", "comma")
    return ex.filter(F.lower("keyword").isin("the", "and", "der") & F.col("subreddit").isin("src1", "src2", "src3")) \
        .select("id", "subreddit", "model", "keyword", "relevance")


@query("keyword_map", f"""WITH {Q.HITS},
ex AS (SELECT id, lower(trim(unnest(keywords))) AS keyword FROM hits)
SELECT id, array_to_string(list_sort(list_distinct(list(keyword))), '; ') AS keyword FROM ex GROUP BY id""")
def q_keyword_map(spark, sf):
    ex = S.hit_keys(spark, sf).select("id", F.explode("keywords").alias("keyword"))
    return ex.groupBy("id").agg(F.array_join(F.array_sort(F.collect_set(F.lower(F.trim("keyword")))), "; ").alias("keyword"))


@query("first_per_id", f"""WITH {Q.PREDS}
SELECT id, arg_min(model, (-relevance, model)) AS model, min(relevance) AS min_relevance FROM preds GROUP BY id""")
def q_first_per_id(spark, sf):
    """First row per id under an explicit order (relevance desc, then model)."""
    p = S.predictions(spark, sf)
    return p.groupBy("id").agg(F.min_by("model", F.struct((-F.col("relevance")).alias("r"), F.col("model"))).alias("model"),
                               F.min("relevance").alias("min_relevance"))


@query("top_keywords", f"""WITH {_CODED_Q},
r AS (SELECT keyword, count(label) AS count, round(avg(label), 9) AS hit_rate
      FROM {Q.explode_semicolon('coded', 'id, subreddit, label')} GROUP BY keyword),
h AS (SELECT *, 'head' AS side FROM r ORDER BY hit_rate DESC NULLS LAST, keyword LIMIT 5),
t AS (SELECT *, 'tail' AS side FROM r ORDER BY hit_rate ASC NULLS FIRST, keyword LIMIT 5)
SELECT * FROM h UNION ALL SELECT * FROM t""")
def q_top_keywords(spark, sf):
    """Head and tail of the keyword hit-rate table (a top-k report)."""
    r = ST.hit_rates(ST.explode_keywords(S.coded_lines(spark, sf), "keyword", "semicolon"), "keyword", "label")
    h = r.orderBy(F.col("hit_rate").desc_nulls_last(), "keyword").limit(5).withColumn("side", F.lit("head"))
    t = r.orderBy(F.col("hit_rate").asc_nulls_first(), "keyword").limit(5).withColumn("side", F.lit("tail"))
    return h.unionByName(t)


@query("distinct_texts", """SELECT text, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY text""")
def q_distinct_texts(spark, sf):
    """One row per distinct text, first by id; how many copies it has."""
    d = S.docs(spark, sf).groupBy(F.md5("text").alias("_d")).agg(
        F.min_by("text", "doc_id").alias("text"), F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"))
    return d.drop("_d")


_SAMPLE_ROWS = 500


@query("sample_with_text", f"""WITH {_SUBSET_BASE},
drawn AS (SELECT id FROM gold ORDER BY md5('sample|' || id), id LIMIT {_SAMPLE_ROWS}),
s AS (SELECT id FROM km UNION SELECT id FROM drawn)
SELECT s.id, coalesce(t.text, '[Text not found]') AS text
FROM s LEFT JOIN (SELECT id, coalesce(title, '') || ' | ' || coalesce(selftext, '') AS text FROM posts
                  UNION ALL SELECT id, body FROM comments) t ON t.id = s.id""")
def q_sample_with_text(spark, sf):
    """Ids of keyword matches and of a drawn sample of labelled rows, with text:
    posts as "title | selftext", comments as body, else a default."""
    posts, comments, km = _posts_comments_matches(spark, sf)
    labelled = S.labels(spark, sf).select(F.concat(F.lit("p"), F.col("doc_id").cast("string")).alias("id")).distinct()
    ids = km.unionByName(SU.take_k(labelled, _SAMPLE_ROWS, "sample")).distinct()
    texts = posts.select("id", T.compose_text([F.col("title"), F.col("selftext")], " | ", "empty").alias("text")) \
        .unionByName(comments.select("id", F.col("body").alias("text")))
    return ids.join(texts, "id", "left").select("id", F.coalesce("text", F.lit("[Text not found]")).alias("text"))


@query("dosage_mentions", f"""WITH {_REMARKED},
m AS (SELECT doc_id, regexp_extract_all(lower(text), '{L.DOSAGE_PATTERN}') AS doses FROM remarked)
SELECT doc_id, array_to_string(doses, '; ') AS doses, len(doses)::INTEGER AS n_doses FROM m WHERE len(doses) > 0""")
def q_dosage_mentions(spark, sf):
    """Every dose mention of each document (regexp_extract_all with the dosage pattern)."""
    d = S.remarked(spark, sf)
    m = F.regexp_extract_all(F.lower("text"), F.lit(L.DOSAGE_PATTERN), 0)
    return M.fence(d.select("doc_id", "text"), m, "doses").filter(F.size("doses") > 0) \
        .select("doc_id", F.array_join("doses", "; ").alias("doses"), F.size("doses").alias("n_doses"))


@query("matched_in_category_sql", f"""WITH {_SUBSET_BASE} SELECT id FROM matched""")
def q_matched_in_category_sql(spark, sf):
    """The category membership written as SQL over temp views (catalog scans)."""
    posts, comments, km = _posts_comments_matches(spark, sf)
    posts.createOrReplaceTempView("tl_posts")
    comments.createOrReplaceTempView("tl_comments")
    km.createOrReplaceTempView("tl_keyword_matches")
    return spark.sql("""
        SELECT DISTINCT km.id
        FROM tl_keyword_matches km
        LEFT JOIN tl_posts p ON km.id = p.id
        LEFT JOIN tl_comments c ON km.id = c.id
        LEFT JOIN tl_posts parent_post ON c.post_id = parent_post.id
        WHERE p.category = 'user' OR parent_post.category = 'user'""")


_TAG_CATEGORIES = ["phrases", "compounds", "compounds_short", "ingestion_methods", "strains", "dosages", "traits",
                   "topicals", "symptoms"]


def _category_sql() -> str:
    parts = []
    for cat in _TAG_CATEGORIES:
        parts.append(f"SELECT doc_id, '{cat}' AS category, {_phrase_case_sql('low', L.CATEGORIES[cat])} AS kw FROM d")
    return "\nUNION ALL\n".join(parts)


@query("lexicon_categories", f"""WITH {_REMARKED}, d AS (SELECT doc_id, lower(text) AS low FROM remarked),
m AS ({_category_sql()})
SELECT doc_id, category, array_to_string(kw, '; ') AS keywords, len(kw) AS n_keywords FROM m WHERE len(kw) > 0""")
def q_lexicon_categories(spark, sf):
    """Documents tagged with every category lexicon: one match pass over the
    union of all terms, then matched terms join the (category, ord, term)
    lexicon (a few hundred rows, broadcast) and are listed in each
    category's own order."""
    lex = None
    for cat in _TAG_CATEGORIES:
        one = L.lexicon_df(spark, cat).dropDuplicates(["term"])
        lex = one if lex is None else lex.unionByName(one)
    all_terms = list(dict.fromkeys(t for cat in _TAG_CATEGORIES for t in L.CATEGORIES[cat]))
    d = S.remarked(spark, sf).select("doc_id", "text")
    hits = M.keyword_match(d, "text", all_terms).select("doc_id", F.explode("keywords").alias("term"))
    tagged = hits.join(F.broadcast(lex), "term")
    per = tagged.groupBy("doc_id", "category").agg(F.array_sort(F.collect_list(F.struct("ord", "term"))).alias("_k"))
    return per.select("doc_id", "category", F.array_join(F.transform("_k", lambda s: s["term"]), "; ").alias("keywords"),
                      F.size("_k").alias("n_keywords"))
