"""The stand-in rules of ``standins`` spelled as DuckDB SQL (oracle side).

Regex notes: RE2 has no lookaround and its ``\\b`` is ASCII-only, so whole
words are tested as ``(?:^|[^\\p{L}\\p{N}_])kw(?:[^\\p{L}\\p{N}_]|$)``, which
equals the Spark lookaround form for an existence test.
"""

from __future__ import annotations

from ..lexicon import FIXTURE_LEXICON

LEX = "[" + ", ".join(f"'{k}'" for k in FIXTURE_LEXICON) + "]"
WB_L = r"(?:^|[^\p{L}\p{N}_])"
WB_R = r"(?:[^\p{L}\p{N}_]|$)"


def match_list(text_sql: str, lex: str = LEX) -> str:
    r"""Lexicon words (single tokens) present as whole words, in lexicon order.

    For a one-token word, "whole-word match" is "equals one of the text's
    maximal [\p{L}\p{N}_] runs"; the tokens are computed once per row.
    """
    return (f"list_transform([regexp_extract_all(lower({text_sql}), '[\\p{{L}}\\p{{N}}_]+')], "
            f"lambda toks: list_filter({lex}, lambda k: list_contains(toks, k)))[1]")


HITS_ALL = f"""hits_all AS (
  SELECT doc_id AS id, source AS subreddit, text, lang, n_chars, {match_list('text')} AS keywords
  FROM documents)"""

HITS = HITS_ALL + """,
hits AS (SELECT * FROM hits_all WHERE len(keywords) > 0)"""


def coded(name: str, label: str, extra: str = "") -> str:
    return f"""{name} AS (
  SELECT h.id, h.subreddit, h.lang, array_to_string(h.keywords, ';') AS keyword, l.{label} AS label
  FROM hits h JOIN labels l ON l.doc_id = h.id {extra})"""


CODERS = HITS + ",\n" + coded("coder_1", "quality") + ",\n" + coded("coder_2", "toxic", "WHERE h.lang <> 'de'")


def explode_semicolon(src: str, cols: str) -> str:
    return (f"(SELECT {cols}, lower(trim(k)) AS keyword FROM "
            f"(SELECT *, unnest(string_split(coalesce(keyword, ''), ';')) AS k FROM {src}))")


def explode_comma(src: str, cols: str) -> str:
    return (f"(SELECT {cols}, lower(trim(k)) AS keyword FROM "
            f"(SELECT *, unnest(string_split(coalesce(keyword, ''), ',')) AS k FROM {src}))")


PREDS = HITS_ALL + """,
preds AS (
  SELECT id, subreddit, text,
         CASE WHEN len(keywords) > 0 THEN array_to_string(keywords, ',') END AS keyword,
         CASE WHEN len(keywords) > 0 THEN 'keyword_match' ELSE 'random_kfails' END AS subset,
         least(1.0::DOUBLE, n_chars / 2000.0::DOUBLE) AS confidence, id AS ord, m.model,
         CASE m.model WHEN 'logreg' THEN (n_chars > 1500)::INT
                      WHEN 'svm' THEN (len(keywords) >= 3)::INT
                      ELSE (lang = 'en')::INT END AS relevance
  FROM hits_all, (VALUES ('logreg'), ('svm'), ('gpt_zero_shot')) m(model))"""

GOLD = """cand AS (SELECT doc_id AS id, quality AS relevance_true FROM labels WHERE toxic = 0),
ranked AS (
  SELECT id, row_number() OVER (PARTITION BY relevance_true ORDER BY md5('42|' || CAST(id AS VARCHAR)), id) AS rn,
         count(*) OVER (PARTITION BY relevance_true) AS n
  FROM cand),
train AS (SELECT id FROM ranked WHERE rn > ceil(0.2::DOUBLE * n)),
gold AS (
  SELECT l.doc_id AS id, l.quality AS relevance_true, CASE WHEN t.id IS NOT NULL THEN 0 ELSE 1 END AS is_test
  FROM labels l LEFT JOIN train t ON t.id = l.doc_id)"""

POSTS = r"""posts AS (
  SELECT 'p' || CAST(conv_id AS VARCHAR) AS id, split_part(text, chr(10), 1) AS title,
         CASE WHEN strpos(text, chr(10)) > 0 THEN substr(text, strpos(text, chr(10)) + 1) ELSE '' END AS selftext,
         role AS category, conv_id
  FROM conversations WHERE turn = 0),
comments AS (
  SELECT 'c' || CAST(conv_id AS VARCHAR) || '_' || CAST(turn AS VARCHAR) AS id,
         'p' || CAST(conv_id AS VARCHAR) AS post_id, text AS body, conv_id, turn
  FROM conversations WHERE turn > 0)"""

SHEET = """sheet AS (
  SELECT 'sheet_' || p.role AS file, r.conv_id * 100 + r.turn AS row, r.conv_id AS post_id,
         split_part(p.text, chr(10), 1) AS title, p.text AS post_text,
         r.conv_id * 100 + (r.turn + 1) // 2 AS comment_id, c.text AS comment_body,
         CASE WHEN r.turn % 2 = 0 THEN r.conv_id * 100 + 50 + r.turn END AS reply_id,
         CASE WHEN r.turn % 2 = 0 THEN r.text END AS reply_body
  FROM conversations r
  JOIN conversations p ON p.conv_id = r.conv_id AND p.turn = 0
  LEFT JOIN conversations c ON c.conv_id = r.conv_id AND c.turn = 2 * ((r.turn + 1) // 2) - 1
  WHERE r.turn >= 1)"""

RAW = r"""raw0 AS (
  SELECT doc_id,
         source || CASE WHEN lang = 'en' THEN '_comments' ELSE '_submissions' END || '.zst' AS file,
         lang = 'en' AS is_c,
         CAST(doc_id AS VARCHAR) AS id,
         text AS body,
         split_part(text, chr(10), 1) AS title,
         CASE WHEN doc_id % 11 = 3 THEN '[deleted]' WHEN doc_id % 11 = 5 THEN '[Removed]'
              WHEN strpos(text, chr(10)) > 0 THEN substr(text, strpos(text, chr(10)) + 1) ELSE '' END AS selftext,
         1546300800 + n_chars * 40000 AS created_utc
  FROM documents),
raw AS (
  SELECT doc_id, file, CASE WHEN is_c THEN 'comments' ELSE 'submissions' END AS kind,
         doc_id % 97 = 0 OR doc_id % 89 = 1 AS bad, id,
         CASE WHEN is_c THEN body END AS body, CASE WHEN NOT is_c THEN title END AS title,
         CASE WHEN NOT is_c THEN selftext END AS selftext, created_utc
  FROM raw0)"""


def remarked(remarks: list[str], every: int) -> str:
    """CTEs remarked(doc_id, source, text) and remarked_posts(doc_id, title, body)."""
    listed = "[" + ", ".join("'" + r.replace("'", "''") + "'" for r in remarks) + "]"
    return f"""remarked AS (SELECT doc_id, source, text || coalesce({listed}[doc_id % {every} + 1], '') AS text FROM documents),
remarked_posts AS (SELECT doc_id, split_part(text, chr(10), 1) AS title,
         CASE WHEN strpos(text, chr(10)) > 0 THEN substr(text, strpos(text, chr(10)) + 1) ELSE '' END AS body FROM remarked)"""


def text_list(xs: list[str]) -> str:
    return "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in xs) + "]"
