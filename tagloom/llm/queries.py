"""The registered queries of the operators: thin, over whole tables, with
production parameters; and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, conversation, decontaminate, langid, packing, phrases, secrets, simhash, substring_dedup, token_cache, topk, toxicity, url_filter
from .common import read

TOXIC_FROM = 0.7


def tokenizer() -> str:
    """The tokenizer file of the queries; operators take any path."""
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


def fold(of: int) -> Column:
    """crc32 of doc_id as text, modulo ``of``."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % of


def toxicity_model(spark: SparkSession, docs: DataFrame, sf_dir: str) -> toxicity.Model:
    return toxicity.train(docs, read(spark, sf_dir, "labels"), fold(3) != 1)


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(read(spark, sf_dir, "pages"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    scored = toxicity.score(spark, docs, toxicity_model(spark, docs, sf_dir))
    held_out = F.coalesce(fold(3) == 1, F.lit(False))  # a null id is in no fold
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= TOXIC_FROM).cast("int").alias("predicted"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(spark, read(spark, sf_dir, "documents"), tokenizer())


def op4_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return secrets.scan(spark, docs, secrets.train(docs))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = langid.train(docs, fold(4) != 2)
    held_out = F.coalesce(fold(4) == 2, F.lit(False))  # a null id is in no fold
    return langid.predict(spark, docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    # a cache of its own for each call: the query shows the cost of a cold one
    return token_cache.count(spark, read(spark, sf_dir, "documents"), tokenizer(), token_cache.fresh(spark))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(spark, read(spark, sf_dir, "documents"))


def op8_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(spark, read(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0)


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup(spark, read(spark, sf_dir, "documents"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.pairs_of(spark, read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(spark, read(spark, sf_dir, "documents"), tokenizer())
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "conversations")
    repaired = conversation.repair(spark, conversation.damaged(rows))
    out = rows.select("conv_id").distinct()
    for part in (repaired.reports, conversation.digests(repaired.parts)):  # a conversation may have lost all rows
        out = out.join(part.withColumnRenamed("conv_id", "c"), F.col("conv_id").eqNullSafe(F.col("c")), "left").drop("c")
    return out.na.fill(0, ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]).na.fill("", ["audit"]).na.fill(hashlib.sha256(b"").hexdigest(), ["repaired_sha256"])


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(spark, read(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    op1_url_filters, op2_toxicity, op3_bpe, op4_secret_scans, op5_language_id, op6_token_counts, op7_simhash, op8_topk, op9_substring_dedup, op10_decontamination,
    op11_packing, op12_conversation_repair, op13_phrases)}

TOPK_SQL = """
WITH v AS (SELECT vec_id, [floor(256 * x::DOUBLE) FOR x IN embedding] AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT DISTINCT q.vec_id AS query_id, c.vec_id, max(list_inner_product(q.e, c.e)::BIGINT) OVER (PARTITION BY q.vec_id, c.vec_id) AS score
      FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""".strip()

#: windows as word lists joined by a space; small tables only (the driver's are)
SUBSTRING_SQL = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS rn, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, rn, i, array_to_string(w[i:i + 49], ' ') AS s FROM (SELECT doc_id, rn, w, unnest(range(1, len(w) - 48)) AS i FROM d)),
least_of AS (SELECT s, min(doc_id) AS lo FROM win GROUP BY s),
hit AS (SELECT rn, i FROM win JOIN least_of USING (s) WHERE lo < doc_id),
gone AS (SELECT DISTINCT rn, i + k AS p FROM hit, range(0, 50) t(k)),
keep AS (SELECT rn, string_agg(x, ' ' ORDER BY p) AS t, count(*) AS n FROM (SELECT rn, unnest(w) AS x, generate_subscripts(w, 1) AS p FROM d) ANTI JOIN gone USING (rn, p) GROUP BY rn)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN keep USING (rn)""".strip()

PHRASES_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rn, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, regexp_extract_all(unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS w FROM d),
g AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM p, range(1, 5) t(k))),
f AS (SELECT lang, k, phrase, count(*)::HUGEINT AS f FROM g GROUP BY ALL HAVING count(*) >= 30),
n AS (SELECT lang, count(*) AS n FROM g WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
inside AS (SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, max(a) AS longer
           FROM (SELECT lang, k, w, a, m, unnest(range(1, k - m + 2)) AS i FROM c, range(2, 4) t(m) WHERE m < k) GROUP BY 1, 2),
kept AS (SELECT c.* FROM c LEFT JOIN inside USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 80 * a),
cut AS (SELECT c.lang, c.phrase, c.a, j, l.f AS l, r.f AS r, 2000000 * c.a // (l.f + r.f) AS score
        FROM (SELECT *, unnest(range(1, k)) AS j FROM kept) c
        JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[1:j], ' ') JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[j + 1:], ' ')),
best AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
top AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM best)
SELECT lang, rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score FROM top JOIN n USING (lang) WHERE rank <= 2000""".strip()

ORACLE: dict[str, str] = {
    "op1_url_filters": url_filter.sql(),
    "op8_topk": TOPK_SQL,
    "op9_substring_dedup": SUBSTRING_SQL,
    "op10_decontamination": decontaminate.sql(),
    "op13_phrases": PHRASES_SQL,
}
