"""Model answers: prompts in, scores / label blocks / claim lists out; claim summary."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..lexicon import DOSE_BINS, SUMMARY_COMPOUNDS, SUMMARY_CONDITIONS, SUMMARY_SENTIMENTS
from .sampling import md5_rank_key

CLAIM_FIELDS = ["dosage", "compound", "symptom", "sentiment", "brand"]


def fill_template(template: str, **cols: Column) -> Column:
    """Fill ``{name}`` slots of a template with column values (str.format style).

    The template is split once, so a value that holds a slot's text stays as it is.
    """
    if not cols:
        return F.lit(template)
    parts = re.split("(" + "|".join(re.escape("{" + n + "}") for n in cols) + ")", template)
    return F.concat(*[F.coalesce(cols[p[1:-1]].cast("string"), F.lit("None")) if k % 2 else F.lit(p) for k, p in enumerate(parts)])


def few_shot_block(examples: DataFrame, text_col: str, label_col: str, order_col: str) -> DataFrame:
    """One row: the few drawn examples as "Text: ..\\nRelevance: .." blocks in order."""
    item = F.concat(F.lit("Text: "), F.col(text_col), F.lit("\nRelevance: "), F.col(label_col).cast("string"), F.lit("\n\n"))
    return examples.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order_col).alias("o"),
                                                                                      item.alias("t")))),
                                                 lambda s: s["t"]), "").alias("examples"))


def few_shot_prompts(rows: DataFrame, gold: DataFrame, template: str, id_col: str, text_col: str, label_col: str,
                     shots: int = 7, seed=42) -> DataFrame:
    """(id, prompt) for every row: ``shots`` gold rows, drawn by md5 rank, are
    rendered once and put, with the row's text, into the template's
    ``{examples}`` and ``{text}`` slots."""
    key = md5_rank_key(seed, F.col(id_col))
    drawn = gold.withColumn("_h", F.struct(key, F.col(id_col))).orderBy("_h").limit(shots)
    block = few_shot_block(drawn, text_col, label_col, "_h").first()["examples"]
    return rows.select(id_col, fill_template(template, examples=F.lit(block), text=F.col(text_col)).alias("prompt"))


def claims_rows(answers: DataFrame, id_col: str, answer_col: str) -> DataFrame:
    """Parse claim lists out of free-text answers.

    The JSON array is the text from the first "[" to the last "]". Each
    object becomes a claim row; any other item becomes an error row
    (false_positive = true, error = "non-dict object returned"); an answer
    without a parsable array becomes one error row (error = "parse error").
    Output: id, item_no, the claim fields, false_positive, error.
    """
    a = F.col(answer_col)
    lo = F.instr(a, "[")
    hi = F.length(a) - F.instr(F.reverse(a), "]") + 1
    has = (lo > 0) & (F.instr(a, "]") > 0) & (hi >= lo)
    sliced = F.when(has, F.expr(f"substr({answer_col}, instr({answer_col}, '['), "
                               f"length({answer_col}) - instr(reverse({answer_col}), ']') + 2 - instr({answer_col}, '['))"))
    # variants keep each item's type: a string that opens with "{" is no object
    items = F.from_json(sliced, "array<variant>")
    d = answers.select(id_col, sliced.alias("_slice"), items.alias("_items"))
    ok = d.filter(F.col("_items").isNotNull())
    bad = d.filter(F.col("_items").isNull())
    ex = ok.select(id_col, F.posexplode("_items").alias("item_no", "_it"))
    is_obj = F.coalesce(F.schema_of_variant("_it").startswith("OBJECT"), F.lit(False))
    claim_cols = [F.when(is_obj, F.try_variant_get("_it", f"$.{f}", "string")).alias(f) for f in CLAIM_FIELDS]
    rows = ex.select(id_col, "item_no", *claim_cols,
                     F.when(~is_obj, F.lit(True)).alias("false_positive"),
                     F.when(~is_obj, F.lit("non-dict object returned")).alias("error"))
    errs = bad.select(id_col, F.lit(0).alias("item_no"), *[F.lit(None).cast("string").alias(f) for f in CLAIM_FIELDS],
                      F.lit(True).alias("false_positive"), F.lit("parse error").alias("error"))
    return rows.unionByName(errs)


def dosage_summary(claims: DataFrame, conditions=tuple(SUMMARY_CONDITIONS), sentiments=tuple(SUMMARY_SENTIMENTS),
                   bins=tuple(DOSE_BINS), compounds=tuple(SUMMARY_COMPOUNDS)) -> DataFrame:
    """Long form of the (condition, sentiment) dose x compound tables.

    Only listed conditions, sentiments, bins and compounds count; a compound
    appears in a table when it has any count there, and then with all bins
    (0 filled); tables without counts are left out.
    """
    c = claims.filter(F.col("dosage").isNotNull() & F.col("compound").isNotNull()
                      & F.col("symptom").isin(list(conditions)) & F.col("sentiment").isin(list(sentiments))
                      & F.col("dosage").isin(list(bins)) & F.col("compound").isin(list(compounds)))
    counts = c.groupBy("symptom", "sentiment", "compound", "dosage").agg(F.count(F.lit(1)).alias("count"))
    present = counts.select("symptom", "sentiment", "compound").distinct()
    grid = present.select("*", F.explode(F.array(*[F.lit(b) for b in bins])).alias("dosage"))
    return (grid.join(counts, ["symptom", "sentiment", "compound", "dosage"], "left")
            .select(F.col("symptom").alias("condition"), "sentiment", "dosage", "compound",
                    F.coalesce("count", F.lit(0)).cast("long").alias("count")))

