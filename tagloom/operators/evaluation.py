"""Scoring predictions against gold labels, thresholds, disagreement, examples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..lexicon import CLASSICAL_MODELS, DISAGREE_HIGH, DISAGREE_LOW, GPT_MODELS, UNCERT_FULL, UNCERT_HALF
from .sampling import top_n_per_group
from .stats import explode_keywords, usefulness


def _safe_div(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / b).otherwise(F.lit(0.0))


def metric_columns(pred: Column, true: Column, digits: int = 9) -> list[Column]:
    """Aggregates: TP, predicted / actual positives, correct, rows, P / R / F1 (0 on 0/0)."""
    return [
        F.count(F.lit(1)).alias("n_eval"),
        F.count_if((pred == 1) & (true == 1)).alias("tp"),
        F.count_if(pred == 1).alias("pred_pos"),
        F.count_if(true == 1).alias("actual_pos"),
        F.count_if(pred == true).alias("correct"),
    ]


def with_prf(df: DataFrame, digits: int = 9) -> DataFrame:
    p = _safe_div(F.col("tp"), F.col("pred_pos"))
    r = _safe_div(F.col("tp"), F.col("actual_pos"))
    f = _safe_div(2 * p * r, p + r)
    return df.select("*", F.round(p, digits).alias("precision"), F.round(r, digits).alias("recall"),
                     F.round(f, digits).alias("f1"))


def gold_join(preds: DataFrame, gold: DataFrame, model_col: str = "model",
              classical=tuple(CLASSICAL_MODELS), test_col: str = "is_test") -> DataFrame:
    """Predictions x gold on id; classical models only see gold rows with is_test = 1."""
    j = preds.join(gold, "id", "inner")
    classical_lc = [m.lower() for m in classical]
    return j.filter(~F.lower(F.col(model_col)).isin(classical_lc) | (F.col(test_col) == 1))


def gold_eval(preds: DataFrame, gold: DataFrame, pred_col: str = "relevance_pred",
              true_col: str = "relevance_true", model_col: str = "model", digits: int = 9) -> DataFrame:
    """Per model: counts and precision / recall / F1 against the gold labels."""
    j = gold_join(preds, gold, model_col)
    agg = j.groupBy(model_col).agg(*metric_columns(F.col(pred_col), F.col(true_col)))
    return with_prf(agg, digits)


def confusion_matrix(df: DataFrame, true_col: str, pred_col: str, group_cols: list[str] | None = None,
                     labels=(0, 1)) -> DataFrame:
    """Long confusion counts for every (true, pred) pair of ``labels`` (0 filled)."""
    g = group_cols or []
    aggs = [F.count_if((F.col(true_col) == t) & (F.col(pred_col) == p)).alias(f"t{t}_p{p}")
            for t in labels for p in labels]
    wide = df.groupBy(*g).agg(*aggs)
    return wide.unpivot(g, [f"t{t}_p{p}" for t in labels for p in labels], "cell", "count") \
        .select(*g, F.regexp_extract("cell", r"^t(\d+)_", 1).cast("int").alias("true_label"),
                F.regexp_extract("cell", r"_p(\d+)$", 1).cast("int").alias("pred_label"), "count")


def class_report(df: DataFrame, true_col: str, pred_col: str, group_cols: list[str] | None = None,
                 labels=(0, 1), digits: int = 9) -> DataFrame:
    """Per class precision / recall / F1 / support plus macro and weighted averages."""
    g = group_cols or []
    pred, true = F.col(pred_col), F.col(true_col)
    # one conditional aggregate over the input, then a row a class
    counts = [F.struct(F.lit(str(c)).alias("class"), F.count_if((pred == c) & (true == c)).alias("tp"),
                       F.count_if(pred == c).alias("pred_pos"), F.count_if(true == c).alias("support")) for c in labels]
    per = df.groupBy(*g).agg(F.array(*counts).alias("_c")).select(*g, F.explode("_c").alias("_c")).select(*g, "_c.*")
    p = _safe_div(F.col("tp"), F.col("pred_pos"))
    r = _safe_div(F.col("tp"), F.col("support"))
    per = per.select(*g, "class", p.alias("precision"), r.alias("recall"),
                     _safe_div(2 * p * r, p + r).alias("f1"), "support")
    # averages: macro = plain mean over classes, weighted = support-weighted mean
    every = F.collect_list(F.struct("class", "precision", "recall", "f1", "support"))  # a row a class
    w = F.sum("support")
    means = [F.struct(F.lit("macro avg").alias("class"), F.avg("precision").alias("precision"), F.avg("recall").alias("recall"),
                      F.avg("f1").alias("f1"), w.alias("support")),
             F.struct(F.lit("weighted avg").alias("class"),
                      *[_safe_div(F.sum(F.col(c) * F.col("support")), w).alias(c) for c in ("precision", "recall", "f1")],
                      w.alias("support"))]
    out = per.groupBy(*g).agg(F.concat(every, F.array(*means)).alias("_r")).select(*g, F.explode("_r").alias("_r")).select(*g, "_r.*")
    return out.select(*g, "class", *[F.round(c, digits).alias(c) for c in ("precision", "recall", "f1")],
                      F.col("support").cast("long").alias("support"))


def threshold_filter_eval(full: DataFrame, gold: DataFrame, model: str, exclude_kfails: bool = True,
                          min_kw_freq: int = 0, min_kw_hit: float = 0.0, min_kw_score: float = 0.0,
                          min_sub_freq: int = 0, min_sub_hit: float = 0.0, min_sub_score: float = 0.0,
                          excluded: str = "zero", digits: int = 9) -> DataFrame:
    """Keyword / subreddit threshold filter as a classifier, scored on gold.

    ``full`` has id, subreddit, keyword (comma list), model, subset,
    relevance, ord (a unique row order used to keep the first row per id).
    Subreddits over the minima are found first, then keywords over the
    minima within those subreddits; ids with a surviving keyword keep their
    prediction, the other ids get 0 (``excluded="zero"``) or are dropped
    (``"drop"``). One row of metrics.
    """
    base = full.filter(F.col("model") == model)
    if exclude_kfails:
        base = base.filter(~F.col("subset").eqNullSafe("random_kfails"))
    kws = explode_keywords(base, "keyword", "comma")

    subs = usefulness(kws.filter(F.col("subreddit").isNotNull()).groupBy("subreddit").agg(
        F.count("relevance").alias("frequency"), F.avg("relevance").alias("hit_rate")), digits=12)
    keep_subs = subs.filter((F.col("frequency") >= min_sub_freq) & (F.col("hit_rate") >= min_sub_hit)
                            & (F.col("usefulness") >= min_sub_score)).select("subreddit")
    kws_sub = kws.join(keep_subs, "subreddit", "left_semi")
    kwsum = usefulness(kws_sub.groupBy("keyword").agg(
        F.count("relevance").alias("frequency"), F.avg("relevance").alias("hit_rate")), digits=12)
    keep_kw = kwsum.filter((F.col("frequency") >= min_kw_freq) & (F.col("hit_rate") >= min_kw_hit)
                           & (F.col("usefulness") >= min_kw_score)).select("keyword")
    ids = kws_sub.join(keep_kw, "keyword", "left_semi").select("id").distinct().withColumn("_in", F.lit(True))

    marked = base.join(ids, "id", "left").withColumn("_in", F.coalesce("_in", F.lit(False)))
    if excluded == "drop":
        marked = marked.filter("_in")
    pred = F.when(F.col("_in"), F.col("relevance")).otherwise(F.lit(0))
    # first row per id: included rows come before excluded ones, then input order
    first = (marked.groupBy("id")
             .agg(F.min_by(pred, F.struct((~F.col("_in")).alias("x"), F.col("ord"))).alias("relevance_pred")))
    j = gold_join(first.withColumn("model", F.lit(model)), gold)
    # one aggregation over both inputs (tagged union) instead of joining two one-row results
    both = (j.select(F.lit(True).alias("_e"), "relevance_pred", "relevance_true")
            .unionByName(first.select(F.lit(False).alias("_e"), "relevance_pred",
                                      F.lit(None).cast("int").alias("relevance_true"))))
    e = F.col("_e")
    pr, tr = F.col("relevance_pred"), F.col("relevance_true")
    m = both.agg(
        F.count_if(e).alias("n_eval"),
        F.count_if(e & (pr == 1) & (tr == 1)).alias("tp"),
        F.count_if(e & (pr == 1)).alias("pred_pos"),
        F.count_if(e & (tr == 1)).alias("actual_pos"),
        F.count_if(e & (pr == tr)).alias("correct"),
        F.count_if(~e).alias("total"),
        F.coalesce(F.sum(F.when(~e, pr)), F.lit(0)).cast("long").alias("predicted_relevant"))
    return with_prf(m, digits)


def self_metrics(full: DataFrame, kept: DataFrame, rel_col: str = "relevance", digits: int = 9) -> DataFrame:
    """A filter scored by its own labels: precision = relevant share of the kept
    rows, recall = their part of all relevant rows (0 on 0/0). One row."""
    both = full.select(F.lit(False).alias("_k"), F.col(rel_col).alias("_r")).unionByName(
        kept.select(F.lit(True).alias("_k"), F.col(rel_col).alias("_r")))
    m = both.agg(F.count_if("_k").alias("total"),
                 F.coalesce(F.sum(F.when(F.col("_k"), F.col("_r"))), F.lit(0)).cast("long").alias("relevant"),
                 F.coalesce(F.sum(F.when(~F.col("_k"), F.col("_r"))), F.lit(0)).cast("long").alias("all_relevant"))
    p = _safe_div(F.col("relevant"), F.col("total"))
    r = _safe_div(F.col("relevant"), F.col("all_relevant"))
    return m.select("*", F.round(p, digits).alias("precision"), F.round(r, digits).alias("recall"),
                    F.round(_safe_div(2 * p * r, p + r), digits).alias("f1"))


def model_disagreement(preds: DataFrame, id_col: str = "id", pred_col: str = "predicted_label") -> DataFrame:
    """Per id: mode of the predictions (lowest on ties), models that differ, models, ratio.

    A null prediction differs from the mode (it is not equal to it) but is
    not counted among the models.
    """
    per = preds.groupBy(id_col, pred_col).agg(F.count(F.lit(1)).alias("_n"))
    named = F.col(pred_col).isNotNull()
    # the mode: most rows, then the lowest label
    best = F.min(F.when(named, F.struct((-F.col("_n")).alias("n"), F.col(pred_col).alias("label"))))
    out = per.groupBy(id_col).agg(best.alias("_b"), F.sum(F.when(named, F.col("_n")).otherwise(0)).alias("total_models"),
                                  F.sum("_n").alias("_rows"))
    out = out.select(id_col, F.col("_b.label").alias("mode_label"),
                     (F.col("_rows") + F.coalesce(F.col("_b.n"), F.lit(0))).alias("disagreeing_models"), "total_models")
    return out.filter(F.col("total_models") > 0).select(
        "*", F.round(F.col("disagreeing_models") / F.col("total_models"), 9).alias("disagreement_ratio"))


def outcome_category(tp: Column, fp: Column, fn: Column, tn: Column) -> Column:
    return (F.when(tp, F.lit("true_positive")).when(fp, F.lit("false_positive"))
            .when(fn, F.lit("false_negative")).when(tn, F.lit("true_negative")))


def example_rows(df: DataFrame, per_group: int = 10, order_col: str = "id") -> DataFrame:
    """At most ``per_group`` controversial and low-confidence rows per model and
    at most ``per_group`` per (model, outcome category); concatenated.

    ``df`` is the full-text examples table (id, model, predicted_label,
    gold_label, confidence, low_confidence, text, true_positive,
    false_positive, false_negative, true_negative). "First" means lowest
    ``order_col`` (the original relied on input order). (id, model) must be a key
    of ``df``, as in the examples table: texts are fetched by it, so a pair that
    repeats would come out once for each pair of its rows.
    """
    narrow = df.drop("text")
    dis = model_disagreement(narrow, "id", "predicted_label").select("id", "disagreement_ratio")
    d = narrow.join(dis, "id", "left").filter(F.col("predicted_label").isNotNull() & F.col("gold_label").isNotNull())
    outcome = outcome_category(F.col("true_positive"), F.col("false_positive"), F.col("false_negative"), F.col("true_negative"))
    categories = F.array(
        F.when((F.col("disagreement_ratio") > 0.5) & (F.col("predicted_label") != F.col("gold_label")), F.lit("controversial")),
        F.when(F.col("low_confidence") == 1, F.lit("low_confidence")), outcome)
    cols = ["model", "id", "predicted_label", "confidence", "gold_label", "low_confidence"]
    tagged = d.select(*dict.fromkeys([*cols, order_col]), F.explode(F.filter(categories, lambda c: c.isNotNull())).alias("category"))
    picked = top_n_per_group(tagged, ["model", "category"], [F.col(order_col)], per_group, "rownum")
    # texts only for the rows picked (at most per_group x 6 a model), chosen without them
    texts = df.select("id", "model", "text")
    return texts.join(F.broadcast(picked), ["id", "model"]).select(
        "model", "id", "predicted_label", "confidence", "gold_label", "text", "category", "low_confidence", "rownum")


def priority_score(allpreds: DataFrame, gpt_models=tuple(GPT_MODELS)) -> DataFrame:
    """Per (id, subreddit, keyword): share of label 1, disagreement band,
    confidence band and their sum. GPT confidences are first mapped to .5 + .5c.
    """
    d = allpreds.filter(~F.col("subset").eqNullSafe("gold_label") & ~F.col("model").eqNullSafe("xgboost"))
    conf = F.col("confidence").cast("double")
    d = d.withColumn("confidence", F.when(F.col("model").isin(list(gpt_models)), 0.5 + 0.5 * conf).otherwise(conf))
    d = explode_keywords(d, "keyword", "comma")
    g = d.groupBy("id", "subreddit", "keyword").agg(
        F.count_if(F.col("relevance") == 1).alias("_ones"), F.count("relevance").alias("_n"),
        F.avg("confidence").alias("avg_conf"))
    p = F.when(F.col("_n") > 0, F.col("_ones") / F.col("_n")).otherwise(F.lit(0.0))
    dis = ((p >= DISAGREE_LOW) & (p <= DISAGREE_HIGH)).cast("int")
    a = F.col("avg_conf")
    unc = (F.when(a.isNull(), 0.0)
           .when((a >= UNCERT_HALF[0]) & (a < UNCERT_HALF[1]), 0.5)
           .when((a >= UNCERT_FULL[0]) & (a < UNCERT_FULL[1]), 1.0).otherwise(0.0))
    return g.select("id", "subreddit", "keyword",
                    F.round(dis + unc, 9).alias("priority_score"), dis.alias("disagreement"),
                    unc.alias("uncertainty"), F.round(a, 9).alias("avg_conf"), F.round(p, 9).alias("relevance_split"))


def labelling_progress(df: DataFrame, label_col: str = "label", order_col: str = "id") -> DataFrame:
    """labelled / total and the first unlabelled row (by ``order_col``)."""
    return df.agg(
        F.count(label_col).alias("labelled"), F.count(F.lit(1)).alias("total"),
        F.round(F.count(label_col) / F.count(F.lit(1)), 9).alias("share"),
        F.min(F.when(F.col(label_col).isNull(), F.col(order_col))).alias("first_unlabelled"))
