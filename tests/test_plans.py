"""Plan regressions: the scale properties the design relies on stay true."""

import re

from pyspark.sql import functions as F

import __spark_entry__ as E
from tagloom import lexicon as L
from tagloom.operators import matching as M
from tagloom.operators import sampling as SA
from tests.conftest import SF_SMALL


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_phrase_match_is_one_narrow_pass(spark):
    d = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text")
    plan = plan_of(M.keyword_match(d, "text", L.FILTERING_PHRASES))
    assert "Join" not in plan and "Aggregate" not in plan and "Exchange" not in plan
    assert plan.count("Generate") == 1
    # the tokenizer appears once: the filter was not inlined below the fence
    assert len(re.findall(r"split\(", plan)) == 1


def test_exact_cut_has_no_nested_loop(spark):
    df = spark.range(0, 1000).select(F.col("id"), F.md5(F.col("id").cast("string")).alias("h"))
    plan = plan_of(SA.bottom_k_flags(df, [], "h", 10, "sel", ["id"]))
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_staged_consumers_do_not_rescan_documents(spark):
    E.queries()["keyword_hit_rate"](spark, SF_SMALL).count()  # stages the hit index
    plan = plan_of(E.queries()["threshold_filter_eval"](spark, SF_SMALL))
    assert "documents.parquet" not in plan


def test_top_n_ranks_inside_salted_groups(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df = spark.range(0, 100).select("id", (F.col("id") % 2).alias("g"))
        plan = plan_of(SA.top_n_per_group(df, ["g"], [F.col("id")], 3, "rk"))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert "_salt" in plan and "WindowGroupLimit" in plan


def executed_scans(df, what):
    """Scans of files whose path has ``what`` in the plan as run (reused exchanges count once)."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    plan = plan.split("== Initial Plan ==")[0]
    return plan.count("FileScan parquet") if not what else len([x for x in plan.split("FileScan parquet")[1:] if what in x[:1500]])


def test_reports_read_their_input_once(spark):
    from tagloom.operators import agreement as AG
    from tagloom.operators import evaluation as EV
    path = __import__("tempfile").mkdtemp(prefix="tagloom-plan-", dir="/tmp") + "/t"
    spark.range(0, 200).selectExpr("id", "cast(id % 2 as int) as a", "cast(id % 3 = 0 as int) as b", "'m' as model").write.parquet(path)
    t = spark.read.parquet(path)
    assert executed_scans(EV.class_report(t, "a", "b", ["model"]), "") == 1
    assert executed_scans(EV.model_disagreement(t, "id", "a"), "") == 1
    assert executed_scans(AG.cohen_kappa(t, "a", "b"), "") == 1


def test_example_rows_move_no_text_before_the_last_join(spark):
    df = E.queries()["example_rows"](spark, SF_SMALL)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    for line in plan.splitlines():
        if "Window" in line or "Aggregate" in line:
            assert "text#" not in line


def test_phrase_match_cost_does_not_hold_the_lexicon_as_regexes(spark):
    d = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text")
    plan = plan_of(M.keyword_match(d, "text", [f"word{i} two" for i in range(5000)]))
    assert "from_json" not in plan and "Exchange" not in plan and plan.count("Generate") == 1


def test_a_cluster_without_a_shared_folder_is_refused(spark):
    import pytest
    from tagloom import session

    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return Conf()

        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError):
        session.ensure_checkpoint_dir(Session())


def test_stages_follow_a_rewritten_input(spark):
    import tempfile
    from tagloom.plans import standins as S
    base = tempfile.mkdtemp(prefix="tagloom-stage-", dir="/tmp")
    d = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    spark.read.parquet(f"{SF_SMALL}/labels.parquet").write.parquet(f"{base}/labels.parquet")
    d.filter("doc_id < 50").write.parquet(f"{base}/documents.parquet")
    assert S.hit_index(spark, base).count() == 50
    assert S.hit_index(spark, base) is S.hit_index(spark, base)
    d.filter("doc_id < 70").write.mode("overwrite").parquet(f"{base}/documents.parquet")
    assert S.hit_index(spark, base).count() == 70


def test_stages_prune_columns(spark):
    from tagloom.plans import standins as S
    plan = plan_of(S.predictions(spark, SF_SMALL).select("id"))
    assert "ReadSchema: struct<id:bigint>" in plan


def test_regexes_run_once(spark):
    """No regex of a label table or dose pattern is evaluated twice."""
    from tagloom import lexicon as L
    from tagloom.operators import matching as M
    from tagloom.operators import threads as TH
    rules = [(r"\balpha\b", "a"), (r"\bbeta", "b"), (r"gamma", "c")]
    df = spark.createDataFrame([(1, "alpha beta")], "id long, text string")
    assert plan_of(M.regex_label_match(df, "text", rules)).count("RLIKE") == len(rules)
    sheet = spark.createDataFrame([("f", 1, "p", "t alpha", "x", "c", "beta", "r", "gamma")], "file string, row int, post_id string, title string, post_text string, comment_id string, comment_body string, reply_id string, reply_body string")
    assert plan_of(TH.match_by_row(sheet, rules)).count("RLIKE") == 0  # matched cells were written
    assert plan_of(TH.match_by_textid(sheet, rules)).count("RLIKE") == len(rules)
    import __spark_entry__ as E
    assert plan_of(E.queries()["dosage_mentions"](spark, "/root/testdata/sf0.001")).count("regexp_extract_all") == 1
    assert L.DOSAGE_PATTERN
