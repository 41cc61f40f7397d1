"""Answer parsing, keyword encodings, confidence bins, hand-made edge rows."""

from pyspark.sql import functions as F

from tagloom.functions import text as T
from tagloom.operators import parsing as PA


def one(spark, value, expr, schema="v string"):
    return spark.createDataFrame([(value,)], schema).select(expr(F.col("v")).alias("o")).first().o


def test_label_block_last_label_line_wins(spark):
    ans = "Label: 1\nConfidence: High\nReasoning: the label is unclear"
    r = one(spark, ans, T.parse_label_block)
    assert (r.label, r.confidence, r.reasoning) == ("the label is unclear", "High", "")
    s = one(spark, ans, T.parse_label_block_strict)
    assert (s.label, s.reasoning) == ("1", "the label is unclear")


def test_label_block_missing_parts(spark):
    r = one(spark, "  just text  ", T.parse_label_block)
    assert (r.label, r.confidence, r.reasoning) == ("", "", "")


def test_parse_score(spark):
    vals = [(" 1 ",), ("2",), ("3",), ("1.0",), ("",), (None,), ("+0",)]
    df = spark.createDataFrame(vals, "v string").select(T.parse_score(F.col("v")).alias("s"))
    assert [r.s for r in df.collect()] == [1, 2, None, None, None, None, 0]


def test_keyword_encodings(spark):
    assert one(spark, "['THC', \"Mary Jane\"]", lambda c: T.keyword_array_parse(c, "pylist")) == ["THC", "Mary Jane"]
    assert one(spark, None, lambda c: T.keyword_array_parse(c, "semicolon")) == [""]
    assert one(spark, " Pain ; SLEEP", lambda c: T.keyword_array_parse(c, "semicolon")) == ["pain", "sleep"]
    assert one(spark, "a, B", lambda c: T.keyword_array_parse(c, "comma")) == ["a", "b"]


def test_confidence_bins(spark):
    vals = [("0.9",), ("0.85",), ("0.7",), ("0.1",), ("n/a",), (None,)]
    df = spark.createDataFrame(vals, "v string").select(T.confidence_bin(F.col("v")).alias("b"),
                                                        T.confidence_bin(F.col("v"), 0.5, 0.85).alias("o"))
    assert [(r.b, r.o) for r in df.collect()] == [("High", "High"), ("High", "High"), ("Medium", "Medium"),
                                                  ("Low", "Low"), ("n/a", "n/a"), (None, None)]


def test_claims_bare_object_and_non_dict(spark):
    rows = [(1, 'x [{"dosage": "<10mg", "compound": "THC"}, 5] y'), (2, '{"dosage": "<10mg"}'), (3, "[")]
    df = spark.createDataFrame(rows, "id int, a string")
    out = sorted((r.id, r.item_no, r.compound, r.error) for r in PA.claims_rows(df, "id", "a").collect())
    assert out == [(1, 0, "THC", None), (1, 1, None, "non-dict object returned"),
                   (2, 0, None, "parse error"), (3, 0, None, "parse error")]


def test_fill_template(spark):
    df = spark.createDataFrame([("k", "t")], "k string, t string")
    r = df.select(PA.fill_template("K={keyword} T={text}", keyword=F.col("k"), text=F.col("t")).alias("p")).first()
    assert r.p == "K=k T=t"


def test_claims_keep_the_type_of_items(spark):
    df = spark.createDataFrame([(1, '["{x", {"dosage": 5, "compound": "CBD"}, "{}", null, [1]]')], "id int, a string")
    got = [(r.item_no, r.dosage, r.compound, r.false_positive) for r in PA.claims_rows(df, "id", "a").orderBy("item_no").collect()]
    assert got == [(0, None, None, True), (1, "5", "CBD", None), (2, None, None, True), (3, None, None, True), (4, None, None, True)]


def test_template_values_are_not_filled_again(spark):
    df = spark.createDataFrame([("{text}", "t {keyword}")], "k string, t string")
    r = df.select(PA.fill_template("K={keyword} T={text} {other}", keyword=F.col("k"), text=F.col("t")).alias("p")).first()
    assert r.p == "K={text} T=t {keyword} {other}"


def test_python_list_reprs(spark):
    from tagloom.functions import text as T
    values = [["a", "b c"], ["it's", 'say "x"'], ["both ' and \"", "back\\slash"], []]
    df = spark.createDataFrame([(i, repr(v)) for i, v in enumerate(values)], "i int, s string")
    got = {r.i: r.a for r in df.select("i", T.keyword_array_parse(F.col("s"), "pylist").alias("a")).collect()}
    assert [got[i] for i in range(len(values))] == values
