"""Regex dictionaries: the literal test loses no match and saves the regexes."""

import random

import pytest
from pyspark.sql import functions as F

from tagloom.operators import regex_sets as R


@pytest.mark.parametrize("pattern,want", [
    ("cannabis", {"cannabis"}), ("pour|para|por", {"pour", "para", "por"}), ("(?:hash|weed)s?", {"hash", "weed"}), ("colou?r", {"color", "colour"}),
    (r"\bmedical\s+marijuana\b", {"marijuana"}), ("a.c", set()), ("(abc)*", set()), ("(abc)+", {"abc"}), ("x|cannabis", set()), (r"\p{L}+abc", set()),
    ("[Tt]hc-?oil", {"thc"}), ("straße", {"stra"}), ("(?!foo)bar", {"bar"}), (r"[0-9]+mg", set()), ("ab{2}cde", {"cde"})])
def test_required_literals(pattern, want):
    assert R.required(pattern) == want


def texts_of(r, words):
    return [" ".join(r.choice(words) for _ in range(r.randint(0, 30))) for _ in range(150)]


def test_equal_to_running_all_of_a_thousand(spark):
    r = random.Random(4)
    words = ["".join(r.choice("abcdeiksKIS") for _ in range(r.randint(2, 9))) for _ in range(900)]
    shapes = [lambda a, b: a, lambda a, b: f"{a}|{b}", lambda a, b: rf"{a}\s+{b[:2]}", lambda a, b: f"({a[:-1]})?{b}", lambda a, b: f"{a}[aeiou]", lambda a, b: rf"\b{a}\b", lambda a, b: f"{a}+.{{0,3}}{b}"]
    rules = [(r.choice(shapes)(r.choice(words), r.choice(words)), f"label {r.randrange(400)}") for _ in range(1000)]
    odd = [None, "", "Kſİı", "straße STRASSE", "İs i̇s is", "diſk diKs DISK", "a" * 20000, "é \U0001f600 kis"]
    rules += [("is", "i"), ("disk", "d"), ("straße", "s"), (r"\p{Lu}{2}", "upper"), ("k", "k"), ("isk|dis", "x")]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(odd + texts_of(r, words) + [w.upper() for w in words[:50]])], "id long, text string").repartition(4)
    want = sorted(map(tuple, R.regex_dictionary_match(df, "text", rules, prefilter=False).collect()))
    got = sorted(map(tuple, R.regex_dictionary_match(df, "text", rules, prefilter=True).collect()))
    assert got == want and len(got) > 100


def test_plan_runs_no_regex_for_each_rule(spark):
    df = spark.range(3).select("id", F.lit("some text").alias("text"))
    plan = R.regex_dictionary_match(df, "text", [(f"word{i}", f"l{i}") for i in range(500)])._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and plan.count("RLIKE") <= 1


def test_no_rules_and_empty_table(spark):
    df = spark.createDataFrame([(1, "abc")], "id long, text string")
    assert R.regex_dictionary_match(df, "text", []).count() == 0 and R.regex_dictionary_match(df, "text", [], prefilter=True).count() == 0
    assert R.regex_dictionary_match(df.limit(0), "text", [("abc", "a")] * 40).count() == 0
    assert [x["keyword"] for x in R.regex_dictionary_match(df, "text", [("abc", "a")] * 40).collect()] == ["a"]
