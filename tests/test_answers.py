import random

import pytest
from pyspark.sql import functions as F

import spec
from rolltally.functions import answers as A
from rolltally.functions import prompts as P
from rolltally.operators.vote import with_answers

B = "\\boxed{"
NBSP = " "
TEXTS = [
    None,
    "",
    "no box",
    B + "5}",
    B + "}",
    B + " }",
    B + "5",
    "a " + B + "1} b " + B + "2} c",
    B + "1}</think> then " + B + "2}",
    B + "1}</think> none",
    "x</think>" + B + "3}</think>" + B + "4}",
    B + "\\frac{1}{2}} tail",
    B + "{a{b}c}{d}} tail }",
    B + "1} then " + B + "2",
    B + "1} then \\boxed {2}",
    B + "1} then \\boxed",
    "\\boxed 5}",
    B + "\n\t" + NBSP + "7" + NBSP + "\x1c\n}",
    B + "a\nb}\n",
    "}" * 5 + B + "{}}",
]


@pytest.mark.parametrize("rule,want", [("first", spec.first_box), ("last", spec.last_box)])
def test_extraction_cases(spark, rule, want):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, completion string")
    got = {r.i: r.answer for r in with_answers(df, rule=rule).collect()}
    assert got == {i: want(t) for i, t in enumerate(TEXTS)}


def test_extraction_random(spark):
    rng = random.Random(7)
    pieces = ["{", "}", "\\boxed{", "\\boxed", "</think>", "1", " ", "\\frac{1}{2}", "x"]
    texts = ["".join(rng.choices(pieces, k=rng.randint(0, 14))) for _ in range(3000)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    out = df.select("i", A.extract_boxed_first(F.col("t")).alias("a"), A.extract_boxed_last(F.col("t")).alias("b"))
    for r in out.collect():
        assert (r.a, r.b) == (spec.first_box(texts[r.i]), spec.last_box(texts[r.i])), texts[r.i]


def keys(spark, values, build=A.answer_key):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, a string")
    return [r.k for r in df.select("i", build(F.col("a")).alias("k")).orderBy("i").collect()]


SAME = [
    ["3", "3.0", " 3 ", "6:2", "\\frac{6}{2}", "6/2", "$3$", "+3", "3.", "\\dfrac{6}{2}", "\\frac62", "x=3", "x = 3", "\\text{3}", "3^{1}", "\\sqrt{9}", "03"],
    ["-1/2", "-0.5", "\\frac{-1}{2}", "-\\frac{1}{2}", "-1:2", "\\frac{1}{-2}", "-\\frac12", "-.5"],
    ["1,234,567", "1234567", "1\\,234\\,567", "1{,}234{,}567", "$1,234,567$"],
    ["1/3", "0.3333333", "\\tfrac{1}{3}", "\\frac13", "\\frac{1}3", "\\frac1{3}"],
    ["2\\frac{1}{3}", "7/3", "2\\frac13", "\\frac{7}{3}", "2 \\frac{1}{3}"],
    ["-2\\frac{1}{2}", "-2.5", "-\\frac{5}{2}"],
    ["50\\%", "50%", "50 \\%"],
    ["90^\\circ", "90", "90^{\\circ}", "90°", "90\\degree"],
    ["10^3", "1\\times 10^3", "1000", "10^{3}", "1 \\cdot 10^{3}", "1,000"],
    ["2.5\\times10^{-2}", "0.025", "1/40"],
    ["-2^{3}", "-8"],
    ["\\text{Monday}", "Monday", "\\mathrm{monday}", "\\textbf{Monday}"],
    ["\\left(1,2\\right)", "(1, 2)", "(1,2)", "(1.0, 4/2)", "\\left( 1, \\frac{4}{2} \\right)"],
    ["\\{1,2\\}", "\\{2, 1\\}", "{1,2}", "\\left\\{2,1\\right\\}"],
    ["1, 234", "1,  234"],
    ["[0, \\frac12)", "[0,0.5)"],
    ["2\\sqrt{3}", "\\sqrt{12}", "2\\sqrt3", "2 \\cdot \\sqrt{3}"],
    ["\\frac{\\sqrt{3}}{2}", "\\frac{1}{2}\\sqrt{3}", "\\frac{\\sqrt3}{2}"],
    ["-\\sqrt{2}", "-1\\sqrt{2}"],
    ["\\frac{\\pi}{1}", "\\pi", "1\\pi"],
    ["\\frac{\\pi}{2}", "\\frac{1}{2}\\pi", "0.5\\pi", "\\frac{2\\pi}{4}"],
    ["-3\\pi", "-3 \\pi"],
    ["E", " e ", "\\text{E}"],
    ["X + 1", "x+1"],
    ["9" * 60, "+" + "9" * 60, "0" + "9" * 60, "9" * 60 + ".0"],
    ["123456789012345678901/123456789012345678901", "1"],
    ["1/0.0000001", "10000000"],
]


@pytest.mark.parametrize("same", SAME, ids=lambda s: s[0][:20])
def test_equivalent_answers_share_a_key(spark, same):
    got = keys(spark, same)
    assert len(set(got)) == 1 and got[0] is not None, dict(zip(same, got))


def test_different_answers_have_different_keys(spark):
    """The first of each row above, and some that must not be merged with any."""
    odd = ["1/0", "nan", "inf", "Infinity", "1" * 60, "1e5", "(1,234)", "0:0", "1:2:3", "\\frac{1}{0}", "(2,1)", "[1,2]", "1234", "\\sqrt{3}", "2^x", "\\pi r", "50", "a=b=c"]
    values = [s[0] for s in SAME if s[0] not in ("123456789012345678901/123456789012345678901",)] + odd
    got = keys(spark, values)
    assert None not in got and len(set(got)) == len(values), sorted(zip(got, values))


def test_keys_of_odd_answers(spark):
    odd = ["1/0", "nan", "inf", "Infinity", "1e5x", "0:0", "1:2:3", "\\frac{1}{0}"]
    got = keys(spark, odd)
    assert all(k.startswith("t:") for k in got) and len(set(got)) == len(odd)
    assert keys(spark, [None, "", " \n"]) == [None, None, None]
    assert keys(spark, ["0", "-0", "0.0"]) == ["n:0.000000"] * 3


def test_text_forms(spark):
    df = spark.createDataFrame([(" $A b" + NBSP + "C$ ",)], "a string")
    row = df.select(A.normalize_answer(F.col("a")).alias("v"), A.normalize_answer_eval(F.col("a")).alias("e")).first()
    assert row.v == "$abc$" and row.e == "ab" + NBSP + "c"


@pytest.mark.parametrize(
    "answer,want", [("3:4", "\\frac{3}{4}"), (" -1.5 : 2 ", "\\frac{-1.5}{2}"), ("1:2:3", "1:2:3"), ("a:b", "a:b"), ("+1:2", "+1:2")]
)
def test_ratio(spark, answer, want):
    df = spark.createDataFrame([(answer,)], "a string")
    assert df.select(A.ratio_to_fraction(F.col("a"))).first()[0] == want


@pytest.mark.parametrize(
    "answer,continuation,want",
    [
        ("5", "6}", "5"),
        (None, "6}}} ", "6}}}"),
        (None, "6}}}", "6"),
        (None, " 7 }", "7"),
        ("", " }", ""),
        (None, "}}", None),
        (None, None, None),
        ("", "8", "8"),
    ],
)
def test_repair(spark, answer, continuation, want):
    df = spark.createDataFrame([(answer, continuation)], "a string, c string")
    assert df.select(P.merge_repair(F.col("a"), F.col("c"))).first()[0] == want


def test_forced_prefix(spark):
    df = spark.createDataFrame([("still thinking",), ("x</think> y",)], "c string")
    got = [r[0] for r in df.select(P.forced_prefix(F.col("c"))).collect()]
    assert got == ["</think>\n\n\\boxed{", "\n\n\\boxed{"]


def test_ground_truth_or_solution(spark):
    df = spark.createDataFrame([("so " + B + "4}",), ("plain",), (B + "4",)], "s string")
    assert [r[0] for r in df.select(A.ground_truth_or_solution(F.col("s"))).collect()] == ["4", "plain", B + "4"]
