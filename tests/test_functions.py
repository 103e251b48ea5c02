import math
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from flowmill.functions import columns as c


def one(spark, expression, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expression(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize("value, expected", [("3.5", 3.5), ("x", None), ("NaN", None), ("", None), (None, None), ("-1", -1.0)])
def test_number(spark, value, expected):
    assert one(spark, c.number, value) == expected


@pytest.mark.parametrize("value, expected", [("T", 1), ("true", 1), ("F", 0), ("t", 0), (None, 0)])
def test_true_flag(spark, value, expected):
    assert one(spark, c.true_flag, value) == expected


def test_nulls_of_logs_stay_missing(spark):
    assert one(spark, c.log_of, None, "double") is None
    assert one(spark, lambda x: c.filled(c.log_of(x)), None, "double") == -1.0
    assert one(spark, c.log_of, -5.0, "double") == 0.0


@pytest.mark.parametrize("value, expected", [("http", 0), ("quic", 1), (None, 0)])
def test_other(spark, value, expected):
    assert one(spark, lambda x: c.other(x, ["http", "dns"]), value) == expected


def test_first_of(spark):
    assert one(spark, lambda x: c.first_of(x, False), "a,b") == "a"
    assert one(spark, lambda x: c.first_of(x, True), [], "array<string>") is None
    assert one(spark, lambda x: c.first_of(x, True), None, "array<string>") is None


def test_ordinal_of_unknown_is_missing(spark):
    assert one(spark, lambda x: c.ordinal(x, ["a", "b"]), "b") == 1.0
    assert one(spark, lambda x: c.ordinal(x, ["a", "b"]), "z") is None


def by_hand(text):
    n = len(text)
    return -sum(k / n * math.log2(k / n) for k in Counter(text).values()) if n else None


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(st.characters(max_codepoint=0x2FFF, exclude_categories=["Cs"]), max_size=20), min_size=1, max_size=20))
def test_entropies_agree(spark, texts):
    rows = spark.createDataFrame([(t,) for t in texts], "x string").select("x", c.entropy(F.col("x")).alias("a"), c.long_text_entropy("x").alias("b")).collect()
    for r in rows:
        expected = by_hand(r["x"])
        assert r["a"] == (None if expected is None else pytest.approx(expected, abs=1e-9))
        assert r["b"] == (None if expected is None else pytest.approx(expected, abs=1e-9))
        assert expected is None or -1e-9 <= r["a"] <= math.log2(len(r["x"])) + 1e-9


@pytest.mark.parametrize("value, digits, expected", [(0.559375, 5, 0.55937), (0.129875, 5, 0.12987), (2.5, 0, 3.0), (-2.5, 0, -3.0), (3.5, 0, 4.0), (-0.0, 3, 0.0), (1e17, 5, 1e17), (None, 5, None)])
def test_rounding_in_doubles(spark, value, digits, expected):
    """The first two lie below their half as doubles scale, and a decimal of their digits would go up."""
    assert one(spark, lambda x: c.rounded_half_up(x, digits), value, "double") == expected


def test_entropy_looks_at_each_text_once_per_character(spark):
    """No sorted list of characters, and code points beyond 16 bits are one."""
    df = spark.createDataFrame([("a\U0001f600b\U0001f600\n",)], "x string").select(c.entropy(F.col("x")).alias("y"))
    assert abs(df.first()["y"] - 1.9219280948873623) < 1e-12
    assert "sort_array" not in df._jdf.queryExecution().optimizedPlan().toString()
