from __future__ import annotations

import datetime
import math

import pytest
from pyspark.sql import functions as F

from riskloom.functions import columns as C
from riskloom.functions import scorecards as S
from riskloom.operators import features as Fe
from riskloom.operators import targets as T


def values(spark, inputs, kind, expression):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], f"i int, x {kind}")
    return [r[0] for r in df.orderBy("i").select(expression).collect()]


def test_clip_keeps_null(spark):
    assert values(spark, [None, -1.0, 0.5, 9.0], "double", C.clip("x", 0.0, 1.0)) == [None, 0.0, 0.5, 1.0]


def test_rates(spark):
    got = values(spark, ["13.99%", " 0.9%", "0.1399", "abc", None, "25"], "string", C.clean_rate("x"))
    assert got == [pytest.approx(0.1399), 0.9, 0.1399, None, None, 0.25]


def test_employment(spark):
    inputs = ["10+ years", "< 1 year", "1 year", "n/a", None, "less than a year", "7 years"]
    assert values(spark, inputs, "string", C.clean_emp_length("x")) == [10.0, 0.5, 1.0, 5.0, 5.0, 0.5, 7.0]
    assert values(spark, [5.0, 10.0, 0.5, None], "double", C.clean_emp_length("x", numeric=True)) == [5.0, 10.0, 0.5, 5.0]


def test_terms(spark):
    assert values(spark, [" 36 months", "60", None, "none"], "string", C.clean_term("x")) == [36, 60, 36, 36]


def test_issue_month(spark):
    assert values(spark, ["Dec-2015", "2015", None], "string", C.parse_issue_month("x")) == [datetime.date(2015, 12, 1), None, None]


def test_grade_number(spark):
    assert values(spark, ["A", "G", "X", None], "string", C.grade_number("x")) == [1, 7, 4, 4]


def test_intervals_and_slots(spark):
    edges = [0.0, 1.0, 2.0, 3.0]
    inputs = [-0.1, 0.0, 1.0, 1.5, 2.0, 3.0, 3.1, None]
    assert values(spark, inputs, "double", C.interval("x", edges)) == [None, 0, 0, 1, 1, 2, None, None]
    assert values(spark, inputs, "double", C.histogram_slot("x", edges)) == [None, 0, 1, 1, 2, 2, None, None]


def test_quarter_label(spark):
    assert values(spark, [datetime.date(2017, 8, 1)], "date", C.quarter_label("x")) == ["2017-3T3"]


def test_points_and_ratings(spark):
    assert values(spark, [0.001, 0.5, 0.999], "double", S.points("x")) == [849, 575, 300]
    assert values(spark, [0.03, 0.031, 0.32, 0.33], "double", S.rating("x")) == ["A", "B", "F", "G"]
    assert values(spark, [0.05, 0.35, 0.36], "double", S.rating("x", "basic")) == ["A", "F", "G"]


def test_pd_of_a_standard_request(spark):
    df = spark.range(1).select(S.pd_basic(F.lit(720.0), F.lit(18.5), F.lit(11.99), F.lit(75000.0), F.lit(5.0)).alias("p"))
    log_odds = -4.5 - 0.3 + 0.74 + 0.8393 - 0.6 - 0.15
    assert df.first()["p"] == pytest.approx(1 / (1 + math.exp(-log_odds)))


def test_exposure(spark):
    parts = S.ead_parts(F.lit(20000.0), F.lit(10000.0), F.lit(12000.0), F.lit("revolving"))
    row = spark.range(1).select(*(c.alias(n) for n, c in parts.items())).first()
    assert (row["drawn"], row["undrawn"], row["ccf"], row["ead"]) == (10000.0, 0.0, 0.525, 10000.0)


def test_targets_on_literal_loans(spark):
    rows = [
        (1, "Charged Off", 1000.0, 100.0, None, "A"),   # loss 0.9
        (2, "Charged Off", 1000.0, None, 900.0, "A"),   # no recovery: the grade's mean
        (3, "Default", 1000.0, 5000.0, 1000.0, "B"),    # over-recovered: lower limit
        (4, "Late (31-120 days)", 1000.0, 0.0, 1000.0, "C"),  # alone in its grade: fallback
        (5, "Fully Paid", 1000.0, 0.0, 1000.0, "A"),
        (6, None, 1000.0, 0.0, 1000.0, "A"),
        (7, "Default", 0.0, 0.0, 0.0, "A"),
    ]
    df = spark.createDataFrame(rows, "loan_id int, loan_status string, loan_amnt double, recoveries double, funded_amnt double, grade string")
    got = {r["loan_id"]: r for r in T.build_targets(df).collect()}
    assert [got[i]["is_default"] for i in range(1, 8)] == [True, True, True, True, False, False, True]
    assert got[1]["lgd"] == pytest.approx(0.9) and got[2]["lgd"] == pytest.approx(0.9)
    assert got[3]["lgd"] == 0.05 and got[4]["lgd"] == 0.65
    assert got[5]["lgd"] is None and got[7]["lgd"] is None
    assert got[1]["ead"] == 1000.0 and got[2]["ccf"] == pytest.approx(0.9) and got[5]["ccf"] is None


def test_cleaning_twice_changes_nothing(spark):
    df = spark.createDataFrame([("13.99%", "10+ years", " 60 months")], "int_rate string, emp_length string, term string")
    once = Fe.clean_fields(df)
    twice = Fe.clean_fields(once)
    assert once.collect() == twice.collect()


def test_verified_text(spark):
    df = spark.createDataFrame(
        [("Verified",), ("Not Verified",), (None,)], "verification_status string"
    ).selectExpr("*", "1D loan_amnt", "1D annual_inc", "1 fico_range_low", "1 fico_range_high", "1D installment",
                 "'OWN' home_ownership", "36 term_months", "'A' grade")
    assert [r["is_verified"] for r in Fe.derive_features(df).collect()] == [1, 1, 0]
    assert [r["is_verified"] for r in Fe.derive_features(df, strict_verified=True).collect()] == [1, 0, 0]


def test_sanitize(spark):
    df = spark.createDataFrame([(float("nan"), "abcdef"), (float("inf"), "ab"), (1.0, None)], "x double, grade string")
    assert [tuple(r) for r in Fe.sanitize(df).collect()] == [(None, "ab"), (None, "ab"), (1.0, None)]
