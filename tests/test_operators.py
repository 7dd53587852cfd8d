"""Operators on small literal tables and against brute force on skewed ones."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from riskloom.operators import binning as B
from riskloom.operators import exploration as X
from riskloom.operators import loading as L
from riskloom.operators import monitoring as M
from riskloom.operators import scoring as Sc
from riskloom.operators import validation as V
from riskloom.operators.lookup import attach_statistic
from riskloom.operators.quantiles import exact_quantiles
from riskloom.session import work_folder
from riskloom.sources import sinks
from riskloom.streaming import scoring as SS


def scored(spark, pairs, partitions=1):
    df = spark.createDataFrame([(float(s), bool(y)) for s, y in pairs], "score double, is_default boolean")
    return df.repartition(partitions)


# --- discrimination --------------------------------------------------------------
def test_ties_count_half(spark):
    row = V.discrimination(scored(spark, [(0.1, 0), (0.4, 0), (0.4, 1), (0.8, 1)])).first()
    assert (row["auc"], row["gini"], row["ks"]) == (0.875, 0.75, 0.5)


def test_brier(spark):
    assert V.discrimination(scored(spark, [(0.2, 0), (0.6, 1)])).first()["brier"] == pytest.approx(0.10)


@pytest.mark.parametrize("partitions", [1, 4, 64])
def test_discrimination_with_one_hot_score(spark, partitions):
    rng = np.random.default_rng(7)
    s = np.where(rng.random(3000) < 0.35, 0.25, rng.random(3000).round(3))
    y = (rng.random(3000) < 0.1 + 0.5 * s).astype(int)
    bad, good = s[y == 1], s[y == 0]
    auc = ((bad[:, None] > good[None, :]) + 0.5 * (bad[:, None] == good[None, :])).mean()
    grid = np.unique(s)
    ks = max(abs((bad <= g).mean() - (good <= g).mean()) for g in grid)
    row = V.discrimination(scored(spark, zip(s, y), partitions)).first()
    assert row["auc"] == pytest.approx(auc, abs=1e-6) and row["ks"] == pytest.approx(ks, abs=1e-6)


def test_one_class_gives_no_auc(spark):
    row = V.discrimination(scored(spark, [(0.1, 0), (0.4, 0)])).first()
    assert row["auc"] is None and row["n_obs"] == 2


def test_last_calibration_bin_holds_one(spark):
    rows = {r["bin"]: r for r in V.calibration_curve(scored(spark, [(1.0, 1), (0.95, 0), (0.05, 0)])).collect()}
    assert set(rows) == {0, 9} and rows[9]["n"] == 2 and rows[9]["observed_rate"] == 0.5


def test_backtest_gates(spark):
    rows = [(0.1 + 0.001 * i, i < bad, year) for year, n, bad in ((2010, 199, 50), (2011, 300, 9), (2012, 300, 50)) for i in range(n)]
    df = spark.createDataFrame(rows, "score double, is_default boolean, year int").withColumn(
        "issue_d", F.make_date("year", F.lit(1), F.lit(1))
    )
    assert [r["ano"] for r in V.cohort_backtest(df).collect()] == [2012]


def test_discrimination_of_close_scores(spark):
    # closer than any rounding to six digits, with ties, zeros and negative scores
    scores = [0.0, 0.0, -1.5, 1e-9, 1.1e-9, 1.1e-9, 2e-9, 0.3, 0.3 + 1e-12, 7.0]
    bad = [False, True, False, False, True, False, True, False, True, True]
    df = spark.createDataFrame(list(zip(scores, bad)), "score double, is_default boolean")
    row = V.discrimination(df).first()
    pairs = [(a, b) for a, x in zip(scores, bad) if x for b, y in zip(scores, bad) if not y]
    assert row["auc"] == pytest.approx(sum((a > b) + 0.5 * (a == b) for a, b in pairs) / len(pairs), abs=1e-6)
    assert V.roc_points(df).count() == len(set(scores))
    assert V.discrimination(df, digits=6).first()["auc"] != row["auc"]


def test_ten_million_distinct_scores(spark):
    n = 10_000_000
    df = spark.range(n).select(((F.col("id") + 0.5) / n).alias("score"), (F.col("id") % 10 * n < F.col("id") * 10).alias("is_default"))
    plan = V.running_counts(V.score_counts(df))._jdf.queryExecution().toString()
    ids = np.arange(n)
    bad = ids % 10 * n < ids * 10
    below = np.cumsum(~bad)
    auc = below[bad].sum() / (bad.sum() * (~bad).sum())
    row = V.discrimination(df).first()
    assert (row["n_obs"], row["n_defaults"]) == (n, bad.sum()) and row["auc"] == pytest.approx(auc, abs=1e-6)
    # the only window over a whole group orders ranges
    assert "_range" in plan and "windowspecdefinition(score" not in plan


def test_score_ranges_never_fall(spark):
    rng = np.random.default_rng(1)
    x = np.sort(np.concatenate([rng.normal(size=3000), 10.0 ** rng.uniform(-300, 300, 2000), -(10.0 ** rng.uniform(-320, 300, 2000)), [0.0, 5e-324, -5e-324]]))
    df = spark.createDataFrame(pd.DataFrame({"x": x})).select("x", V.score_range(F.col("x")).alias("r")).toPandas().sort_values("x")
    assert df.r.is_monotonic_increasing


# --- quantiles, PSI and WoE ------------------------------------------------------
@pytest.mark.parametrize("n", [1, 2, 7, 500, 20_000])
def test_quantiles_are_exact(spark, n):
    rng = np.random.default_rng(n)
    skewed = np.where(rng.random(n) < 0.4, 3.25, rng.lognormal(10, 2, n))  # one value holds 40 %
    gaps = np.where(rng.random(n) < 0.2, np.nan, rng.normal(size=n))
    df = spark.createDataFrame(pd.DataFrame({"a": skewed, "b": gaps, "c": np.full(n, 5.0)}))
    probs = [0.0, 0.02, 0.1, 0.5, 0.9, 0.98, 1.0]
    got = exact_quantiles(df, ["a", "b", "c"], probs)
    assert got["a"] == pytest.approx(list(np.quantile(skewed, probs)))
    full = gaps[~np.isnan(gaps)]
    assert (got["b"] is None) if len(full) == 0 else got["b"] == pytest.approx(list(np.quantile(full, probs)))
    assert got["c"] == [5.0] * len(probs)


def test_quantiles_of_outliers_and_infinities(spark):
    rng = np.random.default_rng(2)
    wide = np.where(rng.random(5000) < 0.5, -1.7e308, 1.7e308 * rng.random(5000))
    far = np.where(rng.random(5000) < 0.01, 1e300, rng.normal(size=5000))
    ends = np.where(rng.random(5000) < 0.2, np.inf, np.where(rng.random(5000) < 0.3, -np.inf, rng.normal(size=5000)))
    df = spark.createDataFrame(pd.DataFrame({"a": wide, "b": far, "c": ends}))
    probs = [i / 64 for i in range(65)]
    got = exact_quantiles(df, ["a", "b", "c"], probs)
    for c, x in (("a", wide), ("b", far), ("c", ends)):
        ranked = np.sort(x)
        for p, v in zip(probs, got[c]):
            low, high = ranked[int(np.floor(4999 * p))], ranked[int(np.ceil(4999 * p))]
            assert low <= v <= high, (c, p)


def test_folds_hold_the_same_shares_of_each_class(spark):
    from riskloom.operators.loading import stratified_folds

    df = spark.range(3001).select(F.col("id").alias("loan_id"), F.when(F.col("id") % 7 > 0, F.col("id") % 7 > 4).alias("y"))
    got = stratified_folds(df.repartition(5), "y")
    sizes = {(r["y"], r["fold"]): r["count"] for r in got.groupBy("y", "fold").count().collect()}
    for y, n in ((True, sum(i % 7 > 4 for i in range(3001))), (False, sum(0 < i % 7 <= 4 for i in range(3001))), (None, sum(i % 7 == 0 for i in range(3001)))):
        assert sizes[y, "train"] == n * 60 // 100 and sizes[y, "train"] + sizes[y, "calibration"] == n * 80 // 100
    again = stratified_folds(df.coalesce(1), "y")
    assert got.exceptAll(again).count() == 0


def test_psi_of_the_same_sample_is_zero(spark):
    df = spark.range(1000).select((F.col("id") % 97).cast("double").alias("x"))
    assert V.compute_psi(df, df, "x").first()["psi"] == 0.0


def test_psi_keeps_outsiders_in_the_denominator(spark):
    rng = np.random.default_rng(3)
    expected, actual = rng.normal(size=2000), rng.normal(0.5, 1.5, 2000)
    edges = np.unique(np.percentile(expected, np.linspace(0, 100, 11)))
    e = np.maximum(np.histogram(expected, edges)[0] / len(expected), 1e-8)
    a = np.maximum(np.histogram(actual, edges)[0] / len(actual), 1e-8)
    want = float(((a - e) * np.log(a / e)).sum())
    one = spark.createDataFrame(pd.DataFrame({"x": expected}))
    two = spark.createDataFrame(pd.DataFrame({"x": actual}))
    assert V.compute_psi(one, two, "x").first()["psi"] == pytest.approx(want, abs=1e-6)


def test_woe_with_a_bin_without_events(spark):
    rows = [("A", 0)] * 4 + [("B", 1)] * 3 + [("B", 0)] * 3
    df = spark.createDataFrame(rows, "g string, is_default int")
    got = {r["bin_label"]: r for r in B.woe_table(df, ["g"]).collect()}
    assert got["A"]["woe"] == pytest.approx(math.log(1e-9 / (4 / 7)))
    assert got["B"]["woe"] == pytest.approx(math.log(1 / (3 / 7)))


def test_woe_with_heavy_ties_and_constants(spark):
    rng = np.random.default_rng(5)
    x = np.where(rng.random(3000) < 0.5, 1.0, rng.normal(size=3000))
    y = (rng.random(3000) < 0.3).astype(int)
    df = spark.createDataFrame(pd.DataFrame({"x": x, "k": 2.0, "is_default": y}))
    got = B.woe_table(df, ["x", "k"]).toPandas()
    bins = pd.qcut(pd.Series(x), 10, duplicates="drop").cat.codes
    want = pd.Series(y).groupby(bins).agg(["count", "sum"])
    mine = got[got.feature == "x"].sort_values("bin_no")
    assert list(mine.count_total) == list(want["count"]) and list(mine.count_events) == list(want["sum"])
    assert list(got[got.feature == "k"].count_total) == [3000]


def test_woe_of_one_class_is_empty(spark):
    df = spark.createDataFrame([(1.0, 0), (2.0, 0)], "x double, is_default int")
    assert B.woe_table(df, ["x"]).count() == 0


def test_correlations_with_gaps(spark):
    rng = np.random.default_rng(11)
    pdf = pd.DataFrame(rng.normal(size=(400, 3)), columns=["a", "b", "c"])
    pdf.loc[::7, "c"] = np.nan
    df = spark.createDataFrame(pdf).select("a", "b", F.nanvl("c", F.lit(None).cast("double")).alias("c"))
    got = {(r["feature_a"], r["feature_b"]): r["r"] for r in X.correlation_matrix(df, ("a", "b", "c")).collect()}
    want = pdf.corr()
    assert len(got) == 9
    for pair, r in got.items():
        assert r == pytest.approx(want.loc[pair], abs=1e-6)


# --- loading ---------------------------------------------------------------------
@pytest.mark.parametrize("n", [0, 1, 777, 5000, 9000])
def test_sample_has_exactly_n_rows(spark, n):
    df = spark.range(5000).withColumnRenamed("id", "loan_id")
    first = {r[0] for r in L.sample_rows(df.repartition(3), n, "loan_id").collect()}
    again = {r[0] for r in L.sample_rows(df.repartition(17), n, "loan_id").collect()}
    assert len(first) == min(n, 5000) and first == again


def test_new_rows_with_many_copies(spark):
    target = spark.createDataFrame([(1, 10.0)], "loan_id int, x double")
    batch = spark.createDataFrame([(1, 99.0)] * 300 + [(2, 5.0)] * 300 + [(3, 7.0), (3, 6.0)], "loan_id int, x double")
    got = sorted(tuple(r) for r in L.new_rows(batch, target).collect())
    assert got == [(2, 5.0), (3, 6.0)]


def test_append_is_idempotent(spark):
    path = work_folder(spark, "append")
    batch = spark.createDataFrame([(1, 1.0), (2, 2.0), (2, 2.0)], "loan_id int, x double")
    batch.limit(1).write.parquet(path)
    assert L.append_new(batch, path) == 1
    assert L.append_new(batch, path) == 0
    assert spark.read.parquet(path).count() == 2


def test_loans_by_year(spark, small_loans):
    path = work_folder(spark, "by-year")
    L.write_loans(small_loans, path)
    back = spark.read.parquet(path)
    assert back.count() == small_loans.count() and "issue_year" in back.columns
    plan = back.filter("issue_year = 1997").select("loan_amnt")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(issue_year" in plan


def test_lookup_falls_back_to_a_join(spark):
    facts = spark.range(20).select((F.col("id") % 5).alias("k"))
    stat = facts.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    for limit in (100, 2):
        rows = attach_statistic(facts, stat, "k", max_rows=limit).collect()
        assert len(rows) == 20 and {r["n"] for r in rows} == {4}


# --- backtests -------------------------------------------------------------------
def test_all_pairs_equals_the_real_pairing(spark):
    loans = spark.createDataFrame([(1, "A", True), (2, "A", False), (3, "B", False), (4, None, True)], "loan_id long, grade string, is_default boolean")
    preds = spark.createDataFrame([("1", "PD", 0.2), ("2", "PD", 0.4), ("9", "LGD", 0.9)], "loan_ref string, model_type string, p double").select(
        "loan_ref", "model_type", F.col("p").cast("decimal(10,6)").alias("prediction")
    )
    got = {r["grade"]: r for r in M.backtest_all_pairs(loans, preds).collect()}
    assert got["A"]["total_observacoes"] == 4 and got["B"]["total_observacoes"] == 2
    assert got["A"]["pd_prevista_media"] == 0.3 and got["A"]["pd_observada"] == 0.5
    keyed = {r["grade"]: r for r in M.backtest_by_loan(loans, preds).collect()}
    assert set(keyed) == {"A"} and keyed["A"]["total_observacoes"] == 2


def test_a_loan_scored_often_keeps_its_weight(spark):
    loans = spark.createDataFrame([(1, "A", True), (2, "A", False)], "loan_id long, grade string, is_default boolean")
    preds = spark.createDataFrame([("1", "PD", 0.5)] * 3 + [("2", "PD", 0.1)], "loan_ref string, model_type string, p double").select(
        "loan_ref", "model_type", F.col("p").cast("decimal(10,6)").alias("prediction")
    )
    row = M.backtest_by_loan(loans, preds).first()
    assert (row["total_observacoes"], row["pd_prevista_media"], row["pd_observada"]) == (4, 0.4, 0.75)


def test_a_model_not_measured_on_the_newest_day_is_absent(spark):
    rows = [("PD", "v", "gini", 0.45, "2024-02-01"), ("LGD", "v", "r2", 0.1, "2024-01-01")]
    df = spark.createDataFrame(rows, "model_type string, model_version string, metric_name string, metric_value double, d string").withColumn(
        "evaluation_date", F.to_date("d")
    )
    got = M.latest_status(df).collect()
    assert [(r["model_type"], r["status_regulatorio"]) for r in got] == [("PD", "ATENÇÃO")]


def test_unknown_policy(spark):
    with pytest.raises(ValueError):
        M.thresholds(spark, "none")


# --- scoring ---------------------------------------------------------------------
BATCH = [
    (1, 720.0, 18.5, 11.99, 75000.0, 15000.0, 5.0),
    (2, 650.0, 32.1, 21.45, 45000.0, 8000.0, 2.0),
    (3, 780.0, 8.2, 6.99, 120000.0, 25000.0, 10.0),
    (4, None, 0.0, float("nan"), None, None, None),
]
BATCH_SCHEMA = "idx long, fico_score double, dti double, int_rate double, annual_inc double, loan_amnt double, emp_length double"


def by_hand(fico, dti, rate, income, amount, years):
    z = -4.5 + (700 - fico) * 0.015 + dti * 0.04 + rate * 0.07 - min(income / 10000, 5) * 0.12 - years * 0.03
    p = min(max(1 / (1 + math.exp(-z)), 0.001), 0.999)
    return round(p * 100, 2), amount * round(p, 4) * 0.55


def test_batch_file(spark):
    got = {r["idx"]: r for r in Sc.score_batch(spark.createDataFrame(BATCH, BATCH_SCHEMA), "idx").collect()}
    for idx, fico, dti, rate, income, amount, years in BATCH[:3]:
        pct, loss = by_hand(fico, dti, rate, income, amount, years)
        assert got[idx]["pd_pct"] == pytest.approx(pct) and got[idx]["expected_loss"] == pytest.approx(loss, abs=0.006)
        assert got[idx]["lgd_pct"] == 55.0
    pct, loss = by_hand(700, 15, 12, 60000, 10000, 5)
    assert got[4]["pd_pct"] == pytest.approx(pct) and got[4]["ead"] == 10000.0 and got[4]["fico"] is None


def test_batch_with_one_model_only(spark):
    row = Sc.score_batch(spark.createDataFrame(BATCH[:1], BATCH_SCHEMA), "idx", ["lgd"]).first()
    assert row["pd_pct"] == 0.0 and row["grade"] == "—" and row["expected_loss"] == 0.0


def test_requests_out_of_range_are_set_aside(spark):
    rows = [(1, 700.0, 15.0), (2, 900.0, 60.0), (3, None, 15.0), (4, float("nan"), 15.0)]
    good, bad = Sc.split_valid(spark.createDataFrame(rows, "loan_id long, fico_score double, dti double"))
    assert sorted(r["loan_id"] for r in good.collect()) == [1, 3]
    assert {r["loan_id"]: r["violations"] for r in bad.collect()} == {2: ["fico_score", "dti"], 4: ["fico_score"]}


def test_failed_job_leaves_an_error_row(spark):
    result, ledger = work_folder(spark, "r"), work_folder(spark, "l")
    df = spark.range(3).withColumnRenamed("id", "loan_id")
    with pytest.raises(Exception):
        sinks.run_batch_job(spark, "job", "PD", df, lambda x: x.select(F.raise_error(F.lit("boom"))), result, ledger)
    row = spark.read.parquet(ledger).first()
    assert row["status"] == "error" and "boom" in row["error_message"]


def test_stream_drops_repeated_keys(spark):
    source = work_folder(spark, "in")
    request = (1, 700.0, 15.0, 12.0, 60000.0, 10000.0, 5.0, 30.0, "other", "RENT", "2024-01-01 00:00:00")
    schema = ("loan_id long, fico_score double, dti double, int_rate double, annual_inc double, loan_amnt double, "
              "emp_length double, revol_util double, purpose string, home_ownership string, t string")
    rows = [request, request, (2, *request[1:]), (3, 900.0, *request[2:])]
    spark.createDataFrame(rows, schema).withColumn("ts", F.to_timestamp("t")).drop("t").write.parquet(source)
    stream = spark.readStream.schema(spark.read.parquet(source).schema).parquet(source)
    predictions, rejected = SS.score_stream(stream, dedupe_within="1 hour")
    out = work_folder(spark, "out")
    SS.start_append(predictions, out, work_folder(spark, "cp")).awaitTermination()
    assert sorted(r["loan_ref"] for r in spark.read.schema(predictions.schema).parquet(out).collect()) == ["1", "2"]
    assert rejected.isStreaming


def test_views_answer_sql(spark, small_loans):
    from riskloom.plans.views import register_views

    register_views(small_loans)
    n = spark.sql("SELECT sum(total_loans) AS n FROM v_portfolio_summary").first()["n"]
    months = spark.sql("SELECT sum(total_loans) AS n FROM v_monthly_default_rates").first()["n"]
    assert n == months == small_loans.count()
