"""Monitoring of stored metrics, conformance policies, drift and backtests."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskloom import constants as K
from riskloom.functions.columns import banded, mean, rounded, share_true
from riskloom.functions.scorecards import lgd_basic
from riskloom.operators.validation import discrimination, psi_by_group, regression_errors

# --- measuring -------------------------------------------------------------------
PD_METRICS = ("gini", "ks", "auc_roc", "brier_score")
REGRESSION_METRICS = ("r2", "rmse", "mae")


def measure_models(scored: DataFrame, version: str = "analytic_v1", dataset: str = "cohort") -> DataFrame:
    """Metric rows of the three models per issue quarter.

    ``scored`` is the loan table with a ``score`` column. The date of evaluation is the
    first day of the quarter. The LGD model is the analytic one, the exposure model takes
    the full amount.
    """
    df = scored.filter(F.col("issue_d").isNotNull()).select(
        F.trunc("issue_d", "quarter").alias("evaluation_date"),
        "score",
        "is_default",
        "lgd",
        "ead",
        "loan_amnt",
        lgd_basic("loan_amnt", F.lit(0.0), F.lit(0.0), "home_ownership").alias("lgd_hat"),
    )
    key = ["evaluation_date"]
    pd = discrimination(df, key).withColumnsRenamed({"auc": "auc_roc", "brier": "brier_score"})
    bad = df.filter("is_default")
    first = scored.agg(F.trunc(F.min(F.col("issue_d").cast("date")), "quarter")).first()[0]
    stability = psi_by_group(
        df.select("evaluation_date", "score", F.when(F.col("is_default"), F.col("lgd")).alias("lgd"), "ead"),
        "evaluation_date", first, ["score", "lgd", "ead"],
    )
    model_of = F.create_map(*(F.lit(x) for x in ("score", "PD", "lgd", "LGD", "ead", "EAD")))
    rows = [
        _long(pd, "PD", PD_METRICS),
        _long(regression_errors(bad, "lgd", "lgd_hat", key), "LGD", REGRESSION_METRICS),
        _long(regression_errors(bad, "ead", "loan_amnt", key), "EAD", REGRESSION_METRICS),
        stability.select(
            F.element_at(model_of, F.col("feature")).alias("model_type"),
            F.lit("psi").alias("metric_name"),
            F.col("psi").alias("metric_value"),
            "evaluation_date",
        ),
    ]
    out = rows[0]
    for more in rows[1:]:
        out = out.unionByName(more)
    return out.filter(F.col("metric_value").isNotNull()).select(
        "model_type",
        F.lit(version).alias("model_version"),
        "metric_name",
        F.col("metric_value").cast("decimal(16,6)").alias("metric_value"),
        "evaluation_date",
        F.lit(dataset).alias("dataset"),
    )


def _long(wide: DataFrame, model: str, names) -> DataFrame:
    cells = F.array(
        *(F.struct(F.lit(n).alias("metric_name"), F.col(n).cast("double").alias("metric_value")) for n in names)
    )
    return wide.select("evaluation_date", F.inline(cells)).withColumn("model_type", F.lit(model))


# --- latest figures --------------------------------------------------------------
def latest_metrics(metrics: DataFrame) -> DataFrame:
    """Rows of the newest evaluation date of all models together.

    A model that was not evaluated on that day is absent.
    """
    newest = metrics.agg(F.max("evaluation_date")).scalar()
    return metrics.filter(F.col("evaluation_date") == newest)


def latest_status(metrics: DataFrame) -> DataFrame:
    """Newest metrics with their regulatory status; only the Gini can fail."""
    limits = {m: (ok, warn, lower) for p, _, m, ok, warn, lower in K.THRESHOLDS if p == "status"}
    ok, warn, _ = limits["gini"]
    gini = F.col("metric_name") == "gini"
    value = F.col("metric_value")
    status = (
        F.when(gini & (value < warn), K.STATUS_BAD)
        .when(gini & (value < ok), K.STATUS_WARN)
        .otherwise(K.STATUS_OK)
    )
    return (
        latest_metrics(metrics)
        .select(
            "model_type", "model_version", "metric_name",
            value.cast("double").alias("metric_value"), "evaluation_date",
            status.alias("status_regulatorio"),
        )
        .orderBy("model_type", "metric_name")
    )


def metrics_by_model(metrics: DataFrame) -> DataFrame:
    """Newest value of every metric per model."""
    return metrics.groupBy("model_type", "metric_name").agg(
        F.max_by("model_version", "evaluation_date").alias("version"),
        F.max_by("dataset", "evaluation_date").alias("dataset"),
        F.round(F.max_by("metric_value", "evaluation_date").cast("double"), 4).alias("metric_value"),
    )


def nested_metrics(metrics: DataFrame) -> DataFrame:
    """One row per model with its metrics as a map."""
    flat = metrics_by_model(metrics)
    return flat.groupBy("model_type").agg(
        F.max("version").alias("version"),
        F.max("dataset").alias("dataset"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("metric_name", "metric_value")))).alias("metrics"),
    )


def recent_metrics(metrics: DataFrame, n: int = 100) -> DataFrame:
    return (
        metrics.select(
            "model_type", "metric_name", F.col("metric_value").cast("double").alias("metric_value"), "evaluation_date"
        )
        .orderBy(F.col("evaluation_date").desc(), "model_type", "metric_name")
        .limit(n)
    )


# --- history ---------------------------------------------------------------------
def gini_evolution(metrics: DataFrame) -> DataFrame:
    by_model = Window.partitionBy("model_type").orderBy("evaluation_date")
    previous = F.lag("metric_value").over(by_model)
    return (
        metrics.filter(F.col("metric_name") == "gini")
        .select(
            "model_type",
            "evaluation_date",
            F.col("metric_value").cast("double").alias("gini"),
            previous.cast("double").alias("gini_anterior"),
            rounded(F.col("metric_value") - previous, 4).alias("variacao_gini"),
        )
        .orderBy("model_type", "evaluation_date")
    )


def psi_history(metrics: DataFrame) -> DataFrame:
    return (
        metrics.filter(F.col("metric_name") == "psi")
        .select(
            "model_type",
            "evaluation_date",
            F.col("metric_value").cast("double").alias("psi"),
            banded("metric_value", K.PSI_LONG_BANDS, K.PSI_LONG_TOP).alias("interpretacao_psi"),
        )
        .orderBy("model_type", F.col("evaluation_date").desc())
    )


# --- policies --------------------------------------------------------------------
def thresholds(spark: SparkSession, policy: str) -> DataFrame:
    rows = [t for t in K.THRESHOLDS if t[0] == policy]
    if not rows:
        raise ValueError(f"unknown policy: {policy}")
    fields = {"policy": "string", "model_type": "string", "metric_name": "string",
              "ok": "double", "warn": "double", "lower_is_better": "bool"}
    columns = zip(*rows)
    return spark.createDataFrame(
        pa.table({name: pa.array(values, pa.type_for_alias(kind)) for (name, kind), values in zip(fields.items(), columns)})
    )


def judge(metrics: DataFrame, policy: str) -> DataFrame:
    """Latest value of each metric against a policy: ok, warn or bad, and conformity.

    The policy table has a handful of rows by construction and is broadcast.
    """
    limits = thresholds(metrics.sparkSession, policy)
    latest = metrics.groupBy("model_type", "metric_name").agg(
        F.max_by("metric_value", "evaluation_date").cast("double").alias("metric_value"),
        F.max("evaluation_date").alias("evaluation_date"),
    )
    value = F.col("metric_value")

    def reaches(limit: str):
        return F.when(F.col("lower_is_better"), value <= F.col(limit)).otherwise(value >= F.col(limit))

    light = F.when(reaches("ok"), "ok").when(reaches("warn"), "warn").otherwise("bad")
    return (
        latest.join(F.broadcast(limits), ["model_type", "metric_name"])
        .select(
            "policy", "model_type", "metric_name", "evaluation_date", "metric_value", "ok", "warn",
            light.alias("light"),
            F.when(reaches("ok"), K.CONFORM).otherwise(K.NOT_CONFORM).alias("conformity"),
        )
        .orderBy("model_type", "metric_name")
    )


def compliance_flags(metrics: DataFrame, least_gini: float = 0.20) -> DataFrame:
    """Per model: PD needs the least Gini, the other models always comply."""
    gini = F.max_by(
        F.col("metric_value").cast("double"),
        F.when(F.col("metric_name") == "gini", F.col("evaluation_date")),
    )
    return metrics.groupBy("model_type").agg(gini.alias("g")).select(
        "model_type",
        F.when(F.col("model_type") == "PD", F.coalesce(F.col("g") >= least_gini, F.lit(False)))
        .otherwise(F.lit(True)).cast("int").alias("eba_compliant"),
    )


def _latest_wide(metrics: DataFrame) -> DataFrame:
    names = ("gini", "ks", "auc_roc", "brier_score", "r2", "rmse", "mae", "psi")

    def newest(name):
        return F.max_by(
            F.col("metric_value").cast("double"),
            F.when(F.col("metric_name") == name, F.col("evaluation_date")),
        ).alias(name)

    return metrics.groupBy("model_type").agg(
        F.max_by("model_version", "evaluation_date").alias("version"),
        F.max("evaluation_date").alias("last_date"),
        *(newest(n) for n in names),
    )


def status_cards(metrics: DataFrame) -> DataFrame:
    """One card per model: main figure, stability, drift and status."""
    return _latest_wide(metrics).select(
        "model_type",
        "version",
        "last_date",
        F.coalesce("gini", "r2").alias("main_figure"),
        "psi",
        banded("psi", ((0.10, "Baixo"), (0.25, "Médio")), "Alto").alias("drift"),
        banded("psi", K.PSI_SHORT_BANDS, K.PSI_SHORT_TOP).alias("status"),
    )


def report_dataset(metrics: DataFrame) -> DataFrame:
    """One row per model for the regulatory report, with a verdict from the report policy."""
    verdicts = judge(metrics, "report").groupBy("model_type").agg(
        F.min((F.col("conformity") == K.CONFORM).cast("int")).alias("approved")
    )
    return (
        _latest_wide(metrics)
        .join(verdicts, "model_type", "left")
        .select(
            F.col("model_type").alias("modelo"),
            F.coalesce("gini", "r2").alias("gini_r2"),
            "ks",
            "auc_roc",
            F.coalesce("brier_score", "rmse").alias("brier_rmse"),
            F.when(F.col("approved") == 1, "APROVADO").otherwise("VERIFICAR").alias("validacao"),
        )
        .orderBy("modelo")
    )


def validation_report(scored: DataFrame, score: str = "score") -> DataFrame:
    """Four measures with their pass flag and the text band of the Gini."""
    d = discrimination(scored, (), score)
    limits = {m: (ok, lower) for p, _, m, ok, _, lower in K.THRESHOLDS if p == "validation"}
    source = {"gini": "gini", "ks": "ks", "auc_roc": "auc", "brier_score": "brier"}
    rows = []
    for metric, (limit, lower) in limits.items():
        v = F.col(source[metric])
        passed = (v <= limit) if lower else (v >= limit)
        band = banded(v, K.GINI_BANDS, K.GINI_TOP) if metric == "gini" else F.lit(None).cast("string")
        rows.append(
            F.struct(
                F.lit(metric).alias("metric"),
                v.alias("value"),
                F.lit(limit).alias("limit"),
                passed.cast("int").alias("passed"),
                band.alias("band"),
            )
        )
    return d.select(F.inline(F.array(*rows))).orderBy("metric")


# --- backtests -------------------------------------------------------------------
def _calibration(df: DataFrame) -> DataFrame:
    gap = F.abs(F.col("predicted") - F.col("observed"))
    return df.select(
        "grade",
        "total_observacoes",
        F.round("predicted", 4).alias("pd_prevista_media"),
        F.round("observed", 4).alias("pd_observada"),
        F.round(gap, 4).alias("desvio_absoluto"),
        banded(gap, K.CALIBRATION_BANDS, K.CALIBRATION_TOP).alias("status_calibracao"),
    ).orderBy("grade")


def backtest_all_pairs(loans: DataFrame, predictions: DataFrame) -> DataFrame:
    """Observed rate per grade against the mean of all PD predictions.

    This is the figure of pairing every loan with every PD prediction. The pairing is
    linear, so it follows from the counts: rows per grade times the number of predictions,
    and their one mean. Nothing is paired.
    """
    pd = predictions.filter(F.col("model_type") == "PD")
    by_grade = (
        loans.filter(F.col("grade").isNotNull())
        .groupBy("grade")
        .agg(F.count(F.lit(1)).alias("n"), share_true("is_default").alias("observed"))
    )
    n_predictions = pd.agg(F.count(F.lit(1))).scalar()
    mean_prediction = pd.agg(mean("prediction")).scalar()
    return _calibration(
        by_grade.select(
            "grade",
            (F.col("n") * n_predictions).alias("total_observacoes"),
            mean_prediction.alias("predicted"),
            "observed",
        ).filter(F.col("total_observacoes") > 0)
    )


def backtest_by_loan(loans: DataFrame, predictions: DataFrame) -> DataFrame:
    """Observed rate per grade against the mean prediction of the same loans.

    Predictions are summed per loan before the join, so a loan scored very often is one
    row there; every prediction still carries weight.
    """
    per_loan = (
        predictions.filter((F.col("model_type") == "PD") & F.col("loan_ref").isNotNull())
        .groupBy("loan_ref")
        .agg(F.sum("prediction").alias("p_sum"), F.count("prediction").alias("p_n"))
    )
    keyed = loans.filter(F.col("grade").isNotNull()).select(
        "grade", "is_default", F.col("loan_id").cast("string").alias("loan_ref")
    )
    joined = keyed.join(per_loan, "loan_ref")
    weight = F.sum("p_n").cast("double")
    return _calibration(
        joined.groupBy("grade").agg(
            F.sum("p_n").alias("total_observacoes"),
            (F.sum("p_sum").cast("double") / weight).alias("predicted"),
            (F.sum(F.when(F.col("is_default"), F.col("p_n")).otherwise(0)).cast("double") / weight).alias("observed"),
        )
    )


# --- drift -----------------------------------------------------------------------
DRIFT_VARIABLES = (("DTI", "dti", 4), ("FICO", "fico_range_low", 1), ("INT_RATE", "int_rate", 4))


def drift_means(loans: DataFrame, cutoff: str = "2017-01-01") -> DataFrame:
    """Means before and since the cut-off and the change in percent, from a single scan."""
    recent = F.col("issue_d") >= F.lit(cutoff).cast("date")
    earlier = F.col("issue_d") < F.lit(cutoff).cast("date")
    sums = []
    for _, c, _ in DRIFT_VARIABLES:
        sums += [mean(F.when(recent, F.col(c))).alias(f"{c}_new"), mean(F.when(earlier, F.col(c))).alias(f"{c}_old")]
    rows = []
    for name, c, digits in DRIFT_VARIABLES:
        new, old = F.col(f"{c}_new"), F.col(f"{c}_old")
        rows.append(
            F.struct(
                F.lit(name).alias("variavel"),
                F.round(new, digits).alias("media_recente"),
                F.round(old, digits).alias("media_treino"),
                F.round(F.try_divide(F.abs(new - old), old) * 100, 2).alias("variacao_pct"),
            )
        )
    return loans.agg(*sums).select(F.inline(F.array(*rows)))


# --- windows of events -----------------------------------------------------------
def window_monitor(scored: DataFrame, length: str = "1 day", slide: str | None = None, width: float = 50.0) -> DataFrame:
    """Counts, mean and extremes of ``value`` per time window and band of the value.

    Works on a table and on a stream with a watermark alike.
    """
    band = F.floor(F.col("value") / width) * width
    return (
        scored.groupBy(F.window("ts", length, slide).alias("w"), band.alias("band"))
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.sum(F.col("value").cast("decimal(18,2)")).alias("total"),
            F.max("value").alias("highest"),
        )
        .select(
            F.col("w.start").alias("window_start"),
            F.col("band").cast("double").alias("band"),
            "n",
            F.round(F.col("total").cast("double") / F.col("n"), 6).alias("mean_value"),
            "highest",
        )
    )
