"""Validation queries, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom import constants as K
from riskloom.functions.scorecards import points
from riskloom.operators import monitoring as M
from riskloom.operators import validation as V
from riskloom.plans.base_sql import on_loans, quoted
from riskloom.plans.book import loans, scored, with_score
from riskloom.plans.metric_sql import SCORED, basic_terms, logistic, measures, psi_ctes

_FINAL = f"{SCORED}, final_scored AS (SELECT * FROM scored WHERE loan_status IN ({quoted(K.FINAL_STATUSES)}))"
_ADJUST = ("CASE purpose WHEN 'small_business' THEN 0.08e0 WHEN 'medical' THEN 0.05e0 WHEN 'other' THEN 0.03e0 "
           "WHEN 'credit_card' THEN 0.02e0 WHEN 'home_improvement' THEN -0.02e0 ELSE 0e0 END"
           " + CASE home_ownership WHEN 'RENT' THEN 0.05e0 WHEN 'OWN' THEN -0.03e0 ELSE 0e0 END")
_SERVICE = logistic(
    basic_terms("fico_avg", "CAST(dti AS DOUBLE)", "CAST(int_rate * 100 AS DOUBLE)", "CAST(annual_inc AS DOUBLE)", "emp_length")
    + f" + CAST(revol_util AS DOUBLE) * 0.008e0 + {_ADJUST}"
)
_BOTH = f"""{_FINAL}, two_scores AS (SELECT is_default, 'basic' AS modelo, score FROM final_scored
  UNION ALL SELECT is_default, 'service', ROUND({_SERVICE}, 6) FROM final_scored)"""


def final_scored(s, d):
    return scored(s, d).filter(F.col("loan_status").isin(*K.FINAL_STATUSES))


def two_scores(s, d):
    other = with_score(loans(s, d), "service").withColumnRenamed("score", "service_score")
    return with_score(other, "basic").filter(F.col("loan_status").isin(*K.FINAL_STATUSES))


_MEASURES = "n_obs, n_defaults, dr, ROUND(auc, 6) AS auc, ROUND(auc * 2 - 1, 6) AS gini, ks, ks_score, brier"
_DESC = """pts AS (SELECT score AS s, COUNT(*) AS n, SUM(CASE WHEN is_default THEN 1 ELSE 0 END) AS b FROM final_scored GROUP BY score),
runs AS (SELECT s, CAST(SUM(n) OVER (ORDER BY s DESC) AS DOUBLE) / SUM(n) OVER () AS cum_pop,
  CAST(SUM(b) OVER (ORDER BY s DESC) AS DOUBLE) / SUM(b) OVER () AS cum_events,
  CAST(SUM(n - b) OVER (ORDER BY s DESC) AS DOUBLE) / SUM(n - b) OVER () AS cum_good FROM pts)"""
_CALIBRATION = """curve AS (SELECT CAST(LEAST(FLOOR(score * 10), 9) AS INTEGER) AS bin, COUNT(*) AS n, ROUND(AVG(score), 6) AS mean_predicted,
  ROUND(AVG(CASE WHEN is_default THEN 1e0 ELSE 0e0 END), 6) AS observed_rate FROM final_scored GROUP BY 1)"""
_YEARS = "years AS (SELECT *, CAST(YEAR(issue_d) AS INTEGER) AS ano FROM final_scored)"
_BAND = "CASE WHEN psi < 0.10 THEN 'Estável' WHEN psi < 0.25 THEN 'Monitorizar' ELSE 'Instável' END"

QUERIES = {
    "auc_gini_ks": (
        lambda s, d: V.discrimination(final_scored(s, d)),
        on_loans(f"{_FINAL}, {measures('', 'final_scored')} SELECT {_MEASURES} FROM measured"),
    ),
    "brier_score": (
        lambda s, d: V.discrimination(final_scored(s, d)).select("brier", "n_obs"),
        on_loans(f"""{_FINAL} SELECT ROUND(AVG(POWER(score - CASE WHEN is_default THEN 1 ELSE 0 END, 2)), 6) AS brier, COUNT(*) AS n_obs FROM final_scored"""),
    ),
    "grade_discrimination": (
        lambda s, d: V.discrimination(final_scored(s, d), ["grade"]),
        on_loans(f"{_FINAL}, {measures('grade', 'final_scored')} SELECT grade, {_MEASURES} FROM measured"),
    ),
    "roc_points": (
        lambda s, d: V.roc_points(final_scored(s, d)),
        on_loans(f"{_FINAL}, {_DESC} SELECT s AS threshold, ROUND(cum_good, 6) AS fpr, ROUND(cum_events, 6) AS tpr FROM runs"),
    ),
    "lorenz_points": (
        lambda s, d: V.lorenz_points(final_scored(s, d)).select(
            "score", F.round("cum_pop", 6).alias("cum_pop"), F.round("cum_events", 6).alias("cum_events")
        ),
        on_loans(f"{_FINAL}, {_DESC} SELECT s AS score, ROUND(cum_pop, 6) AS cum_pop, ROUND(cum_events, 6) AS cum_events FROM runs"),
    ),
    "lorenz_capture": (
        lambda s, d: V.capture_rates(final_scored(s, d)),
        on_loans(f"""{_FINAL}, {_DESC} SELECT q AS population, ROUND(ARG_MIN(cum_events, cum_pop), 6) AS captured
        FROM runs JOIN (SELECT UNNEST([0.2e0, 0.4e0]) AS q) ON cum_pop >= q GROUP BY q"""),
    ),
    "calibration_curve": (
        lambda s, d: V.calibration_curve(final_scored(s, d)),
        on_loans(f"{_FINAL}, {_CALIBRATION} SELECT * FROM curve"),
    ),
    "ece": (
        lambda s, d: V.calibration_error(final_scored(s, d)),
        on_loans(f"""{_FINAL}, {_CALIBRATION} SELECT ROUND(AVG(ABS(observed_rate - mean_predicted)), 6) AS ece,
        ROUND(SUM(ABS(observed_rate - mean_predicted) * n) / SUM(n), 6) AS ece_weighted,
        CASE WHEN AVG(ABS(observed_rate - mean_predicted)) < 0.05 THEN 1 ELSE 0 END AS well_calibrated FROM curve"""),
    ),
    "model_comparison": (
        lambda s, d: V.compare_models(two_scores(s, d), {"basic": "score", "service": "service_score"}),
        on_loans(f"""{_BOTH}, {measures('modelo', 'two_scores')}
        SELECT modelo, ROUND(auc * 2 - 1, 6) AS gini, ks, ROUND(auc, 6) AS auc, brier,
          CAST(modelo = (SELECT ARG_MAX(modelo, auc) FROM measured) AS INTEGER) AS winner FROM measured"""),
    ),
    "regression_errors": (
        lambda s, d: V.regression_errors(
            loans(s, d).filter("is_default").withColumn("hat", F.when(F.col("is_mortgage") == 1, 0.8).otherwise(0.85)), "lgd", "hat", ["grade"]
        ),
        on_loans("""d AS (SELECT grade, CAST(lgd AS DOUBLE) AS y, CASE WHEN is_mortgage = 1 THEN 0.8e0 ELSE 0.85e0 END AS p FROM loans WHERE is_default)
        SELECT grade, COUNT(*) AS n, ROUND(1 - AVG(POWER(y - p, 2)) / NULLIF(VAR_POP(y), 0), 6) AS r2,
          ROUND(SQRT(AVG(POWER(y - p, 2))), 6) AS rmse, ROUND(AVG(ABS(y - p)), 6) AS mae FROM d GROUP BY grade"""),
    ),
    "cohort_backtest": (
        lambda s, d: V.cohort_backtest(final_scored(s, d)),
        on_loans(f"""{_FINAL}, {_YEARS}, {measures('ano', 'years')}
        SELECT ano, n_obs, dr, ROUND(auc * 2 - 1, 6) AS gini, ks, ROUND(auc, 6) AS auc FROM measured WHERE n_obs >= 200 AND n_defaults >= 10"""),
    ),
    "temporal_split": (
        lambda s, d: V.temporal_split(final_scored(s, d)).groupBy("fold").agg(
            F.count(F.lit(1)).alias("n"), F.count_if("is_default").alias("defaults"),
            F.min("issue_d").alias("first_day"), F.max("issue_d").alias("last_day"),
        ),
        on_loans(f"""{_FINAL}, cut AS (SELECT QUANTILE_CONT(CAST(DATE_DIFF('day', DATE '1970-01-01', issue_d) AS DOUBLE), 0.8) AS c FROM final_scored)
        SELECT CASE WHEN DATE_DIFF('day', DATE '1970-01-01', issue_d) <= c THEN 'train' ELSE 'test' END AS fold, COUNT(*) AS n,
          CAST(SUM(CASE WHEN is_default THEN 1 ELSE 0 END) AS BIGINT) AS defaults, MIN(issue_d) AS first_day, MAX(issue_d) AS last_day
        FROM final_scored, cut GROUP BY 1"""),
    ),
    "psi_by_year": (
        lambda s, d: V.psi_by_year(final_scored(s, d)),
        on_loans(f"""{_FINAL}, {_YEARS}, {psi_ctes('y', 'years', 'ano', 'score')}
        SELECT g AS ano, psi, {_BAND} AS status FROM y_psi JOIN (SELECT ano, COUNT(*) AS n FROM years GROUP BY ano) ON ano = g WHERE n > 100"""),
    ),
    "pd_by_grade": (
        lambda s, d: V.pd_by_grade(final_scored(s, d)),
        on_loans(f"""{_FINAL} SELECT grade, COUNT(*) AS n_obs, ROUND(AVG(CASE WHEN is_default THEN 1e0 ELSE 0e0 END) * 100, 6) AS dr_obs,
        ROUND(AVG(score) * 100, 6) AS pd_mean, ROUND(QUANTILE_CONT(score, 0.5), 7) AS pd_median FROM final_scored GROUP BY grade"""),
    ),
    "score_boxplot": (
        lambda s, d: V.score_boxplot(final_scored(s, d)),
        on_loans(f"""{_FINAL}, boxes AS (SELECT grade, QUANTILE_CONT(score, 0.25) AS q1, QUANTILE_CONT(score, 0.5) AS q2,
          QUANTILE_CONT(score, 0.75) AS q3 FROM final_scored GROUP BY grade),
        marked AS (SELECT f.grade, score, q1, q2, q3, score >= q1 - 1.5e0 * (q3 - q1) AND score <= q3 + 1.5e0 * (q3 - q1) AS inside FROM final_scored f JOIN boxes USING (grade))
        SELECT grade, ROUND(MAX(q1) * 100, 6) AS q1, ROUND(MAX(q2) * 100, 6) AS median, ROUND(MAX(q3) * 100, 6) AS q3,
          ROUND(MIN(CASE WHEN inside THEN score END) * 100, 6) AS whisker_low, ROUND(MAX(CASE WHEN inside THEN score END) * 100, 6) AS whisker_high,
          CAST(SUM(CASE WHEN inside THEN 0 ELSE 1 END) AS BIGINT) AS n_outliers FROM marked GROUP BY grade"""),
    ),
    "score_class_histogram": (
        lambda s, d: V.score_class_histogram(final_scored(s, d)),
        on_loans(f"""{_FINAL} SELECT CAST(is_default AS INTEGER) AS is_default, CAST(LEAST(FLOOR(score * 50), 49) AS INTEGER) AS slot, COUNT(*) AS n
        FROM final_scored GROUP BY 1, 2"""),
    ),
    "score_distribution": (
        lambda s, d: V.points_distribution(
            V.temporal_split(scored(s, d)).select(points("score").alias("points"), F.col("fold").alias("population"))
        ),
        on_loans(f"""{SCORED}, cut AS (SELECT QUANTILE_CONT(CAST(DATE_DIFF('day', DATE '1970-01-01', issue_d) AS DOUBLE), 0.8) AS c FROM scored),
        pts AS (SELECT CASE WHEN DATE_DIFF('day', DATE '1970-01-01', issue_d) <= c THEN 'train' ELSE 'test' END AS population,
          GREATEST(300, LEAST(850, CAST(TRUNC(850 - 550 * score) AS INTEGER))) AS p FROM scored, cut),
        counts AS (SELECT population, CAST(LEAST(FLOOR(p / 50e0) * 50, 800) AS INTEGER) AS b, COUNT(*) AS n FROM pts GROUP BY 1, 2)
        SELECT population, CONCAT(CAST(b AS VARCHAR), '-', CAST(b + 50 AS VARCHAR)) AS band, n,
          ROUND(n * 100e0 / SUM(n) OVER (PARTITION BY population), 6) AS pct FROM counts"""),
    ),
    "validation_report": (
        lambda s, d: M.validation_report(final_scored(s, d)),
        on_loans(f"""{_FINAL}, {measures('', 'final_scored')},
        report AS (SELECT 'gini' AS metric, ROUND(auc * 2 - 1, 6) AS value, 0.35e0 AS "limit", FALSE AS lower FROM measured
          UNION ALL SELECT 'ks', ks, 0.25e0, FALSE FROM measured UNION ALL SELECT 'auc_roc', ROUND(auc, 6), 0.65e0, FALSE FROM measured
          UNION ALL SELECT 'brier_score', brier, 0.25e0, TRUE FROM measured)
        SELECT metric, value, "limit", CAST(CASE WHEN lower THEN value <= "limit" ELSE value >= "limit" END AS INTEGER) AS passed,
          CASE WHEN metric = 'gini' THEN CASE WHEN value < 0.20 THEN 'Abaixo EBA' WHEN value < 0.35 THEN 'Aceitável' ELSE 'Adequado (IRB Unsecured)' END END AS band FROM report"""),
    ),
}
