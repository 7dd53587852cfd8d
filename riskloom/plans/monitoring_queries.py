"""Monitoring queries, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom import constants as K
from riskloom.operators import monitoring as M
from riskloom.plans.base_sql import DEFAULT_RATE, avg, on_loans
from riskloom.plans.book import loans, metrics, predictions
from riskloom.plans.metric_sql import METRICS, SCORED
from riskloom.sources.testbook import table

DRIFT_CUTOFF = "2000-01-01"

_LATEST = """latest AS (SELECT model_type, metric_name, CAST(ARG_MAX(metric_value, evaluation_date) AS DOUBLE) AS metric_value,
  MAX(evaluation_date) AS evaluation_date, ARG_MAX(model_version, evaluation_date) AS version FROM metrics GROUP BY 1, 2)"""


def _on_metrics(body: str) -> str:
    return on_loans(f"{METRICS}{' ' if body.strip().upper().startswith('SELECT') else ', '}{body}")


def _policy_values(policy: str) -> str:
    def text(v):
        return "NULL" if v is None else (str(v).upper() if isinstance(v, bool) else f"{v}e0" if not isinstance(v, str) else f"'{v}'")

    rows = ", ".join("(" + ", ".join(text(v) for v in t) + ")" for t in K.THRESHOLDS if t[0] == policy)
    return f"limits(policy, model_type, metric_name, ok, warn, lower) AS (VALUES {rows})"


def _judged(policy: str) -> str:
    return _on_metrics(f"""{_LATEST}, {_policy_values(policy)}, judged AS (
      SELECT policy, latest.model_type, latest.metric_name, evaluation_date, metric_value, ok, CAST(warn AS DOUBLE) AS warn,
        CASE WHEN lower THEN metric_value <= ok ELSE metric_value >= ok END AS fits,
        COALESCE(CASE WHEN lower THEN metric_value <= warn ELSE metric_value >= warn END, FALSE) AS nearly
      FROM latest JOIN limits USING (model_type, metric_name))
    SELECT policy, model_type, metric_name, evaluation_date, metric_value, ok, warn,
      CASE WHEN fits THEN 'ok' WHEN nearly THEN 'warn' ELSE 'bad' END AS light,
      CASE WHEN fits THEN 'Conforme' ELSE 'Não Conforme' END AS conformity FROM judged""")


_WIDE = "wide AS (SELECT model_type, ARG_MAX(model_version, evaluation_date) AS version, MAX(evaluation_date) AS last_date, " + ", ".join(
    f"CAST(ARG_MAX(metric_value, evaluation_date) FILTER (WHERE metric_name = '{m}') AS DOUBLE) AS {m}"
    for m in ("gini", "ks", "auc_roc", "brier_score", "r2", "rmse", "mae", "psi")
) + " FROM metrics GROUP BY model_type)"

_CALIBRATED = """SELECT grade, total_observacoes, ROUND(predicted, 4) AS pd_prevista_media, ROUND(observed, 4) AS pd_observada,
  ROUND(ABS(predicted - observed), 4) AS desvio_absoluto, CASE WHEN ABS(predicted - observed) < 0.02 THEN 'BOA CALIBRAÇÃO'
  WHEN ABS(predicted - observed) < 0.05 THEN 'CALIBRAÇÃO ACEITÁVEL' ELSE 'RECALIBRAR' END AS status_calibracao FROM backtest"""

_PREDICTIONS = f"{SCORED}, predictions AS (SELECT CAST(loan_id AS VARCHAR) AS loan_ref, CAST(score AS DECIMAL(10,6)) AS prediction FROM scored)"


def _drift_rows() -> str:
    new, old = f"issue_d >= DATE '{DRIFT_CUTOFF}'", f"issue_d < DATE '{DRIFT_CUTOFF}'"
    rows = []
    for name, c, digits in M.DRIFT_VARIABLES:
        a, b = avg(f"CASE WHEN {new} THEN {c} END"), avg(f"CASE WHEN {old} THEN {c} END")
        rows.append(f"SELECT '{name}' AS variavel, ROUND({a}, {digits}) AS media_recente, ROUND({b}, {digits}) AS media_treino, "
                    f"ROUND(ABS({a} - {b}) / NULLIF({b}, 0) * 100, 2) AS variacao_pct FROM loans")
    return "drift AS (" + " UNION ALL ".join(rows) + ") SELECT * FROM drift"


QUERIES = {
    "model_metrics": (
        lambda s, d: metrics(s, d).withColumn("metric_value", F.col("metric_value").cast("double")),
        _on_metrics("SELECT model_type, model_version, metric_name, CAST(metric_value AS DOUBLE) AS metric_value, evaluation_date, dataset FROM metrics"),
    ),
    "latest_metrics_status": (
        lambda s, d: M.latest_status(metrics(s, d)),
        _on_metrics("""SELECT model_type, model_version, metric_name, CAST(metric_value AS DOUBLE) AS metric_value, evaluation_date,
        CASE WHEN metric_name = 'gini' AND metric_value < 0.40 THEN 'CRÍTICO' WHEN metric_name = 'gini' AND metric_value < 0.50 THEN 'ATENÇÃO'
          ELSE 'CONFORME' END AS status_regulatorio FROM metrics WHERE evaluation_date = (SELECT MAX(evaluation_date) FROM metrics)"""),
    ),
    "gini_evolution": (
        lambda s, d: M.gini_evolution(metrics(s, d)),
        _on_metrics("""SELECT model_type, evaluation_date, CAST(metric_value AS DOUBLE) AS gini,
        CAST(LAG(metric_value) OVER (PARTITION BY model_type ORDER BY evaluation_date) AS DOUBLE) AS gini_anterior,
        CAST(ROUND(metric_value - LAG(metric_value) OVER (PARTITION BY model_type ORDER BY evaluation_date), 4) AS DOUBLE) AS variacao_gini
        FROM metrics WHERE metric_name = 'gini'"""),
    ),
    "psi_status": (
        lambda s, d: M.psi_history(metrics(s, d)),
        _on_metrics("""SELECT model_type, evaluation_date, CAST(metric_value AS DOUBLE) AS psi, CASE WHEN metric_value < 0.10 THEN 'Estável'
        WHEN metric_value < 0.25 THEN 'Ligeira Alteração — Monitorizar' ELSE 'Alteração Significativa — Recalibrar' END AS interpretacao_psi
        FROM metrics WHERE metric_name = 'psi'"""),
    ),
    "recent_metrics": (
        lambda s, d: M.recent_metrics(metrics(s, d)),
        _on_metrics("""SELECT model_type, metric_name, CAST(metric_value AS DOUBLE) AS metric_value, evaluation_date FROM metrics
        ORDER BY evaluation_date DESC, model_type, metric_name LIMIT 100"""),
    ),
    "metrics_by_model": (
        lambda s, d: M.metrics_by_model(metrics(s, d)),
        _on_metrics("""SELECT model_type, metric_name, 'analytic_v1' AS version, 'cohort' AS dataset,
        CAST(ROUND(ARG_MAX(metric_value, evaluation_date), 4) AS DOUBLE) AS metric_value FROM metrics GROUP BY 1, 2"""),
    ),
    "nested_metrics": (
        lambda s, d: M.nested_metrics(metrics(s, d)).select(
            "model_type", "version", "dataset", F.array_join(F.map_keys("metrics"), ",").alias("names"),
            F.size("metrics").cast("long").alias("n"),
        ),
        _on_metrics("""SELECT model_type, 'analytic_v1' AS version, 'cohort' AS dataset,
        STRING_AGG(DISTINCT metric_name, ',' ORDER BY metric_name) AS names, COUNT(DISTINCT metric_name) AS n FROM metrics GROUP BY model_type"""),
    ),
    "traffic_lights": (lambda s, d: M.judge(metrics(s, d), "dashboard"), _judged("dashboard")),
    "conformance_by_policy": (lambda s, d: M.judge(metrics(s, d), "report"), _judged("report")),
    "benchmark_conformance": (lambda s, d: M.judge(metrics(s, d), "benchmark"), _judged("benchmark")),
    "compliance_flags": (
        lambda s, d: M.compliance_flags(metrics(s, d)),
        _on_metrics(f"{_WIDE} SELECT model_type, CASE WHEN model_type <> 'PD' THEN 1 WHEN gini >= 0.2 THEN 1 ELSE 0 END AS eba_compliant FROM wide"),
    ),
    "status_cards": (
        lambda s, d: M.status_cards(metrics(s, d)),
        _on_metrics(f"""{_WIDE} SELECT model_type, version, last_date, COALESCE(gini, r2) AS main_figure, psi,
        CASE WHEN psi < 0.10 THEN 'Baixo' WHEN psi < 0.25 THEN 'Médio' ELSE 'Alto' END AS drift,
        CASE WHEN psi < 0.10 THEN 'Estável' WHEN psi < 0.25 THEN 'Monitorizar' ELSE 'Instável' END AS status FROM wide"""),
    ),
    "report_dataset": (
        lambda s, d: M.report_dataset(metrics(s, d)),
        _on_metrics(f"""{_WIDE} SELECT model_type AS modelo, COALESCE(gini, r2) AS gini_r2, ks, auc_roc, COALESCE(brier_score, rmse) AS brier_rmse,
        CASE WHEN CASE model_type WHEN 'PD' THEN gini >= 0.2 AND ks >= 0.2 AND auc_roc >= 0.65 AND brier_score <= 0.25
          WHEN 'LGD' THEN r2 >= 0 AND rmse <= 0.2 AND mae <= 0.15 ELSE r2 >= 0.8 AND rmse <= 5000 END THEN 'APROVADO' ELSE 'VERIFICAR' END AS validacao FROM wide"""),
    ),
    "backtest_cross": (
        lambda s, d: M.backtest_all_pairs(loans(s, d), predictions(s, d)),
        on_loans(f"""{_PREDICTIONS}, backtest AS (SELECT grade, COUNT(*) AS total_observacoes, {avg('prediction')} AS predicted,
        {DEFAULT_RATE} AS observed FROM loans CROSS JOIN predictions WHERE grade IS NOT NULL GROUP BY grade) {_CALIBRATED}"""),
    ),
    "backtest_keyed": (
        lambda s, d: M.backtest_by_loan(loans(s, d), predictions(s, d)),
        on_loans(f"""{_PREDICTIONS}, backtest AS (SELECT grade, COUNT(*) AS total_observacoes, {avg('prediction')} AS predicted,
        {DEFAULT_RATE} AS observed FROM loans JOIN predictions ON loan_ref = CAST(loan_id AS VARCHAR) WHERE grade IS NOT NULL GROUP BY grade) {_CALIBRATED}"""),
    ),
    "drift_means": (lambda s, d: M.drift_means(loans(s, d), DRIFT_CUTOFF), on_loans(_drift_rows())),
    "event_window_monitor": (
        lambda s, d: M.window_monitor(table(s, d, "events")),
        """SELECT DATE_TRUNC('day', ts) AS window_start, FLOOR(value / 50) * 50 AS band, COUNT(*) AS n,
        ROUND(CAST(SUM(CAST(value AS DECIMAL(18,2))) AS DOUBLE) / COUNT(*), 6) AS mean_value, MAX(value) AS highest FROM events GROUP BY 1, 2""",
    ),
    "event_sliding_monitor": (
        lambda s, d: M.window_monitor(
            table(s, d, "events"), "2 days", "1 day"
        ),
        """slid AS (SELECT DATE_TRUNC('day', ts) AS window_start, value FROM events
          UNION ALL SELECT DATE_TRUNC('day', ts) - INTERVAL 1 DAY, value FROM events)
        SELECT window_start, FLOOR(value / 50) * 50 AS band, COUNT(*) AS n,
        ROUND(CAST(SUM(CAST(value AS DECIMAL(18,2))) AS DOUBLE) / COUNT(*), 6) AS mean_value, MAX(value) AS highest FROM slid GROUP BY 1, 2""",
    ),
}
QUERIES["event_sliding_monitor"] = (QUERIES["event_sliding_monitor"][0], "WITH " + QUERIES["event_sliding_monitor"][1])
