"""SQL for scores and for the metric rows that the monitoring queries use."""

from __future__ import annotations


def logistic(parts: str) -> str:
    return f"GREATEST(0.001e0, LEAST(0.999e0, 1e0 / (1e0 + EXP(-({parts})))))"


def basic_terms(fico, dti, rate, income, emp) -> str:
    return (
        f"-4.5e0 + (700e0 - {fico}) * 0.015e0 + {dti} * 0.04e0 + {rate} * 0.07e0"
        f" + (-LEAST({income} / 10000, 5e0) * 0.12e0) + (-{emp} * 0.03e0)"
    )


LOAN_PD = logistic(
    basic_terms("fico_avg", "CAST(dti AS DOUBLE)", "CAST(int_rate * 100 AS DOUBLE)", "CAST(annual_inc AS DOUBLE)", "emp_length")
)
SCORED = f"scored AS (SELECT *, ROUND({LOAN_PD}, 6) AS score FROM loans)"


def measures(keys: str, source: str = "scored", score: str = "score") -> str:
    """CTEs that end in ``measured``: AUC, Gini, KS and Brier per group of distinct scores."""
    by = f"PARTITION BY {keys}" if keys else ""
    group = f"{keys}, " if keys else ""
    return f"""
points AS (SELECT {group}{score} AS s, COUNT(*) AS n, SUM(CASE WHEN is_default THEN 1 ELSE 0 END) AS b,
    SUM(CASE WHEN is_default THEN 0 ELSE 1 END) AS g FROM {source} GROUP BY {group}{score}),
runs AS (SELECT *, CAST(SUM(b) OVER (w) AS DOUBLE) AS cb, CAST(SUM(g) OVER (w) AS DOUBLE) AS cg,
    CAST(SUM(b) OVER ({by}) AS DOUBLE) AS tb, CAST(SUM(g) OVER ({by}) AS DOUBLE) AS tg
    FROM points WINDOW w AS ({by} ORDER BY s)),
gaps AS (SELECT *, ABS(cb / NULLIF(tb, 0) - cg / NULLIF(tg, 0)) AS gap FROM runs),
measured AS (SELECT {group}CAST(SUM(n) AS BIGINT) AS n_obs, CAST(SUM(b) AS BIGINT) AS n_defaults,
    ROUND(CAST(SUM(b) AS DOUBLE) / SUM(n), 6) AS dr,
    SUM(b * (cg - g + 0.5e0 * g)) / NULLIF(MAX(tb) * MAX(tg), 0) AS auc, ROUND(MAX(gap), 6) AS ks,
    ARG_MIN(s, ROUND(1 - gap, 12) + s * 1e-15) AS ks_score,
    ROUND(SUM(b * (s - 1) * (s - 1) + g * s * s) / SUM(n), 6) AS brier FROM gaps {"GROUP BY " + keys if keys else ""})"""


def psi_ctes(name: str, source: str, group: str, value: str) -> str:
    """CTEs that end in ``{name}_psi`` with the group and its stability against the first group."""
    probs = "[" + ", ".join(f"{i / 10}" for i in range(11)) + "]"
    return f"""
{name}_base AS (SELECT QUANTILE_CONT({value}, {probs}) AS q FROM {source} WHERE {group} = (SELECT MIN({group}) FROM {source})),
{name}_edges AS (SELECT e, LEAD(e) OVER (ORDER BY e) AS nxt, ROW_NUMBER() OVER (ORDER BY e DESC) AS from_end
    FROM (SELECT DISTINCT UNNEST(q) AS e FROM {name}_base)),
{name}_slots AS (SELECT e AS lo, nxt AS hi, from_end = 2 AS last_slot FROM {name}_edges WHERE nxt IS NOT NULL),
{name}_sizes AS (SELECT {group} AS g, CAST(COUNT({value}) AS DOUBLE) AS size FROM {source} WHERE {value} IS NOT NULL GROUP BY 1),
{name}_counts AS (SELECT {group} AS g, lo, COUNT(*) AS k FROM {source} JOIN {name}_slots
    ON {value} >= lo AND ({value} < hi OR (last_slot AND {value} = hi)) GROUP BY 1, 2),
{name}_shares AS (SELECT z.g, s.lo, GREATEST(COALESCE(k, 0) / size, 1e-8) AS a FROM {name}_sizes z CROSS JOIN {name}_slots s
    LEFT JOIN {name}_counts c ON c.g = z.g AND c.lo = s.lo),
{name}_psi AS (SELECT x.g, ROUND(SUM((x.a - e.a) * LN(x.a / e.a)), 6) AS psi FROM {name}_shares x
    JOIN {name}_shares e ON e.lo = x.lo AND e.g = (SELECT MIN(g) FROM {name}_shares)
    WHERE x.g <> (SELECT MIN(g) FROM {name}_shares) GROUP BY x.g)"""


_LGD_HAT = "GREATEST(0.01e0, LEAST(0.99e0, 0.45e0 - 0e0 + CASE WHEN home_ownership = 'RENT' THEN 0.1e0 ELSE 0e0 END - 0e0))"


def _errors(y: str, p: str) -> str:
    return (
        f"ROUND(1 - AVG(POWER({y} - {p}, 2)) / NULLIF(VAR_POP({y}), 0), 6) AS r2, "
        f"ROUND(SQRT(AVG(POWER({y} - {p}, 2))), 6) AS rmse, ROUND(AVG(ABS({y} - {p})), 6) AS mae"
    )


_UNION = " UNION ALL ".join(
    [f"SELECT 'PD' AS model_type, '{m}' AS metric_name, {x} AS v, quarter_start AS d FROM measured"
     for m, x in (("gini", "ROUND(auc * 2 - 1, 6)"), ("ks", "ks"), ("auc_roc", "ROUND(auc, 6)"), ("brier_score", "brier"))]
    + [f"SELECT '{t}', '{m}', {m}, quarter_start FROM {t.lower()}_errors" for t in ("LGD", "EAD") for m in ("r2", "rmse", "mae")]
    + [f"SELECT '{t}', 'psi', psi, g FROM {t.lower()}_psi" for t in ("PD", "LGD", "EAD")]
)

METRICS = f"""{SCORED},
quarters AS (SELECT *, CAST(DATE_TRUNC('quarter', issue_d) AS DATE) AS quarter_start, CAST(lgd AS DOUBLE) AS lgd_d,
    CAST(ead AS DOUBLE) AS ead_d, CAST(loan_amnt AS DOUBLE) AS amount_d, {_LGD_HAT} AS lgd_hat FROM scored),
{measures("quarter_start", "quarters")},
lgd_errors AS (SELECT quarter_start, {_errors("lgd_d", "lgd_hat")} FROM quarters WHERE is_default AND lgd IS NOT NULL GROUP BY 1),
ead_errors AS (SELECT quarter_start, {_errors("ead_d", "amount_d")} FROM quarters WHERE is_default GROUP BY 1),
bad_quarters AS (SELECT * FROM quarters WHERE is_default),
{psi_ctes("pd", "quarters", "quarter_start", "score")},
{psi_ctes("lgd", "bad_quarters", "quarter_start", "lgd_d")},
{psi_ctes("ead", "quarters", "quarter_start", "ead_d")},
metric_rows AS ({_UNION}),
metrics AS (SELECT model_type, 'analytic_v1' AS model_version, metric_name, CAST(v AS DECIMAL(16,6)) AS metric_value,
    d AS evaluation_date, 'cohort' AS dataset FROM metric_rows WHERE v IS NOT NULL)"""
