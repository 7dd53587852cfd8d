"""Portfolio and exploration queries, each beside the SQL it is checked against."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom import constants as K
from riskloom.operators import exploration as X
from riskloom.operators import portfolio as P
from riskloom.plans.base_sql import DEFAULT_RATE, DEFAULTS, avg, on_loans, quoted
from riskloom.plans.book import loans

SNAPSHOT_DATE = "2024-01-31"

_LGD = "COALESCE(lgd, CAST(0.45 AS DECIMAL(6,4)))"
_TOTAL = "CAST(SUM(loan_amnt) AS DOUBLE)"
_LOST = f"COALESCE(CAST(SUM(CASE WHEN is_default THEN loan_amnt * {_LGD} END) AS DOUBLE), 0)"
_MID = "(CAST(fico_range_low + fico_range_high AS DOUBLE) / 2)"
_N = "CAST(COUNT(*) AS BIGINT)"
_DR4, _DR2 = f"ROUND({DEFAULT_RATE}, 4)", f"ROUND({DEFAULT_RATE} * 100, 2)"
_EXPECTED = f"ROUND({_TOTAL} * {DEFAULT_RATE} * {avg(_LGD)} / 1000000, 2)"


def _grade(select: str) -> str:
    return on_loans(f"SELECT grade, {select} FROM loans WHERE grade IS NOT NULL GROUP BY grade")


def _quarter_label(x: str) -> str:
    q = f"CAST(QUARTER({x}) AS VARCHAR)"
    return f"CONCAT(CAST(YEAR({x}) AS VARCHAR), '-', {q}, 'T', {q})"


_QUARTER = "CAST(DATE_TRUNC('quarter', issue_d) AS DATE)"

_BANDS = "CASE WHEN fico_range_low < 600 THEN '580-599' " + " ".join(
    f"WHEN fico_range_low < {s + 20} THEN '{s}-{s + 19}'" for s in range(600, 780, 20)
) + " ELSE '780+' END"


def _corr_rows() -> str:
    names = K.CORRELATION_COLUMNS
    cells = []
    for a in names:
        for b in names:
            r = "1e0" if a == b else f"ROUND(CORR({_num(a)}, {_num(b)}), 6)"
            cells.append(f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, {r} AS r FROM loans")
    distinct_pairs = [c + (" LIMIT 1" if " 1e0 " in c else "") for c in cells]
    return " UNION ALL ".join(f"({c})" for c in distinct_pairs)


def _num(name: str) -> str:
    if name == "is_default":
        return "CAST(CAST(is_default AS INTEGER) AS DOUBLE)"
    return f"CAST({name} AS DOUBLE)"


def _target_corr(columns) -> str:
    target = _num("is_default")
    rows = " UNION ALL ".join(
        f"SELECT '{c}' AS feature, ROUND(CORR({_num(c)}, {target}), 6) AS r FROM loans" for c in columns
    )
    return f"ranked AS ({rows}) SELECT feature, r, CASE WHEN r > 0 THEN '↑ risco' ELSE '↓ risco' END AS direction FROM ranked"


def _missing() -> str:
    kinds = {
        "loan_amnt": "decimal(12,2)", "int_rate": "decimal(6,4)", "annual_inc": "decimal(14,2)",
        "dti": "decimal(8,4)", "fico_avg": "double", "emp_length": "double", "revol_util": "decimal(6,4)",
        "open_acc": "int", "pub_rec": "int", "grade": "string",
        "funded_amnt": "decimal(12,2)", "installment": "decimal(10,2)", "lgd": "decimal(6,4)",
    }
    return " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", '{t}' AS dtype, CAST(COUNT(*) - COUNT({c}) AS BIGINT) AS missing_n, "
        f"ROUND((COUNT(*) - COUNT({c})) * 100e0 / COUNT(*), 6) AS missing_pct FROM loans"
        for c, t in kinds.items()
    )


_PROFILED = (*K.PROFILE_COLUMNS, "funded_amnt", "installment", "lgd")


def _histogram_sql(select: str) -> str:
    """Long winsorised values; limits come from the good class."""
    limits = ", ".join(
        f"QUANTILE_CONT(CAST({c} AS DOUBLE), {q}) AS {c}_{n}"
        for c in K.HISTOGRAM_COLUMNS for q, n in ((0.02, "lo"), (0.98, "hi"))
    )
    rows = " UNION ALL ".join(
        f"SELECT '{c}' AS feature, is_default AS bad, {c}_lo AS low, {c}_hi AS high, "
        f"GREATEST({c}_lo, LEAST({c}_hi, CAST({c} AS DOUBLE))) AS value FROM loans, limits WHERE {c} IS NOT NULL"
        for c in K.HISTOGRAM_COLUMNS
    )
    return f"limits AS (SELECT {limits} FROM loans WHERE NOT is_default), long_rows AS ({rows}){select}"


_HISTOGRAMS = _histogram_sql(""",
slots AS (SELECT feature, bad, (high - low) / 40 AS width,
    CASE WHEN high > low THEN LEAST(FLOOR((value - low) / ((high - low) / 40)), 39) ELSE 0 END AS slot FROM long_rows),
counts AS (SELECT feature, bad, slot, width, COUNT(*) AS n FROM slots GROUP BY ALL)
SELECT feature, CAST(bad AS INTEGER) AS is_default, CAST(slot AS INTEGER) AS slot, n,
  ROUND(n / (SUM(n) OVER (PARTITION BY feature, bad) * width), 9) AS density FROM counts""")

_FEATURE_KS = _histogram_sql(""",
points AS (SELECT feature, value, SUM(CASE WHEN bad THEN 1 ELSE 0 END) AS b, SUM(CASE WHEN bad THEN 0 ELSE 1 END) AS g
           FROM long_rows GROUP BY feature, value),
runs AS (SELECT feature, SUM(b) OVER (PARTITION BY feature ORDER BY value) / CAST(SUM(b) OVER (PARTITION BY feature) AS DOUBLE) AS fb,
           SUM(g) OVER (PARTITION BY feature ORDER BY value) / CAST(SUM(g) OVER (PARTITION BY feature) AS DOUBLE) AS fg FROM points)
SELECT feature, ROUND(MAX(ABS(fb - fg)), 6) AS ks FROM runs GROUP BY feature""")


def _population(statuses) -> str:
    return on_loans(f"""SELECT {_N} AS n_total, {DEFAULTS} AS n_defaults,
      CAST(SUM(CASE WHEN is_default THEN 0 ELSE 1 END) AS BIGINT) AS n_non_defaults,
      ROUND({DEFAULT_RATE}, 6) AS default_rate FROM loans WHERE loan_status IN ({quoted(statuses)})""")


QUERIES = {
    "portfolio_by_grade": (
        lambda s, d: P.portfolio_by_grade(loans(s, d)),
        _grade(f"""{_N} AS total_emprestimos, {_TOTAL} AS exposicao_total, ROUND({avg('loan_amnt')}, 2) AS ticket_medio,
        ROUND({avg('annual_inc')}, 2) AS rendimento_medio, ROUND({avg('dti')}, 4) AS dti_medio,
        ROUND({avg('fico_range_low')}, 1) AS fico_medio, ROUND({avg('int_rate')}, 4) AS taxa_juro_media,
        {DEFAULTS} AS total_defaults, {_DR4} AS taxa_default, ROUND({avg('lgd')}, 4) AS lgd_media,
        ROUND(CAST(SUM(loan_amnt * {_LGD}) AS DOUBLE), 2) AS perda_esperada,
        ROUND(CAST(SUM(loan_amnt * {_LGD}) AS DOUBLE) / NULLIF({_TOTAL}, 0), 4) AS ratio_perda_exposicao"""),
    ),
    "portfolio_summary_view": (
        lambda s, d: P.portfolio_summary(loans(s, d)),
        _grade(f"""{_N} AS total_loans, {_TOTAL} AS total_exposure, ROUND({avg('annual_inc')}, 6) AS avg_annual_income,
        ROUND({avg('dti')}, 6) AS avg_dti, ROUND({avg('fico_range_low')}, 6) AS avg_fico, {DEFAULTS} AS total_defaults,
        {_DR4} AS default_rate, ROUND({avg('lgd')}, 6) AS avg_lgd, CAST(SUM(loan_amnt * lgd) AS DOUBLE) AS expected_loss"""),
    ),
    "monthly_default_rates": (
        lambda s, d: P.monthly_default_rates(loans(s, d)),
        on_loans(f"""SELECT CAST(DATE_TRUNC('month', issue_d) AS DATE) AS month, {_N} AS total_loans, {DEFAULTS} AS defaults,
        {_DR4} AS default_rate, {_TOTAL} AS total_exposure FROM loans WHERE issue_d IS NOT NULL GROUP BY 1"""),
    ),
    "vintage_quarter": (
        lambda s, d: P.vintage_by_quarter(loans(s, d)),
        on_loans(f"""by_quarter AS (SELECT {_QUARTER} AS q, {_N} AS total, {_TOTAL} AS volume, {DEFAULTS} AS defaults,
        {_DR4} AS taxa_default, ROUND({avg('fico_range_low')}, 1) AS fico_medio, ROUND({avg('dti')}, 4) AS dti_medio
        FROM loans WHERE issue_d IS NOT NULL GROUP BY 1)
        SELECT {_quarter_label('q')} AS trimestre_emissao, total, volume, defaults, taxa_default, fico_medio, dti_medio FROM by_quarter"""),
    ),
    "quarterly_defaults_40": (
        lambda s, d: P.quarterly_defaults(loans(s, d)),
        on_loans(f"""by_quarter AS (SELECT {_QUARTER} AS q, {_N} AS total, {DEFAULTS} AS defaults, {_DR4} AS dr
        FROM loans WHERE issue_d IS NOT NULL GROUP BY 1 ORDER BY q LIMIT 40)
        SELECT {_quarter_label('q')} AS period, total, defaults, dr FROM by_quarter"""),
    ),
    "vintage_year": (
        lambda s, d: P.vintage_by_year(loans(s, d)),
        on_loans(f"""SELECT CAST(YEAR(issue_d) AS INTEGER) AS year, {_N} AS total_loans, {DEFAULTS} AS defaults, {_DR2} AS dr_pct,
        ROUND({_TOTAL} / 1000000, 1) AS exposure_m, ROUND({avg(_MID)}, 0) AS avg_fico FROM loans WHERE issue_d IS NOT NULL GROUP BY 1"""),
    ),
    "vintage_grade_pivot": (
        lambda s, d: P.vintage_grade_pivot(loans(s, d)),
        on_loans("""recent AS (SELECT DISTINCT """ + _QUARTER + """ AS q FROM loans WHERE issue_d IS NOT NULL ORDER BY q DESC LIMIT 20)
        SELECT CONCAT(CAST(YEAR(q) AS VARCHAR), 'Q', CAST(QUARTER(q) AS VARCHAR)) AS issue_quarter, """ + ", ".join(
            f"ROUND(SUM(CASE WHEN grade = '{g}' AND is_default THEN 1e0 WHEN grade = '{g}' THEN 0e0 END)"
            f" / NULLIF(SUM(CASE WHEN grade = '{g}' THEN 1 ELSE 0 END), 0) * 100, 6) AS {g}" for g in K.GRADES
        ) + f" FROM loans JOIN recent ON {_QUARTER} = q GROUP BY q"),
    ),
    "purpose_profile": (
        lambda s, d: P.purpose_profile(loans(s, d)),
        on_loans(f"""SELECT purpose AS finalidade, {_N} AS total, {_TOTAL} AS volume_total, ROUND({avg('loan_amnt')}, 2) AS ticket_medio,
        {_DR4} AS taxa_default, ROUND({avg('int_rate')}, 4) AS taxa_juro_media, ROUND({avg('fico_range_low')}, 1) AS fico_medio
        FROM loans WHERE purpose IS NOT NULL GROUP BY purpose"""),
    ),
    "purpose_top10": (
        lambda s, d: P.top_purposes(loans(s, d)),
        on_loans(f"SELECT purpose, {_N} AS total FROM loans WHERE purpose IS NOT NULL GROUP BY purpose ORDER BY total DESC, purpose LIMIT 10"),
    ),
    "purpose_riskiest8": (
        lambda s, d: P.query_portfolio(loans(s, d), "top_defaults"),
        on_loans(f"""SELECT purpose, {_N} AS emprestimos, {_DR2} AS taxa_default_pct FROM loans WHERE purpose IS NOT NULL
        GROUP BY purpose ORDER BY taxa_default_pct DESC, purpose LIMIT 8"""),
    ),
    "hhi_concentration": (
        lambda s, d: P.concentration(loans(s, d)),
        on_loans("""grade_sums AS (SELECT grade, CAST(SUM(loan_amnt) AS DOUBLE) AS exposure FROM loans WHERE grade IS NOT NULL GROUP BY grade),
        whole AS (SELECT CAST(SUM(loan_amnt) AS DOUBLE) AS amount FROM loans WHERE grade IS NOT NULL)
        SELECT grade, exposure, ROUND(exposure / amount * 100, 2) AS peso_pct,
          ROUND(POWER(exposure / amount, 2) * 10000, 2) AS hhi_contribuicao FROM grade_sums, whole"""),
    ),
    "fico_bands": (
        lambda s, d: P.fico_bands(loans(s, d)),
        on_loans(f"""SELECT {_BANDS} AS fico_band, {_N} AS total, {_DR4} AS taxa_default, ROUND({avg('loan_amnt')}, 2) AS ticket_medio,
        ROUND({avg('int_rate')}, 4) AS taxa_juro_media FROM loans WHERE fico_range_low IS NOT NULL GROUP BY 1"""),
    ),
    "fico_histogram": (
        lambda s, d: P.fico_histogram(loans(s, d)),
        on_loans(f"""SELECT CAST(FLOOR({_MID} / 20) * 20 AS INTEGER) AS fico_bucket, {_N} AS total, {_DR2} AS dr_pct
        FROM loans WHERE fico_range_low > 0 GROUP BY 1"""),
    ),
    "headline_kpis": (
        lambda s, d: P.headline_kpis(loans(s, d)),
        on_loans(f"""SELECT {_N} AS total_loans, COALESCE({_TOTAL}, 0) AS total_exposure, {_DR4} AS default_rate,
        ROUND({avg('fico_range_low')}, 1) AS avg_fico, ROUND({avg('dti')}, 2) AS avg_dti, ROUND({avg('int_rate')}, 4) AS avg_int_rate FROM loans"""),
    ),
    "dashboard_kpis": (
        lambda s, d: P.dashboard_kpis(loans(s, d)),
        on_loans(f"""SELECT {_N} AS total_loans, ROUND({_TOTAL} / 1000000, 1) AS total_exposure_m, {_DR2} AS default_rate_pct,
        ROUND({avg(_MID)}, 1) AS avg_fico, ROUND({avg('dti')}, 1) AS avg_dti, ROUND({avg('int_rate')} * 100, 2) AS avg_int_rate_pct,
        ROUND({_LOST} / 1000000, 1) AS realised_loss_m, ROUND({_TOTAL} * 0.08e0 / 1000000, 1) AS min_capital_m,
        COUNT(DISTINCT grade) AS n_grades, COUNT(DISTINCT YEAR(issue_d)) AS n_years FROM loans"""),
    ),
    "portfolio_overview": (
        lambda s, d: P.query_portfolio(loans(s, d), "overview"),
        on_loans(f"""SELECT {_N} AS total_emprestimos, ROUND({_TOTAL} / 1000000, 1) AS exposicao_milhoes, {_DR2} AS taxa_default_pct,
        ROUND({avg(_MID)}, 1) AS fico_medio, ROUND({avg('dti')}, 1) AS dti_medio, ROUND({avg('int_rate')} * 100, 2) AS taxa_juro_media_pct FROM loans"""),
    ),
    "portfolio_question_by_grade": (
        lambda s, d: P.query_portfolio(loans(s, d), "by_grade"),
        _grade(f"{_N} AS emprestimos, ROUND({_TOTAL} / 1000000, 1) AS exposicao_m, {_DR2} AS taxa_default_pct, ROUND({avg(_MID)}, 0) AS fico_medio"),
    ),
    "portfolio_question_vintage": (
        lambda s, d: P.query_portfolio(loans(s, d), "vintage"),
        on_loans(f"SELECT CAST(YEAR(issue_d) AS INTEGER) AS ano, {_N} AS emprestimos, {_DR2} AS taxa_default_pct FROM loans WHERE issue_d IS NOT NULL GROUP BY 1"),
    ),
    "portfolio_question_fico": (
        lambda s, d: P.query_portfolio(loans(s, d), "fico_distribution"),
        on_loans(f"""SELECT CAST(FLOOR({_MID} / 20) * 20 AS INTEGER) AS fico_bucket, {_N} AS total, {_DR2} AS taxa_default_pct
        FROM loans WHERE fico_range_low > 0 GROUP BY 1"""),
    ),
    "grade_mini": (lambda s, d: P.grade_mini(loans(s, d)), _grade(f"{_N} AS total, {_DR4} AS dr")),
    "grade_chart": (
        lambda s, d: P.grade_chart(loans(s, d)),
        _grade(f"{_N} AS total, {_TOTAL} AS exposure, {_DR4} AS dr, ROUND({avg('fico_range_low')}, 1) AS avg_fico"),
    ),
    "el_vs_realised": (
        lambda s, d: P.loss_by_grade(loans(s, d)),
        _grade(f"""ROUND({_TOTAL} / 1000000, 2) AS exposure_m, {_DR2} AS dr_pct, ROUND({avg(_LGD)} * 100, 2) AS avg_lgd_pct,
        ROUND({_LOST} / 1000000, 2) AS realised_loss_m, {_EXPECTED} AS expected_loss_m"""),
    ),
    "grade_snapshot": (
        lambda s, d: P.grade_snapshot(loans(s, d), SNAPSHOT_DATE),
        on_loans(f"""SELECT CAST('{SNAPSHOT_DATE}' AS DATE) AS snapshot_date, grade, COUNT(loan_amnt) AS total_loans, {_TOTAL} AS total_exposure,
        {_DR4} AS avg_pd, ROUND({avg('lgd')}, 4) AS avg_lgd,
        ROUND({_TOTAL} * {DEFAULT_RATE} * COALESCE({avg('lgd')}, 0.45e0), 2) AS expected_loss,
        {DEFAULTS} AS actual_defaults, {_DR4} AS default_rate FROM loans WHERE grade IS NOT NULL GROUP BY grade"""),
    ),
    "grade_risk_table": (
        lambda s, d: P.grade_risk_table(loans(s, d)),
        on_loans(f"""chart AS (SELECT grade, {_N} AS total, ROUND({_TOTAL} / 1000000, 2) AS exposure_m, {_DR4} AS dr,
          ROUND({avg('fico_range_low')}, 0) AS avg_fico FROM loans WHERE grade IS NOT NULL GROUP BY grade),
        el AS (SELECT grade, {_EXPECTED} AS expected_loss_m FROM loans WHERE grade IS NOT NULL GROUP BY grade)
        SELECT chart.*, expected_loss_m, CASE WHEN dr < 0.05 THEN 'Baixo' WHEN dr < 0.15 THEN 'Médio' WHEN dr < 0.25 THEN 'Alto'
          ELSE 'Muito Alto' END AS risk FROM chart LEFT JOIN el USING (grade)"""),
    ),
    "grade_stats": (
        lambda s, d: P.grade_statistics(loans(s, d)),
        _grade(f"""COUNT(loan_amnt) AS total, {_TOTAL} AS exposicao, ROUND({avg('loan_amnt')}, 6) AS ticket_medio,
        ROUND({avg('fico_avg')}, 6) AS fico_medio, ROUND({avg('dti')}, 6) AS dti_medio, ROUND({avg('int_rate')}, 6) AS taxa_juro_media,
        ROUND({DEFAULT_RATE}, 6) AS taxa_default, ROUND({_TOTAL} / 1000000, 6) AS exposicao_m, ROUND({DEFAULT_RATE} * 100, 6) AS taxa_default_pct"""),
    ),
    "riskiest_grade": (
        lambda s, d: P.riskiest_grade(loans(s, d)),
        on_loans(f"""SELECT grade, ROUND({DEFAULT_RATE} * 100, 4) AS taxa_default_pct FROM loans WHERE grade IS NOT NULL
        GROUP BY grade ORDER BY {DEFAULT_RATE} DESC, grade LIMIT 1"""),
    ),
    "missing_profile": (lambda s, d: X.missing_profile(loans(s, d), _PROFILED), on_loans(_missing())),
    "class_default_rates": (
        lambda s, d: X.class_default_rates(loans(s, d)),
        on_loans(" UNION ALL ".join(
            f"SELECT '{view}' AS view, {key} AS \"key\", {_N} AS n_loans, ROUND({DEFAULT_RATE} * 100, 6) AS default_rate_pct "
            f"FROM loans WHERE {key} IS NOT NULL GROUP BY {key}"
            for view, key in (
                ("is_default", "CAST(CAST(is_default AS INTEGER) AS VARCHAR)"),
                ("grade", "grade"),
                ("issue_year", "CAST(YEAR(issue_d) AS VARCHAR)"),
            )
        )),
    ),
    "executive_summary": (
        lambda s, d: P.executive_summary(loans(s, d)),
        on_loans(f"""SELECT {_N} AS n_loans, {_DR2} AS default_rate_pct, ROUND({_TOTAL} / 1000000, 1) AS exposure_m,
        ROUND({avg('loan_amnt')}, 0) AS ticket_medio, ROUND({avg('fico_avg')}, 0) AS fico_medio, ROUND({avg('dti')}, 1) AS dti_medio FROM loans"""),
    ),
    "correlation_matrix": (lambda s, d: X.correlation_matrix(loans(s, d)), on_loans("matrix AS (" + _corr_rows() + ") SELECT * FROM matrix")),
    "target_correlation_rank": (
        lambda s, d: X.target_correlations(loans(s, d), K.CORRELATION_COLUMNS[1:]),
        on_loans(_target_corr(K.CORRELATION_COLUMNS[1:])),
    ),
    "target_correlation_top3": (
        lambda s, d: X.target_correlations(loans(s, d), K.TOP_CORRELATION_COLUMNS, top=3),
        on_loans(_target_corr(K.TOP_CORRELATION_COLUMNS) + " ORDER BY ABS(r) DESC, feature LIMIT 3"),
    ),
    "class_histograms": (lambda s, d: X.class_histograms(loans(s, d)), on_loans(_HISTOGRAMS)),
    "feature_ks": (lambda s, d: X.feature_ks(loans(s, d)), on_loans(_FEATURE_KS)),
    "class_weights": (
        lambda s, d: X.class_weights(loans(s, d).filter(F.col("loan_status").isin(*K.RESOLVED_STATUSES))),
        on_loans(f"""SELECT CAST(SUM(CASE WHEN is_default THEN 0 ELSE 1 END) AS BIGINT) AS neg, {DEFAULTS} AS pos,
        ROUND(CAST(SUM(CASE WHEN is_default THEN 0 ELSE 1 END) AS DOUBLE) / GREATEST({DEFAULTS}, 1), 6) AS scale_pos_weight
        FROM loans WHERE loan_status IN ({quoted(K.RESOLVED_STATUSES)})"""),
    ),
    "resolved_population": (lambda s, d: X.population_counts(loans(s, d), K.RESOLVED_STATUSES), _population(K.RESOLVED_STATUSES)),
    "final_population": (lambda s, d: X.population_counts(loans(s, d), K.FINAL_STATUSES), _population(K.FINAL_STATUSES)),
}
