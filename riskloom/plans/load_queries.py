"""Scan, load, cleaning and feature queries, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom import constants as K
from riskloom.functions import columns as C
from riskloom.operators import features as Fe
from riskloom.operators import loading as L
from riskloom.operators import portfolio as P
from riskloom.operators import targets as T
from riskloom.plans.base_sql import DEFAULT_RATE, avg, clip, on_loans, on_raw, on_targets, quoted
from riskloom.plans.book import loans, metrics
from riskloom.plans.metric_sql import METRICS
from riskloom.sources.testbook import raw_loans

SAMPLE = 4000
APPEND_CUTOFF = "1999-01-01"


def _as_plain(df, *names):
    """Decimals to double for output; other types stay."""
    kinds = dict(df.dtypes)
    return df.select(*(F.col(n).cast("double").alias(n) if kinds[n].startswith("decimal") else F.col(n) for n in names))


def admissible(s, d):
    return _as_plain(
        Fe.admissible_loans(raw_loans(s, d)),
        "loan_id", "loan_amnt", "term", "int_rate", "grade", "annual_inc", "issue_d", "loan_status", "dti",
    )


def arithmetic_hash():
    """A hash that any SQL engine can compute."""
    return (F.col("loan_id") % 4294967291 * 1103515245 + 42) % (1 << 32)


def hash_sample(s, d):
    raw = raw_loans(s, d).select("loan_id", "loan_amnt", "loan_status", "annual_inc", "grade")
    sampled = L.sample_rows(raw, SAMPLE, "loan_id", arithmetic_hash())
    return _as_plain(Fe.admissible_loans(sampled), "loan_id", "loan_amnt", "grade")


def append_new(s, d):
    book = loans(s, d).select("loan_id", "loan_amnt", "grade", "issue_d")
    target = book.filter(F.col("issue_d") < APPEND_CUTOFF)
    batch = book.unionByName(book.filter(F.col("issue_d") >= APPEND_CUTOFF))
    return _as_plain(L.new_rows(batch, target), "loan_id", "loan_amnt", "grade", "issue_d")


def sanitized(s, d):
    raw = raw_loans(s, d)
    ratio = F.when(F.col("revol_util") == 0, F.lit(float("nan"))).when(
        F.col("revol_util") == 99, F.lit(float("inf"))
    ).otherwise(F.col("revol_util"))
    dirty = raw.select("loan_id", "verification_status", "purpose", "loan_status", ratio.alias("ratio"))
    limits = {"verification_status": 8, "purpose": 10, "loan_status": 50}
    return Fe.sanitize(dirty, limits)


def conformed(s, d):
    """Typing of a raw file: month text to dates, gaps, junk and out-of-range values."""
    raw = raw_loans(s, d).withColumns(
        {
            "issue_d": F.when(F.col("loan_id") % 17 == 0, "unknown").otherwise(F.date_format("issue_d", "MMM-yyyy")),
            "dti": F.when(F.col("loan_id") % 11 == 0, 999.0).when(F.col("loan_id") % 13 == 0, -1.0).otherwise(F.col("dti")),
            "delinq_2yrs": F.when(F.col("loan_id") % 7 == 0, "n/a").otherwise(F.col("delinq_2yrs").cast("string")),
            "revol_util": F.col("revol_util") + 1.5,
        }
    )
    df = Fe.conform(Fe.clean_fields(raw))
    return _as_plain(df, "loan_id", "term", "issue_d", "dti", "delinq_2yrs", "revol_util", "int_rate", "open_acc")


def cleaned(s, d):
    raw = raw_loans(s, d)
    return Fe.clean_fields(raw).select(
        "loan_id", "int_rate", "emp_length", "term_months",
        C.clean_rate(F.lit("0.9%")).alias("small_rate"),
        C.clean_rate(F.lit("abc")).alias("bad_rate"),
    )


def defaults_and_targets(s, d):
    df = T.with_exposure(T.with_raw_lgd(T.with_default_flag(raw_loans(s, d))))
    return df.select(
        "loan_id", F.col("is_default").cast("int").alias("is_default"),
        F.round("lgd", 9).alias("lgd"), F.col("ead").cast("double").alias("ead"), F.round("ccf", 9).alias("ccf"),
    )


def imputed_lgd(s, d):
    df = T.impute_lgd(T.with_raw_lgd(T.with_default_flag(Fe.admissible_loans(raw_loans(s, d)))))
    return df.filter("is_default").select("loan_id", "grade", F.round("lgd", 9).alias("lgd"))


def features(s, d):
    return loans(s, d).select(
        "loan_id", F.round("loan_to_income", 9).alias("loan_to_income"), "fico_avg",
        F.round("payment_ratio", 9).alias("payment_ratio"),
        "is_mortgage", "is_own", "is_long_term", "is_verified", "grade_num",
    )


GAP_COLUMNS = ("funded_amnt", "installment", "payment_ratio", "dti")


def medians(s, d):
    df = Fe.fill_medians(loans(s, d), GAP_COLUMNS)
    return df.select("loan_id", *(F.round(c, 6).alias(c) for c in GAP_COLUMNS))


def verified_target(s, d):
    return (
        loans(s, d).filter(F.col("is_default") & F.col("lgd").isNotNull()).groupBy("grade")
        .agg(F.count(F.lit(1)).alias("n"), P.avg_rounded("lgd", 6).alias("mean_lgd"), P.avg_rounded("ead", 6).alias("mean_ead"))
    )


_RATE = "(CASE WHEN x > 1 THEN x / 100 ELSE x END)"
_MEDIAN = {c: f"(SELECT QUANTILE_CONT(CAST({c} AS DOUBLE), 0.5) FROM loans)" for c in GAP_COLUMNS}
_ESTIMATE = " ".join(
    f"WHEN rate < {r} OR fico_avg >= {f} THEN {n}" for r, f, n in K.GRADE_ESTIMATE_RULES
)

QUERIES = {
    "admissible_loans": (
        admissible,
        on_raw("""SELECT loan_id, CAST(loan_amnt AS DOUBLE) AS loan_amnt, term, int_rate, grade, CAST(annual_inc AS DOUBLE) AS annual_inc,
        issue_d, loan_status, dti FROM raw_loans
        WHERE loan_status IS NOT NULL AND annual_inc > 0 AND loan_amnt > 0 AND grade IS NOT NULL"""),
    ),
    "hash_sample": (
        hash_sample,
        on_raw(f"""sampled AS (SELECT * FROM raw_loans ORDER BY (loan_id % 4294967291 * 1103515245 + 42) % 4294967296, loan_id LIMIT {SAMPLE})
        SELECT loan_id, CAST(loan_amnt AS DOUBLE) AS loan_amnt, grade FROM sampled
        WHERE loan_status IS NOT NULL AND annual_inc > 0 AND loan_amnt > 0 AND grade IS NOT NULL"""),
    ),
    "row_count": (
        lambda s, d: raw_loans(s, d).agg(F.count(F.lit(1)).alias("n")),
        on_raw("SELECT COUNT(*) AS n FROM raw_loans"),
    ),
    "append_new_antijoin": (
        append_new,
        on_loans(f"""SELECT loan_id, CAST(loan_amnt AS DOUBLE) AS loan_amnt, grade, issue_d FROM loans
        WHERE loan_id NOT IN (SELECT loan_id FROM loans WHERE issue_d < DATE '{APPEND_CUTOFF}')"""),
    ),
    "sanitize": (
        sanitized,
        on_raw("""SELECT loan_id, SUBSTR(verification_status, 1, 8) AS verification_status, SUBSTR(purpose, 1, 10) AS purpose, loan_status,
        CASE WHEN revol_util = 0 OR revol_util = 99 THEN NULL ELSE revol_util END AS ratio FROM raw_loans"""),
    ),
    "conform_types": (
        conformed,
        on_raw(f"""messy AS (SELECT *, CASE WHEN loan_id % 11 = 0 THEN 999e0 WHEN loan_id % 13 = 0 THEN -1e0 ELSE dti END AS x,
          revol_util + 1.5e0 AS u, TRY_CAST(REPLACE(int_rate, '%', '') AS DOUBLE) AS r FROM raw_loans)
        SELECT loan_id, TRIM(COALESCE(term, '36 months')) AS term,
          CASE WHEN loan_id % 17 = 0 THEN NULL ELSE CAST(DATE_TRUNC('month', issue_d) AS DATE) END AS issue_d,
          CAST(CAST({clip('x', '0e0', '200e0')} AS DECIMAL(8,4)) AS DOUBLE) AS dti,
          CASE WHEN loan_id % 7 = 0 THEN 0 ELSE delinq_2yrs END AS delinq_2yrs,
          CAST(CAST({clip('u', '0e0', '99.99e0')} AS DECIMAL(6,4)) AS DOUBLE) AS revol_util,
          CAST(CAST(CASE WHEN r > 1 THEN r / 100 ELSE r END AS DECIMAL(6,4)) AS DOUBLE) AS int_rate, open_acc FROM messy"""),
    ),
    "load_checks": (
        lambda s, d: L.load_checks(loans(s, d), metrics(s, d), P.grade_snapshot(loans(s, d), "2024-01-31")),
        on_loans(METRICS + f""",
        checks AS (SELECT CAST(COUNT(*) AS DOUBLE) AS total_loans, CAST(SUM(CASE WHEN is_default THEN 1 ELSE 0 END) AS DOUBLE) AS defaults,
          ROUND({DEFAULT_RATE} * 100, 2) AS default_rate_pct, CAST(COUNT(DISTINCT grade) AS DOUBLE) AS grades,
          CAST(COUNT(DISTINCT YEAR(issue_d)) AS DOUBLE) AS issue_years, ROUND(CAST(SUM(loan_amnt) AS DOUBLE) / 1000000, 1) AS exposure_m,
          ROUND({avg('(fico_range_low + fico_range_high)')} / 2, 1) AS mean_fico,
          CAST((SELECT COUNT(*) FROM metrics) AS DOUBLE) AS metric_rows, CAST(COUNT(DISTINCT grade) AS DOUBLE) AS snapshot_rows FROM loans)
        SELECT label, value FROM (UNPIVOT checks ON COLUMNS(*) INTO NAME label VALUE value)"""),
    ),
    "default_targets": (
        defaults_and_targets,
        on_targets(f"""flags AS (SELECT *, COALESCE(loan_status IN ({quoted(K.DEFAULT_STATUSES)}), FALSE) AS bad FROM raw_loans)
        SELECT loan_id, CAST(bad AS INTEGER) AS is_default,
          ROUND(CASE WHEN bad AND loan_amnt > 0 THEN GREATEST(0.05e0, LEAST(0.99e0, 1e0 - GREATEST(0e0, LEAST(1e0,
            CAST(COALESCE(recoveries, 0) AS DOUBLE) / GREATEST(CAST(loan_amnt AS DOUBLE), 1e0))))) END, 9) AS lgd,
          CAST(COALESCE(funded_amnt, loan_amnt) AS DOUBLE) AS ead,
          ROUND(CASE WHEN bad THEN LEAST(1e0, CAST(COALESCE(funded_amnt, loan_amnt) AS DOUBLE) / GREATEST(CAST(loan_amnt AS DOUBLE), 1e0)) END, 9) AS ccf
        FROM flags"""),
    ),
    "lgd_imputed": (
        imputed_lgd,
        on_targets("SELECT loan_id, grade, ROUND(full_lgd, 9) AS lgd FROM targets WHERE is_default"),
    ),
    "cleaners": (
        cleaned,
        on_targets(f"""numbers AS (SELECT *, TRY_CAST(REPLACE(TRIM(int_rate), '%', '') AS DOUBLE) AS x FROM raw_loans)
        SELECT loan_id, {_RATE} AS int_rate,
          CASE WHEN emp_length IS NULL THEN 5e0 WHEN emp_length LIKE '%10+%' THEN 10e0 WHEN emp_length LIKE '%< 1%' THEN 0.5e0
            ELSE CAST(REGEXP_EXTRACT(emp_length, '[0-9]+') AS DOUBLE) END AS emp_length,
          CASE WHEN term IS NULL THEN 36 ELSE CAST(REGEXP_EXTRACT(term, '[0-9]+') AS INTEGER) END AS term_months,
          0.9e0 AS small_rate, CAST(NULL AS DOUBLE) AS bad_rate FROM numbers"""),
    ),
    "features": (
        features,
        on_loans("""SELECT loan_id, ROUND(loan_to_income, 9) AS loan_to_income, fico_avg, ROUND(payment_ratio, 9) AS payment_ratio,
        is_mortgage, is_own, is_long_term, is_verified, grade_num FROM loans"""),
    ),
    "median_impute": (
        medians,
        on_loans("SELECT loan_id, " + ", ".join(
            f"ROUND(COALESCE(CAST({c} AS DOUBLE), {_MEDIAN[c]}), 6) AS {c}" for c in GAP_COLUMNS
        ) + " FROM loans"),
    ),
    "complete_cases": (
        lambda s, d: Fe.complete_cases(loans(s, d), ("funded_amnt", "installment", "lgd")).select("loan_id", "grade"),
        on_loans("SELECT loan_id, grade FROM loans WHERE funded_amnt IS NOT NULL AND installment IS NOT NULL AND lgd IS NOT NULL"),
    ),
    "grade_estimate": (
        lambda s, d: loans(s, d).groupBy(
            C.estimated_grade_number((F.col("int_rate") * 100).cast("double"), "fico_avg").alias("estimated"), "grade"
        ).agg(F.count(F.lit(1)).alias("n")),
        on_loans(f"""rates AS (SELECT *, CAST(int_rate * 100 AS DOUBLE) AS rate FROM loans)
        SELECT CASE {_ESTIMATE} ELSE 7 END AS estimated, grade, COUNT(*) AS n FROM rates GROUP BY ALL"""),
    ),
    "defaulted_with_target": (
        verified_target,
        on_loans(f"""SELECT grade, COUNT(*) AS n, ROUND({avg('lgd')}, 6) AS mean_lgd, ROUND({avg('ead')}, 6) AS mean_ead
        FROM loans WHERE is_default AND lgd IS NOT NULL GROUP BY grade"""),
    ),
}
