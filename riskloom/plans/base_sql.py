"""SQL for DuckDB that derives the same loan book as the adapter, as CTE text."""

from __future__ import annotations

from riskloom import constants as K


def quoted(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def avg(x: str) -> str:
    return f"(CAST(SUM({x}) AS DOUBLE) / NULLIF(COUNT({x}), 0))"


def money(x: str) -> str:
    return f"CAST(CAST(CAST({x} AS DECIMAL(24,6)) AS DECIMAL(24,2)) AS DOUBLE)"


def share(flag: str) -> str:
    return f"(CAST(SUM(CASE WHEN {flag} THEN 1 ELSE 0 END) AS DOUBLE) / NULLIF(COUNT(*), 0))"


DEFAULT_RATE = share("is_default")
DEFAULTS = "CAST(SUM(CASE WHEN is_default THEN 1 ELSE 0 END) AS BIGINT)"


def clip(x: str, low, high) -> str:
    return f"CASE WHEN {x} IS NULL THEN NULL WHEN {x} < {low} THEN {low} WHEN {x} > {high} THEN {high} ELSE {x} END"


RAW = """
returned_lines AS (
  SELECT l_orderkey, SUM(CAST(l_extendedprice AS DECIMAL(12,2))) AS returned
  FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_orderkey
),
seeds AS (
  SELECT o_orderkey AS ok, o_orderdate, o_orderpriority, c_mktsegment, returned,
    (o_orderkey*7919 + o_custkey*10473) % 1000 AS h, (o_orderkey*31 + o_custkey*17) % 54 AS f,
    (o_orderkey*13 + o_custkey*7) % 100 AS m, (o_orderkey*53 + o_custkey*29) % 450 AS dt,
    CAST(o_totalprice AS DECIMAL(12,2)) AS amt, CAST(c_acctbal AS DECIMAL(12,2)) AS bal
  FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN returned_lines ON l_orderkey = o_orderkey
),
graded AS (
  SELECT *, CASE WHEN f >= 44 THEN 0 WHEN f >= 36 THEN 1 WHEN f >= 28 THEN 2 WHEN f >= 20 THEN 3
                 WHEN f >= 12 THEN 4 WHEN f >= 6 THEN 5 ELSE 6 END AS gi FROM seeds
),
outcomes AS (SELECT *, h < 30 + 50*gi + (dt - dt % 5) // 5 AS bad FROM graded),
statuses AS (
  SELECT *, CASE WHEN bad AND h % 5 < 3 THEN 'Charged Off' WHEN bad AND h % 5 = 3 THEN 'Default'
    WHEN bad THEN 'Late (31-120 days)' WHEN m % 4 = 0 THEN 'Current' ELSE 'Fully Paid' END AS status,
    CASE WHEN m <> 9 THEN CAST(CAST(CAST(amt*100 AS BIGINT) // (CASE WHEN m % 4 = 0 THEN 60 ELSE 36 END)
      AS DECIMAL(12,0)) * CAST(0.01 AS DECIMAL(3,2)) AS DECIMAL(10,2)) END AS instalment
  FROM outcomes
),
raw_loans AS (
  SELECT ok AS loan_id, amt AS loan_amnt,
    CASE WHEN m < 3 THEN NULL WHEN m < 10 THEN CAST(amt * CAST(0.9 AS DECIMAL(2,1)) AS DECIMAL(12,2)) ELSE amt END AS funded_amnt,
    CASE WHEN m = 1 THEN NULL WHEN m % 4 = 0 THEN ' 60 months' ELSE ' 36 months' END AS term,
    CONCAT(CAST(CAST(CAST(500 + 300*gi + h % 300 AS DECIMAL(6,0)) * CAST(0.01 AS DECIMAL(3,2)) AS DECIMAL(6,2)) AS VARCHAR), '%') AS int_rate,
    instalment AS installment, SUBSTR('ABCDEFG', CAST(gi + 1 AS BIGINT), 1) AS grade,
    CONCAT(SUBSTR('ABCDEFG', CAST(gi + 1 AS BIGINT), 1), CAST(h % 5 + 1 AS VARCHAR)) AS sub_grade,
    CASE WHEN m < 5 THEN NULL WHEN m < 15 THEN '< 1 year' WHEN m < 25 THEN '10+ years'
         ELSE CONCAT(CAST(m % 9 + 1 AS VARCHAR), ' years') END AS emp_length,
    CASE c_mktsegment WHEN 'BUILDING' THEN 'MORTGAGE' WHEN 'HOUSEHOLD' THEN 'OWN' ELSE 'RENT' END AS home_ownership,
    CAST(bal * 10 + 20000 AS DECIMAL(14,2)) AS annual_inc,
    CASE m % 3 WHEN 0 THEN 'Verified' WHEN 1 THEN 'Source Verified' ELSE 'Not Verified' END AS verification_status,
    CAST(o_orderdate AS DATE) AS issue_d, status AS loan_status,
    CASE o_orderpriority WHEN '1-URGENT' THEN 'medical' WHEN '2-HIGH' THEN 'credit_card'
      WHEN '3-MEDIUM' THEN 'debt_consolidation' WHEN '4-NOT SPECIFIED' THEN 'other' ELSE 'home_improvement' END AS purpose,
    CAST(dt AS DOUBLE) / 10 AS dti, CAST(m % 4 AS INTEGER) AS delinq_2yrs,
    CAST(580 + 5*f AS INTEGER) AS fico_range_low, CAST(584 + 5*f AS INTEGER) AS fico_range_high,
    CAST(h % 7 AS INTEGER) AS inq_last_6mths, CAST(1 + f % 20 AS INTEGER) AS open_acc, CAST(m % 2 AS INTEGER) AS pub_rec,
    CAST(dt*100 + h AS DOUBLE) AS revol_bal, CAST(m AS DOUBLE) AS revol_util, CAST(5 + f % 40 AS INTEGER) AS total_acc,
    CASE WHEN status = 'Current' THEN CAST(amt * CAST(0.5 AS DECIMAL(2,1)) AS DECIMAL(12,2)) ELSE CAST(0 AS DECIMAL(12,2)) END AS out_prncp,
    CAST(amt * CAST(0.7 AS DECIMAL(2,1)) AS DECIMAL(12,2)) AS total_pymnt,
    CAST(amt * CAST(0.6 AS DECIMAL(2,1)) AS DECIMAL(12,2)) AS total_rec_prncp,
    CAST(amt * CAST(0.1 AS DECIMAL(2,1)) AS DECIMAL(12,2)) AS total_rec_int,
    CASE WHEN bad THEN CAST(returned * CAST(0.1 AS DECIMAL(2,1)) AS DECIMAL(12,2)) END AS recoveries,
    CAST(instalment AS DECIMAL(12,2)) AS last_pymnt_amnt
  FROM statuses
)"""

_LOW, _HIGH = K.LGD_RANGE

TARGETS = f"""
admitted AS (
  SELECT *, COALESCE(loan_status IN ({quoted(K.DEFAULT_STATUSES)}), FALSE) AS is_default
  FROM raw_loans WHERE loan_status IS NOT NULL AND annual_inc > 0 AND loan_amnt > 0 AND grade IS NOT NULL
),
losses AS (
  SELECT *, CASE WHEN is_default AND loan_amnt > 0 THEN
      GREATEST({_LOW}e0, LEAST({_HIGH}e0, 1e0 - GREATEST(0e0, LEAST(1e0,
        CAST(COALESCE(recoveries, 0) AS DOUBLE) / GREATEST(CAST(loan_amnt AS DOUBLE), 1e0))))) END AS first_lgd
  FROM admitted
),
grade_means AS (
  SELECT grade AS g, AVG(first_lgd) AS mean_lgd FROM losses WHERE first_lgd < {_HIGH}e0 GROUP BY grade
),
targets AS (
  SELECT losses.*, CASE WHEN first_lgd >= {_HIGH}e0 THEN COALESCE(mean_lgd, {K.LGD_WITHOUT_HISTORY}e0) ELSE first_lgd END AS full_lgd,
    COALESCE(funded_amnt, loan_amnt) AS ead,
    CASE WHEN is_default THEN GREATEST(0e0, LEAST(1e0, CAST(COALESCE(funded_amnt, loan_amnt) AS DOUBLE)
      / GREATEST(CAST(loan_amnt AS DOUBLE), 1e0))) END AS full_ccf
  FROM losses LEFT JOIN grade_means ON grade = g
)"""

LOANS = f"""
cleaned AS (
  SELECT *, TRY_CAST(REPLACE(TRIM(int_rate), '%', '') AS DOUBLE) AS rate_number,
    CASE WHEN emp_length IS NULL THEN 5e0 WHEN LOWER(emp_length) LIKE '%10+%' THEN 10e0
      WHEN LOWER(emp_length) LIKE '%< 1%' OR LOWER(emp_length) LIKE '%less%' THEN 0.5e0
      ELSE COALESCE(TRY_CAST(REGEXP_REPLACE(emp_length, '[^0-9]', '', 'g') AS DOUBLE), 5e0) END AS emp_years,
    COALESCE(TRY_CAST(REGEXP_REPLACE(term, '[^0-9]', '', 'g') AS INTEGER), 36) AS term_months
  FROM targets
),
loans AS (
  SELECT loan_id, loan_amnt, funded_amnt, TRIM(COALESCE(term, '36 months')) AS term, term_months,
    CAST({clip("(CASE WHEN rate_number > 1 THEN rate_number / 100 ELSE rate_number END)", "0e0", "0.9999e0")} AS DECIMAL(6,4)) AS int_rate,
    installment, grade, sub_grade, emp_years AS emp_length, home_ownership, annual_inc, verification_status,
    issue_d, loan_status, purpose, CAST({clip("dti", "0e0", "200e0")} AS DECIMAL(8,4)) AS dti,
    delinq_2yrs, fico_range_low, fico_range_high, inq_last_6mths, open_acc, pub_rec,
    CAST(revol_bal AS DECIMAL(14,2)) AS revol_bal,
    CAST({clip("revol_util", "0e0", "99.99e0")} AS DECIMAL(6,4)) AS revol_util, total_acc,
    out_prncp, total_pymnt, total_rec_prncp, total_rec_int, recoveries, last_pymnt_amnt, is_default,
    CAST({clip("full_lgd", "0e0", "0.9999e0")} AS DECIMAL(6,4)) AS lgd, ead,
    CAST({clip("full_ccf", "0e0", "0.9999e0")} AS DECIMAL(6,4)) AS ccf,
    CAST(loan_amnt AS DOUBLE) / GREATEST(CAST(annual_inc AS DOUBLE), 1e0) AS loan_to_income,
    CAST(fico_range_low + fico_range_high AS DOUBLE) / 2 AS fico_avg,
    CAST(installment AS DOUBLE) / GREATEST(CAST(annual_inc AS DOUBLE), 1e0) * 12 AS payment_ratio,
    CASE WHEN home_ownership = 'MORTGAGE' THEN 1 ELSE 0 END AS is_mortgage,
    CASE WHEN home_ownership = 'OWN' THEN 1 ELSE 0 END AS is_own,
    CASE WHEN term_months = 60 THEN 1 ELSE 0 END AS is_long_term,
    CASE WHEN LOWER(verification_status) LIKE '%verified%' THEN 1 ELSE 0 END AS is_verified,
    CASE grade WHEN 'A' THEN 1 WHEN 'B' THEN 2 WHEN 'C' THEN 3 WHEN 'D' THEN 4 WHEN 'E' THEN 5
      WHEN 'F' THEN 6 WHEN 'G' THEN 7 ELSE 4 END AS grade_num
  FROM cleaned
)"""


def on_raw(body: str) -> str:
    return f"WITH {RAW}{_join(body)}"


def on_targets(body: str) -> str:
    return f"WITH {RAW},{TARGETS}{_join(body)}"


def on_loans(body: str) -> str:
    return f"WITH {RAW},{TARGETS},{LOANS}{_join(body)}"


def _join(body: str) -> str:
    """A body starts either with SELECT or with further CTEs ('name AS (...)')."""
    text = body.strip()
    return ("\n" + text) if text.upper().startswith("SELECT") else (",\n" + text)
