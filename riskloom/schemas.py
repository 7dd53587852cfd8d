"""Schemas of the raw file and of the tables."""

from __future__ import annotations

# Types of the loan table. Everything not listed keeps the type the derivation gives it.
LOAN_TYPES = {
    "loan_amnt": "decimal(12,2)",
    "funded_amnt": "decimal(12,2)",
    "int_rate": "decimal(6,4)",
    "installment": "decimal(10,2)",
    "annual_inc": "decimal(14,2)",
    "dti": "decimal(8,4)",
    "revol_bal": "decimal(14,2)",
    "revol_util": "decimal(6,4)",
    "out_prncp": "decimal(12,2)",
    "total_pymnt": "decimal(12,2)",
    "total_rec_prncp": "decimal(12,2)",
    "total_rec_int": "decimal(12,2)",
    "recoveries": "decimal(12,2)",
    "last_pymnt_amnt": "decimal(12,2)",
    "lgd": "decimal(6,4)",
    "ead": "decimal(12,2)",
    "ccf": "decimal(6,4)",
}

RAW_LOANS = """
    loan_id long, loan_amnt double, funded_amnt double, term string, int_rate string,
    installment double, grade string, sub_grade string, emp_length string,
    home_ownership string, annual_inc double, verification_status string,
    issue_d string, loan_status string, purpose string, dti double, delinq_2yrs int,
    fico_range_low int, fico_range_high int, inq_last_6mths int, open_acc int,
    pub_rec int, revol_bal double, revol_util double, total_acc int, out_prncp double,
    total_pymnt double, total_rec_prncp double, total_rec_int double,
    recoveries double, last_pymnt_amnt double
"""

APPLICATIONS = """
    fico_score double, dti double, int_rate double, annual_inc double,
    loan_amnt double, emp_length double, purpose string, home_ownership string
"""

MODEL_PREDICTIONS = """
    id string, loan_ref string, model_type string, model_version string,
    prediction decimal(10,6), score short, rating string, input_features string,
    created_at timestamp
"""

MODEL_METRICS = """
    model_type string, model_version string, metric_name string,
    metric_value decimal(16,6), evaluation_date date, dataset string
"""

PORTFOLIO_SNAPSHOTS = """
    snapshot_date date, grade string, total_loans int, total_exposure decimal(16,2),
    avg_pd decimal(6,4), avg_lgd decimal(6,4), expected_loss decimal(16,2),
    actual_defaults int, default_rate decimal(6,4)
"""

FEATURE_WOE = """
    feature_name string, bin_label string, bin_min double, bin_max double,
    count_total int, count_events int, count_non_events int,
    woe decimal(10,6), iv decimal(10,6), model_type string
"""

BATCH_JOBS = """
    job_id string, job_name string, model_type string, status string, total_records long,
    processed long, result_file string, error_message string,
    created_at timestamp, logged_at timestamp, completed_at timestamp
"""
