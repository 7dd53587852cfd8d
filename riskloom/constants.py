"""Every list, label, threshold and coefficient that results depend on.

They are data, not logic: the operators take them as defaults and every one can be
replaced by an argument.
"""

from __future__ import annotations

import math

# --- populations (fixed values) -------------------------------------------------
DEFAULT_STATUSES = (
    "Charged Off",
    "Default",
    "Does not meet the credit policy. Status:Charged Off",
    "Does not meet the credit policy. Status:Default",
    "Late (121-150 days)",
    "Late (31-120 days)",
)

# Training population: loans whose outcome is settled. Late loans are not in it.
RESOLVED_STATUSES = (
    "Fully Paid",
    "Charged Off",
    "Default",
    "Does not meet the credit policy. Status:Fully Paid",
    "Does not meet the credit policy. Status:Charged Off",
)

# Validation and binning population: late loans are in it.
FINAL_STATUSES = (
    "Fully Paid",
    "Charged Off",
    "Default",
    "Does not meet the credit policy. Status:Charged Off",
    "Does not meet the credit policy. Status:Fully Paid",
    "Late (121-150 days)",
    "Late (31-120 days)",
)

# --- features (fixed values) ----------------------------------------------------
GRADES = ("A", "B", "C", "D", "E", "F", "G")
UNKNOWN_GRADE_NUM = 4

PD_FEATURES = (
    "fico_avg", "dti", "int_rate", "annual_inc", "emp_length",
    "loan_to_income", "revol_util", "open_acc", "pub_rec",
    "grade_num", "is_mortgage", "is_own", "is_long_term", "is_verified",
)
LGD_FEATURES = (
    "loan_amnt", "funded_amnt", "is_mortgage", "is_own",
    "annual_inc", "dti", "revol_bal", "fico_avg",
    "int_rate", "grade_num", "loan_to_income",
)
EAD_FEATURES = (
    "loan_amnt", "funded_amnt", "int_rate", "is_long_term",
    "annual_inc", "dti", "loan_to_income",
)
EXTRA_IV_FEATURES = ("delinq_2yrs", "revol_bal", "loan_amnt", "funded_amnt", "payment_ratio")

PROFILE_COLUMNS = (
    "loan_amnt", "int_rate", "annual_inc", "dti", "fico_avg",
    "emp_length", "revol_util", "open_acc", "pub_rec", "grade",
)
CORRELATION_COLUMNS = (
    "is_default", "fico_avg", "dti", "int_rate", "annual_inc", "loan_amnt",
    "revol_util", "emp_length", "open_acc", "pub_rec", "loan_to_income", "grade_num",
)
TOP_CORRELATION_COLUMNS = (
    "fico_avg", "dti", "int_rate", "grade_num", "revol_util", "loan_to_income",
)
HISTOGRAM_COLUMNS = ("fico_avg", "dti", "int_rate", "annual_inc", "loan_amnt", "revol_util")

# --- cleaning (fixed values) ----------------------------------------------------
DEFAULT_EMP_YEARS = 5.0
SHORT_EMP_YEARS = 0.5
LONG_EMP_YEARS = 10.0
DEFAULT_TERM_MONTHS = 36
LONG_TERM_MONTHS = 60
DEFAULT_TERM_TEXT = "36 months"

ZERO_FILLED_INTEGERS = (
    "delinq_2yrs", "fico_range_low", "fico_range_high",
    "inq_last_6mths", "open_acc", "pub_rec", "total_acc",
)
VALUE_RANGES = {
    "revol_util": (0.0, 99.99),
    "int_rate": (0.0, 0.9999),
    "ccf": (0.0, 0.9999),
    "lgd": (0.0, 0.9999),
    "dti": (0.0, 200.0),
}
TEXT_LIMITS = {
    "term": 20,
    "grade": 2,
    "sub_grade": 3,
    "emp_length": 20,
    "home_ownership": 20,
    "verification_status": 30,
    "loan_status": 50,
    "purpose": 50,
}

# --- loss parameters (fixed values) ---------------------------------------------
LGD_RANGE = (0.05, 0.99)
LGD_WITHOUT_HISTORY = 0.65
DOWNTURN_LGD = 0.45
CAPITAL_RATIO = 0.08

# --- score scale (fixed values) -------------------------------------------------
SCORECARD_PDO = 20
SCORECARD_BASE = 600
SCORECARD_ODDS = 1.0
SCORECARD_FACTOR = SCORECARD_PDO / math.log(2)
SCORECARD_OFFSET = SCORECARD_BASE - SCORECARD_FACTOR * math.log(SCORECARD_ODDS)
POINTS_TOP = 850
POINTS_SPAN = 550
POINTS_FLOOR = 300
PD_RANGE = (0.001, 0.999)
LGD_SCORE_RANGE = (0.01, 0.99)

# --- analytic scoring (fixed values) --------------------------------------------
PD_WEIGHTS = {
    "intercept": -4.5,
    "fico_pivot": 700,
    "fico": 0.015,
    "dti": 0.04,
    "int_rate": 0.07,
    "income_unit": 10000,
    "income_cap": 5,
    "income": 0.12,
    "emp_length": 0.03,
    "revol_util": 0.008,
}
PD_PURPOSE = {
    "small_business": 0.08,
    "medical": 0.05,
    "other": 0.03,
    "debt_consolidation": 0.0,
    "credit_card": 0.02,
    "home_improvement": -0.02,
}
PD_HOME = {"RENT": 0.05, "MORTGAGE": 0.0, "OWN": -0.03}
RATING_CUTOFFS = {
    "service": ((0.03, "A"), (0.07, "B"), (0.12, "C"), (0.18, "D"), (0.24, "E"), (0.32, "F")),
    "basic": ((0.05, "A"), (0.10, "B"), (0.15, "C"), (0.20, "D"), (0.25, "E"), (0.35, "F")),
}
LAST_RATING = "G"

LGD_COLLATERAL_WEIGHT = 0.30
LGD_RECOVERY_CAP = 0.3
LGD_HOME = {"OWN": -0.05, "MORTGAGE": -0.02, "RENT": 0.08}
LGD_CREDIT_TYPE = {"mortgage": -0.15, "secured": -0.10, "unsecured": 0.0}
LGD_BASIC_RENT = 0.10

CCF_BASE = {"revolving": 0.40, "line": 0.35, "term": 0.25}
CCF_DEFAULT_BASE = 0.40
CCF_UTILISATION_WEIGHT = 0.25

GRADE_ESTIMATE_RULES = (
    # rate below, score at or above, grade number
    (7.5, 780, 1),
    (10.5, 740, 2),
    (13.5, 700, 3),
    (16.5, 670, 4),
    (19.5, 640, 5),
    (23.0, 610, 6),
)
LAST_GRADE_NUM = 7

PD_REQUEST_DEFAULTS = {
    "fico_score": 700.0,
    "dti": 15.0,
    "int_rate": 12.0,
    "annual_inc": 60000.0,
    "emp_length": 5.0,
    "loan_amnt": 10000.0,
}
COMBINED_DEFAULTS = {"pd": 0.14, "lgd": 0.45}
MODEL_REQUEST_DEFAULTS = {
    "int_rate": 0.12,
    "annual_inc": 60000.0,
    "dti": 15.0,
    "revol_bal": 5000.0,
    "fico_avg": 700.0,
    "grade_num": 4.0,
}
REQUEST_RANGES = {
    "fico_score": (580.0, 850.0),
    "dti": (0.0, 50.0),
    "int_rate": (0.0, 35.0),
    "emp_length": (0.0, 10.0),
    "revol_util": (0.0, 100.0),
    "annual_inc": (0.0, None),
    "loan_amnt": (0.0, None),
    "open_acc": (0.0, None),
    "pub_rec": (0.0, None),
}
LGD_REQUEST_RANGES = {"loan_amnt": (0.0, None), "collateral_value": (0.0, None), "recoveries": (0.0, None)}
EAD_REQUEST_RANGES = {"credit_limit": (0.0, None), "committed_amount": (0.0, None), "drawn_amount": (0.0, None)}
# What a request that lacks a field is scored with.
REQUEST_DEFAULTS = {
    "pd": {
        **PD_REQUEST_DEFAULTS, "purpose": "debt_consolidation", "home_ownership": "MORTGAGE", "open_acc": 8.0,
        "revol_util": 30.0, "pub_rec": 0.0, "term_months": 36,
    },
    "lgd": {"loan_amnt": 10000.0, "collateral_value": 0.0, "recoveries": 0.0, "home_ownership": "MORTGAGE", "credit_type": "unsecured"},
    "ead": {"credit_limit": 20000.0, "committed_amount": 10000.0, "drawn_amount": 5000.0, "product_type": "revolving"},
}

# sensitivity lines: (intercept, slope)
LGD_COLLATERAL_LINES = {"mortgage": (0.45, -0.30), "rent": (0.55, -0.30)}
CCF_UTILISATION_LINES = {"revolving": (0.40, 0.25), "term": (0.30, 0.15)}

# --- labels (fixed values; users read them, so they keep their language) ---------
PD_RISK_BANDS = ((0.05, "Baixo"), (0.15, "Moderado"), (0.25, "Alto"))
GRADE_RISK_BANDS = ((0.05, "Baixo"), (0.15, "Médio"), (0.25, "Alto"))
TOP_RISK = "Muito Alto"
LGD_RISK_BANDS = ((0.30, "Baixo"), (0.60, "Médio"))
LGD_TOP_RISK = "Alto"
IV_BANDS = ((0.02, "Muito Fraco"), (0.10, "Fraco"), (0.30, "Médio"), (0.50, "Forte"))
IV_TOP = "Suspeito"
PSI_SHORT_BANDS = ((0.10, "Estável"), (0.25, "Monitorizar"))
PSI_SHORT_TOP = "Instável"
PSI_LONG_BANDS = ((0.10, "Estável"), (0.25, "Ligeira Alteração — Monitorizar"))
PSI_LONG_TOP = "Alteração Significativa — Recalibrar"
CALIBRATION_BANDS = ((0.02, "BOA CALIBRAÇÃO"), (0.05, "CALIBRAÇÃO ACEITÁVEL"))
CALIBRATION_TOP = "RECALIBRAR"
GINI_BANDS = ((0.20, "Abaixo EBA"), (0.35, "Aceitável"))
GINI_TOP = "Adequado (IRB Unsecured)"
STATUS_OK, STATUS_WARN, STATUS_BAD = "CONFORME", "ATENÇÃO", "CRÍTICO"
CONFORM, NOT_CONFORM = "Conforme", "Não Conforme"

FICO_COARSE = (
    (600, "A: <600 (Alto Risco)"),
    (650, "B: 600-650"),
    (700, "C: 650-700"),
    (750, "D: 700-750"),
)
FICO_COARSE_TOP = "E: ≥750 (Baixo Risco)"
DTI_COARSE = ((10, "A: <10%"), (20, "B: 10-20%"), (30, "C: 20-30%"), (40, "D: 30-40%"))
DTI_COARSE_TOP = "E: ≥40%"
FICO_BAND_STARTS = tuple(range(580, 780, 20))

# --- threshold policies (fixed values) ------------------------------------------
# (policy, model, metric, ok, warn, lower is better)
THRESHOLDS = (
    ("status", "PD", "gini", 0.50, 0.40, False),
    ("status", "PD", "ks", 0.30, None, False),
    ("status", "PD", "auc_roc", 0.75, None, False),
    ("status", "PD", "brier_score", 0.25, None, True),
    ("dashboard", "PD", "gini", 0.20, 0.15, False),
    ("dashboard", "PD", "ks", 0.20, 0.15, False),
    ("dashboard", "PD", "auc_roc", 0.65, 0.60, False),
    ("dashboard", "PD", "brier_score", 0.25, 0.30, True),
    ("dashboard", "LGD", "r2", 0.01, 0.0, False),
    ("dashboard", "LGD", "rmse", 0.15, 0.20, True),
    ("dashboard", "LGD", "mae", 0.10, 0.15, True),
    ("dashboard", "EAD", "r2", 0.80, 0.50, False),
    ("dashboard", "EAD", "rmse", 1000.0, 5000.0, True),
    ("report", "PD", "gini", 0.20, None, False),
    ("report", "PD", "ks", 0.20, None, False),
    ("report", "PD", "auc_roc", 0.65, None, False),
    ("report", "PD", "brier_score", 0.25, None, True),
    ("report", "LGD", "r2", 0.0, None, False),
    ("report", "LGD", "rmse", 0.20, None, True),
    ("report", "LGD", "mae", 0.15, None, True),
    ("report", "EAD", "r2", 0.80, None, False),
    ("report", "EAD", "rmse", 5000.0, None, True),
    ("flag", "PD", "gini", 0.20, None, False),
    ("validation", "PD", "gini", 0.35, None, False),
    ("validation", "PD", "ks", 0.25, None, False),
    ("validation", "PD", "auc_roc", 0.65, None, False),
    ("validation", "PD", "brier_score", 0.25, None, True),
    ("benchmark", "PD", "auc_roc", 0.60, None, False),
    ("benchmark", "PD", "gini", 0.20, None, False),
    ("benchmark", "PD", "ks", 0.20, None, False),
    ("benchmark", "PD", "brier_score", 0.25, None, True),
    ("benchmark", "LGD", "r2", 0.01, None, False),
    ("benchmark", "LGD", "rmse", 0.15, None, True),
    ("benchmark", "LGD", "mae", 0.10, None, True),
    ("benchmark", "EAD", "r2", 0.80, None, False),
    ("benchmark", "EAD", "rmse", 1000.0, None, True),
)

SAVED_METRIC_DEFAULTS = {"gini": 0.4105, "ks": 0.2982, "auc_roc": 0.7052, "brier_score": 0.2146}
SAVED_ERROR_DEFAULTS = {"LGD": {"r2": 0.0079, "rmse": 0.0717, "mae": 0.0355}, "EAD": {"r2": 1.0, "rmse": 35.17}}
