"""Admission, cleaning, derived features, typing and imputation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom import constants as K
from riskloom.functions.columns import (
    at_least_one,
    clean_emp_length,
    clean_rate,
    clean_term,
    clip,
    grade_number,
    parse_issue_month,
)
from riskloom.operators.targets import build_targets
from riskloom.schemas import LOAN_TYPES


def admissible_loans(raw: DataFrame, *, check_amount: bool = True) -> DataFrame:
    """Rows with a status, a grade, an income and (unless told otherwise) an amount."""
    ok = F.col("loan_status").isNotNull() & F.col("grade").isNotNull() & (F.col("annual_inc") > 0)
    if check_amount:
        ok = ok & (F.col("loan_amnt") > 0)
    return raw.filter(ok)


def _is_text(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, T.StringType)


def clean_fields(raw: DataFrame) -> DataFrame:
    """Rate as a fraction, employment in years, term in months.

    Fields that are already numbers pass through, so the step can be repeated.
    """
    return raw.withColumns(
        {
            "int_rate": clean_rate("int_rate"),
            "emp_length": clean_emp_length("emp_length", numeric=not _is_text(raw, "emp_length")),
            "term_months": clean_term("term"),
        }
    )


def derive_features(loans: DataFrame, *, strict_verified: bool = False) -> DataFrame:
    """Ratios, flags and the grade number.

    By default any verification text with the word 'verified' counts, also
    'Not Verified'; ``strict_verified`` leaves that one out.
    """
    income = at_least_one("annual_inc")
    status = F.lower(F.col("verification_status"))
    verified = F.coalesce(status.contains("verified"), F.lit(False))
    if strict_verified:
        verified = verified & ~status.startswith("not")

    def flag(condition):
        return F.coalesce(condition, F.lit(False)).cast("int")

    return loans.withColumns(
        {
            "loan_to_income": F.col("loan_amnt").cast("double") / income,
            "fico_avg": (F.col("fico_range_low") + F.col("fico_range_high")).cast("double") / 2,
            "payment_ratio": F.col("installment").cast("double") / income * 12,
            "is_mortgage": flag(F.col("home_ownership") == "MORTGAGE"),
            "is_own": flag(F.col("home_ownership") == "OWN"),
            "is_long_term": flag(F.col("term_months") == K.LONG_TERM_MONTHS),
            "is_verified": flag(verified),
            "grade_num": grade_number("grade"),
        }
    )


def conform(loans: DataFrame) -> DataFrame:
    """Table types: dates, zero-filled counts, limited ranges, decimals of fixed scale."""
    changes = {
        "term": F.trim(F.coalesce(F.col("term"), F.lit(K.DEFAULT_TERM_TEXT))),
    }
    if _is_text(loans, "issue_d"):
        changes["issue_d"] = parse_issue_month("issue_d")
    for name in K.ZERO_FILLED_INTEGERS:
        if name in loans.columns:
            number = F.col(name).try_cast("double") if _is_text(loans, name) else F.col(name)
            changes[name] = F.coalesce(number, F.lit(0)).cast("int")
    for name, (low, high) in K.VALUE_RANGES.items():
        if name in loans.columns:
            changes[name] = clip(F.col(name).try_cast("double"), low, high)
    df = loans.withColumns(changes)
    return df.withColumns(
        {name: F.col(name).try_cast(kind) for name, kind in LOAN_TYPES.items() if name in df.columns}
    )


def build_loans(raw: DataFrame, *, check_amount: bool = True, loss: bool = True) -> DataFrame:
    """Raw rows to the typed loan table with targets and features.

    Features are derived from the untyped values, as the table's fixed scales would
    round the ratios.
    """
    df = admissible_loans(raw, check_amount=check_amount)
    df = build_targets(df, loss=loss)
    df = derive_features(clean_fields(df))
    return conform(df)


def sanitize(df: DataFrame, limits: dict[str, int] | None = None) -> DataFrame:
    """NaN and infinities to NULL, over-long text cut to its column's limit."""
    limits = K.TEXT_LIMITS if limits is None else limits
    changes = {}
    for field in df.schema:
        c = F.col(field.name)
        if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            finite = ~F.isnan(c) & (F.abs(c) != F.lit(float("inf")))
            changes[field.name] = F.when(finite, c)
        elif isinstance(field.dataType, T.StringType) and field.name in limits:
            changes[field.name] = F.substring(c, 1, limits[field.name])
    return df.withColumns(changes) if changes else df


def fill_medians(df: DataFrame, columns: Sequence[str], fit_on: DataFrame | None = None) -> DataFrame:
    """Exact medians of the given columns, from the training rows if given, into the gaps."""
    from riskloom.operators.quantiles import exact_quantiles

    medians = exact_quantiles(df if fit_on is None else fit_on, columns, [0.5])
    return df.withColumns(
        {
            name: F.coalesce(F.col(name).cast("double"), F.lit(values[0]))
            for name, values in medians.items()
            if values is not None
        }
    )


def complete_cases(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.na.drop(subset=list(columns))
