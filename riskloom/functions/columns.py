"""Column expressions shared by the operators. All run inside the JVM."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from riskloom import constants as K


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clip(c: Column | str, low: float | None = None, high: float | None = None) -> Column:
    """Limit a value to a range. NULL stays NULL, unlike bare ``least``/``greatest``."""
    value = col(c)
    limited = value
    if high is not None:
        limited = F.least(F.lit(high), limited)
    if low is not None:
        limited = F.greatest(F.lit(low), limited)
    return F.when(value.isNotNull(), limited)


def at_least_one(c: Column | str) -> Column:
    """Floor a denominator at 1."""
    return clip(col(c).cast("double"), low=1.0)


def rounded(c: Column | str, digits: int) -> Column:
    return F.round(col(c).cast("double"), digits)


def money(c: Column | str) -> Column:
    """Cents, half up. Six digits first, so binary noise around half a cent plays no part."""
    return F.round(F.round(col(c).cast("double"), 6), 2)


def mean(c: Column | str) -> Column:
    """Average as one exact sum over one count.

    ``avg`` of a decimal rounds to a few extra digits first; this keeps the full sum.
    """
    value = col(c)
    return F.try_divide(F.sum(value).cast("double"), F.count(value))


def share_true(flag: Column | str) -> Column:
    """Share of rows where the flag holds; NULL counts as not held."""
    return F.try_divide(F.count_if(col(flag)).cast("double"), F.count(F.lit(1)))


def banded(c: Column | str, bands: Sequence[tuple[float, object]], top: object, *, inclusive=False, unknown: object = None) -> Column:
    """First label whose upper limit lies above the value (or equals it, if inclusive).

    An unknown value has no label, unless ``unknown`` names one.
    """
    value = col(c)
    steps = [((value <= limit) if inclusive else (value < limit), label) for limit, label in bands]
    first_condition, first_label = steps[0]
    chain = F.when(first_condition, F.lit(first_label))
    for condition, label in steps[1:]:
        chain = chain.when(condition, F.lit(label))
    return F.when(value.isNull(), F.lit(unknown)).otherwise(chain.otherwise(F.lit(top)))


def looked_up(c: Column | str, table: Mapping[str, float], missing: float) -> Column:
    """Value of a small fixed table, compiled into the expression."""
    pairs = [F.lit(x) for item in table.items() for x in item]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), col(c)), F.lit(missing))


def number_sql(x: float) -> str:
    return f"{float(x)!r}D" if math.isfinite(x) else f"double('{float(x)}')"


def _slot(name: str, edges: Sequence[float], reaches: str) -> Column:
    """Count of inner edges a value reaches, NULL outside the outer ones.

    Written as one SQL text: assembling it call by call is slow with many edges.
    """
    value = f"CAST(`{name}` AS DOUBLE)"
    low, *inner, high = (number_sql(e) for e in edges)
    steps = " + ".join(f"CAST({value} {reaches} {e} AS INT)" for e in inner) or "0"
    return F.expr(f"CASE WHEN {value} >= {low} AND {value} <= {high} THEN {steps} END")


def interval(name: str, edges: Sequence[float]) -> Column:
    """Zero-based index of the right-closed interval a column's value falls in.

    The lowest edge belongs to the first interval; values outside get NULL.
    """
    return _slot(name, edges, ">")


def histogram_slot(name: str, edges: Sequence[float]) -> Column:
    """Like :func:`interval` with left-closed slots; the last slot is closed on both sides."""
    return _slot(name, edges, ">=")


# --- cleaners --------------------------------------------------------------------
def clean_rate(c: Column | str) -> Column:
    """'13.99%' to 0.1399. Numbers up to 1 are taken as fractions already; junk is NULL."""
    number = F.replace(F.trim(col(c).cast("string")), F.lit("%"), F.lit("")).try_cast("double")
    return number / F.when(number > 1, F.lit(100.0)).otherwise(F.lit(1.0))


def digits_of(c: Column | str) -> Column:
    return F.regexp_replace(col(c).cast("string"), "[^0-9]", "")


def clean_emp_length(c: Column | str, numeric: bool = False) -> Column:
    """Years of employment. Numeric input passes through, so cleaning twice is harmless."""
    if numeric:
        return F.coalesce(col(c).cast("double"), F.lit(K.DEFAULT_EMP_YEARS))
    text = F.lower(F.trim(col(c)))
    return (
        F.when(text.isNull(), F.lit(K.DEFAULT_EMP_YEARS))
        .when(text.contains("10+"), F.lit(K.LONG_EMP_YEARS))
        .when(text.contains("< 1") | text.contains("less"), F.lit(K.SHORT_EMP_YEARS))
        .otherwise(F.coalesce(digits_of(text).try_cast("double"), F.lit(K.DEFAULT_EMP_YEARS)))
    )


def clean_term(c: Column | str) -> Column:
    """' 36 months' to 36; missing or without digits is 36."""
    return F.coalesce(digits_of(c).try_cast("int"), F.lit(K.DEFAULT_TERM_MONTHS))


def parse_issue_month(c: Column | str) -> Column:
    """'Dec-2015' to 2015-12-01; junk is NULL."""
    return F.try_to_timestamp(col(c), F.lit("MMM-yyyy")).cast("date")


def grade_number(c: Column | str) -> Column:
    numbers = {grade: float(i) for i, grade in enumerate(K.GRADES, start=1)}
    return looked_up(c, numbers, float(K.UNKNOWN_GRADE_NUM)).cast("int")


def estimated_grade_number(rate_pct: Column | str, fico: Column | str) -> Column:
    """Grade number from the rate in percent or the credit score, first rule that fits."""
    rate, score = col(rate_pct), col(fico)
    chain = None
    for rate_below, score_from, number in K.GRADE_ESTIMATE_RULES:
        fits = (rate < rate_below) | (score >= score_from)
        chain = F.when(fits, number) if chain is None else chain.when(fits, number)
    return chain.otherwise(K.LAST_GRADE_NUM)


def is_default(status: Column | str) -> Column:
    return F.coalesce(col(status).isin(*K.DEFAULT_STATUSES), F.lit(False))


def quarter_label(c: Column | str) -> Column:
    """Quarter text with the quarter number on both sides of the T, as in 2017-3T3."""
    date = col(c)
    q = F.quarter(date).cast("string")
    return F.concat(F.year(date).cast("string"), F.lit("-"), q, F.lit("T"), q)
