"""Bulk scoring: formulas over whole tables, batch files, stress tables, input checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom import constants as K
from riskloom.functions import scorecards as S
from riskloom.functions.columns import banded, money, rounded


def applications(loans: DataFrame) -> DataFrame:
    """Loans as scoring requests: mid credit score, rate in percent."""
    return loans.select(
        "loan_id",
        "grade",
        "issue_d",
        "loan_status",
        "is_default",
        F.col("fico_avg").alias("fico_score"),
        F.col("dti").cast("double").alias("dti"),
        (F.col("int_rate") * 100).cast("double").alias("int_rate"),
        F.col("annual_inc").cast("double").alias("annual_inc"),
        F.col("loan_amnt").cast("double").alias("loan_amnt"),
        "emp_length",
        F.col("revol_util").cast("double").alias("revol_util"),
        "open_acc",
        "pub_rec",
        "purpose",
        "home_ownership",
        "term_months",
    )


def pd_column(variant: str = "service", **given: Column) -> Column:
    """PD of a request; inputs under other names can be given by keyword."""

    def arg(name: str) -> Column:
        return given.get(name, F.col(name))

    shared = [arg(n) for n in ("fico_score", "dti", "int_rate", "annual_inc", "emp_length")]
    if variant == "basic":
        return S.pd_basic(*shared)
    return S.pd_service(*shared, arg("revol_util"), arg("purpose"), arg("home_ownership"))


def with_defaults(requests: DataFrame, kind: str) -> DataFrame:
    """Requests of a model (pd, lgd or ead) in which absent and empty fields have their defaults."""
    given = set(requests.columns)
    return requests.withColumns(
        {n: F.coalesce(F.col(n), F.lit(v)) if n in given else F.lit(v) for n, v in K.REQUEST_DEFAULTS[kind].items()}
    )


def score_pd(requests: DataFrame, variant: str = "service", key: str = "loan_id") -> DataFrame:
    with_pd = with_defaults(requests, "pd").withColumn("_pd", pd_column(variant))
    outputs = S.pd_outputs("_pd", "loan_amnt", variant)
    return with_pd.select(key, *(c.alias(name) for name, c in outputs.items()))


def score_lgd(requests: DataFrame, variant: str = "service", key: str = "loan_id") -> DataFrame:
    """Reads loan_amnt, collateral_value, recoveries, home_ownership and, for the service
    variant, credit_type; absent ones have their defaults."""
    requests = with_defaults(requests, "lgd")
    inputs = ("loan_amnt", "collateral_value", "recoveries", "home_ownership")
    lgd = S.lgd_basic(*inputs) if variant == "basic" else S.lgd_service(*inputs, "credit_type")
    outputs = S.lgd_outputs("_lgd", "loan_amnt", variant)
    return requests.withColumn("_lgd", lgd).select(key, *(c.alias(n) for n, c in outputs.items()))


def score_ead(requests: DataFrame, variant: str = "service", key: str = "loan_id") -> DataFrame:
    """Reads credit_limit, committed_amount, drawn_amount and, for the service variant,
    product_type; absent ones have their defaults."""
    requests = with_defaults(requests, "ead")
    inputs = ("credit_limit", "committed_amount", "drawn_amount")
    product = None if variant == "basic" else "product_type"
    outputs = S.ead_outputs(*inputs, product)
    return requests.select(key, *(c.alias(n) for n, c in outputs.items()))


# --- batch files -----------------------------------------------------------------
def given_or_default(name: str) -> Column:
    """The value, or the request default where it is missing, not a number or zero."""
    c = F.col(name).cast("double")
    return F.when(c.isNull() | F.isnan(c) | (c == 0), F.lit(K.PD_REQUEST_DEFAULTS[name])).otherwise(c)


def score_batch(
    requests: DataFrame, key: str, models: Sequence[str] = ("pd", "lgd", "ead")
) -> DataFrame:
    """Batch results with PD, LGD, exposure and expected loss per row.

    Only the five shared terms enter the PD, and the LGD knows the amount only, as the
    batch file has no collateral. A part that is not asked for falls back to its default.
    """
    x = requests.select(
        key,
        F.col("fico_score").alias("fico"),
        F.col("dti").alias("given_dti"),
        *(given_or_default(n).alias(n) for n in K.PD_REQUEST_DEFAULTS),
    )
    zero = F.lit(0.0)
    pd = pd_column("basic") if "pd" in models else zero
    lgd = S.lgd_basic("loan_amnt", zero, zero, F.lit("RENT")) if "lgd" in models else F.lit(K.DOWNTURN_LGD)
    x = x.withColumns({"_pd": pd, "_lgd": lgd})
    loss = F.col("loan_amnt") * F.round("_pd", 4) * F.round("_lgd", 4)
    return x.select(
        F.col(key).alias("idx"),
        "fico",
        F.col("given_dti").alias("dti"),
        F.round(F.col("_pd") * 100, 2).alias("pd_pct"),
        (S.rating("_pd", "basic") if "pd" in models else F.lit("—")).alias("grade"),
        (F.round(F.col("_lgd") * 100, 2) if "lgd" in models else zero).alias("lgd_pct"),
        money("loan_amnt").alias("ead"),
        money(loss).alias("expected_loss"),
    )


def score_portfolio(requests: DataFrame, key: str = "loan_id") -> DataFrame:
    """Combined risk: PD times LGD times EAD, with a default for any missing part."""
    x = requests.withColumns(
        {
            "_pd": F.round(pd_column("service"), 6),
            "_lgd": F.round(
                S.lgd_service("loan_amnt", F.lit(0.0), F.lit(0.0), "home_ownership", F.lit("unsecured")), 6
            ),
        }
    )
    pd = F.coalesce("_pd", F.lit(K.COMBINED_DEFAULTS["pd"]))
    lgd = F.coalesce("_lgd", F.lit(K.COMBINED_DEFAULTS["lgd"]))
    ead = F.coalesce(F.col("ead").cast("double"), F.col("loan_amnt").cast("double"))
    return x.select(
        key,
        pd.alias("pd"),
        lgd.alias("lgd"),
        ead.alias("ead"),
        money(pd * lgd * ead).alias("expected_loss"),
    )


def to_predictions(
    requests: DataFrame, variant: str = "basic", version: str = "analytic_v1", created_at=None
) -> DataFrame:
    """PD rows for the table of predictions; the request is kept as JSON."""
    x = requests.withColumn("_pd", pd_column(variant))
    stamp = F.current_timestamp() if created_at is None else F.lit(created_at).cast("timestamp")
    inputs = ("fico_score", "dti", "int_rate", "annual_inc", "emp_length")
    return x.select(
        F.concat_ws("-", F.lit("PD"), F.lit(version), F.col("loan_id").cast("string")).alias("id"),
        F.col("loan_id").cast("string").alias("loan_ref"),
        F.lit("PD").alias("model_type"),
        F.lit(version).alias("model_version"),
        F.round("_pd", 6).cast("decimal(10,6)").alias("prediction"),
        S.points("_pd").cast("short").alias("score"),
        S.rating("_pd", variant).alias("rating"),
        F.to_json(F.struct(*inputs)).alias("input_features"),
        stamp.alias("created_at"),
    )


# --- explanations ----------------------------------------------------------------
FACTOR_NAMES = {  # fixed values
    "fico": "FICO Score",
    "dti": "Rácio DTI",
    "int_rate": "Taxa de Juro",
    "income": "Rendimento Anual",
    "emp_length": "Tempo de Emprego",
}


def risk_factors(requests: DataFrame, key: str = "loan_id") -> DataFrame:
    """Five signed contributions per request with their share and rank by size.

    The rank comes from sorting a five-element array within the row, so nothing is shuffled.
    """
    terms = S.pd_terms("fico_score", "dti", "int_rate", "annual_inc", "emp_length")
    x = requests.select(key, *(c.alias(f"t_{n}") for n, c in terms.items()))
    size = sum((F.abs(F.col(f"t_{n}")) for n in terms), F.lit(0.0))
    entries = F.array(
        *(
            F.struct(
                (-F.abs(F.col(f"t_{n}"))).alias("order"),
                F.lit(FACTOR_NAMES[n]).alias("factor"),
                F.col(f"t_{n}").alias("value"),
            )
            for n in terms
        )
    )
    return x.select(key, size.alias("size"), F.posexplode(F.array_sort(entries)).alias("at", "x")).select(
        key,
        (F.col("at") + 1).alias("position"),
        F.col("x.factor").alias("factor"),
        rounded("x.value", 6).alias("value"),
        F.round(F.try_divide(-F.col("x.order"), F.col("size")), 6).alias("pct"),
    )


def decisions(scored: DataFrame, key: str = "loan_id") -> DataFrame:
    """Decision codes for the PD, LGD and utilisation (in percent) of each row."""
    return scored.select(
        key,
        banded("pd", ((0.05, "eligible"), (0.15, "guarantees")), "not_recommended").alias("pd_decision"),
        banded("lgd", ((0.30, "low"), (0.60, "moderate")), "high").alias("lgd_decision"),
        banded("utilization", ((30, "low"), (70, "moderate")), "high").alias("ead_decision"),
    )


# --- stress ----------------------------------------------------------------------
def stress_grid(loans: DataFrame, group: str = "home_ownership") -> DataFrame:
    """Portfolio loss under collateral cover from 0 to 100 % and conversion factors under
    utilisation from 0 to 100 %.

    Both lines are linear in the amounts, so the book is summed per group first and only
    the sums are spread over the eleven points.
    """
    sums = loans.groupBy(group).agg(
        F.sum("loan_amnt").cast("double").alias("amount"),
        F.count_if("is_default").alias("defaults"),
        F.sum(F.when(F.col("is_default"), F.col("loan_amnt"))).cast("double").alias("bad_amount"),
    )
    (m0, m1), (r0, r1) = K.LGD_COLLATERAL_LINES["mortgage"], K.LGD_COLLATERAL_LINES["rent"]
    (c0, c1), (t0, t1) = K.CCF_UTILISATION_LINES["revolving"], K.CCF_UTILISATION_LINES["term"]
    at = F.col("step") / 10.0
    rents = F.col(group) == "RENT"
    lgd = F.when(rents, F.lit(r0) + at * r1).otherwise(F.lit(m0) + at * m1)
    return sums.select("*", F.explode(F.sequence(F.lit(0), F.lit(10))).alias("step")).select(
        group,
        F.round(at, 1).alias("ratio"),
        F.round(lgd, 4).alias("lgd"),
        money(F.coalesce(F.col("bad_amount"), F.lit(0.0)) * lgd).alias("stressed_loss"),
        F.round(F.lit(c0) + at * c1, 4).alias("ccf_revolving"),
        F.round(F.lit(t0) + at * t1, 4).alias("ccf_term"),
        money(F.col("amount") * (at + (F.lit(1.0) - at) * (F.lit(c0) + at * c1))).alias("ead_revolving"),
    )


# --- input checks ----------------------------------------------------------------
def with_violations(requests: DataFrame, ranges: dict | None = None) -> DataFrame:
    """Add the names of the fields outside their range; an absent field is accepted."""
    ranges = K.REQUEST_RANGES if ranges is None else ranges
    found = []
    for name, (low, high) in ranges.items():
        if name not in requests.columns:
            continue
        top = float("inf") if high is None else high  # not-a-number lies above every limit
        found.append(F.when(~F.col(name).cast("double").between(low, top), F.lit(name)))
    return requests.withColumn("violations", F.array_compact(F.array(*found)))


def split_valid(requests: DataFrame, ranges: dict | None = None) -> tuple[DataFrame, DataFrame]:
    """Valid requests, and rejected ones with their violations."""
    checked = with_violations(requests, ranges)
    bad = F.size("violations") > 0
    return checked.filter(~bad).drop("violations"), checked.filter(bad)
