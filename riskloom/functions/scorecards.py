"""Analytic PD, LGD and EAD formulas as column expressions.

Each function takes columns and returns a dict of named columns, so the same formula
serves a batch table, a stream and a model fallback.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from riskloom import constants as K
from riskloom.functions.columns import at_least_one, banded, clip, col, looked_up, money, rounded

Columns = dict[str, Column]


def pd_terms(fico, dti, rate_pct, income, emp_years) -> Columns:
    """The five signed terms of the log-odds shared by both PD variants."""
    w = K.PD_WEIGHTS
    capped_income = F.least(col(income) / w["income_unit"], F.lit(float(w["income_cap"])))
    return {
        "fico": (F.lit(float(w["fico_pivot"])) - col(fico)) * w["fico"],
        "dti": col(dti) * w["dti"],
        "int_rate": col(rate_pct) * w["int_rate"],
        "income": -capped_income * w["income"],
        "emp_length": -col(emp_years) * w["emp_length"],
    }


def pd_basic(fico, dti, rate_pct, income, emp_years) -> Column:
    """Probability of default from the five shared terms."""
    t = pd_terms(fico, dti, rate_pct, income, emp_years)
    odds = (
        F.lit(K.PD_WEIGHTS["intercept"])
        + t["fico"] + t["dti"] + t["int_rate"] + t["income"] + t["emp_length"]
    )
    return _probability(odds)


def pd_service(fico, dti, rate_pct, income, emp_years, revol_util, purpose, home) -> Column:
    """Probability of default with utilisation, purpose and housing terms."""
    t = pd_terms(fico, dti, rate_pct, income, emp_years)
    odds = (
        F.lit(K.PD_WEIGHTS["intercept"])
        + t["fico"] + t["dti"] + t["int_rate"] + t["income"] + t["emp_length"]
        + col(revol_util) * K.PD_WEIGHTS["revol_util"]
        + looked_up(purpose, K.PD_PURPOSE, 0.0)
        + looked_up(home, K.PD_HOME, 0.0)
    )
    return _probability(odds)


def _probability(log_odds: Column) -> Column:
    return clip(F.lit(1.0) / (F.lit(1.0) + F.exp(-log_odds)), *K.PD_RANGE)


def points(pd: Column | str) -> Column:
    """Score points on 300 to 850; the fraction is cut off."""
    raw = (F.lit(float(K.POINTS_TOP)) - col(pd) * K.POINTS_SPAN).cast("int")
    return clip(raw, K.POINTS_FLOOR, K.POINTS_TOP)


def rating(pd: Column | str, policy: str = "service") -> Column:
    return banded(pd, K.RATING_CUTOFFS[policy], K.LAST_RATING, inclusive=True)


def pd_risk(pd: Column | str) -> Column:
    return banded(pd, K.PD_RISK_BANDS, K.TOP_RISK)


def pd_outputs(pd: Column | str, loan_amnt: Column | str, policy: str = "service") -> Columns:
    """Everything that is reported with a probability of default."""
    digits = (6, 4) if policy == "service" else (4, 2)
    out = {
        "pd": rounded(pd, digits[0]),
        "pd_pct": rounded(col(pd) * 100, digits[1]),
        "score": points(pd),
        "rating": rating(pd, policy),
        "risk_label": pd_risk(pd),
    }
    if policy == "service":
        out["expected_loss"] = money(col(loan_amnt).cast("double") * col(pd) * K.DOWNTURN_LGD)
    return out


def lgd_service(loan_amnt, collateral, recoveries, home, credit_type) -> Column:
    """Loss given default from collateral, housing, credit type and recoveries."""
    base = at_least_one(loan_amnt)
    cover = F.least(col(collateral) / base, F.lit(1.0))
    recovered = F.least(col(recoveries) / base, F.lit(K.LGD_RECOVERY_CAP))
    return clip(
        F.lit(K.DOWNTURN_LGD)
        - cover * K.LGD_COLLATERAL_WEIGHT
        + looked_up(home, K.LGD_HOME, 0.0)
        + looked_up(credit_type, K.LGD_CREDIT_TYPE, 0.0)
        - recovered,
        *K.LGD_SCORE_RANGE,
    )


def lgd_basic(loan_amnt, collateral, recoveries, home) -> Column:
    """Loss given default without the credit type; a missing housing status counts as rent."""
    base = at_least_one(loan_amnt)
    cover = F.least(col(collateral) / base, F.lit(1.0))
    recovered = F.least(col(recoveries) / base, F.lit(K.LGD_RECOVERY_CAP))
    rents = F.coalesce(col(home), F.lit("RENT")) == "RENT"
    return clip(
        F.lit(K.DOWNTURN_LGD)
        - cover * K.LGD_COLLATERAL_WEIGHT
        + F.when(rents, F.lit(K.LGD_BASIC_RENT)).otherwise(F.lit(0.0))
        - recovered,
        *K.LGD_SCORE_RANGE,
    )


def lgd_outputs(lgd: Column | str, loan_amnt: Column | str, variant: str = "service") -> Columns:
    digits = (6, 4) if variant == "service" else (4, 2)
    return {
        "lgd": rounded(lgd, digits[0]),
        "lgd_pct": rounded(col(lgd) * 100, digits[1]),
        "recovery_rate": rounded(F.lit(1.0) - col(lgd), digits[0]),
        "expected_loss": money(col(loan_amnt).cast("double") * col(lgd)),
        "risk_label": banded(lgd, K.LGD_RISK_BANDS, K.LGD_TOP_RISK),
    }


def ead_parts(limit, committed, drawn, product=None) -> Columns:
    """Drawn, undrawn, utilisation, conversion factor and exposure at default.

    With a product the drawn part is limited to the commitment and the base factor
    depends on the product; without one the drawn part is taken as given.
    """
    committed, drawn = col(committed).cast("double"), col(drawn).cast("double")
    if product is not None:
        drawn = F.least(drawn, committed)
        base = looked_up(product, K.CCF_BASE, K.CCF_DEFAULT_BASE)
    else:
        base = F.lit(K.CCF_DEFAULT_BASE)
    undrawn = F.greatest(committed - drawn, F.lit(0.0))
    utilisation = drawn / at_least_one(limit)
    ccf = clip(base + utilisation * K.CCF_UTILISATION_WEIGHT, 0.0, 1.0)
    return {
        "drawn": drawn,
        "undrawn": undrawn,
        "utilisation": utilisation,
        "ccf": ccf,
        "ead": drawn + ccf * undrawn,
    }


def ead_outputs(limit, committed, drawn, product=None) -> Columns:
    p = ead_parts(limit, committed, drawn, product)
    digits = (6, 4) if product is not None else (4, 2)
    out = {
        "ead": money(p["ead"]),
        "ccf": rounded(p["ccf"], digits[0]),
        "ccf_pct": rounded(p["ccf"] * 100, digits[1]),
        "utilization": rounded(p["utilisation"] * 100, digits[1]),
    }
    if product is not None:
        out["drawn"] = money(p["drawn"])
        out["undrawn_part"] = money(p["ccf"] * p["undrawn"])
    return out


def scorecard_points(probability: Column | str) -> Column:
    """Scorecard points, offset minus factor times the log of the odds of default."""
    p = col(probability)
    return F.lit(K.SCORECARD_OFFSET) - F.lit(K.SCORECARD_FACTOR) * F.ln(p / (F.lit(1.0) - p))
