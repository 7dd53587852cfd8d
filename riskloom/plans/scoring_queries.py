"""Scoring and binning queries, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom import constants as K
from riskloom.functions import scorecards as C
from riskloom.operators import binning as B
from riskloom.operators import scoring as S
from riskloom.plans.base_sql import DEFAULT_RATE, money, on_loans, quoted
from riskloom.plans.book import loans, scored
from riskloom.plans.metric_sql import SCORED, basic_terms, logistic

PD_RATINGS = {
    name: "CASE " + " ".join(f"WHEN p <= {t} THEN '{g}'" for t, g in cuts) + " ELSE 'G' END"
    for name, cuts in K.RATING_CUTOFFS.items()
}
RISK = "CASE WHEN p < 0.05 THEN 'Baixo' WHEN p < 0.15 THEN 'Moderado' WHEN p < 0.25 THEN 'Alto' ELSE 'Muito Alto' END"
LGD_RISK = "CASE WHEN g < 0.30 THEN 'Baixo' WHEN g < 0.60 THEN 'Médio' ELSE 'Alto' END"
POINTS = "GREATEST(300, LEAST(850, CAST(TRUNC(850 - 550 * p) AS INTEGER)))"

# the same requests as the scoring operators read, under the same names
REQUESTS = """requests AS (SELECT loan_id, grade, is_default, fico_avg AS fico_score, CAST(dti AS DOUBLE) AS dti,
  CAST(int_rate * 100 AS DOUBLE) AS int_rate, CAST(annual_inc AS DOUBLE) AS annual_inc, CAST(loan_amnt AS DOUBLE) AS loan_amnt,
  emp_length, CAST(revol_util AS DOUBLE) AS revol_util, purpose, home_ownership, CAST(ead AS DOUBLE) AS ead,
  CAST(recoveries AS DOUBLE) AS recoveries, CAST(annual_inc AS DOUBLE) AS collateral_value,
  CASE loan_id % 3 WHEN 0 THEN 'mortgage' WHEN 1 THEN 'secured' ELSE 'unsecured' END AS credit_type,
  CASE loan_id % 4 WHEN 0 THEN 'revolving' WHEN 1 THEN 'line' WHEN 2 THEN 'term' ELSE 'card' END AS product_type,
  CAST(annual_inc AS DOUBLE) AS credit_limit, CAST(loan_amnt AS DOUBLE) AS committed_amount,
  CAST(loan_amnt AS DOUBLE) * CAST(revol_util AS DOUBLE) / 60 AS drawn_amount FROM loans)"""

_ADJUST = ("CASE purpose WHEN 'small_business' THEN 0.08e0 WHEN 'medical' THEN 0.05e0 WHEN 'other' THEN 0.03e0 "
           "WHEN 'credit_card' THEN 0.02e0 WHEN 'home_improvement' THEN -0.02e0 ELSE 0e0 END"
           " + CASE home_ownership WHEN 'RENT' THEN 0.05e0 WHEN 'OWN' THEN -0.03e0 ELSE 0e0 END")
_BASIC_PD = logistic(basic_terms("fico_score", "dti", "int_rate", "annual_inc", "emp_length"))
SERVICE_PD = logistic(
    basic_terms("fico_score", "dti", "int_rate", "annual_inc", "emp_length") + f" + revol_util * 0.008e0 + {_ADJUST}"
)
_BASE = "GREATEST(loan_amnt, 1e0)"
_HOME_LGD = "CASE home_ownership WHEN 'OWN' THEN -0.05e0 WHEN 'MORTGAGE' THEN -0.02e0 WHEN 'RENT' THEN 0.08e0 ELSE 0e0 END"
_TYPE_LGD = "CASE credit_type WHEN 'mortgage' THEN -0.15e0 WHEN 'secured' THEN -0.10e0 ELSE 0e0 END"
_COVER = f"LEAST(collateral_value / {_BASE}, 1e0) * 0.3e0"
_RECOVERED = f"LEAST(COALESCE(recoveries, 0e0) / {_BASE}, 0.3e0)"
_SERVICE_LGD = f"GREATEST(0.01e0, LEAST(0.99e0, 0.45e0 - {_COVER} + {_HOME_LGD} + {_TYPE_LGD} - {_RECOVERED}))"
_BASIC_LGD = (f"GREATEST(0.01e0, LEAST(0.99e0, 0.45e0 - {_COVER} + CASE WHEN home_ownership = 'RENT' THEN 0.1e0 ELSE 0e0 END"
              f" - {_RECOVERED}))")


def requests(s, d, *more):
    """Loans as requests of all three models, with collateral and limits derived from them."""
    book = loans(s, d)
    amount, income = F.col("loan_amnt").cast("double"), F.col("annual_inc").cast("double")
    k3, k4 = F.col("loan_id") % 3, F.col("loan_id") % 4
    return book.select(
        "loan_id", "grade", "is_default", F.col("fico_avg").alias("fico_score"),
        F.col("dti").cast("double").alias("dti"), (F.col("int_rate") * 100).cast("double").alias("int_rate"),
        income.alias("annual_inc"), amount.alias("loan_amnt"), "emp_length",
        F.col("revol_util").cast("double").alias("revol_util"), "purpose", "home_ownership",
        F.col("ead").cast("double").alias("ead"),
        F.coalesce(F.col("recoveries").cast("double"), F.lit(0.0)).alias("recoveries"),
        income.alias("collateral_value"),
        F.when(k3 == 0, "mortgage").when(k3 == 1, "secured").otherwise("unsecured").alias("credit_type"),
        F.when(k4 == 0, "revolving").when(k4 == 1, "line").when(k4 == 2, "term").otherwise("card").alias("product_type"),
        income.alias("credit_limit"), amount.alias("committed_amount"),
        (amount * F.col("revol_util").cast("double") / 60).alias("drawn_amount"),
        *more,
    )


def batch_requests(s, d):
    """A batch file with gaps and zeros in it."""
    k = F.col("loan_id")
    x = requests(s, d)
    return x.select(
        "loan_id",
        F.when(k % 19 == 0, F.lit(0.0)).otherwise(F.col("fico_score")).alias("fico_score"),
        F.when(k % 23 != 0, F.col("dti")).alias("dti"),
        F.when(k % 29 == 0, F.lit(float("nan"))).otherwise(F.col("int_rate")).alias("int_rate"),
        "annual_inc",
        F.when(k % 31 != 0, F.col("loan_amnt")).alias("loan_amnt"),
        F.col("emp_length"),
        "purpose",
        "home_ownership",
    )


def decided(s, d):
    x = requests(s, d)
    terms = x.withColumn("pd", S.pd_column("service")).withColumn(
        "lgd", C.lgd_service("loan_amnt", "collateral_value", "recoveries", "home_ownership", "credit_type")
    )
    parts = C.ead_parts("credit_limit", "committed_amount", "drawn_amount", "product_type")
    return S.decisions(terms.withColumn("utilization", parts["utilisation"] * 100)).groupBy(
        "pd_decision", "lgd_decision", "ead_decision"
    ).agg(F.count(F.lit(1)).alias("n"))


def quarantine(s, d):
    """Rejected requests with the fields that were out of range, after a shock to the inputs."""
    shocked = requests(s, d).withColumns({"dti": F.col("dti") * 1.5, "fico_score": F.col("fico_score") + 10})
    _, bad = S.split_valid(shocked)
    return bad.select("loan_id", F.array_join("violations", ",").alias("violations"))


def requests_with_gaps(s, d):
    """Requests without two of the fields, and with gaps in two others."""
    x = requests(s, d).drop("emp_length", "purpose")
    k = F.col("loan_id")
    return x.withColumns({"dti": F.when(k % 23 != 0, F.col("dti")), "fico_score": F.when(k % 19 != 0, F.col("fico_score"))})


def quarantine_loss_requests(s, d):
    """Rejected requests of the LGD and EAD models, after amounts are taken off."""
    short = requests(s, d).withColumns({"collateral_value": F.col("annual_inc") - 60000, "drawn_amount": F.col("drawn_amount") - 5000})
    out = []
    for model, ranges in (("lgd", K.LGD_REQUEST_RANGES), ("ead", K.EAD_REQUEST_RANGES)):
        _, bad = S.split_valid(short, ranges)
        out.append(bad.select("loan_id", F.lit(model).alias("model"), F.array_join("violations", ",").alias("violations")))
    return out[0].unionByName(out[1])


_EAD_SERVICE = """parts AS (SELECT *, LEAST(drawn_amount, committed_amount) AS drawn FROM requests),
factors AS (SELECT *, GREATEST(committed_amount - drawn, 0e0) AS undrawn, drawn / GREATEST(credit_limit, 1e0) AS u FROM parts),
ccfs AS (SELECT *, LEAST(CASE product_type WHEN 'line' THEN 0.35e0 WHEN 'term' THEN 0.25e0 ELSE 0.4e0 END + u * 0.25e0, 1e0) AS c FROM factors)"""

_BATCH = """given AS (SELECT loan_id, CASE WHEN loan_id % 19 = 0 THEN 0e0 ELSE fico_score END AS fico,
    CASE WHEN loan_id % 23 <> 0 THEN dti END AS dti, CASE WHEN loan_id % 29 <> 0 THEN int_rate END AS int_rate, annual_inc,
    CASE WHEN loan_id % 31 <> 0 THEN loan_amnt END AS loan_amnt, emp_length FROM requests),
filled AS (SELECT loan_id, fico AS given_fico, dti AS given_dti, COALESCE(NULLIF(fico, 0), 700e0) AS fico_score,
    COALESCE(NULLIF(dti, 0), 15e0) AS dti, COALESCE(NULLIF(int_rate, 0), 12e0) AS int_rate, COALESCE(NULLIF(annual_inc, 0), 60000e0) AS annual_inc,
    COALESCE(NULLIF(emp_length, 0), 5e0) AS emp_length, COALESCE(NULLIF(loan_amnt, 0), 10000e0) AS amount FROM given)"""

_FACTORS = {
    "FICO Score": "(700e0 - fico_score) * 0.015e0",
    "Rácio DTI": "dti * 0.04e0",
    "Taxa de Juro": "int_rate * 0.07e0",
    "Rendimento Anual": "-LEAST(annual_inc / 10000, 5e0) * 0.12e0",
    "Tempo de Emprego": "-emp_length * 0.03e0",
}
_SIZE = " + ".join(f"ABS({x})" for x in _FACTORS.values())
_FACTOR_ROWS = " UNION ALL ".join(
    f"SELECT loan_id, '{n}' AS factor, {x} AS v, {_SIZE} AS total FROM requests" for n, x in _FACTORS.items()
)

RANGE_SQL = " ".join(
    f", CASE WHEN {n} < {lo}" + (f" OR {n} > {hi}" if hi is not None else "") + f" THEN '{n}' END"
    for n, (lo, hi) in K.REQUEST_RANGES.items() if n not in ("open_acc", "pub_rec")
)

FINAL = f"final_loans AS (SELECT * FROM loans WHERE loan_status IN ({quoted(K.FINAL_STATUSES)}))"
IV_NUMERIC = (*K.PD_FEATURES, *K.EXTRA_IV_FEATURES)


def woe_sql(feature: str, prefix: str = "w") -> str:
    """CTEs that end in ``{prefix}_woe`` for one numeric feature in ten quantile bins."""
    probs = "[" + ", ".join(f"{i / 10}" for i in range(11)) + "]"
    x = f"CAST({feature} AS DOUBLE)"
    return f"""
{prefix}_edges AS (SELECT e, LEAD(e) OVER (ORDER BY e) AS nxt, ROW_NUMBER() OVER (ORDER BY e) AS rn, COUNT(*) OVER () AS n_edges FROM
    (SELECT DISTINCT UNNEST(QUANTILE_CONT({x}, {probs})) AS e FROM final_loans)),
{prefix}_bins AS (SELECT CAST(rn - 1 AS INTEGER) AS bin_no, e AS bin_min, COALESCE(nxt, e) AS bin_max FROM {prefix}_edges
    WHERE nxt IS NOT NULL OR n_edges = 1),
{prefix}_counts AS (SELECT bin_no, bin_min, bin_max, COUNT(*) AS n, SUM(CASE WHEN is_default THEN 1 ELSE 0 END) AS ev
    FROM final_loans JOIN {prefix}_bins ON {x} <= bin_max AND ({x} > bin_min OR (bin_no = 0 AND {x} = bin_min)) GROUP BY ALL),
{prefix}_shares AS (SELECT *, GREATEST(CAST(ev AS DOUBLE) / SUM(ev) OVER (), 1e-9) AS pe,
    GREATEST(CAST(n - ev AS DOUBLE) / SUM(n - ev) OVER (), 1e-9) AS pn FROM {prefix}_counts),
{prefix}_woe AS (SELECT '{feature}' AS feature, bin_no, bin_min, bin_max, n AS count_total, CAST(ev AS BIGINT) AS count_events,
    CAST(n - ev AS BIGINT) AS count_non_events, CAST(ev AS DOUBLE) / n AS rate, LN(pe / pn) AS woe, (pe - pn) * LN(pe / pn) AS iv_bin
    FROM {prefix}_shares)"""


def _woe_query(*features: str) -> str:
    ctes = ", ".join(woe_sql(f, f"w{i}") for i, f in enumerate(features))
    rows = " UNION ALL ".join(
        f"SELECT feature, bin_no, ROUND(bin_min, 6) AS bin_min, ROUND(bin_max, 6) AS bin_max, count_total, count_events, count_non_events,"
        f" ROUND(rate, 6) AS event_rate, ROUND(woe, 6) AS woe, ROUND(SUM(iv_bin) OVER (), 6) AS iv FROM w{i}_woe" for i in range(len(features))
    )
    return on_loans(f"{FINAL}, {ctes}, answer AS ({rows}) SELECT * FROM answer")


def woe_rows(features):
    def run(s, d):
        final = loans(s, d).filter(F.col("loan_status").isin(*K.FINAL_STATUSES))
        woe = B.with_feature_iv(B.woe_table(final, features))
        return woe.select(
            "feature", "bin_no", F.round("bin_min", 6).alias("bin_min"), F.round("bin_max", 6).alias("bin_max"),
            "count_total", "count_events", "count_non_events", F.round("event_rate", 6).alias("event_rate"),
            F.round("woe", 6).alias("woe"), F.round("iv", 6).alias("iv"),
        )

    return run


CATEGORICAL = ("grade", "purpose", "home_ownership")


def categorical_woe(s, d):
    final = loans(s, d).filter(F.col("loan_status").isin(*K.FINAL_STATUSES))
    woe = B.with_feature_iv(B.woe_table(final, CATEGORICAL))
    return woe.select("feature", "bin_label", "count_total", "count_events", F.round("woe", 6).alias("woe"), F.round("iv", 6).alias("iv"))


def _categorical_sql() -> str:
    parts = []
    for c in CATEGORICAL:
        parts.append(f"""SELECT '{c}' AS feature, {c} AS bin_label, COUNT(*) AS count_total,
          CAST(SUM(CASE WHEN is_default THEN 1 ELSE 0 END) AS BIGINT) AS count_events FROM final_loans WHERE {c} IS NOT NULL GROUP BY {c}""")
    return on_loans(f"""{FINAL}, counted AS ({" UNION ALL ".join(parts)}),
    shares AS (SELECT *, GREATEST(CAST(count_events AS DOUBLE) / SUM(count_events) OVER (PARTITION BY feature), 1e-9) AS pe,
      GREATEST(CAST(count_total - count_events AS DOUBLE) / SUM(count_total - count_events) OVER (PARTITION BY feature), 1e-9) AS pn FROM counted)
    SELECT feature, bin_label, count_total, count_events, ROUND(LN(pe / pn), 6) AS woe,
      ROUND(SUM((pe - pn) * LN(pe / pn)) OVER (PARTITION BY feature), 6) AS iv FROM shares""")


def ranking(s, d):
    final = loans(s, d).filter(F.col("loan_status").isin(*K.FINAL_STATUSES))
    return B.iv_ranking(final, IV_NUMERIC)


_RANKING = on_loans(
    f"{FINAL}, " + ", ".join(woe_sql(f, f"w{i}") for i, f in enumerate(IV_NUMERIC)) + ", ivs AS ("
    + " UNION ALL ".join(f"SELECT feature, SUM(iv_bin) AS v FROM w{i}_woe GROUP BY feature" for i in range(len(IV_NUMERIC)))
    + """), ranking AS (SELECT feature, ROUND(v, 4) AS iv, CASE WHEN v < 0.02 THEN 'Muito Fraco' WHEN v < 0.10 THEN 'Fraco'
      WHEN v < 0.30 THEN 'Médio' WHEN v < 0.50 THEN 'Forte' ELSE 'Suspeito' END AS poder_preditivo FROM ivs)
    SELECT * FROM ranking"""
)


def _coarse(label_sql: str) -> str:
    return on_loans(f"""{FINAL}, rates AS (SELECT {label_sql} AS classe, ROUND({DEFAULT_RATE} * 100, 6) AS taxa_default, COUNT(*) AS n_obs
      FROM final_loans GROUP BY 1)
    SELECT *, CAST(taxa_default > LAG(taxa_default) OVER (ORDER BY classe) AS INTEGER) AS rises FROM rates""")


def _final(s, d):
    return loans(s, d).filter(F.col("loan_status").isin(*K.FINAL_STATUSES))


_STRESS = on_loans(f"""sums AS (SELECT home_ownership, CAST(SUM(loan_amnt) AS DOUBLE) AS amount,
    COALESCE(CAST(SUM(CASE WHEN is_default THEN loan_amnt END) AS DOUBLE), 0) AS bad FROM loans GROUP BY 1),
  steps AS (SELECT *, UNNEST(RANGE(11)) / 10e0 AS r FROM sums)
  SELECT home_ownership, ROUND(r, 1) AS ratio, ROUND(CASE WHEN home_ownership = 'RENT' THEN 0.55e0 ELSE 0.45e0 END - 0.3e0 * r, 4) AS lgd,
    {money("bad * (CASE WHEN home_ownership = 'RENT' THEN 0.55e0 + r * -0.3e0 ELSE 0.45e0 + r * -0.3e0 END)")} AS stressed_loss,
    ROUND(0.4e0 + r * 0.25e0, 4) AS ccf_revolving, ROUND(0.3e0 + r * 0.15e0, 4) AS ccf_term,
    {money('amount * (r + (1 - r) * (0.4e0 + r * 0.25e0))')} AS ead_revolving FROM steps""")

QUERIES = {
    "pd_scores": (
        lambda s, d: S.score_pd(requests(s, d)),
        on_loans(f"""{REQUESTS}, pds AS (SELECT loan_id, loan_amnt, {SERVICE_PD} AS p FROM requests)
        SELECT loan_id, ROUND(p, 6) AS pd, ROUND(p * 100, 4) AS pd_pct, {POINTS} AS score, {PD_RATINGS['service']} AS rating,
          {RISK} AS risk_label, {money('loan_amnt * p * 0.45e0')} AS expected_loss FROM pds"""),
    ),
    "pd_scores_basic": (
        lambda s, d: S.score_pd(requests(s, d), "basic"),
        on_loans(f"""{REQUESTS}, pds AS (SELECT loan_id, {_BASIC_PD} AS p FROM requests)
        SELECT loan_id, ROUND(p, 4) AS pd, ROUND(p * 100, 2) AS pd_pct, {POINTS} AS score, {PD_RATINGS['basic']} AS rating, {RISK} AS risk_label FROM pds"""),
    ),
    "lgd_scores": (
        lambda s, d: S.score_lgd(requests(s, d)),
        on_loans(f"""{REQUESTS}, lgds AS (SELECT loan_id, loan_amnt, {_SERVICE_LGD} AS g FROM requests)
        SELECT loan_id, ROUND(g, 6) AS lgd, ROUND(g * 100, 4) AS lgd_pct, ROUND(1 - g, 6) AS recovery_rate,
          {money('loan_amnt * g')} AS expected_loss, {LGD_RISK} AS risk_label FROM lgds"""),
    ),
    "lgd_scores_web": (
        lambda s, d: S.score_lgd(requests(s, d), "basic"),
        on_loans(f"""{REQUESTS}, lgds AS (SELECT loan_id, loan_amnt, {_BASIC_LGD} AS g FROM requests)
        SELECT loan_id, ROUND(g, 4) AS lgd, ROUND(g * 100, 2) AS lgd_pct, ROUND(1 - g, 4) AS recovery_rate,
          {money('loan_amnt * g')} AS expected_loss, {LGD_RISK} AS risk_label FROM lgds"""),
    ),
    "ead_scores": (
        lambda s, d: S.score_ead(requests(s, d)),
        on_loans(f"""{REQUESTS}, {_EAD_SERVICE} SELECT loan_id, {money('drawn + c * undrawn')} AS ead, ROUND(c, 6) AS ccf, ROUND(c * 100, 4) AS ccf_pct,
          ROUND(u * 100, 4) AS utilization, {money('drawn')} AS drawn, {money('c * undrawn')} AS undrawn_part FROM ccfs"""),
    ),
    "ead_scores_web": (
        lambda s, d: S.score_ead(requests(s, d), "basic"),
        on_loans(f"""{REQUESTS}, parts AS (SELECT loan_id, drawn_amount AS dr, GREATEST(committed_amount - drawn_amount, 0e0) AS un,
          drawn_amount / GREATEST(credit_limit, 1e0) AS u FROM requests),
        ccfs AS (SELECT *, GREATEST(0e0, LEAST(1e0, 0.4e0 + u * 0.25e0)) AS c FROM parts)
        SELECT loan_id, {money('dr + c * un')} AS ead, ROUND(c, 4) AS ccf, ROUND(c * 100, 2) AS ccf_pct, ROUND(u * 100, 2) AS utilization FROM ccfs"""),
    ),
    "batch_scoring": (
        lambda s, d: S.score_batch(batch_requests(s, d), "loan_id"),
        on_loans(f"""{REQUESTS}, {_BATCH}, pds AS (SELECT *, {_BASIC_PD} AS p FROM filled)
        SELECT loan_id AS idx, given_fico AS fico, given_dti AS dti, ROUND(p * 100, 2) AS pd_pct, {PD_RATINGS['basic']} AS grade,
          ROUND((0.45e0 + 0.1e0) * 100, 2) AS lgd_pct, {money('amount')} AS ead, {money('amount * ROUND(p, 4) * ROUND(0.45e0 + 0.1e0, 4)')} AS expected_loss FROM pds"""),
    ),
    "expected_loss": (
        lambda s, d: S.score_portfolio(requests(s, d)),
        on_loans(f"""{REQUESTS}, parts AS (SELECT loan_id, ROUND({SERVICE_PD}, 6) AS pd,
          ROUND(GREATEST(0.01e0, LEAST(0.99e0, 0.45e0 - 0e0 + {_HOME_LGD} + 0e0 - 0e0)), 6) AS lgd, COALESCE(ead, loan_amnt) AS ead FROM requests)
        SELECT *, {money('pd * lgd * ead')} AS expected_loss FROM parts"""),
    ),
    "risk_factors": (
        lambda s, d: S.risk_factors(requests(s, d)),
        on_loans(f"""{REQUESTS}, factor_rows AS ({_FACTOR_ROWS})
        SELECT loan_id, CAST(ROW_NUMBER() OVER (PARTITION BY loan_id ORDER BY ABS(v) DESC, factor) AS INTEGER) AS position, factor,
          ROUND(v, 6) AS value, ROUND(ABS(v) / NULLIF(total, 0), 6) AS pct FROM factor_rows"""),
    ),
    "decision_bands": (
        decided,
        on_loans(f"""{REQUESTS}, {_EAD_SERVICE}, d AS (SELECT {SERVICE_PD} AS p, {_SERVICE_LGD} AS g, u * 100 AS util FROM ccfs)
        SELECT CASE WHEN p < 0.05 THEN 'eligible' WHEN p < 0.15 THEN 'guarantees' ELSE 'not_recommended' END AS pd_decision,
          CASE WHEN g < 0.3 THEN 'low' WHEN g < 0.6 THEN 'moderate' ELSE 'high' END AS lgd_decision,
          CASE WHEN util < 30 THEN 'low' WHEN util < 70 THEN 'moderate' ELSE 'high' END AS ead_decision, COUNT(*) AS n FROM d GROUP BY ALL"""),
    ),
    "stress_grid": (lambda s, d: S.stress_grid(loans(s, d)), _STRESS),
    "input_quarantine": (
        quarantine,
        on_loans(f"""{REQUESTS}, shocked AS (SELECT * REPLACE (dti * 1.5e0 AS dti, fico_score + 10 AS fico_score) FROM requests),
        checked AS (SELECT loan_id, CONCAT_WS(','{RANGE_SQL}) AS violations FROM shocked)
        SELECT * FROM checked WHERE violations <> ''"""),
    ),
    "quarantine_lgd_ead": (
        quarantine_loss_requests,
        on_loans(f"""{REQUESTS}, short AS (SELECT * REPLACE (annual_inc - 60000 AS collateral_value, drawn_amount - 5000 AS drawn_amount) FROM requests)
        SELECT loan_id, 'lgd' AS model, 'collateral_value' AS violations FROM short WHERE collateral_value < 0
        UNION ALL SELECT loan_id, 'ead', 'drawn_amount' FROM short WHERE drawn_amount < 0"""),
    ),
    "pd_requests_with_gaps": (
        lambda s, d: S.score_pd(requests_with_gaps(s, d)),
        on_loans(f"""{REQUESTS}, filled AS (SELECT * REPLACE (5e0 AS emp_length, 'debt_consolidation' AS purpose,
          CASE WHEN loan_id % 23 = 0 THEN 15e0 ELSE dti END AS dti, CASE WHEN loan_id % 19 = 0 THEN 700e0 ELSE fico_score END AS fico_score) FROM requests),
        pds AS (SELECT loan_id, loan_amnt, {SERVICE_PD} AS p FROM filled)
        SELECT loan_id, ROUND(p, 6) AS pd, ROUND(p * 100, 4) AS pd_pct, {POINTS} AS score, {PD_RATINGS['service']} AS rating,
          {RISK} AS risk_label, {money('loan_amnt * p * 0.45e0')} AS expected_loss FROM pds"""),
    ),
    "scorecard_points": (
        lambda s, d: B.with_scorecard_points(scored(s, d), "score").select("loan_id", "scorecard_points"),
        on_loans(f"""{SCORED} SELECT loan_id,
        ROUND({K.SCORECARD_OFFSET!r} - {K.SCORECARD_FACTOR!r} * LN(score / (1 - score)), 4) AS scorecard_points FROM scored"""),
    ),
    "woe_bins_dti": (woe_rows(["dti"]), _woe_query("dti")),
    "woe_bins_fico": (woe_rows(["fico_avg"]), _woe_query("fico_avg")),
    "woe_bins_amounts": (
        woe_rows(["annual_inc", "loan_to_income", "int_rate", "grade_num"]),
        _woe_query("annual_inc", "loan_to_income", "int_rate", "grade_num"),
    ),
    "woe_categorical": (categorical_woe, _categorical_sql()),
    "iv_ranking": (ranking, _RANKING),
    "iv_selected": (
        lambda s, d: B.selected_features(ranking(s, d)),
        _RANKING + " WHERE iv >= 0.05 ORDER BY iv DESC, feature LIMIT 6",
    ),
    "coarse_fico": (
        lambda s, d: B.coarse_class_rates(_final(s, d), B.coarse_fico()),
        _coarse("CASE WHEN fico_avg < 600 THEN 'A: <600 (Alto Risco)' WHEN fico_avg < 650 THEN 'B: 600-650' WHEN fico_avg < 700 THEN 'C: 650-700' "
                "WHEN fico_avg < 750 THEN 'D: 700-750' ELSE 'E: ≥750 (Baixo Risco)' END"),
    ),
    "coarse_dti": (
        lambda s, d: B.coarse_class_rates(_final(s, d), B.coarse_dti()),
        _coarse("CASE WHEN dti < 10 THEN 'A: <10%' WHEN dti < 20 THEN 'B: 10-20%' WHEN dti < 30 THEN 'C: 20-30%' "
                "WHEN dti < 40 THEN 'D: 30-40%' ELSE 'E: ≥40%' END"),
    ),
}
