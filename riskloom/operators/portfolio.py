"""Portfolio analyses over the loan table.

Every function is one aggregation: rows are pre-aggregated where they are read and only
one partial row per group and task is shuffled, so uneven group sizes do not matter.
Sums of money stay decimal until the end, hence results do not depend on row order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom import constants as K
from riskloom.functions.columns import banded, mean, quarter_label, rounded, share_true

MILLION = 1_000_000


# --- measures --------------------------------------------------------------------
def n_rows() -> Column:
    return F.count(F.lit(1))


def n_defaults() -> Column:
    return F.count_if("is_default")


def default_rate(digits: int = 4) -> Column:
    return F.round(share_true("is_default"), digits)


def default_pct(digits: int = 2) -> Column:
    return F.round(share_true("is_default") * 100, digits)


def total(c: str = "loan_amnt") -> Column:
    return F.sum(c).cast("double")


def in_millions(amount: Column, digits: int) -> Column:
    return F.round(amount.cast("double") / MILLION, digits)


def avg_rounded(c: str | Column, digits: int, scale: float = 1) -> Column:
    value = mean(c)
    return F.round(value * scale if scale != 1 else value, digits)


def downturn_lgd() -> Column:
    """Observed LGD, or the downturn value where there is none."""
    return F.coalesce(F.col("lgd"), F.lit(K.DOWNTURN_LGD).cast("decimal(6,4)"))


def mid_fico() -> Column:
    return (F.col("fico_range_low") + F.col("fico_range_high")).cast("double") / 2


def realised_loss() -> Column:
    return F.sum(F.when(F.col("is_default"), F.col("loan_amnt") * downturn_lgd())).cast("double")


# --- by grade --------------------------------------------------------------------
def portfolio_by_grade(loans: DataFrame) -> DataFrame:
    """Thirteen figures per grade; the loss uses the downturn LGD where none is observed."""
    loss = F.sum(F.col("loan_amnt") * downturn_lgd()).cast("double")
    return (
        _graded(loans)
        .agg(
            n_rows().alias("total_emprestimos"),
            total().alias("exposicao_total"),
            avg_rounded("loan_amnt", 2).alias("ticket_medio"),
            avg_rounded("annual_inc", 2).alias("rendimento_medio"),
            avg_rounded("dti", 4).alias("dti_medio"),
            avg_rounded("fico_range_low", 1).alias("fico_medio"),
            avg_rounded("int_rate", 4).alias("taxa_juro_media"),
            n_defaults().alias("total_defaults"),
            default_rate().alias("taxa_default"),
            avg_rounded("lgd", 4).alias("lgd_media"),
            F.round(loss, 2).alias("perda_esperada"),
            F.round(loss / F.nullif(total(), F.lit(0.0)), 4).alias("ratio_perda_exposicao"),
        )
        .orderBy("grade")
    )


def portfolio_summary(loans: DataFrame) -> DataFrame:
    """Summary view per grade; the loss covers loans with an observed LGD only."""
    return (
        _graded(loans)
        .agg(
            n_rows().alias("total_loans"),
            total().alias("total_exposure"),
            avg_rounded("annual_inc", 6).alias("avg_annual_income"),
            avg_rounded("dti", 6).alias("avg_dti"),
            avg_rounded("fico_range_low", 6).alias("avg_fico"),
            n_defaults().alias("total_defaults"),
            default_rate().alias("default_rate"),
            avg_rounded("lgd", 6).alias("avg_lgd"),
            F.sum(F.col("loan_amnt") * F.col("lgd")).cast("double").alias("expected_loss"),
        )
        .orderBy("grade")
    )


def grade_mini(loans: DataFrame) -> DataFrame:
    return _graded(loans).agg(n_rows().alias("total"), default_rate().alias("dr")).orderBy("grade")


def grade_chart(loans: DataFrame) -> DataFrame:
    return (
        _graded(loans)
        .agg(
            n_rows().alias("total"),
            total().alias("exposure"),
            default_rate().alias("dr"),
            avg_rounded("fico_range_low", 1).alias("avg_fico"),
        )
        .orderBy("grade")
    )


def grade_statistics(loans: DataFrame) -> DataFrame:
    return (
        _graded(loans)
        .agg(
            F.count("loan_amnt").alias("total"),
            total().alias("exposicao"),
            avg_rounded("loan_amnt", 6).alias("ticket_medio"),
            avg_rounded("fico_avg", 6).alias("fico_medio"),
            avg_rounded("dti", 6).alias("dti_medio"),
            avg_rounded("int_rate", 6).alias("taxa_juro_media"),
            default_rate(6).alias("taxa_default"),
            in_millions(total(), 6).alias("exposicao_m"),
            default_pct(6).alias("taxa_default_pct"),
        )
        .orderBy("grade")
    )


def riskiest_grade(loans: DataFrame) -> DataFrame:
    """The grade with the highest default rate; the lower letter wins a tie."""
    rates = _graded(loans).agg(share_true("is_default").alias("dr"))
    best = F.max(F.struct("dr", (-F.ascii("grade")).alias("order"), "grade"))
    return rates.agg(best.alias("b")).select(
        F.col("b.grade").alias("grade"), F.round(F.col("b.dr") * 100, 4).alias("taxa_default_pct")
    )


def loss_by_grade(loans: DataFrame) -> DataFrame:
    """Expected against realised loss per grade."""
    expected = total() * share_true("is_default") * mean(downturn_lgd())
    return (
        _graded(loans)
        .agg(
            in_millions(total(), 2).alias("exposure_m"),
            default_pct().alias("dr_pct"),
            F.round(mean(downturn_lgd()) * 100, 2).alias("avg_lgd_pct"),
            in_millions(F.coalesce(realised_loss(), F.lit(0.0)), 2).alias("realised_loss_m"),
            in_millions(expected, 2).alias("expected_loss_m"),
        )
        .orderBy("grade")
    )


def grade_risk_table(loans: DataFrame) -> DataFrame:
    """Grade table with expected loss and risk label, in one aggregation instead of a join."""
    expected = total() * share_true("is_default") * mean(downturn_lgd())
    return (
        _graded(loans)
        .agg(
            n_rows().alias("total"),
            in_millions(total(), 2).alias("exposure_m"),
            default_rate().alias("dr"),
            avg_rounded("fico_range_low", 0).alias("avg_fico"),
            in_millions(expected, 2).alias("expected_loss_m"),
        )
        .withColumn("risk", banded("dr", K.GRADE_RISK_BANDS, K.TOP_RISK))
        .orderBy("grade")
    )


def grade_snapshot(loans: DataFrame, snapshot_date) -> DataFrame:
    """One snapshot row per grade for the snapshot table."""
    return (
        _graded(loans)
        .agg(
            F.count("loan_amnt").alias("total_loans"),
            F.sum("loan_amnt").alias("exposure"),
            share_true("is_default").alias("rate"),
            mean("lgd").alias("mean_lgd"),
            n_defaults().alias("actual_defaults"),
        )
        .select(
            F.lit(snapshot_date).cast("date").alias("snapshot_date"),
            "grade",
            "total_loans",
            F.col("exposure").cast("double").alias("total_exposure"),
            F.round("rate", 4).alias("avg_pd"),
            F.round("mean_lgd", 4).alias("avg_lgd"),
            F.round(
                F.col("exposure").cast("double") * F.col("rate")
                * F.coalesce(F.col("mean_lgd"), F.lit(K.DOWNTURN_LGD)), 2
            ).alias("expected_loss"),
            "actual_defaults",
            F.round("rate", 4).alias("default_rate"),
        )
        .orderBy("grade")
    )


def concentration(loans: DataFrame, group: str = "grade") -> DataFrame:
    """Exposure share and Herfindahl contribution per group.

    The share of the total is a window over the aggregated rows, one per group.
    """
    by_group = (
        loans.filter(F.col(group).isNotNull()).groupBy(group).agg(F.sum("loan_amnt").alias("amount"))
    )
    whole = F.sum("amount").over(Window.partitionBy()).cast("double")
    weight = F.col("amount").cast("double") / whole
    return by_group.select(
        group,
        F.col("amount").cast("double").alias("exposure"),
        F.round(weight * 100, 2).alias("peso_pct"),
        F.round(weight * weight * 10000, 2).alias("hhi_contribuicao"),
    ).orderBy(group)


# --- over time -------------------------------------------------------------------
def monthly_default_rates(loans: DataFrame) -> DataFrame:
    return (
        loans.filter(F.col("issue_d").isNotNull())
        .groupBy(F.trunc("issue_d", "month").alias("month"))
        .agg(
            n_rows().alias("total_loans"),
            n_defaults().alias("defaults"),
            default_rate().alias("default_rate"),
            total().alias("total_exposure"),
        )
        .orderBy("month")
    )


def vintage_by_quarter(loans: DataFrame) -> DataFrame:
    return (
        _by_quarter(loans)
        .agg(
            n_rows().alias("total"),
            total().alias("volume"),
            n_defaults().alias("defaults"),
            default_rate().alias("taxa_default"),
            avg_rounded("fico_range_low", 1).alias("fico_medio"),
            avg_rounded("dti", 4).alias("dti_medio"),
        )
        .orderBy("quarter_start")
        .withColumn("quarter_start", quarter_label("quarter_start"))
        .withColumnRenamed("quarter_start", "trimestre_emissao")
    )


def quarterly_defaults(loans: DataFrame, quarters: int = 40) -> DataFrame:
    """The first quarters of the book, oldest first."""
    return (
        _by_quarter(loans)
        .agg(n_rows().alias("total"), n_defaults().alias("defaults"), default_rate().alias("dr"))
        .orderBy("quarter_start")
        .limit(quarters)
        .select(quarter_label("quarter_start").alias("period"), "total", "defaults", "dr")
    )


def vintage_by_year(loans: DataFrame) -> DataFrame:
    return (
        _by_year(loans)
        .agg(
            n_rows().alias("total_loans"),
            n_defaults().alias("defaults"),
            default_pct().alias("dr_pct"),
            in_millions(total(), 1).alias("exposure_m"),
            avg_rounded(mid_fico(), 0).alias("avg_fico"),
        )
        .orderBy("year")
    )


def vintage_grade_pivot(loans: DataFrame, quarters: int = 20) -> DataFrame:
    """Default rate in percent by quarter and grade, the last quarters of the book."""
    label = F.concat(
        F.year("quarter_start").cast("string"), F.lit("Q"), F.quarter("quarter_start").cast("string")
    )
    return (
        _by_quarter(loans)
        .pivot("grade", list(K.GRADES))
        .agg(F.round(share_true("is_default") * 100, 6))
        .where(F.coalesce(*K.GRADES).isNotNull())  # quarters without any grade take no place
        .orderBy(F.col("quarter_start").desc())
        .limit(quarters)
        .select(label.alias("issue_quarter"), *K.GRADES)
        .orderBy("issue_quarter")
    )


# --- by purpose and score --------------------------------------------------------
def purpose_profile(loans: DataFrame) -> DataFrame:
    return (
        _by_purpose(loans)
        .agg(
            n_rows().alias("total"),
            total().alias("volume_total"),
            avg_rounded("loan_amnt", 2).alias("ticket_medio"),
            default_rate().alias("taxa_default"),
            avg_rounded("int_rate", 4).alias("taxa_juro_media"),
            avg_rounded("fico_range_low", 1).alias("fico_medio"),
        )
        .withColumnRenamed("purpose", "finalidade")
        .orderBy(F.col("taxa_default").desc(), "finalidade")
    )


def top_purposes(loans: DataFrame, n: int = 10) -> DataFrame:
    return (
        _by_purpose(loans)
        .agg(n_rows().alias("total"))
        .orderBy(F.col("total").desc(), "purpose")
        .limit(n)
    )


def fico_bands(loans: DataFrame) -> DataFrame:
    """Twenty-point score bands, ordered by the lowest score in each.

    The first band also holds everything below it and the last everything above.
    """
    starts = K.FICO_BAND_STARTS
    limits = [(start + 20, f"{start}-{start + 19}") for start in starts]
    band = banded("fico_range_low", limits, f"{starts[-1] + 20}+")
    return (
        loans.filter(F.col("fico_range_low").isNotNull())
        .groupBy(band.alias("fico_band"))
        .agg(
            n_rows().alias("total"),
            default_rate().alias("taxa_default"),
            avg_rounded("loan_amnt", 2).alias("ticket_medio"),
            avg_rounded("int_rate", 4).alias("taxa_juro_media"),
            F.min("fico_range_low").alias("_lowest"),
        )
        .orderBy("_lowest")
        .drop("_lowest")
    )


def fico_histogram(loans: DataFrame, width: int = 20, rate_name: str = "dr_pct") -> DataFrame:
    bucket = (F.floor(mid_fico() / width) * width).cast("int")
    return (
        loans.filter(F.col("fico_range_low") > 0)
        .groupBy(bucket.alias("fico_bucket"))
        .agg(n_rows().alias("total"), default_pct().alias(rate_name))
        .orderBy("fico_bucket")
    )


# --- whole book ------------------------------------------------------------------
def headline_kpis(loans: DataFrame) -> DataFrame:
    return loans.agg(
        n_rows().alias("total_loans"),
        F.coalesce(total(), F.lit(0.0)).alias("total_exposure"),
        default_rate().alias("default_rate"),
        avg_rounded("fico_range_low", 1).alias("avg_fico"),
        avg_rounded("dti", 2).alias("avg_dti"),
        avg_rounded("int_rate", 4).alias("avg_int_rate"),
    )


def dashboard_kpis(loans: DataFrame) -> DataFrame:
    """Ten indicators, among them realised loss and minimum capital.

    Loans are first summed per grade and year. Distinct counts then run over those few
    cells; beside plain sums on rows they would multiply every row.
    """
    averaged = {"fico": mid_fico(), "dti": F.col("dti"), "rate": F.col("int_rate")}
    cells = loans.groupBy("grade", F.year("issue_d").alias("year")).agg(
        n_rows().alias("n"),
        n_defaults().alias("bad"),
        F.sum("loan_amnt").alias("amount"),
        F.sum(F.when(F.col("is_default"), F.col("loan_amnt") * downturn_lgd())).alias("lost"),
        *(F.sum(c).alias(f"sum_{name}") for name, c in averaged.items()),
        *(F.count(c).alias(f"n_{name}") for name, c in averaged.items()),
    )

    def average(name: str, digits: int, scale: float = 1.0) -> Column:
        value = F.try_divide(F.sum(f"sum_{name}").cast("double"), F.sum(f"n_{name}"))
        return F.round(value * scale, digits)

    amount = F.sum("amount").cast("double")
    return cells.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_loans"),
        in_millions(amount, 1).alias("total_exposure_m"),
        F.round(F.try_divide(F.sum("bad").cast("double"), F.sum("n")) * 100, 2).alias("default_rate_pct"),
        average("fico", 1).alias("avg_fico"),
        average("dti", 1).alias("avg_dti"),
        average("rate", 2, 100.0).alias("avg_int_rate_pct"),
        in_millions(F.coalesce(F.sum("lost").cast("double"), F.lit(0.0)), 1).alias("realised_loss_m"),
        in_millions(amount * K.CAPITAL_RATIO, 1).alias("min_capital_m"),
        F.count_distinct("grade").alias("n_grades"),
        F.count_distinct("year").alias("n_years"),
    )


def executive_summary(loans: DataFrame) -> DataFrame:
    return loans.agg(
        n_rows().alias("n_loans"),
        default_pct().alias("default_rate_pct"),
        in_millions(total(), 1).alias("exposure_m"),
        avg_rounded("loan_amnt", 0).alias("ticket_medio"),
        avg_rounded("fico_avg", 0).alias("fico_medio"),
        avg_rounded("dti", 1).alias("dti_medio"),
    )


# --- question catalogue ----------------------------------------------------------
def query_portfolio(loans: DataFrame, kind: str) -> DataFrame:
    """Five standard questions by name."""
    if kind == "overview":
        return loans.agg(
            n_rows().alias("total_emprestimos"),
            in_millions(total(), 1).alias("exposicao_milhoes"),
            default_pct().alias("taxa_default_pct"),
            avg_rounded(mid_fico(), 1).alias("fico_medio"),
            avg_rounded("dti", 1).alias("dti_medio"),
            avg_rounded("int_rate", 2, 100).alias("taxa_juro_media_pct"),
        )
    if kind == "by_grade":
        return (
            _graded(loans)
            .agg(
                n_rows().alias("emprestimos"),
                in_millions(total(), 1).alias("exposicao_m"),
                default_pct().alias("taxa_default_pct"),
                avg_rounded(mid_fico(), 0).alias("fico_medio"),
            )
            .orderBy("grade")
        )
    if kind == "vintage":
        return (
            _by_year(loans)
            .agg(n_rows().alias("emprestimos"), default_pct().alias("taxa_default_pct"))
            .withColumnRenamed("year", "ano")
            .orderBy("ano")
        )
    if kind == "fico_distribution":
        return fico_histogram(loans, rate_name="taxa_default_pct")
    if kind == "top_defaults":
        return (
            _by_purpose(loans)
            .agg(n_rows().alias("emprestimos"), default_pct().alias("taxa_default_pct"))
            .orderBy(F.col("taxa_default_pct").desc(), "purpose")
            .limit(8)
        )
    raise ValueError(f"unknown question: {kind}")


# --- groupings -------------------------------------------------------------------
def _graded(loans):
    return loans.filter(F.col("grade").isNotNull()).groupBy("grade")


def _by_quarter(loans):
    return loans.filter(F.col("issue_d").isNotNull()).groupBy(
        F.trunc("issue_d", "quarter").alias("quarter_start")
    )


def _by_year(loans):
    return loans.filter(F.col("issue_d").isNotNull()).groupBy(F.year("issue_d").alias("year"))


def _by_purpose(loans):
    return loans.filter(F.col("purpose").isNotNull()).groupBy("purpose")
