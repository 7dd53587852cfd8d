"""Fine and coarse classing, weight of evidence and information value."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom import constants as K
from riskloom.functions.columns import banded, interval, number_sql, share_true
from riskloom.functions.scorecards import scorecard_points
from riskloom.operators.quantiles import exact_quantiles

SMALLEST_SHARE = 1e-9


def quantile_edges(df: DataFrame, features: Sequence[str], bins: int = 10) -> dict[str, list[float]]:
    """Distinct quantile edges per feature; a constant feature gets one bin around its value."""
    found = exact_quantiles(df, features, [i / bins for i in range(bins + 1)])
    edges = {}
    for feature, values in found.items():
        if values is None:
            continue
        distinct = sorted(set(values))
        edges[feature] = distinct if len(distinct) > 1 else [distinct[0], distinct[0]]
    return edges


def _is_categorical(df: DataFrame, feature: str) -> bool:
    return isinstance(df.schema[feature].dataType, T.StringType)


def woe_table(
    df: DataFrame, features: Sequence[str], target: str = "is_default", bins: int = 10
) -> DataFrame:
    """Weight of evidence per feature and bin; positive means riskier than the whole.

    All features are counted in one pass. Text features use each value as a bin,
    numeric ones right-closed quantile bins. A feature with only one class gives no rows.
    """
    usable = df.filter(F.col(target).isNotNull())
    numeric = [f for f in features if not _is_categorical(df, f)]
    text = [f for f in features if _is_categorical(df, f)]
    edges = quantile_edges(usable, numeric, bins) if numeric else {}
    counted = []
    if edges:
        counted.append(_count_numeric(usable, target, edges))
    if text:
        counted.append(_count_text(usable, target, text))
    if not counted:
        raise ValueError("no feature has values")
    binned = counted[0] if len(counted) == 1 else counted[0].unionByName(counted[1])
    totals = binned.groupBy("feature").agg(
        F.sum("count_events").alias("events"),
        (F.sum("count_total") - F.sum("count_events")).alias("non_events"),
    )
    joined = binned.join(totals.filter((F.col("events") > 0) & (F.col("non_events") > 0)), "feature")
    others = F.col("count_total") - F.col("count_events")
    pe = F.greatest(F.col("count_events").cast("double") / F.col("events"), F.lit(SMALLEST_SHARE))
    pn = F.greatest(others.cast("double") / F.col("non_events"), F.lit(SMALLEST_SHARE))
    label = F.coalesce(
        F.col("value"),
        F.concat(
            F.when(F.col("bin_no") == 0, "[").otherwise("("),
            F.format_number("bin_min", 4), F.lit(", "), F.format_number("bin_max", 4), F.lit("]"),
        ),
    )
    return joined.select(
        "feature",
        "bin_no",
        label.alias("bin_label"),
        "bin_min",
        "bin_max",
        "count_total",
        "count_events",
        others.alias("count_non_events"),
        (F.col("count_events").cast("double") / F.col("count_total")).alias("event_rate"),
        F.ln(pe / pn).alias("woe"),
        ((pe - pn) * F.ln(pe / pn)).alias("iv_bin"),
    )


def _count_numeric(df: DataFrame, target: str, edges: dict[str, list[float]]) -> DataFrame:
    """Counts per feature and bin. Rows carry small bin numbers only; names and limits are
    attached to the counts."""
    names = list(edges)
    slots = df.select(
        F.col(target).cast("int").alias("y"), *(interval(f, edges[f]).alias(f"b{i}") for i, f in enumerate(names))
    )
    counts = (
        slots.select("y", F.posexplode(F.array(*(f"b{i}" for i in range(len(names))))).alias("at", "bin_no"))
        .filter(F.col("bin_no").isNotNull())
        .groupBy("at", "bin_no")
        .agg(F.count(F.lit(1)).alias("count_total"), F.sum("y").alias("count_events"))
    )
    limits = "array(" + ", ".join(
        f"array({', '.join(number_sql(e) for e in edges[f])})" for f in names
    ) + ")"
    label = "array(" + ", ".join(f"'{f}'" for f in names) + ")"
    return counts.selectExpr(
        f"element_at({label}, at + 1) AS feature",
        "bin_no",
        f"element_at(element_at({limits}, at + 1), bin_no + 1) AS bin_min",
        f"element_at(element_at({limits}, at + 1), bin_no + 2) AS bin_max",
        "CAST(NULL AS STRING) AS value",
        "count_total",
        "count_events",
    )


def _count_text(df: DataFrame, target: str, features: Sequence[str]) -> DataFrame:
    rows = F.array(*(F.struct(F.lit(f).alias("feature"), F.col(f).alias("value")) for f in features))
    none = F.lit(None).cast("double")
    return (
        df.select(F.col(target).cast("int").alias("y"), F.inline(rows))
        .filter(F.col("value").isNotNull())
        .groupBy("feature", "value")
        .agg(F.count(F.lit(1)).alias("count_total"), F.sum("y").alias("count_events"))
        .select(
            "feature", F.lit(0).alias("bin_no"), none.alias("bin_min"), none.alias("bin_max"),
            "value", "count_total", "count_events",
        )
    )


def with_feature_iv(woe: DataFrame) -> DataFrame:
    """Repeat the information value of the feature on each of its bins."""
    per_feature = woe.groupBy("feature").agg(F.sum("iv_bin").alias("iv"))
    return woe.join(per_feature, "feature")


def iv_ranking(
    df: DataFrame, features: Sequence[str], target: str = "is_default", bins: int = 10
) -> DataFrame:
    """Information value and strength label per feature, strongest first."""
    return (
        woe_table(df, features, target, bins)
        .groupBy("feature")
        .agg(F.sum("iv_bin").alias("value"))
        .select(
            "feature",
            F.round("value", 4).alias("iv"),
            banded("value", K.IV_BANDS, K.IV_TOP).alias("poder_preditivo"),
        )
        .orderBy(F.col("iv").desc(), "feature")
    )


def selected_features(ranking: DataFrame, least: float = 0.05, n: int = 6) -> DataFrame:
    return ranking.filter(F.col("iv") >= least).orderBy(F.col("iv").desc(), "feature").limit(n)


def to_feature_woe(woe: DataFrame, model_type: str = "PD") -> DataFrame:
    """Rows for the table that stores bins."""
    return with_feature_iv(woe).select(
        F.col("feature").alias("feature_name"),
        F.substring("bin_label", 1, 100).alias("bin_label"),
        "bin_min",
        "bin_max",
        F.col("count_total").cast("int").alias("count_total"),
        F.col("count_events").cast("int").alias("count_events"),
        F.col("count_non_events").cast("int").alias("count_non_events"),
        F.col("woe").cast("decimal(10,6)").alias("woe"),
        F.col("iv").cast("decimal(10,6)").alias("iv"),
        F.lit(model_type).alias("model_type"),
    )


# --- coarse classes --------------------------------------------------------------
def coarse_fico(c: Column | str = "fico_avg") -> Column:
    return banded(c, K.FICO_COARSE, K.FICO_COARSE_TOP, unknown=K.FICO_COARSE_TOP)


def coarse_dti(c: Column | str = "dti") -> Column:
    """A missing ratio falls in the last class."""
    return banded(c, K.DTI_COARSE, K.DTI_COARSE_TOP, unknown=K.DTI_COARSE_TOP)


def coarse_class_rates(loans: DataFrame, label: Column) -> DataFrame:
    """Default rate per coarse class, and whether each rate lies above the one before it."""
    rates = loans.groupBy(label.alias("classe")).agg(
        F.round(share_true("is_default") * 100, 6).alias("taxa_default"),
        F.count(F.lit(1)).alias("n_obs"),
    )
    order = Window.partitionBy().orderBy("classe")  # five rows
    return rates.withColumn(
        "rises", (F.col("taxa_default") > F.lag("taxa_default").over(order)).cast("int")
    ).orderBy("classe")


def with_scorecard_points(scored: DataFrame, pd: str = "pd") -> DataFrame:
    return scored.withColumn("scorecard_points", F.round(scorecard_points(pd), 4))
