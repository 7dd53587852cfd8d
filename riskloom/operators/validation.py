"""Validation of scores: discrimination, calibration, stability and error measures.

Rows are counted per group and distinct score before anything is ordered; scores are not
rounded. Running totals go in two phases: score ranges of relative width are totalled, and the
totals before a range are added to the running ones within it, so that a task orders one range
and no task sees all scores of a group.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom import constants as K
from riskloom.functions.columns import banded, histogram_slot
from riskloom.operators.lookup import attach_statistic
from riskloom.operators.quantiles import exact_quantiles

RANGES_PER_OCTAVE = 1024


def score_counts(
    scored: DataFrame, keys: Sequence[str] = (), score: str = "score", target: str = "is_default", digits: int | None = None
) -> DataFrame:
    """Loans and defaults per group and score, which is rounded only if ``digits`` are given."""
    point = F.col(score).cast("double")
    return (
        scored.filter(F.col(score).isNotNull())
        .groupBy(*keys, (point if digits is None else F.round(point, digits)).alias("score"))
        .agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(target).cast("int")).alias("bad"))
        .withColumn("good", F.col("n") - F.col("bad"))
    )


def score_range(score: Column) -> Column:
    """A whole number that never falls as the score rises; a range spans a 1024th of an octave."""
    size = (F.floor(F.log2(F.abs(score)) * RANGES_PER_OCTAVE) + 1100 * RANGES_PER_OCTAVE).cast("bigint")
    return F.when(score == 0, F.lit(0).cast("bigint")).otherwise(F.signum(score).cast("bigint") * size)


def running_counts(counts: DataFrame, keys: Sequence[str] = (), *, descending: bool = False) -> DataFrame:
    """Running and whole totals of ``n``, ``bad`` and ``good`` in the order of the score."""
    parts = ("n", "bad", "good")
    turn = F.desc if descending else F.asc
    ranged = counts.withColumn("_range", score_range(F.col("score")))
    before = Window.partitionBy(*keys).orderBy(turn("_range")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    # one row per range: some thousands a group, whatever the number of scores
    totals = ranged.groupBy(*keys, "_range").agg(*(F.sum(c).alias(f"_{c}") for c in parts)).select(
        *(F.col(k).alias(f"_{k}") for k in keys),
        F.col("_range").alias("_at"),
        *(F.coalesce(F.sum(f"_{c}").over(before), F.lit(0)).alias(f"_before_{c}") for c in parts),
        *(F.sum(f"_{c}").over(whole).alias(f"all_{c}") for c in parts),
    )
    # null-safe, though no range is null: an equality adds a null check to one side only, and
    # the counts under both sides are one shuffle only while both are the same
    same = F.col("_range").eqNullSafe(F.col("_at"))
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"_{k}"))
    within = Window.partitionBy(*keys, "_range").orderBy(turn("score")).rowsBetween(Window.unboundedPreceding, 0)
    placed = ranged.withColumns({f"cum_{c}": F.sum(c).over(within) for c in parts}).join(totals, same)
    return placed.withColumns({f"cum_{c}": F.col(f"cum_{c}") + F.col(f"_before_{c}") for c in parts}).select(
        *counts.columns, *(f"cum_{c}" for c in parts), *(f"all_{c}" for c in parts)
    )


def _ratio(a: str, b: str) -> Column:
    return F.try_divide(F.col(a).cast("double"), F.col(b).cast("double"))


def discrimination(
    scored: DataFrame,
    keys: Sequence[str] = (),
    score: str = "score",
    target: str = "is_default",
    *,
    min_rows: int = 0,
    min_defaults: int = 0,
    digits: int | None = None,
) -> DataFrame:
    """AUC, Gini, KS with the score at which it occurs, and Brier score per group.

    Ties count half in the AUC, and the KS is read only between distinct scores.
    """
    r = running_counts(score_counts(scored, keys, score, target, digits), keys)
    below = F.col("cum_good") - F.col("good")
    won = F.col("bad").cast("double") * (below.cast("double") + F.col("good") * 0.5)
    gap = F.abs(_ratio("cum_bad", "all_bad") - _ratio("cum_good", "all_good"))
    p = F.col("score")
    squared = F.col("bad") * (p - 1) * (p - 1) + F.col("good") * p * p
    measures = r.withColumn("gap", gap).groupBy(*keys).agg(
        F.sum("n").alias("n_obs"),
        F.sum("bad").alias("n_defaults"),
        F.sum(won).alias("won"),
        F.sum(F.col("good")).alias("n_good"),
        F.max("gap").alias("ks"),
        F.max(F.struct(F.round("gap", 12).alias("gap"), (-p).alias("s"))).alias("peak"),
        F.sum(squared).alias("squared"),
    )
    auc = F.try_divide(F.col("won"), F.col("n_defaults").cast("double") * F.col("n_good"))
    return (
        measures.filter((F.col("n_obs") >= min_rows) & (F.col("n_defaults") >= min_defaults))
        .withColumn("auc", auc)
        .select(
            *keys,
            "n_obs",
            "n_defaults",
            F.round(_ratio("n_defaults", "n_obs"), 6).alias("dr"),
            F.round("auc", 6).alias("auc"),
            F.round(F.col("auc") * 2 - 1, 6).alias("gini"),
            F.round("ks", 6).alias("ks"),
            (-F.col("peak.s")).alias("ks_score"),
            F.round(F.try_divide(F.col("squared"), F.col("n_obs")), 6).alias("brier"),
        )
    )


def roc_points(scored: DataFrame, score: str = "score", target: str = "is_default") -> DataFrame:
    """One point per distinct score, highest first; no point is dropped."""
    r = running_counts(score_counts(scored, (), score, target), descending=True)
    return r.select(
        F.col("score").alias("threshold"),
        F.round(_ratio("cum_good", "all_good"), 6).alias("fpr"),
        F.round(_ratio("cum_bad", "all_bad"), 6).alias("tpr"),
    )


def lorenz_points(scored: DataFrame, score: str = "score", target: str = "is_default") -> DataFrame:
    """Share of defaults captured against share of the population, riskiest first."""
    r = running_counts(score_counts(scored, (), score, target), descending=True)
    return r.select(
        F.col("score"),
        _ratio("cum_n", "all_n").alias("cum_pop"),
        _ratio("cum_bad", "all_bad").alias("cum_events"),
    )


def capture_rates(
    scored: DataFrame, shares: Sequence[float] = (0.2, 0.4), score: str = "score", target: str = "is_default"
) -> DataFrame:
    """Defaults captured once at least the given share of the population is covered."""
    points = lorenz_points(scored, score, target)
    reads = [
        F.min_by("cum_events", F.when(F.col("cum_pop") >= s, F.col("cum_pop"))).alias(f"c{i}")
        for i, s in enumerate(shares)
    ]
    rows = [F.struct(F.lit(s).alias("population"), F.round(f"c{i}", 6).alias("captured")) for i, s in enumerate(shares)]
    return points.agg(*reads).select(F.inline(F.array(*rows)))


# --- calibration -----------------------------------------------------------------
def calibration_curve(
    scored: DataFrame,
    keys: Sequence[str] = (),
    score: str = "score",
    target: str = "is_default",
    bins: int = 10,
) -> DataFrame:
    """Mean score and observed rate per equal-width bin; empty bins are absent."""
    p = F.col(score).cast("double")
    slot = F.least(F.floor(p * bins), F.lit(bins - 1)).cast("int")
    return (
        scored.filter(F.col(score).isNotNull())
        .groupBy(*keys, slot.alias("bin"))
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.round(F.avg(p), 6).alias("mean_predicted"),
            F.round(F.avg(F.col(target).cast("int").cast("double")), 6).alias("observed_rate"),
        )
    )


def calibration_error(scored: DataFrame, keys: Sequence[str] = (), score="score", target="is_default") -> DataFrame:
    """Mean gap over the non-empty bins, plain and weighted by rows."""
    curve = calibration_curve(scored, keys, score, target)
    gap = F.abs(F.col("observed_rate") - F.col("mean_predicted"))
    return curve.groupBy(*keys).agg(
        F.round(F.avg(gap), 6).alias("ece"),
        F.round(F.sum(gap * F.col("n")) / F.sum("n"), 6).alias("ece_weighted"),
        F.when(F.avg(gap) < 0.05, 1).otherwise(0).alias("well_calibrated"),
    )


# --- comparisons -----------------------------------------------------------------
def compare_models(scored: DataFrame, scores: Mapping[str, str], target: str = "is_default") -> DataFrame:
    """Measures of several score columns side by side, with the winner by Gini."""
    rows = F.array(*(F.struct(F.lit(m).alias("modelo"), F.col(c).cast("double").alias("score")) for m, c in scores.items()))
    long = scored.select(F.col(target).alias("is_default"), F.explode(rows).alias("x")).select("is_default", "x.*")
    table = discrimination(long, ["modelo"])
    everything = Window.partitionBy()  # one row per model
    best = F.max(F.struct("gini", "modelo")).over(everything)
    return table.select(
        "modelo", "gini", "ks", "auc", "brier", (F.col("modelo") == best["modelo"]).cast("int").alias("winner")
    )


def regression_errors(df: DataFrame, actual: str, predicted: str, keys: Sequence[str] = ()) -> DataFrame:
    """R2, RMSE and MAE."""
    y, p = F.col(actual).cast("double"), F.col(predicted).cast("double")
    error = y - p
    both = df.filter(F.col(actual).isNotNull() & F.col(predicted).isNotNull())
    return both.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.round(1 - F.try_divide(F.avg(error * error), F.var_pop(y)), 6).alias("r2"),
        F.round(F.sqrt(F.avg(error * error)), 6).alias("rmse"),
        F.round(F.avg(F.abs(error)), 6).alias("mae"),
    )


def cohort_backtest(scored: DataFrame, score: str = "score", *, min_rows: int = 200, min_defaults: int = 10) -> DataFrame:
    """Measures per issue year, one job for all years."""
    by_year = scored.filter(F.col("issue_d").isNotNull()).withColumn("ano", F.year("issue_d"))
    return (
        discrimination(by_year, ["ano"], score, min_rows=min_rows, min_defaults=min_defaults)
        .select("ano", "n_obs", "dr", "gini", "ks", "auc")
        .orderBy("ano")
    )


def temporal_cutoff(loans: DataFrame, share: float = 0.8) -> DataFrame:
    """The issue date below which the given share of loans lies, as one row.

    Loans are counted per day first, so the quantile sees one entry per calendar day.
    """
    days = (
        loans.filter(F.col("issue_d").isNotNull())
        .groupBy(F.unix_date("issue_d").alias("day"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return days.agg(F.percentile("day", share, F.col("n")).alias("cutoff_day"), F.sum("n").alias("dated"))


def temporal_split(
    loans: DataFrame, share: float = 0.8, *, min_dated: int = 1000, seed: int = 42, key: str = "loan_id"
) -> DataFrame:
    """Mark rows as ``train`` or ``test`` by issue date, or by key hash with too few dates."""
    row = temporal_cutoff(loans, share).first()
    if row["dated"] and row["dated"] > min_dated:
        train = F.unix_date("issue_d") <= F.lit(row["cutoff_day"])
    else:
        train = F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(10_000)) < int(share * 10_000)
    return loans.withColumn("fold", F.when(train, "train").otherwise("test"))


# --- stability -------------------------------------------------------------------
PSI_FLOOR = 1e-8


def psi_edges(expected: DataFrame, columns: Sequence[str], bins: int = 10) -> dict[str, list[float]]:
    # a few columns of the reference, kept while the quantiles pass over them
    numbers = expected.select(*columns).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        found = exact_quantiles(numbers, columns, [i / bins for i in range(bins + 1)])
    finally:
        numbers.unpersist()
    return {c: sorted(set(v)) for c, v in found.items() if v is not None}


def psi_by_group(
    df: DataFrame, group: str, reference, columns: Sequence[str], bins: int = 10, *, min_rows: int = 0
) -> DataFrame:
    """Population stability of several columns per group against a reference group.

    Slots are fixed by the reference. Values outside them stay in the denominator. All
    groups and columns are counted in one pass.
    """
    edges = psi_edges(df.filter(F.col(group) == F.lit(reference)), columns, bins)
    parts = [
        F.struct(
            F.lit(c).alias("feature"),
            F.col(c).cast("double").alias("value"),
            (histogram_slot(c, e) if len(e) > 1 else F.lit(None).cast("int")).alias("slot"),
        )
        for c, e in edges.items()
    ]
    long = df.select(group, F.explode(F.array(*parts)).alias("x")).filter(F.col("x.value").isNotNull())
    wide = long.groupBy(group, F.col("x.feature").alias("feature")).agg(
        F.count(F.lit(1)).alias("n"),
        F.array(*(F.count_if(F.col("x.slot") == i) for i in range(bins))).alias("counts"),
    )
    shares = wide.select(
        group,
        "feature",
        "n",
        F.transform("counts", lambda k: F.greatest(k.cast("double") / F.col("n"), F.lit(PSI_FLOOR))).alias("actual"),
    )
    of_feature = Window.partitionBy("feature")  # one row per group
    base = F.max(F.when(F.col(group) == F.lit(reference), F.col("actual"))).over(of_feature)
    slots = F.create_map(*(x for c, e in edges.items() for x in (F.lit(c), F.lit(len(e) - 1))))
    terms = F.transform(
        F.slice(F.arrays_zip(F.col("actual").alias("a"), F.col("base").alias("e")), F.lit(1), F.col("slots")),
        lambda t: (t["a"] - t["e"]) * F.ln(t["a"] / t["e"]),
    )
    return (
        shares.withColumns({"base": base, "slots": F.element_at(slots, F.col("feature"))})
        .filter((F.col(group) != F.lit(reference)) & (F.col("n") > min_rows))
        .select(
            group,
            "feature",
            "n",
            F.round(F.aggregate(terms, F.lit(0.0), lambda a, b: a + b), 6).alias("psi"),
        )
    )


def compute_psi(expected: DataFrame, actual: DataFrame, column: str, bins: int = 10) -> DataFrame:
    """Stability of one column between two tables."""
    both = expected.select(column, F.lit(0).alias("side")).unionByName(
        actual.select(column, F.lit(1).alias("side"))
    )
    return psi_by_group(both, "side", 0, [column], bins).select("psi")


def psi_by_year(scored: DataFrame, score: str = "score", *, min_rows: int = 100) -> DataFrame:
    """Stability of the score per issue year against the first year."""
    by_year = scored.filter(F.col("issue_d").isNotNull()).withColumn("ano", F.year("issue_d"))
    first = by_year.agg(F.min("ano")).first()[0]
    return (
        psi_by_group(by_year, "ano", first, [score], min_rows=min_rows)
        .select("ano", "psi", banded("psi", K.PSI_SHORT_BANDS, K.PSI_SHORT_TOP).alias("status"))
        .orderBy("ano")
    )


# --- distributions ---------------------------------------------------------------
def pd_by_grade(scored: DataFrame, score: str = "score") -> DataFrame:
    counts = score_counts(scored.filter(F.col("grade").isNotNull()), ["grade"], score)
    return (
        counts.groupBy("grade")
        .agg(
            F.sum("n").alias("n_obs"),
            F.round(F.sum("bad") / F.sum("n") * 100, 6).alias("dr_obs"),
            F.round(F.sum(F.col("score") * F.col("n")) / F.sum("n") * 100, 6).alias("pd_mean"),
            F.round(F.percentile("score", 0.5, F.col("n")), 7).alias("pd_median"),
        )
        .orderBy("grade")
    )


def score_boxplot(scored: DataFrame, key: str = "grade", score: str = "score") -> DataFrame:
    """Quartiles, whiskers at 1.5 interquartile ranges and the number of outliers."""
    counts = score_counts(scored.filter(F.col(key).isNotNull()), [key], score)
    boxes = counts.groupBy(key).agg(F.percentile("score", [0.25, 0.5, 0.75], F.col("n")).alias("q"))
    joined = attach_statistic(counts, boxes, key)
    q1, q3 = F.col("q")[0], F.col("q")[2]
    reach = (q3 - q1) * 1.5
    inside = (F.col("score") >= q1 - reach) & (F.col("score") <= q3 + reach)
    return (
        joined.groupBy(key)
        .agg(
            F.round(F.max(q1) * 100, 6).alias("q1"),
            F.round(F.max(F.col("q")[1]) * 100, 6).alias("median"),
            F.round(F.max(q3) * 100, 6).alias("q3"),
            F.round(F.min(F.when(inside, F.col("score"))) * 100, 6).alias("whisker_low"),
            F.round(F.max(F.when(inside, F.col("score"))) * 100, 6).alias("whisker_high"),
            F.sum(F.when(inside, 0).otherwise(F.col("n"))).alias("n_outliers"),
        )
        .orderBy(key)
    )


def score_class_histogram(scored: DataFrame, score: str = "score", bins: int = 50) -> DataFrame:
    p = F.col(score).cast("double")
    return (
        scored.filter(F.col(score).isNotNull())
        .groupBy(
            F.col("is_default").cast("int").alias("is_default"),
            F.least(F.floor(p * bins), F.lit(bins - 1)).cast("int").alias("slot"),
        )
        .agg(F.count(F.lit(1)).alias("n"))
    )


def points_distribution(scored: DataFrame, points: str = "points", population: str = "population") -> DataFrame:
    """Share of rows per 50-point band in each population."""
    band = F.least(F.floor(F.col(points) / 50) * 50, F.lit(800)).cast("int")
    counts = scored.groupBy(population, band.alias("band")).agg(F.count(F.lit(1)).alias("n"))
    whole = F.sum("n").over(Window.partitionBy(population))  # at most eleven bands each
    return counts.select(
        population,
        F.concat(F.col("band").cast("string"), F.lit("-"), (F.col("band") + 50).cast("string")).alias("band"),
        "n",
        F.round(F.col("n") * 100.0 / whole, 6).alias("pct"),
    )
