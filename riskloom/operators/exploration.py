"""Data profile, correlations and class histograms."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom import constants as K
from riskloom.functions.columns import number_sql, share_true
from riskloom.operators.quantiles import exact_quantiles


def missing_profile(loans: DataFrame, columns: Sequence[str] = K.PROFILE_COLUMNS) -> DataFrame:
    """Missing values per column from one aggregation, most missing first."""
    counted = loans.agg(
        F.count(F.lit(1)).alias("rows"),
        *(F.count_if(F.col(c).isNull()).alias(c) for c in columns),
    )
    kinds = dict(loans.dtypes)
    rows = [F.struct(F.lit(c).alias("column"), F.lit(kinds[c]).alias("dtype"), F.col(c).alias("n")) for c in columns]
    return (
        counted.select("rows", F.explode(F.array(*rows)).alias("x"))
        .select(
            F.col("x.column").alias("column"),
            F.col("x.dtype").alias("dtype"),
            F.col("x.n").alias("missing_n"),
            F.round(F.try_divide(F.col("x.n") * 100.0, F.col("rows")), 6).alias("missing_pct"),
        )
        .orderBy(F.col("missing_pct").desc(), "column")
    )


def class_default_rates(loans: DataFrame) -> DataFrame:
    """Counts per class and default rates per grade and issue year, from one grouping.

    Rows are counted per grade, year and class once; the three views add up those cells.
    """
    cells = loans.groupBy(
        F.col("grade"), F.year("issue_d").cast("string").alias("year"), F.col("is_default")
    ).agg(F.count(F.lit(1)).alias("n"))
    views = F.array(
        F.struct(F.lit("is_default").alias("view"), F.col("is_default").cast("int").cast("string").alias("key")),
        F.struct(F.lit("grade").alias("view"), F.col("grade").alias("key")),
        F.struct(F.lit("issue_year").alias("view"), F.col("year").alias("key")),
    )
    return (
        cells.select("is_default", "n", F.explode(views).alias("x"))
        .filter(F.col("x.key").isNotNull())
        .groupBy(F.col("x.view").alias("view"), F.col("x.key").alias("key"))
        .agg(
            F.sum("n").alias("n_loans"),
            F.round(
                F.sum(F.when(F.col("is_default"), F.col("n")).otherwise(0)).cast("double")
                / F.sum("n") * 100, 6
            ).alias("default_rate_pct"),
        )
        .orderBy("view", "key")
    )


def class_weights(loans: DataFrame) -> DataFrame:
    """Class counts and the weight of the rarer class."""
    return loans.agg(
        F.count_if(~F.col("is_default")).alias("neg"),
        F.count_if("is_default").alias("pos"),
    ).withColumn(
        "scale_pos_weight",
        F.round(F.col("neg").cast("double") / F.greatest(F.col("pos"), F.lit(1)), 6),
    )


def population_counts(loans: DataFrame, statuses: Sequence[str]) -> DataFrame:
    return loans.filter(F.col("loan_status").isin(*statuses)).agg(
        F.count(F.lit(1)).alias("n_total"),
        F.count_if("is_default").alias("n_defaults"),
        F.count_if(~F.col("is_default")).alias("n_non_defaults"),
        F.round(share_true("is_default"), 6).alias("default_rate"),
    )


def correlation_matrix(loans: DataFrame, columns: Sequence[str] = K.CORRELATION_COLUMNS) -> DataFrame:
    """Pearson correlation of every pair, both orders and the diagonal.

    One scan takes the means, a second sums the products of centred values. Pairs with
    gaps are left to ``corr``, which uses the rows where both values are present.
    """
    numbers = loans.select(*(_as_number(loans, c) for c in columns))
    first = numbers.agg(
        F.count(F.lit(1)).alias("rows"),
        *(F.count(c).alias(f"n_{c}") for c in columns),
        *(F.avg(c).alias(f"m_{c}") for c in columns),
    ).first()
    whole = [c for c in columns if first["rows"] > 0 and first[f"n_{c}"] == first["rows"]]
    centred = numbers.select(
        *(F.col(c) for c in columns if c not in whole),
        *((F.col(c) - F.lit(first[f"m_{c}"])).alias(c) for c in whole),
    )
    pairs = list(combinations(columns, 2))
    # SQL text keeps the many small expressions cheap to assemble
    sums = ["count(1) AS rows"]
    for c in whole:
        sums += [f"sum({c}) / count(1) AS m_{c}", f"sum({c} * {c}) / count(1) AS s_{c}"]
    results = [f"1D AS `{c}|{c}`" for c in columns]
    for i, (a, b) in enumerate(pairs):
        if a in whole and b in whole:
            sums.append(f"sum({a} * {b}) / count(1) AS r{i}")
            spread = f"sqrt((s_{a} - m_{a} * m_{a}) * (s_{b} - m_{b} * m_{b}))"
            r = f"try_divide(r{i} - m_{a} * m_{b}, {spread})"
        else:
            sums.append(f"corr({a}, {b}) AS r{i}")
            r = f"r{i}"
        results.append(f"round({r}, 6) AS `{a}|{b}`")
    long = centred.agg(*(F.expr(x) for x in sums)).selectExpr("rows", *results).unpivot("rows", None, "pair", "r")
    names = F.split("pair", r"\|")
    both_ways = F.array_distinct(
        F.array(
            F.struct(names[0].alias("feature_a"), names[1].alias("feature_b")),
            F.struct(names[1].alias("feature_a"), names[0].alias("feature_b")),
        )
    )
    return long.select(F.inline(both_ways), "r").orderBy("feature_a", "feature_b")


def target_correlations(
    loans: DataFrame, columns: Sequence[str], target: str = "is_default", top: int | None = None
) -> DataFrame:
    """Correlation of each column with the target, strongest first, with its direction."""
    numbers = loans.select(*(_as_number(loans, c) for c in [target, *columns]))
    one_row = numbers.agg(*(F.corr(c, target).alias(c) for c in columns))
    cells = [F.struct(F.lit(c).alias("feature"), F.round(F.col(c), 6).alias("r")) for c in columns]
    ranked = (
        one_row.select(F.inline(F.array(*cells)))
        .withColumn("direction", F.when(F.col("r") > 0, "↑ risco").otherwise("↓ risco"))
        .orderBy(F.abs("r").desc(), "feature")
    )
    return ranked if top is None else ranked.limit(top)


def _as_number(df, name):
    c = F.col(name)
    if dict(df.dtypes)[name] == "boolean":
        c = c.cast("int")
    return c.cast("double").alias(name)


# --- class histograms ------------------------------------------------------------
def clipped_by_class(loans: DataFrame, columns: Sequence[str]) -> tuple[DataFrame, list[str], list[tuple[float, float]]]:
    """Long rows (feature number, value, bad) limited to the good class's 2-98 % range.

    Also returns the names and the limits behind the numbers; rows carry numbers only.
    """
    limits = exact_quantiles(loans.filter(~F.col("is_default")), columns, [0.02, 0.98])
    names = [c for c in columns if limits[c] is not None]
    spans = [tuple(limits[c]) for c in names]
    clipped = [
        F.expr(f"CASE WHEN {c} IS NOT NULL THEN greatest({number_sql(lo)}, least({number_sql(hi)}, CAST({c} AS DOUBLE))) END").alias(f"v{i}")
        for i, (c, (lo, hi)) in enumerate(zip(names, spans))
    ]
    long = (
        loans.select(F.col("is_default").alias("bad"), *clipped)
        .select("bad", F.posexplode(F.array(*(f"v{i}" for i in range(len(names))))).alias("at", "value"))
        .filter(F.col("value").isNotNull())
    )
    return long, names, spans


def _of_feature(numbers) -> Column:
    """The figure of the row's feature from a short list."""
    return F.expr(f"element_at(array({', '.join(numbers)}), at + 1)")


def class_histograms(
    loans: DataFrame, columns: Sequence[str] = K.HISTOGRAM_COLUMNS, bins: int = 40
) -> DataFrame:
    """Density per feature, class and slot of the winsorised values."""
    long, names, spans = clipped_by_class(loans, columns)
    low = _of_feature(number_sql(lo) for lo, _ in spans)
    width = _of_feature(number_sql((hi - lo) / bins) for lo, hi in spans)
    slot = F.coalesce(F.least(F.floor(F.try_divide(F.col("value") - low, width)), F.lit(bins - 1)), F.lit(0))
    counts = long.groupBy("at", "bad", slot.cast("int").alias("slot")).agg(F.count(F.lit(1)).alias("n"))
    of_class = F.sum("n").over(Window.partitionBy("at", "bad"))  # at most `bins` rows each
    return counts.select(
        _of_feature(f"'{c}'" for c in names).alias("feature"),
        F.col("bad").cast("int").alias("is_default"),
        "slot",
        "n",
        F.round(F.try_divide(F.col("n").cast("double"), of_class * width), 9).alias("density"),
    )


def feature_ks(
    loans: DataFrame, columns: Sequence[str] = K.HISTOGRAM_COLUMNS, slices: int = 1024
) -> DataFrame:
    """Two-sample KS between the classes per feature, on the winsorised values.

    Values are counted once each. Running totals then work slice by slice of the value
    range, each starting from the total of the slices before it, so no task has to order
    a whole column.
    """
    long, names, spans = clipped_by_class(loans, columns)
    low = _of_feature(number_sql(lo) for lo, _ in spans)
    width = _of_feature(number_sql((hi - lo) / slices) for lo, hi in spans)
    # never NULL, or the null checks of the join below would keep Spark from sharing the counts
    slice_no = F.coalesce(F.floor(F.try_divide(F.col("value") - low, width)), F.lit(0))
    counts = long.groupBy("at", slice_no.alias("slice"), "value").agg(
        F.count_if("bad").alias("bad"), F.count_if(~F.col("bad")).alias("good")
    )
    before = Window.partitionBy("at").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("at")
    starts = (
        counts.groupBy("at", "slice")
        .agg(F.sum("bad").alias("sb"), F.sum("good").alias("sg"))
        .select(
            "at",
            "slice",
            F.coalesce(F.sum("sb").over(before), F.lit(0)).alias("b0"),
            F.coalesce(F.sum("sg").over(before), F.lit(0)).alias("g0"),
            F.sum("sb").over(whole).alias("all_bad"),
            F.sum("sg").over(whole).alias("all_good"),
        )
    )
    inside = Window.partitionBy("at", "slice").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    running = counts.select(
        "at", "slice", F.sum("bad").over(inside).alias("b"), F.sum("good").over(inside).alias("g")
    )
    gap = F.abs(
        F.try_divide((F.col("b0") + F.col("b")).cast("double"), F.col("all_bad"))
        - F.try_divide((F.col("g0") + F.col("g")).cast("double"), F.col("all_good"))
    )
    return (
        running.join(starts, ["at", "slice"])
        .groupBy("at")
        .agg(F.round(F.max(gap), 6).alias("ks"))
        .select(_of_feature(f"'{c}'" for c in names).alias("feature"), "ks")
        .orderBy("feature")
    )
