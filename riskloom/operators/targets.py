"""Default flag and the loss and exposure targets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom import constants as K
from riskloom.functions.columns import at_least_one, clip, is_default
from riskloom.operators.lookup import attach_statistic


def with_default_flag(loans: DataFrame) -> DataFrame:
    return loans.withColumn("is_default", is_default("loan_status"))


def with_raw_lgd(loans: DataFrame) -> DataFrame:
    """Loss given default of defaulted loans from recoveries, limited to its range."""
    recovered = F.coalesce(F.col("recoveries").cast("double"), F.lit(0.0)) / at_least_one("loan_amnt")
    loss = F.lit(1.0) - clip(recovered, 0.0, 1.0)
    usable = F.col("is_default") & (F.col("loan_amnt") > 0)
    return loans.withColumn("lgd", clip(F.when(usable, loss), *K.LGD_RANGE))


def impute_lgd(loans: DataFrame, group: str = "grade", losses: DataFrame | None = None) -> DataFrame:
    """Replace losses at the upper limit by the mean of the group's other losses.

    The means are one small aggregate of ``losses``, rows of ``loans`` with all that have a
    loss (all rows, if not given); rows never move to their group, so a group that holds a
    third of the book costs nothing extra.
    """
    top = K.LGD_RANGE[1]
    below = (loans if losses is None else losses).filter(F.col("lgd") < top)
    means = below.groupBy(group).agg(F.avg("lgd").alias("_mean_lgd"))
    looked_up = attach_statistic(loans, means, group)
    lgd = F.when(
        F.col("lgd") >= top, F.coalesce(F.col("_mean_lgd"), F.lit(K.LGD_WITHOUT_HISTORY))
    ).otherwise(F.col("lgd"))
    return looked_up.withColumn("lgd", lgd).drop("_mean_lgd")


def with_exposure(loans: DataFrame) -> DataFrame:
    """Exposure at default, and the conversion factor of defaulted loans."""
    df = loans.withColumn("ead", F.coalesce(F.col("funded_amnt"), F.col("loan_amnt")))
    factor = F.col("ead").cast("double") / at_least_one("loan_amnt")
    return df.withColumn("ccf", clip(F.when(F.col("is_default"), factor), 0.0, 1.0))


def build_targets(loans: DataFrame, *, loss: bool = True) -> DataFrame:
    """Default flag, EAD, CCF and, unless left out, the imputed LGD.

    The imputation runs one small job for the group means, so work that does not use
    the LGD should leave it out.
    """
    df = with_default_flag(loans)
    if loss:
        df = with_raw_lgd(df)
        df = impute_lgd(df, losses=df.filter("is_default"))
    return with_exposure(df)
