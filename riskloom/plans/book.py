"""Loads the tables that queries share, once per application and scale folder.

The first use derives the loan book from the supplied tables and writes it to the shared
folder as Parquet; later queries read that table. The load reads its rows twice, for the
means of the losses and for the table, so the joined sources are written before it. A lost
executor costs a re-read of files and nothing more.
"""

from __future__ import annotations

from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.operators.features import build_loans
from riskloom.operators.monitoring import measure_models
from riskloom.operators.scoring import applications, pd_column, to_predictions
from riskloom.session import work_folder
from riskloom.sources.testbook import loan_sources, raw_from_joined

PREDICTION_STAMP = "2024-01-01 00:00:00"


@cache
def _table_path(spark: SparkSession, application: str, sf_dir: str, name: str) -> str:
    path = work_folder(spark, name)
    _BUILDERS[name](spark, sf_dir).write.parquet(path)
    return path


def _stored(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(_table_path(spark, spark.sparkContext.applicationId, sf_dir, name))


def loans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The typed loan table with targets and features."""
    return _stored(spark, sf_dir, "loans")


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of the three analytic models per issue quarter."""
    return _stored(spark, sf_dir, "metrics")


def scored(spark: SparkSession, sf_dir: str, variant: str = "basic") -> DataFrame:
    """Loans with the analytic PD as ``score``."""
    return with_score(loans(spark, sf_dir), variant)


def with_score(book: DataFrame, variant: str = "basic") -> DataFrame:
    pd = pd_column(
        variant,
        fico_score=F.col("fico_avg"),
        dti=F.col("dti").cast("double"),
        int_rate=(F.col("int_rate") * 100).cast("double"),
        annual_inc=F.col("annual_inc").cast("double"),
        revol_util=F.col("revol_util").cast("double"),
    )
    return book.withColumn("score", F.round(pd, 6))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One PD prediction per loan."""
    return to_predictions(applications(loans(spark, sf_dir)), created_at=PREDICTION_STAMP)


_BUILDERS = {
    "loan-sources": loan_sources,
    "loans": lambda spark, sf_dir: build_loans(raw_from_joined(_stored(spark, sf_dir, "loan-sources"))),
    "metrics": lambda spark, sf_dir: measure_models(scored(spark, sf_dir)),
}
