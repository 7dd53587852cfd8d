"""Session views, so that the book can be queried in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame

from riskloom.operators.portfolio import monthly_default_rates, portfolio_summary


def register_views(loans: DataFrame, metrics: DataFrame | None = None, predictions: DataFrame | None = None) -> None:
    """Name the tables and the two summary views in the session."""
    tables = {
        "loans": loans,
        "model_metrics": metrics,
        "model_predictions": predictions,
        "v_portfolio_summary": portfolio_summary(loans),
        "v_monthly_default_rates": monthly_default_rates(loans),
    }
    for name, df in tables.items():
        if df is not None:
            df.createOrReplaceTempView(name)
