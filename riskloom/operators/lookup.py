"""Joining small statistics back to large tables with a checked size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LOOKUP_ROWS = 10_000


def attach_statistic(
    facts: DataFrame, statistic: DataFrame, key: str, max_rows: int = LOOKUP_ROWS
) -> DataFrame:
    """Left join of a per-key statistic.

    The statistic is evaluated once. If it has at most ``max_rows`` rows it becomes a
    local relation that is broadcast; above that it is joined by shuffle as usual.
    """
    rows = statistic.limit(max_rows + 1).toArrow()
    if rows.num_rows > max_rows:
        return facts.join(statistic, key, "left")
    local = facts.sparkSession.createDataFrame(rows)
    return facts.join(F.broadcast(local), key, "left")
