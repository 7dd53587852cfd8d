"""Window monitoring of a stream of scores and its stability per closed window."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from riskloom.operators.monitoring import window_monitor
from riskloom.operators.validation import PSI_FLOOR


def monitor_stream(
    events: DataFrame, *, delay: str = "1 hour", length: str = "1 day", slide: str | None = None, width: float = 50.0
) -> DataFrame:
    """Band counts per closed window; rows later than the delay are left out."""
    return window_monitor(events.withWatermark("ts", delay), length, slide, width)


def reference_shares(reference: DataFrame, width: float = 50.0) -> DataFrame:
    """Share of each band of the reference values: band, share."""
    band = (F.floor(F.col("value") / width) * width).cast("double")
    counts = reference.groupBy(band.alias("band")).agg(F.count(F.lit(1)).alias("n"))
    whole = counts.agg(F.sum("n").cast("double")).scalar()
    return counts.select("band", (F.col("n") / whole).alias("share"))


def window_stability(windows: DataFrame, expected: DataFrame) -> DataFrame:
    """Stability index per window against the reference shares (band, share).

    A band that the reference lacks stays in the denominator; a band that the window lacks
    counts with the floor. The index is that of an empty window plus, for each band that the
    window has, the difference that its rows make, so windows meet only the bands they share
    with the reference, however many it has.
    """
    floor = F.lit(PSI_FLOOR)

    def term(actual):
        return (actual - F.col("e")) * F.ln(actual / F.col("e"))

    floored = expected.select(F.col("band").alias("_band"), F.greatest("share", floor).alias("e"))
    empty = floored.agg(F.sum(term(floor))).scalar()
    sizes = windows.groupBy(F.col("window_start").alias("_start")).agg(F.sum("n").alias("_size"))
    bands = windows.groupBy("window_start", "band").agg(F.sum("n").alias("n"))
    met = bands.join(floored, F.col("band").eqNullSafe(F.col("_band")), "left").join(sizes, F.col("window_start") == F.col("_start"))
    actual = F.greatest(F.col("n").cast("double") / F.col("_size"), floor)
    found = met.groupBy("window_start").agg(F.sum("n").alias("n"), F.coalesce(F.sum(term(actual) - term(floor)), F.lit(0.0)).alias("more"))
    return found.select("window_start", "n", F.round(F.coalesce(empty, F.lit(0.0)) + F.col("more"), 6).alias("psi"))


def start_stability(
    windows: DataFrame, expected: DataFrame | Callable[[], DataFrame], path: str, checkpoint: str
) -> StreamingQuery:
    """Write the stability of every closed window; a repeated micro-batch replaces its own folder.

    A reference that changes is given as a function, which is asked at every micro-batch.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        shares = expected() if callable(expected) else expected
        window_stability(batch, shares).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return (
        windows.writeStream.outputMode("append")
        .foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
