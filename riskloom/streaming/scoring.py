"""Scoring a stream of applications into predictions, with a quarantine of what cannot be scored."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from riskloom.operators.scoring import split_valid, to_predictions


def score_stream(applications: DataFrame, *, variant: str = "service", dedupe_within: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Predictions and rejected applications of a stream (or a table).

    The same column expressions score a batch. With ``dedupe_within`` repeated keys are
    dropped within that span of event time ``ts``; the state is bounded by the span.
    """
    valid, rejected = split_valid(_once(applications, dedupe_within))
    scored = to_predictions(valid, variant)
    return scored, rejected.select("loan_id", F.array_join("violations", ",").alias("violations"))


def _once(applications: DataFrame, within: str | None) -> DataFrame:
    if not within:
        return applications
    return applications.withWatermark("ts", within).dropDuplicatesWithinWatermark(["loan_id"])


def start_append(df: DataFrame, path: str, checkpoint: str, *, once: bool = True) -> StreamingQuery:
    """Append a stream to Parquet files; progress is kept in the checkpoint folder."""
    writer = df.writeStream.outputMode("append").format("parquet").option("checkpointLocation", checkpoint)
    if once:
        writer = writer.trigger(availableNow=True)
    return writer.start(path)


def start_scoring(
    applications: DataFrame, path: str, checkpoint: str, *, variant: str = "service", dedupe_within: str | None = None, once: bool = True
) -> StreamingQuery:
    """Writes predictions and quarantine of every micro-batch below ``path``.

    Repeated keys are dropped on the stream. Both tables have a folder per batch, which a repeated
    batch replaces, so a restart neither loses nor doubles rows. The batch is kept for the two
    writes and read once.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            for name, df in zip(("predictions", "quarantine"), score_stream(batch, variant=variant), strict=True):
                df.write.mode("overwrite").parquet(f"{path}/{name}/batch_id={batch_id}")
        finally:
            batch.unpersist()

    writer = _once(applications, dedupe_within).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    if once:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def read_scored(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Predictions and quarantine that ``start_scoring`` wrote."""
    return tuple(spark.read.parquet(f"{path}/{name}") for name in ("predictions", "quarantine"))
