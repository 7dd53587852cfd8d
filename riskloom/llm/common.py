"""Helpers the corpus operators share."""

from __future__ import annotations

import string
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.session import work_folder

# A word is a run of characters other than the six ASCII white spaces.
WORD = "[^\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def staged(df: DataFrame, name: str) -> DataFrame:
    """The rows written to the shared folder and read again: cuts lineage, computes once."""
    folder = work_folder(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def arrow_rows(spark: SparkSession, rows: int = 500) -> None:
    """Rows per Arrow batch, so that a batch of long texts stays small in a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z; every other character stays."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


ROW_KEY = ["__llm_sha", "__llm_row"]


def with_row_key(docs: DataFrame) -> DataFrame:
    """Adds ``ROW_KEY``: digests of the text and of all columns. Rows that share it are interchangeable."""
    plain = [F.to_json(F.struct(f"`{c}`")) if "map<" in t or t == "variant" else F.col(f"`{c}`") for c, t in docs.dtypes]
    # a hash skips nulls, so which values are null is hashed as well
    row = F.xxhash64(*plain, *[F.col(f"`{c}`").isNull() for c in docs.columns])
    return docs.withColumns({ROW_KEY[0]: F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)), ROW_KEY[1]: row})


def ranked(df: DataFrame, order: Iterable[Column], name: str) -> DataFrame:
    """Adds ``_rank``, the row's place from 0 in the whole order, without one task seeing all rows.

    Rows are dealt out by ranges of the order and sorted within them; a row's place is its
    place in its range plus the rows of the ranges before it. The only table that meets in
    one task has a row per range.
    """
    order = list(order)
    dealt = (
        df.repartitionByRange(shuffle_width(df.sparkSession), *order)
        .sortWithinPartitions(*order)
        .withColumn("_at", F.monotonically_increasing_id())
    )
    dealt = staged(dealt, name)
    part = F.shiftright("_at", 33)
    ranges = dealt.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = F.lit(0).cast("bigint")
    sizes = {r["_part"]: r["_n"] for r in ranges.collect()}
    steps, total = [], 0
    for p in sorted(sizes):
        steps.append((p, total))
        total += sizes[p]
    if not steps:
        return dealt.withColumn("_rank", before).drop("_at")
    spark = df.sparkSession
    starts = spark.createDataFrame(steps, "_part bigint, _start bigint")
    local = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    # one row per range: bounded by the shuffle width
    return (
        dealt.withColumn("_part", part)
        .join(F.broadcast(starts), "_part")
        .withColumn("_rank", F.col("_start") + local)
        .drop("_at", "_part", "_start")
    )


def keyed(docs: DataFrame) -> tuple[DataFrame, bool]:
    """k (order of documents), doc_id, text; and whether k is doc_id, which then names the rows.

    Otherwise k is a place in the order of doc_id and the text's SHA-256, the same for equal rows.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    names = rows.groupBy("doc_id").agg(F.count("*").alias("c")).where("doc_id IS NULL OR c > 1")
    if names.isEmpty():
        return rows.select(F.col("doc_id").alias("k"), "doc_id", "text"), True
    named = rows.withColumn("sha", F.sha2(F.coalesce("text", F.lit("")), 256))
    places = ranked(named.select("doc_id", "sha").distinct(), [F.col("doc_id").asc_nulls_first(), F.col("sha")], "document-order")
    a, b = named.alias("a"), staged(places, "document-places").alias("b")
    same = F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.sha") == F.col("b.sha"))
    return staged(a.join(b, same).select(F.col("b._rank").alias("k"), "a.doc_id", "a.text"), "keyed-documents"), False
