"""Exact duplicates by a tree-merge of sorted digest runs. DataFrame functions only.

Every document becomes one narrow row: SHA-256 of the text with A-Z lower-cased, its length
and a second, independent hash. Rows start in as many runs as the input has partitions. In
each round ``fan_in`` neighbouring runs are merged into one: equal digests meet, their
counts add up, and the identifier that stays is kept, until one run is left. A digest counts
as equal only if length and second hash agree as well, at every level. Partial aggregation
merges copies before they move, so a text with very many copies costs one row per task.

Defined cases: a null text counts as empty; a null doc_id loses against any other and stays
only if its whole group has none; repeated rows count as members of the group; an empty
table gives an empty result; further columns are ignored here and kept by ``drop_copies``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import ROW_KEY, ascii_lower, staged, with_row_key

KEY = ["digest", "length", "check"]
FAN_IN = 8


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, digest, length, check, run: what the merge needs of each document."""
    text = ascii_lower(F.coalesce("text", F.lit("")))
    return docs.select(
        "doc_id",
        F.unhex(F.sha2(text, 256)).alias("digest"),
        F.octet_length(text).cast("bigint").alias("length"),
        F.xxhash64(text).alias("check"),
        F.spark_partition_id().alias("run"),
    )


def merge_runs(rows: DataFrame, keep: str = "largest", fan_in: int = FAN_IN) -> DataFrame:
    """One row per distinct text: KEY, keep_id, group_size."""
    best = F.max if keep == "largest" else F.min
    runs = rows.groupBy("run", *KEY).agg(best("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    width = (rows.agg(F.max("run")).first()[0] or 0) + 1
    while True:
        width = -(-width // fan_in)
        runs = (
            runs.withColumn("run", F.floor(F.col("run") / fan_in).cast("int"))
            .groupBy("run", *KEY)
            .agg(best("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
            .sortWithinPartitions("run", *KEY)
        )
        if width == 1:
            return runs.drop("run")
        runs = staged(runs, "digest-runs")


def exact_duplicates(docs: DataFrame, keep: str = "largest", fan_in: int = FAN_IN) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    rows = staged(digests(docs), "digests")
    groups = staged(merge_runs(rows, keep, fan_in), "digest-groups")
    a, b = rows.alias("a"), groups.alias("b")
    same = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in KEY]
    return a.join(b, same).select(
        "a.doc_id",
        "b.keep_id",
        "b.group_size",
        F.col("a.doc_id").eqNullSafe(F.col("b.keep_id")).alias("kept"),
        F.lower(F.hex("a.digest")).alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, keep: str = "largest", fan_in: int = FAN_IN) -> DataFrame:
    """The documents with one row left of each group of equal texts, all columns as they were.

    The row itself is chosen, not its doc_id, which other rows may share: by doc_id, then by
    the digests of its text and its columns.
    """
    marked = with_row_key(docs)
    known = F.col("doc_id").isNotNull() if keep == "largest" else F.col("doc_id").isNull()
    rows = digests(marked.withColumn("doc_id", F.struct(known.alias("known"), "doc_id", *ROW_KEY)))
    rows = staged(rows, "digests")
    picks = merge_runs(rows, keep, fan_in).select(*[F.col(f"keep_id.{k}").alias(k) for k in ROW_KEY], "group_size")
    picks = staged(picks, "kept-rows")
    left = marked.join(picks.select(*ROW_KEY), ROW_KEY, "left_semi")
    several = rows.select("doc_id.*").join(picks.where("group_size > 1"), ROW_KEY, "left_semi")
    if not several.groupBy(*ROW_KEY).agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        left = left.dropDuplicates(ROW_KEY)  # rows alike in every column
    return left.select(*[F.col(f"`{c}`") for c in docs.columns])
