"""Importance resampling towards a target distribution, on hashed word n-grams.

1. Each text is scanned once for running CRCs (``prefix_crc``); the buckets of all its runs of
   1 to 3 words follow from them and are stored, two bytes a feature.
2. Features are counted by bucket: one vector of ``buckets`` counts per task, added up in a
   tree. The logarithm of target share over corpus share, smoothed, is the gain of a bucket.
3. A document's weight is the sum of its features' gains. With Gumbel noise from a hash of its
   doc_id, the documents of highest score are a draw without replacement in proportion to
   exp(weight). Places are read from ranges of the score order, without one task that sees all.

Defined cases: a null text has no words, no features and weight 0; a null doc_id is hashed as
an empty one and comes last among ties; rows that share doc_id and score are drawn in any order;
a text of any length is scanned whole, a megabyte at a time; without target texts, or without
documents, the counts are 0 and the smoothing alone decides; an empty table gives an empty
result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import arrow_rows, ranked, staged
from riskloom.llm.prefix_crc import feature_buckets

BUCKETS = 10_000
LEAST_WORDS = 20
SHARE = 5  # per hundred documents of at least that many words
SEED = 42
LONGEST = 3
GROUP = 1 << 22  # bytes of texts in hand at a time
_SCANNED = pa.schema([("doc_id", pa.int64()), ("found", pa.binary())])


def _groups(batch: pa.RecordBatch) -> Iterator[list[tuple]]:
    """doc_id and UTF-8 bytes, some ``GROUP`` bytes of texts at a time."""
    rows, size = [], 0
    for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
        raw = text.as_py() or b""
        rows.append((doc_id, raw))
        size += len(raw)
        if size >= GROUP:
            yield rows
            rows, size = [], 0
    if rows:
        yield rows


def scan(docs: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """doc_id and found: the buckets of the document's features, little-endian 16-bit numbers."""
    arrow_rows(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in _groups(batch):
                found = feature_buckets([raw for _, raw in rows], buckets, LONGEST)
                columns = [pa.array([d for d, _ in rows], pa.int64()), pa.array([f.astype("<u2").tobytes() for f in found], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, schema=_SCANNED)

    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    return texts.mapInArrow(run, "doc_id bigint, found binary")


def _numbers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All buckets of a batch, and where each document's end."""
    column = column.cast(pa.large_binary())
    ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    return data.view("<u2"), (ends - ends[0]) // 2


def bucket_counts(scanned: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Features per bucket over all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            total += np.bincount(_numbers(batch.column(0))[0], minlength=buckets)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["counts"])

    parts = scanned.select("found").mapInArrow(run, "counts binary").rdd.map(lambda r: np.frombuffer(r["counts"], np.int64))
    return parts.treeAggregate(np.zeros(buckets, np.int64), np.add, np.add, 3)


def bucket_gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln(target share / corpus share)) per bucket, one added to every count."""
    n, s_all, t_all = len(corpus), int(corpus.sum()), int(target.sum())
    pairs = zip(corpus.tolist(), target.tolist(), strict=True)
    return np.array([math.floor(1000 * math.log((t + 1) * (s_all + n) / ((s + 1) * (t_all + n)))) for s, t in pairs], np.int64)


def _weigh(gains: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, ends = _numbers(batch.column(1))
            total = np.concatenate([[0], np.cumsum(gains[found])])
            weight = total[ends[1:]] - total[ends[:-1]]
            columns = [batch.column(0), pa.array(np.diff(ends)), pa.array(weight)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_features", "weight"])

    return run


def gumbel(doc_id: Column, seed: int = SEED) -> Column:
    """floor(1000 G) with G from the standard Gumbel distribution, fixed by the hash of doc_id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    u = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0
    return F.floor(-1000 * F.ln(-F.ln(u)))


def resample(docs: DataFrame, target: DataFrame, *, share: int = SHARE, least_words: int = LEAST_WORDS, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """One row per document: doc_id, n_features, weight, score, rank (null where not drawn).

    ``target`` has a column ``text``.
    """
    scanned = staged(scan(docs, buckets), "features")
    aim = bucket_counts(scan(target.select(F.lit(None).alias("doc_id"), "text"), buckets), buckets)
    gains = bucket_gains(bucket_counts(scanned, buckets), aim)
    weighed = scanned.mapInArrow(_weigh(gains), "doc_id bigint, n_features bigint, weight bigint")
    scored = weighed.withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed))
    # n words make n + (n - 1) + (n - 2) features
    least = sum(max(0, least_words - i) for i in range(LONGEST))
    scored = staged(
        scored.withColumns({"long": F.col("n_features") >= least, "row": F.monotonically_increasing_id()}), "scored-documents"
    )
    drawn = scored.where("long").count() * share // 100
    # the row number lets ranges split equal rows
    order = [F.col("long").desc(), F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("row")]
    placed = ranked(scored, order, "score-order")
    rank = F.when(F.col("long") & (F.col("_rank") < drawn), F.col("_rank") + 1)
    return placed.select("doc_id", "n_features", "weight", "score", rank.alias("rank"))


def drawn_documents(docs: DataFrame, target: DataFrame, **options) -> DataFrame:
    """doc_id and rank of the drawn documents only."""
    return resample(docs, target, **options).where("rank IS NOT NULL").select("doc_id", "rank")
