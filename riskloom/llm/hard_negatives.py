"""Hard negatives by a secondary sort of scored pairs.

Anchors are taken in blocks of bounded bytes. Per block all rows are scored against it, in
slices, by matrix products, and a pair of anchor and row is packed into one key: anchor,
descending score, kind, id. ``repartitionAndSortWithinPartitions`` deals the keys by anchor and
sorts them; an iterator then walks each partition once: a positive opens a window, the next
rows of another label fall into all open windows, and a window closes after ``per_positive``
rows or below ``low`` hundredths of its score. It holds the open windows of one anchor only.

So that pairs stay in proportion to the anchors, tasks hand on what can still be among the
results: first positives and negatives of an eighth of the rows are found, which gives every
window a row that the last result cannot lie behind; then all rows are scored, and only pairs at
or before that row leave a task, the first few per window and task. Ties end at the id, so
copies of one vector do not add pairs. All rows are scored; the eighth is a bound and no sample.

Scores are whole numbers and exact: products of 64-bit floats where the sums stay below 2^53,
else of Python integers, held to the range of a long in the result.

Defined cases: rows with a null label, a null vector, or a null or non-finite component take no
part; a shorter vector counts as padded with zeros, an empty one scores 0; repeated rows are one,
and rows that share a vec_id but not the vector are anchors of their own, each other's neither
positives nor negatives; of rows with the same id, label and score an anchor meets one; rows
without vec_id are no anchors and come last among ties; an anchor without another row of its
label, or whose positives score below 0, has no results; an empty table gives an empty result;
other columns are ignored, whatever their names.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm.common import arrow_rows, shuffle_width, staged
from riskloom.session import work_folder

SCALE = 256
ANCHOR_BYTES = 16 << 20  # of the vectors of one block of anchors
CELLS = 1 << 20  # scores in hand at a time
EIGHTH = 8
LONG = (1 << 63) - 1
NO_ID = LONG  # stands for a null id, and comes last
KEY = struct.Struct(">QQBQ")  # anchor, descending score, kind, id: sorts as bytes
POSITIVE, NEGATIVE = 0, 1
MINED = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"
_PAIRS = pa.schema([("anchor", pa.int64()), ("score", pa.int64()), ("id", pa.int64())])


def pack_key(anchor: int, score: int, kind: int, row_id: int) -> bytes:
    return KEY.pack(anchor, LONG - score, kind, row_id + LONG + 1)


def unpack_key(key: bytes) -> tuple[int, int, int, int]:
    anchor, score, kind, row_id = KEY.unpack(key)
    return anchor, LONG - score, kind, row_id - LONG - 1


# --- rows ------------------------------------------------------------------------
def scaled(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id, label and vector (whole numbers) of the rows that take part."""
    v = F.col("vector")
    whole = F.transform(v, lambda x: F.floor(x.cast("double") * scale))
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return vectors.where(F.col("label").isNotNull() & v.isNotNull() & ~F.coalesce(bad, F.lit(True))).select(
        F.coalesce(F.col("vec_id").cast("bigint"), F.lit(NO_ID)).alias("vec_id"),
        F.col("label").cast("bigint").alias("label"),
        whole.alias("vector"),
    )


def _matrix(column: pa.ListArray) -> np.ndarray:
    """The vectors as rows, shorter ones padded with zeros."""
    flat = np.asarray(column.flatten())
    sizes = np.asarray(column.value_lengths())
    out = np.zeros((len(sizes), int(sizes.max(initial=0))), np.int64)
    out[np.arange(out.shape[1]) < sizes[:, None]] = flat
    return out


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of a with those of b."""
    d = min(a.shape[1], b.shape[1])
    a, b = a[:, :d], b[:, :d]
    largest = int(np.abs(a.astype(np.float64)).max(initial=0)) * int(np.abs(b.astype(np.float64)).max(initial=0)) * d
    if largest < 1 << 52:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return np.clip(a.astype(object) @ b.astype(object).T, -LONG, LONG).astype(np.int64) if d else np.zeros((len(a), len(b)), np.int64)


# --- scoring a block of anchors -----------------------------------------------------
@dataclass
class Windows:
    """What is wanted of each anchor: rows of its label or of others, scores of low to high.

    Nothing behind (``bound_score``, ``bound_id``) in the order of results can matter.
    """

    anchor: np.ndarray  # index into the block
    same_label: bool
    low: np.ndarray
    high: np.ndarray
    bound_score: np.ndarray
    bound_id: np.ndarray


def _first(window: np.ndarray, score: np.ndarray, row_id: np.ndarray, keep: int) -> np.ndarray:
    """Indexes of the first ``keep`` distinct pairs of each window, by falling score and rising id."""
    order = np.lexsort((row_id, -score, window))
    pairs = np.stack([window[order], score[order], row_id[order]])
    order = order[np.concatenate([[True], (pairs[:, 1:] != pairs[:, :-1]).any(0)])]
    w = window[order]
    return order[np.arange(len(w)) - np.searchsorted(w, w) < keep]


def _score_block(block: dict, windows: Windows, keep: int):
    """Keys of the block's anchors and a task's rows, the first of each window."""
    kind = POSITIVE if windows.same_label else NEGATIVE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, labels, vectors = block["vec_id"], block["label"], block["vector"]
        at_score, at_id = windows.bound_score.copy(), windows.bound_id.copy()
        held = [np.zeros(0, np.int64)] * 3  # window, score, id
        for batch in batches:
            row_ids, row_labels = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            row_vectors = _matrix(batch.column(2))
            step = max(1, CELLS // max(1, len(windows.anchor)))
            for a in range(0, len(row_ids), step):
                i, label = row_ids[a : a + step, None], row_labels[a : a + step, None]
                score = _products(row_vectors[a : a + step], vectors)[:, windows.anchor]
                fits = (score >= windows.low) & (score <= windows.high)
                fits &= (score > at_score) | ((score == at_score) & (i <= at_id))
                fits &= (label == labels[windows.anchor]) == windows.same_label
                fits &= i != ids[windows.anchor]
                r, w = np.nonzero(fits)
                if not len(r):
                    continue
                held = [np.concatenate(x) for x in zip(held, (w, score[r, w], i[r, 0]), strict=True)]
                first = _first(*held, keep)
                held = [x[first] for x in held]
                # a full window takes nothing behind its last pair any more
                last = np.flatnonzero(np.diff(held[0], append=-1))
                full = last[np.bincount(held[0])[held[0][last]] >= keep]
                at_score[held[0][full]], at_id[held[0][full]] = held[1][full], held[2][full]
        found = {*zip(windows.anchor[held[0]].tolist(), held[1].tolist(), held[2].tolist(), strict=True)}
        yield pa.RecordBatch.from_arrays([pa.array([pack_key(a, s, kind, i) for a, s, i in found], pa.binary())], names=["key"])

    return run


# --- walking the sorted keys ----------------------------------------------------------
def _by_anchor(keys, width: int):
    """An RDD of keys dealt by anchor and sorted."""
    return keys.map(lambda k: (k, None)).repartitionAndSortWithinPartitions(width, lambda k: int.from_bytes(k[:8]) % width).keys()


def first_positives(keys: Iterator[bytes], positives: int) -> Iterator[tuple]:
    """anchor, score, id of the first positives of each anchor, from sorted keys."""
    before, at, n = None, None, 0
    for key in keys:
        if key == before:
            continue
        before, (anchor, score, _, row_id) = key, unpack_key(key)
        at, n = (at, n + 1) if anchor == at else (anchor, 1)
        if n <= positives:
            yield anchor, score, row_id


def mined_windows(keys: Iterator[bytes], per_positive: int, low: int) -> Iterator[tuple]:
    """anchor, positive's id, rank, negative's id, both scores, from sorted keys of both kinds."""
    before, at, windows = None, None, []
    for key in keys:
        if key == before:
            continue
        before, (anchor, score, kind, row_id) = key, unpack_key(key)
        if anchor != at:
            at, windows = anchor, []
        if kind == POSITIVE:
            windows.append([row_id, score, 0])
            continue
        windows = [w for w in windows if w[2] < per_positive and low * w[1] <= 100 * score]
        for w in windows:
            w[2] += 1
            yield anchor, w[0], w[2], row_id, w[1], score


# --- a block of anchors ------------------------------------------------------------
class _Block:
    def __init__(self, rows: DataFrame, anchors: list, positives: int, per_positive: int, low: int):
        self.rows, self.spark = rows, rows.sparkSession
        self.positives, self.per_positive, self.low = positives, per_positive, low
        vectors = pa.array([a["vector"] for a in anchors], pa.list_(pa.int64()))
        self.block = {
            "vec_id": np.array([a["vec_id"] for a in anchors], np.int64),
            "label": np.array([a["label"] for a in anchors], np.int64),
            "vector": _matrix(vectors),
        }
        self.width = shuffle_width(self.spark)

    def keys(self, rows: DataFrame, windows: Windows, keep: int):
        return rows.select("vec_id", "label", "vector").mapInArrow(_score_block(self.block, windows, keep), "key binary").rdd.map(lambda r: bytes(r[0]))

    def first(self, rows: DataFrame, windows: Windows) -> list[tuple]:
        """The first positives of each anchor: a few per anchor of the block."""
        n = self.positives
        return _by_anchor(self.keys(rows, windows, n), self.width).mapPartitions(lambda keys: first_positives(keys, n)).collect()

    def mined(self, rows: DataFrame, windows: Windows, found: list[tuple]):
        per, low = self.per_positive, self.low
        opening = self.spark.sparkContext.parallelize([pack_key(a, s, POSITIVE, i) for a, s, i in found])
        keys = _by_anchor(self.keys(rows, windows, per).union(opening), self.width)
        return keys.mapPartitions(lambda keys: mined_windows(keys, per, low))

    def all_windows(self) -> Windows:
        n = len(self.block["vec_id"])
        return Windows(np.arange(n), True, np.full(n, -LONG), np.full(n, LONG), np.full(n, -LONG), np.full(n, LONG))

    def negative_windows(self, found: list[tuple]) -> Windows:
        a, score, _ = np.array(found, np.int64).reshape(-1, 3).T
        low = np.array([-(-self.low * s // 100) for s in score.tolist()], np.int64)
        return Windows(a, False, low, score, np.full(len(a), -LONG), np.full(len(a), LONG))

    def run(self):
        """An RDD of the block's results."""
        part = self.rows.where(F.pmod(F.xxhash64("vec_id"), F.lit(EIGHTH)) == 0)
        wide = self.all_windows()
        some: dict[int, list] = {}
        for a, s, i in self.first(part, wide):
            some.setdefault(a, []).append((-s, i))
        for a, found in some.items():
            if len(found) == self.positives:
                s, wide.bound_id[a] = max(found)
                wide.bound_score[a] = -s
        found = sorted(self.first(self.rows, wide))
        found = [f for f in found if f[1] >= 0]  # below 0 no score is within the window
        windows = self.negative_windows(found)
        place = {(a, i, s): w for w, (a, s, i) in enumerate(found)}
        per = self.per_positive
        for a, p, _, i, ps, s in self.mined(part, windows, found).filter(lambda r: r[2] == per).collect():
            w = place[a, p, ps]
            windows.bound_score[w], windows.bound_id[w] = s, i
        return self.mined(self.rows, windows, found)


def hard_negatives(
    vectors: DataFrame, anchor: Column, *, positives: int = 5, per_positive: int = 5, low: int = 80, anchor_bytes: int = ANCHOR_BYTES
) -> DataFrame:
    """One row per anchor, positive and rank: ``MINED``.

    ``vectors`` has vec_id, label and vector; ``anchor`` tells which of its rows are anchors.
    """
    spark: SparkSession = vectors.sparkSession
    arrow_rows(spark)
    marked = scaled(vectors.withColumn("vec_id", F.col("vec_id").cast("bigint"))).withColumn("anchor", F.coalesce(anchor, F.lit(False)))
    # scoring is what takes time, so the rows are spread however the files lie
    rows = staged(marked.repartition(shuffle_width(spark)), "scaled-vectors")
    anchors = staged(rows.where(F.col("anchor") & (F.col("vec_id") != NO_ID)).select("vec_id", "label", "vector").distinct(), "anchors")
    size = anchors.agg(F.sum(8 * F.size("vector") + 16)).first()[0] or 0
    blocks = -(-size // anchor_bytes)
    folder = work_folder(spark, "hard-negatives")
    for b in range(blocks):
        mine = anchors.where(F.pmod(F.xxhash64("vec_id", "label", "vector"), F.lit(blocks)) == b).collect()  # about anchor_bytes
        if mine:
            block = _Block(rows, mine, positives, per_positive, low)
            ids = block.block["vec_id"].tolist()
            found = block.run().map(lambda r, ids=ids: (ids[r[0]], None if r[1] == NO_ID else r[1], r[2], None if r[3] == NO_ID else r[3], *r[4:]))
            spark.createDataFrame(found, MINED).write.parquet(f"{folder}/block={b}")
    if not blocks:
        return spark.createDataFrame([], MINED)
    return spark.read.schema(MINED).parquet(*[f"{folder}/block={b}" for b in range(blocks)])
