"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1, drawn from its code point. A three-gram binds
its letters by multiplication after permuting the first twice and the second once, so order
counts. A text bundles the vectors of its three-grams, as often as each occurs; a language's
prototype bundles the texts of the rows learned from. A text gets the language whose
prototype has the largest cosine with it.

Runs of characters that are not letters count as one gap, which is a symbol like a letter.
Prototypes are learned on a bounded sample, ``TRAIN_ROWS`` rows chosen by a hash of doc_id;
each language's texts add up as unit vectors, so long texts do not dominate. What reaches
the driver is one vector per language.

Defined cases: a text that is null or has no letter is ``und`` with score 0; so is every text
if nothing could be learned; ties go to the language first in order; a text shorter than a
three-gram is padded by gaps; the score is the cosine, 0 if negative; rows with a null doc_id
are predicted but not learned from; repeated rows are predicted as often as they come; an
empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import arrow_rows

DIMENSIONS = 1024
TRAIN_ROWS = 10_000
HELD_OUT = 2
KNOWN_GRAMS = 60_000  # vectors a task remembers before it starts anew
SLICE = 4096  # grams of a text bundled at a time


@cache
def _letter_table() -> np.ndarray:
    """Which of the code points are letters."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


@cache
def letter_vector(code: int) -> np.ndarray:
    bits = np.random.Generator(np.random.PCG64([code, 977])).integers(0, 2, DIMENSIONS, dtype=np.int8)
    return (2 * bits - 1).astype(np.float32)


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct three-grams (packed code points) and their counts; empty without letters."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    letters = _letter_table()[codes]
    if not letters.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    symbols = np.where(letters, codes, 0).astype(np.int64)
    symbols = np.r_[0, symbols, 0]
    symbols = symbols[np.r_[True, (symbols[1:] != 0) | (symbols[:-1] != 0)]]
    packed = (symbols[:-2] << 42) | (symbols[1:-1] << 21) | symbols[2:]
    return np.unique(packed, return_counts=True)


class GramVectors:
    """Vectors of the three-grams met so far, in the order of their packed code points."""

    def __init__(self) -> None:
        self._forget()

    def _forget(self) -> None:
        self.known = np.zeros(0, np.int64)
        self.rows = np.zeros(0, np.int64)
        self.vectors = np.zeros((1024, DIMENSIONS), np.float32)
        self.used = 0

    def bundle(self, packed: np.ndarray, counts: np.ndarray) -> np.ndarray:
        parts = [self._bundle(packed[i : i + SLICE], counts[i : i + SLICE]) for i in range(0, len(packed), SLICE)]
        return np.sum(parts, axis=0) if len(parts) > 1 else parts[0]

    def _bundle(self, packed: np.ndarray, counts: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.known, packed)
        here = at < len(self.known)
        here[here] = self.known[at[here]] == packed[here]
        if not here.all():
            self._learn(packed[~here])
            at = np.searchsorted(self.known, packed)
        out = counts.astype(np.float32) @ self.vectors[self.rows[at]]
        if self.used > KNOWN_GRAMS:
            self._forget()
        return out

    def _learn(self, packed: np.ndarray) -> None:
        while self.used + len(packed) > len(self.vectors):
            self.vectors = np.concatenate([self.vectors, np.zeros_like(self.vectors)])
        for i, p in enumerate(packed.tolist(), self.used):
            a, b, c = (letter_vector((p >> s) & 0x1FFFFF) for s in (42, 21, 0))
            self.vectors[i] = np.roll(a, 2) * np.roll(b, 1) * c
        known = np.r_[self.known, packed]
        rows = np.r_[self.rows, np.arange(self.used, self.used + len(packed))]
        order = np.argsort(known, kind="stable")
        self.known, self.rows, self.used = known[order], rows[order], self.used + len(packed)


def _prototype_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    vectors, sums = GramVectors(), {}
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            packed, counts = grams(text or "")
            if len(packed):
                v = vectors.bundle(packed, counts)
                sums[lang] = sums.get(lang, 0) + v.astype(float) / max(1e-9, float(np.linalg.norm(v)))
    langs = list(sums)
    yield pa.RecordBatch.from_arrays(
        [pa.array(langs, pa.string()), pa.array([sums[x] for x in langs], pa.list_(pa.float64()))], names=["lang", "vector"]
    )


def held_out(doc_id: Column) -> Column:
    """The rows kept from all learning: crc32 of the id's text leaves 2 when divided by 4."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(4)) == HELD_OUT, F.lit(False))


def learn(docs: DataFrame, rows: int = TRAIN_ROWS) -> dict[str, np.ndarray]:
    """Language prototypes of unit length, in order, from at most about ``rows`` documents."""
    known = docs.where("lang IS NOT NULL AND doc_id IS NOT NULL").where(~held_out(F.col("doc_id")))
    n = known.count()
    keep = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1 << 30)) < F.lit(int((1 << 30) * min(1.0, rows / max(1, n))))
    sample = known.where(keep).select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    sums = sample.mapInArrow(_prototype_sums, "lang string, vector array<double>")
    cells = sums.select("lang", F.posexplode("vector")).groupBy("lang", "pos").agg(F.sum("col").alias("x"))
    table = cells.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("pos", "x"))).alias("v")).select("lang", F.col("v.x").alias("v"))
    found = {r["lang"]: np.array(r["v"]) for r in table.orderBy("lang").collect()}
    return {k: (v / max(1e-9, float(np.linalg.norm(v)))).astype(np.float32) for k, v in found.items()}


def _predict(langs: list[str], prototypes: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors = GramVectors()
        for batch in batches:
            best, scores = [], []
            for text in batch.column(1).to_pylist():
                packed, counts = grams(text or "")
                if not len(packed) or not langs:
                    best.append("und")
                    scores.append(0.0)
                    continue
                v = vectors.bundle(packed, counts)
                cosines = prototypes @ v / max(1e-9, float(np.linalg.norm(v)))
                i = int(np.argmax(cosines))
                best.append(langs[i])
                scores.append(min(1.0, max(0.0, float(cosines[i]))))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(best, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"]
            )

    return run


def identify(docs: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score."""
    arrow_rows(docs.sparkSession)
    learned = learn(docs, rows)
    prototypes = np.array(list(learned.values())) if learned else np.zeros((0, DIMENSIONS), np.float32)
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = texts.mapInArrow(_predict(list(learned), prototypes), "doc_id bigint, lang_pred string, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
