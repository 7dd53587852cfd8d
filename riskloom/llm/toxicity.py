"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

The labelled rows a model is fitted on are a bounded sample, ``TRAIN_ROWS`` rows chosen by a
hash of doc_id, cut by another hash into ``PARTS``. A lexicon holds words whose share of toxic
documents stands out, each with its log odds; a row that is learned from sees a lexicon made
without its part, so no word counts for it because of its own label. On all parts but the
last ``CALIBRATE``, trees are boosted over lexicon densities, closeness of lexicon words to the second
person, capitals, punctuation and obfuscation. On those, isotonic regression maps margins
to probabilities.
Every document of the table is then scored on its whole text; text is the only input.

Defined cases: a null text counts as empty and is scored like one; rows without a label, or
whose doc_id is null, are not learned from; without any row of both labels every score is
the share of label 1 among the rows learned from (0 without rows); repeated rows are scored
as often as they come; an empty table gives an empty result; a doc_id with several labels is
learned from with each of them; other columns are ignored, or kept by ``drop_toxic``, but names
that begin with ``__llm_`` are taken.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import arrow_rows, staged

TRAIN_ROWS = 20_000
LEXICON = 400
THRESHOLD = 0.3
STRONG = 4.0  # log odds
SURE = 2.5  # log odds in standard errors
TREES, DEPTH = 20, 3
PARTS, CALIBRATE = 5, 2
HELD_OUT = 2

_TOKEN = re.compile(r"[^\W\d_]+")
# from the first letter of a run only, so that unbroken text takes linear time
_DISGUISED = re.compile(r"(?<![^\W\d_])[^\W\d_]+(?:[0-9@$!*#]+[^\W\d_]+)+")
_SHOUTED = re.compile(r"\b[A-Z]{3,}\b")
_PLAIN = str.maketrans("013457@$!#*", "oieastasihu")
# Second-person words of the four languages: fixed values.
YOU = frozenset("you your yours yourself u tu te toi vous votre vos usted ustedes tus su du dich dir dein deine ihr euch sie".split())
_UPPER = np.arange(ord("A"), ord("Z") + 1)
_PUNCT = np.array([b for b in range(0x21, 0x7F) if not chr(b).isalnum()])
NAMES = (
    "strong_density", "weak_density", "weight_density", "strong_count", "weak_count", "heaviest", "weight_log",
    "near_you", "nearest_you", "you_density", "capitals", "shouted", "punctuation", "exclaims", "questions", "digits",
    "disguised", "disguised_hits", "non_ascii", "words_log",
)


def held_out(doc_id: Column) -> Column:
    """The rows kept from all learning: crc32 of the id's text leaves 2 when divided by 4."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(4)) == HELD_OUT, F.lit(False))


def _nearest(places: np.ndarray, others: np.ndarray) -> list[int]:
    """How far the nearest of the others, which ascend, is from each place."""
    after = np.searchsorted(others, places)
    right = np.abs(others[np.minimum(after, len(others) - 1)] - places)
    return np.minimum(right, np.abs(others[np.maximum(after - 1, 0)] - places)).tolist()


def features(text: str, lexicon: dict[str, float]) -> list[float]:
    lower = text.lower()
    words = _TOKEN.findall(lower)
    n = max(1, len(words))
    hits = [(i, lexicon[w]) for i, w in enumerate(words) if w in lexicon]
    strong = [i for i, x in hits if x >= STRONG]
    you = [i for i, w in enumerate(words) if w in YOU] if strong else []
    gaps = _nearest(np.array(strong), np.array(you)) if you else []
    raw = text.encode("utf-8", "replace")
    seen = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    size = max(1, len(raw))
    odd = _DISGUISED.findall(lower)
    odd_hits = sum(lexicon.get(w.translate(_PLAIN), 0.0) >= STRONG for w in odd)
    weight = sum(x for _, x in hits)
    return [
        len(strong) / n, (len(hits) - len(strong)) / n, weight / n, float(len(strong)), float(len(hits) - len(strong)),
        max((x for _, x in hits), default=0.0), math.log1p(max(0.0, weight)),
        sum(g <= 5 for g in gaps) / n, 1.0 / (1 + min(gaps)) if gaps else 0.0, len(you) / n,
        seen[_UPPER].sum() / size, len(_SHOUTED.findall(text)) / n, seen[_PUNCT].sum() / size,
        seen[ord("!")] / size, seen[ord("?")] / size, seen[0x30:0x3A].sum() / size,
        len(odd) / n, float(odd_hits), seen[128:].sum() / size, math.log1p(len(words)),
    ]


def feature_column(text: Column, lexicon: dict[str, float]) -> Column:
    @F.pandas_udf("array<double>")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([np.array(features(t or "", lexicon), float) for t in texts])

    return array_to_vector(of(text.cast("string")))


@dataclass
class ToxicityModel:
    lexicon: dict[str, float]
    trees: GBTClassificationModel | None
    calibration: IsotonicRegressionModel | None
    prior: float

    def score(self, docs: DataFrame) -> DataFrame:
        """The documents with one more column, ``__llm_score``."""
        if self.trees is None:
            return docs.withColumn("__llm_score", F.lit(self.prior))
        made = docs.withColumn("__llm_features", feature_column(F.col("text"), self.lexicon))
        margin = self.trees.transform(made).withColumn("__llm_margin", vector_to_array("__llm_probability")[1])
        scored = self.calibration.transform(margin)
        return scored.select(*[f"`{c}`" for c in docs.columns], F.least(F.greatest("__llm_score", F.lit(0.0)), F.lit(1.0)).alias("__llm_score"))


def learned_lexicons(rows: DataFrame, size: int = LEXICON) -> list[dict[str, float]]:
    """Words that stand out in toxic rows (text, label, part), with their log odds; at most ``size``.

    The first lexicon is from all rows, the others each leave out one part.
    """
    words = rows.select("label", "part", F.explode(F.array_distinct(F.split(F.lower("text"), "[^\\p{L}]+"))).alias("word")).where("word <> ''")
    without = [F.lit(True), *[F.col("part") != p for p in range(PARTS)]]
    sums = [x for i, w in enumerate(without) for x in (F.sum(F.when(w, F.col("label")).otherwise(0.0)).alias(f"a{i}"), F.count(F.when(w, 1)).alias(f"n{i}"))]
    counts = staged(words.groupBy("word").agg(*sums).where("a0 >= 2"), "word-counts")
    totals = rows.agg(*sums).first()
    out = []
    for i in range(len(without)):
        toxic, total = totals[f"a{i}"], totals[f"n{i}"]
        n1, n = F.col(f"a{i}"), F.col(f"n{i}")
        a, b = n1 + 0.5, n - n1 + 0.5
        odds = F.log(a / (F.lit(float(toxic)) - n1 + 0.5)) - F.log(b / (F.lit(float(total - toxic)) - n + n1 + 0.5))
        best = (
            counts.where(n1 >= max(3.0, 0.005 * toxic))
            .select("word", odds.alias("odds"), (odds / F.sqrt(1 / a + 1 / b)).alias("sure"))
            .where(F.col("sure") > SURE)
            .orderBy(F.desc("sure"), "word")
            .limit(size)
        )
        out.append({w: o for w, o, _ in best.collect()})
    return out


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> ToxicityModel:
    """A model from at most about ``rows`` of the labelled documents that are not held out."""
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(~held_out(F.col("doc_id")))
    n = known.count()
    keep = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(1 << 30)) < F.lit(int((1 << 30) * min(1.0, rows / max(1, n))))
    chosen = known.where(keep).select(F.col("doc_id").alias("id"), F.col("toxic").cast("double").alias("label")).distinct()
    # about ``rows`` pairs of numbers: a bound that does not grow with the data
    d, c = docs.alias("d"), F.broadcast(chosen).alias("c")
    sample = d.join(c, F.col("d.doc_id") == F.col("c.id")).select(
        F.coalesce(F.col("d.text").cast("string"), F.lit("")).alias("text"), "c.label", F.pmod(F.xxhash64("c.id", F.lit(2)), F.lit(PARTS)).alias("part")
    )
    sample = staged(sample, "toxicity-sample")
    total, toxic = sample.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0.0))).first()
    prior = toxic / total if total else 0.0
    if not 0 < toxic < total:
        return ToxicityModel({}, None, None, prior)
    lexicon, *others = learned_lexicons(sample)
    made = [
        sample.where(F.col("part") == p).select("label", "part", feature_column(F.col("text"), words).alias("__llm_features"))
        for p, words in enumerate(others)
    ]
    ready = staged(reduce(DataFrame.unionByName, made).repartition(4), "toxicity-features")
    grow, check = ready.where(F.col("part") < PARTS - CALIBRATE), ready.where(F.col("part") >= PARTS - CALIBRATE)
    if grow.select("label").distinct().count() < 2 or check.isEmpty():
        grow = check = ready
    trees = GBTClassifier(
        featuresCol="__llm_features", labelCol="label", predictionCol="__llm_class", maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, seed=7
    )
    trees = trees.setProbabilityCol("__llm_probability").setRawPredictionCol("__llm_raw").fit(grow)
    margins = trees.transform(check).select("label", vector_to_array("__llm_probability")[1].alias("__llm_margin"))
    calibration = IsotonicRegression(featuresCol="__llm_margin", labelCol="label", predictionCol="__llm_score").fit(margins)
    return ToxicityModel(lexicon, trees, calibration, prior)


def toxicity(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    arrow_rows(docs.sparkSession)
    scored = fit(docs, labels, rows).score(docs.select("doc_id", "text"))
    return scored.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        F.col("__llm_score").alias("score"),
        (F.col("__llm_score") >= threshold).cast("int").alias("predicted"),
    )


def drop_toxic(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """The documents scored below the threshold, all columns as they were."""
    arrow_rows(docs.sparkSession)
    scored = fit(docs, labels, rows).score(docs)
    return scored.where(F.col("__llm_score") < threshold).drop("__llm_score")
