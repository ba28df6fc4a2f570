"""A quality classifier by compression.

Two dictionaries of raw content are cut from good and from bad labelled documents. A text is compressed piece
by piece with each; how much smaller the one makes it than the other, relative to both, says which it
resembles. That difference, its extremes over the pieces, and how far the text compresses at all become a
score through a logistic regression on labelled documents that the dictionaries have not seen.
"""

import random
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lynceus.llm.labelled import held_out, logistic, sample, sigmoid

#: Bytes of a dictionary, of the excerpts it is made of, and of the pieces compressed; the compression level.
DICTIONARY, EXCERPT, PIECE, LEVEL = 400_000, 250, 1500, 6
#: Labelled documents of each class to fit on, at most (about).
PER_CLASS = 3000
THRESHOLD = 0.3


@dataclass
class QualityModel:
    """Dictionaries and calibration; a model without dictionaries scores everything alike."""

    good: bytes
    bad: bytes
    centre: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    def compressors(self):
        import zstandard

        out = []
        for content in (self.good, self.bad):
            d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            out.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=d))
        return out

    def scores(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(np.c_[(x - self.centre) / self.scale, np.ones(len(x))] @ self.weights)


def features(text: str, good, bad) -> list[float]:
    """The normalised difference over all pieces, its least and greatest value, log length, and the sizes per byte."""
    data = text.encode()
    sizes = [(len(good.compress(p)), len(bad.compress(p))) for k in range(0, max(1, len(data)), PIECE) for p in [data[k : k + PIECE]]]
    g, b = sum(x for x, _ in sizes), sum(x for _, x in sizes)
    each = [(y - x) / (x + y) for x, y in sizes]
    return [(b - g) / (b + g), min(each), max(each), float(np.log1p(len(data))), g / (len(data) + 1), b / (len(data) + 1)]


def _dictionary(texts: list[str], rng: random.Random) -> bytes:
    """Excerpts of all texts in turn, until the dictionary is full or no text has anything new."""
    out, n, data = [], 0, [t.encode() for t in texts]
    turns = 1 + DICTIONARY // max(1, sum(min(len(x), EXCERPT) for x in data))
    for x in data * turns:
        start = rng.randrange(max(1, len(x) - EXCERPT))
        out.append(x[start : start + EXCERPT])
        n += len(out[-1])
        if n >= DICTIONARY:
            break
    return b"".join(out)[:DICTIONARY]


def fit(rows: list[tuple[str, int]], seed: int = 0) -> QualityModel:
    """Fits on (text, label) rows: three fifths make the dictionaries and the others the calibration.

    With labels of one class or none, every text gets the smoothed share of label 1.
    """
    rng = random.Random(seed)
    rows = rows[:]
    rng.shuffle(rows)
    cut = len(rows) * 3 // 5
    makes, rest = rows[:cut], rows[cut:]
    y = np.array([v for _, v in rest], "float64")
    base = float(np.log((sum(v for _, v in rows) + 1) / (len(rows) - sum(v for _, v in rows) + 1)))
    model = QualityModel(b"good " * 8, b"bad " * 8, np.zeros(6), np.ones(6), np.array([0.0] * 6 + [base]))
    if len({v for _, v in makes}) < 2 or len(set(y)) < 2:
        return model
    model.good, model.bad = (_dictionary([t for t, v in makes if v == c], rng) for c in (1, 0))
    if min(len(model.good), len(model.bad)) < 8:
        return model
    good, bad = model.compressors()
    x = np.array([features(t, good, bad) for t, _ in rest])
    model.centre, model.scale = x.mean(0), x.std(0) + 1e-9
    model.weights = logistic((x - model.centre) / model.scale, y)
    return model


def prior_corrected(model: QualityModel, drawn: list[tuple[str, int]], labels: DataFrame, label: str) -> QualityModel:
    """Moves the constant from the classes' shares in the draw to those among all labels outside the held-out fold."""
    n = dict(labels.where(F.col(label).isin(0, 1) & ~held_out(F.col("doc_id"))).groupBy(label).count().collect())
    d = [sum(v == c for _, v in drawn) for c in (0, 1)]
    if all(d) and n.get(0) and n.get(1):
        model.weights[-1] += np.log(n[1] / n[0]) - np.log(d[1] / d[0])
    return model


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> QualityModel:
    """A model from about per_class labelled documents of each class (labels: doc_id, quality), the held-out fold left out.

    Rows with null ids or labels are no labels, null texts are empty, repeated rows count each, and empty tables
    give a model that scores everything alike.
    """
    drawn = sample(docs, labels, "quality", per_class)
    return prior_corrected(fit(drawn), drawn, labels, "quality")


def score(docs: DataFrame, model: QualityModel, threshold: float = THRESHOLD) -> DataFrame:
    """docs with the columns quality_score and quality_predicted (1 if the score reaches the threshold).

    docs needs text; whole texts are scored. Null and empty texts are scored as the empty text. Columns of
    docs by those names are replaced.
    """
    docs = docs.drop("quality_score", "quality_predicted")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model_ = shared.value
        good, bad = model_.compressors()
        for texts in batches:
            x = np.array([features(t or "", good, bad) for t in texts]).reshape(-1, 6)
            yield pd.Series(model_.scores(x))

    return docs.withColumn("quality_score", scored(F.col("text"))).withColumn("quality_predicted", (F.col("quality_score") >= threshold).cast("int"))


def accepted(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, with all their columns, that the classifier doesn't reject.

    Null and empty texts are scored as the empty text; rows that repeat stay or go together; an empty table gives an
    empty result.
    """
    model = train(docs, labels, per_class)
    whole = docs.select(F.struct("*").alias("row"), "text")  # columns of docs may have any name
    return score(whole, model, threshold).where("quality_predicted = 1").select("row.*")
