"""A convolutional toxicity classifier, trained in numpy.

A word's embedding is the sum of the rows that the word and its beginnings hash to, so unseen forms of a stem
resemble it. Filters of several widths slide over the words, each keeps its maximum over the whole text, and a
linear layer turns the maxima into one number. One embedding dimension starts as the log odds of the hash in
toxic documents, the others small and random; all are trained. Thresholds are calibrated by the language that
the text itself suggests, and moved to a score of one half.
"""

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lynceus.llm.labelled import sample, sigmoid

#: Hash buckets, embedding dimensions, filter widths and filters of each; lengths of the beginnings hashed.
BUCKETS, DIM, WIDTHS, FILTERS, STEMS = 1 << 20, 12, (1, 2, 3), 8, (3, 4, 5, 6, 7)
#: Labelled documents of each class to fit on, at most (about); words kept in a worker's table.
PER_CLASS, MAX_TABLE = 3000, 300_000
WORD = re.compile(r"[^\W_]+")
#: Frequent function words, by which a text's language is guessed (fixed values).
FUNCTION_WORDS = {
    "en": "the of and to in is that for it was with as on be by at this",
    "de": "der die und das den von zu mit sich des auf für ist im dem nicht ein",
    "fr": "le les et des en un du une est que dans qui par pour au la ne",
    "es": "el los que y en las del se por con una para su al lo es un",
}
LANGUAGES = [*FUNCTION_WORDS, "other"]


def words(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def guess_language(counts: np.ndarray) -> int:
    """The index in LANGUAGES of the most function words; the last one if there are none."""
    return int(counts.argmax()) if counts.any() else len(LANGUAGES) - 1


def _hashes(word: str) -> list[int]:
    """Buckets of a word and its beginnings; those that it is too short for go to bucket 0, which stays zero."""
    keys = [word, *[f"^{word[:n]}" if len(word) > n else "" for n in STEMS]]
    return [zlib.crc32(k.encode()) % (BUCKETS - 1) + 1 if k else 0 for k in keys]


@dataclass
class ToxicityModel:
    """rows maps a hash bucket to its embedding; buckets that training has not seen are zero."""

    rows: dict[int, int]
    embedding: np.ndarray
    filters: list[np.ndarray]
    bias: np.ndarray
    dense: np.ndarray
    constant: float
    slope: float = 1.0
    thresholds: np.ndarray = field(default_factory=lambda: np.zeros(len(LANGUAGES)))

    def ids(self, word: str) -> list[int]:
        return [self.rows.get(h, 0) for h in _hashes(word)]

    def pooled(self, projected: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Maxima of all filters over a text, and where they are; projected has a row for each word."""
        best, at, k = [], [], 0
        for w in WIDTHS:
            n = len(projected) - w + 1
            if n <= 0:
                best.append(np.zeros(FILTERS))
                at.append(np.full(FILTERS, -1))
            else:
                out = projected[:n, k : k + FILTERS]
                for j in range(1, w):
                    out = out + projected[j : j + n, k + j * FILTERS : k + (j + 1) * FILTERS]
                i = out.argmax(0)
                best.append(out[i, np.arange(FILTERS)])
                at.append(i)
            k += w * FILTERS
        return np.concatenate(best), np.concatenate(at)

    def matrix(self) -> np.ndarray:
        """All filters' weights side by side: a word's embedding times this is what the word adds to each."""
        return np.concatenate([f.transpose(1, 0, 2).reshape(DIM, -1) for f in self.filters], axis=1)

    def logit(self, maxima: np.ndarray) -> np.ndarray:
        return np.maximum(maxima + self.bias, 0) @ self.dense + self.constant

    def score(self, logits: np.ndarray, languages: np.ndarray) -> np.ndarray:
        return sigmoid(self.slope * (logits - self.thresholds[languages]))


class Scorer:
    """Scores texts with a bounded table of the words met so far, each with what it adds to the filters."""

    def __init__(self, model: ToxicityModel):
        self.model, self.matrix = model, model.matrix().astype("float32")
        self.function = [{w: 1 for w in v.split()} for v in FUNCTION_WORDS.values()]
        self.clear()

    def clear(self) -> None:
        self.table: dict[str, int] = {}
        self.projected = np.zeros((1 << 12, self.matrix.shape[1]), "float32")
        self.language = np.zeros((1 << 12, len(FUNCTION_WORDS)), "float32")

    def _learn(self, new: list[str]) -> None:
        n = len(self.table)
        while n + len(new) > len(self.projected):
            self.projected = np.concatenate([self.projected, np.zeros_like(self.projected)])
            self.language = np.concatenate([self.language, np.zeros_like(self.language)])
        ids = np.array([self.model.ids(w) for w in new])
        self.projected[n : n + len(new)] = self.model.embedding[ids].sum(1) @ self.matrix
        for i, w in enumerate(new, n):
            self.table[w] = i
            self.language[i] = [f.get(w, 0) for f in self.function]

    def raw(self, text: str | None) -> tuple[float, int]:
        """The logit and the language; long texts go in parts that overlap by the widest filter."""
        every, seen, top, counts = words(text), 0, None, np.zeros(len(FUNCTION_WORDS))
        while top is None or seen < len(every):
            part = every[max(0, seen - max(WIDTHS) + 1) : seen + 50_000]
            if len(self.table) > MAX_TABLE:
                self.clear()
            if new := [w for w in dict.fromkeys(part) if w not in self.table]:
                self._learn(new)
            at = np.fromiter(map(self.table.__getitem__, part), "int64", len(part))
            counts += self.language[at].sum(0)
            maxima = self.model.pooled(self.projected[at])[0]
            top = maxima if top is None else np.maximum(top, maxima)
            seen += 50_000
        return float(self.model.logit(top)), guess_language(counts)


def _log_odds(docs: list[np.ndarray], y: np.ndarray, size: int) -> np.ndarray:
    df = np.zeros((2, size))
    for d, v in zip(docs, y, strict=True):
        df[int(v), np.unique(d)] += 1
    n = np.array([(y == 0).sum(), (y == 1).sum()])[:, None]
    rate = np.log((df + 0.5) / (n + 1))
    return np.where(df.sum(0) >= 2, np.clip(rate[1] - rate[0], -3, 4), 0)


def fit(rows: list[tuple[str, int]], epochs: int = 6, seed: int = 0) -> ToxicityModel:
    """Fits on (text, label) rows; a quarter of them calibrates slope and thresholds.

    With labels of one class or none, every text gets the smoothed share of label 1.
    """
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(rows))
    y = np.array([rows[i][1] for i in order], "float64")
    base = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    filters = [rng.normal(0, 0.15, (w, DIM, FILTERS)) for w in WIDTHS]
    for f in filters:
        f[0, 0] = np.abs(f[0, 0]) + 0.5
    units = FILTERS * len(WIDTHS)
    cut = len(rows) * 3 // 4
    model = ToxicityModel({0: 0}, np.zeros((1, DIM)), filters, np.zeros(units), np.full(units, 0.0), base)
    if len(set(y[:cut])) < 2 or len(set(y[cut:])) < 2:
        return model
    vocabulary: dict[str, int] = {}
    texts = [np.array([vocabulary.setdefault(w, len(vocabulary)) for w in words(rows[i][0])], "int64") for i in order[:cut]]
    hashed = np.array([_hashes(w) for w in vocabulary]) if vocabulary else np.zeros((1, 1 + len(STEMS)), "int64")
    buckets, inverse = np.unique(np.append(hashed.ravel(), 0), return_inverse=True)
    ids = inverse[:-1].reshape(hashed.shape)
    seen = np.zeros(len(buckets))
    for d in texts:
        seen[np.unique(ids[d])] += 1
    keep = (seen >= 3) & (buckets != 0)  # rarer ones say nothing
    number = np.where(keep, np.cumsum(keep), 0)
    ids, buckets = number[ids], buckets[keep]
    model.rows = {0: 0} | {int(b): i + 1 for i, b in enumerate(buckets)}
    e = rng.normal(0, 0.05, (len(buckets) + 1, DIM))
    e[:, 0] = _log_odds([np.unique(ids[d]) for d in texts], y[:cut], len(e))
    e[0] = 0
    model.embedding, model.dense, model.constant = e, np.full(units, 0.3), base - 3.0
    weight = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum())))
    state = {k: 1e-2 for k in ("dense", "bias", "constant")} | {"e": np.full(len(e), 1e-2), "f": [1e-2] * len(WIDTHS)}
    rate = 0.05
    for epoch in range(epochs):
        for batch in np.array_split(rng.permutation(cut), max(1, cut // 32)):
            grad = {"dense": np.zeros(units), "bias": np.zeros(units), "constant": 0.0, "f": [np.zeros_like(f) for f in model.filters]}
            at_e, of_e = [], []
            for b in batch:
                d = texts[b]
                x = model.embedding[ids[d]].sum(1) if len(d) else np.zeros((0, DIM))
                top, at = model.pooled(x @ model.matrix())
                act = np.maximum(top + model.bias, 0)
                delta = weight[b] * (sigmoid(act @ model.dense + model.constant) - y[b]) / len(batch)
                grad["dense"] += delta * act
                grad["constant"] += delta
                up = delta * model.dense * (act > 0)
                grad["bias"] += up
                for k, w in enumerate(WIDTHS):
                    for u in range(FILTERS):
                        i, g = at[k * FILTERS + u], up[k * FILTERS + u]
                        if i >= 0 and g:
                            grad["f"][k][:, :, u] += g * x[i : i + w]
                            for j in range(w):
                                at_e.append(ids[d[i + j]])
                                of_e.append(np.broadcast_to(g * model.filters[k][j, :, u], (ids.shape[1], DIM)))
            for name in ("dense", "bias", "constant"):
                state[name] = state[name] + grad[name] ** 2
                setattr(model, name, getattr(model, name) - rate * grad[name] / np.sqrt(state[name]))
            for k, g in enumerate(grad["f"]):
                state["f"][k] = state["f"][k] + g**2
                model.filters[k] = model.filters[k] - rate * g / np.sqrt(state["f"][k])
            if at_e:
                i, where = np.unique(np.concatenate(at_e), return_inverse=True)
                g = np.zeros((len(i), DIM))
                np.add.at(g, where, np.concatenate(of_e))
                state["e"][i] += (g**2).mean(1)
                model.embedding[i] -= rate * g / np.sqrt(state["e"][i])[:, None]
                model.embedding[0] = 0
    _calibrate(model, [rows[i][0] for i in order[cut:]], y[cut:], weight[cut:])
    return model


def _calibrate(model: ToxicityModel, texts: list[str], y: np.ndarray, weight: np.ndarray) -> None:
    """The threshold of each language is the one with the fewest errors, drawn to the common one where labels are few."""
    scorer = Scorer(model)
    raw = [scorer.raw(t) for t in texts]
    z, language = np.array([a for a, _ in raw]), np.array([b for _, b in raw])

    def best(mask: np.ndarray) -> float | None:
        """Halfway between neighbours, and in the middle of equally good places; errors on either class count."""
        s, v = z[mask], y[mask]
        if len(set(v)) < 2:
            return None
        s, v = s[o := np.argsort(s)], v[o]
        f1 = np.array([2 * v[k:].sum() / (v.sum() + len(v) - k) if len(v) > k else 0 for k in range(len(s) + 1)])
        ks = np.flatnonzero(f1 >= f1.max() - 1e-12)
        edges = np.concatenate([[s[0] - 1], (s[1:] + s[:-1]) / 2, [s[-1] + 1]])
        return float(edges[ks[len(ks) // 2]])

    common = best(np.ones(len(y), bool))
    common = 0.0 if common is None else common
    for k in range(len(LANGUAGES)):
        mask = language == k
        own, n = best(mask), (mask & (y == 1)).sum()
        model.thresholds[k] = common if own is None else (n * own + 10 * common) / (n + 10)
    gap = z - model.thresholds[language]
    model.slope = float(np.clip(2 / (np.abs(gap).mean() + 1e-9), 0.2, 5))


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> ToxicityModel:
    """A model from about per_class labelled documents of each class (labels: doc_id, toxic), the held-out fold left out.

    Rows with null ids or labels are no labels, null texts are empty, repeated rows count each, and empty tables
    give a model that scores everything alike.
    """
    return fit(sample(docs, labels, "toxic", per_class))


def score(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """docs with the columns toxicity_score and toxicity_predicted (1 from a score of one half on).

    docs needs text; whole texts are scored. Null texts are scored as the empty text. Columns of docs by
    those names are replaced.
    """
    docs = docs.drop("toxicity_score", "toxicity_predicted")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(shared.value)
        for texts in batches:
            raw = [scorer.raw(t) for t in texts]
            yield pd.Series(scorer.model.score(np.array([a for a, _ in raw]), np.array([b for _, b in raw], "int64")), dtype="float64")

    return docs.withColumn("toxicity_score", scored(F.col("text"))).withColumn("toxicity_predicted", (F.col("toxicity_score") >= 0.5).cast("int"))
