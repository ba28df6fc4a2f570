"""Boosted trees grown by leaves, from histograms that tasks make.

Features become bins once. A scan of the rows adds up gradients by leaf, feature and bin in each task, one aggregate merges
them, and the driver, which holds nothing but histograms and trees, splits the leaf that gains most. A scan
tallies one side of every leaf that might be split next (the other side is the difference), so a tree takes about
as many scans as it is deep, not as it has leaves. Scores are kept beside the bins and brought up to date every few trees.

Histograms have (leaves, features, bins) cells whatever the number of rows, and a task emits each once.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lynceus.sources.folder import delete, kept

#: A feature has at most so many bins besides that of missing values, so a bin is one byte.
MAX_BINS = 254


@dataclass(frozen=True)
class Growth:
    """How trees grow. rows_share and features_share are drawn anew for each tree; patience counts trees without a better validation loss."""

    rounds: int = 400
    leaves: int = 15
    rate: float = 0.08
    least_rows: int = 50
    ridge: float = 1.0
    bins: int = MAX_BINS
    rows_share: float = 1.0
    features_share: float = 1.0
    patience: int = 50
    #: 1 for features along which the score must not fall, -1 for those along which it must not rise.
    monotone: dict[str, int] = field(default_factory=dict)
    seed: int = 0
    #: Trees between two rewritings of the rows' scores.
    refresh: int = 10


class Split:
    """The best split of a leaf: feature, last bin of the left side, where missing values go, gain, and both sides' values."""

    __slots__ = ("feature", "bin", "missing_left", "gain", "left", "right")

    def __init__(self, feature: int, bin: int, missing_left: bool, gain: float, left: float, right: float):
        self.feature, self.bin, self.missing_left, self.gain, self.left, self.right = feature, bin, missing_left, gain, left, right


class Grown:
    """A tree over bins. Nodes are numbered as they are made; a leaf has no split."""

    def __init__(self):
        self.splits: list[Split | None] = [None]
        self.children: list[tuple[int, int]] = [(0, 0)]
        self.values: list[float] = [0.0]

    def divide(self, node: int, split: Split) -> tuple[int, int]:
        n = len(self.splits)
        self.splits[node], self.children[node] = split, (n, n + 1)
        for v in (split.left, split.right):
            self.splits.append(None)
            self.children.append((0, 0))
            self.values.append(v)
        return n, n + 1

    def leaf_of(self, codes: np.ndarray) -> np.ndarray:
        at = np.zeros(len(codes), "int32")
        for node, s in enumerate(self.splits):  # children come after their parents
            if s is not None:
                here = np.flatnonzero(at == node)
                at[here] = np.where(goes_left(codes[here, s.feature], s), *self.children[node])
        return at


def goes_left(codes: np.ndarray, s: Split) -> np.ndarray:
    return np.where(codes == 255, s.missing_left, codes <= s.bin)


def best_split(hist: np.ndarray, n_edges: np.ndarray, signs: np.ndarray, allowed: np.ndarray, bounds: tuple[float, float], g: Growth) -> Split | None:
    """The split that lowers the second-order loss most; hist is (features, bins and missing last, [gradient, hessian, rows]).

    Sides' values are kept within bounds, and in order where a feature is monotone. Ties go to the first feature and
    bin, and missing values to the right where that gains as much. None if no split gains.
    """
    whole = hist.sum(1)[0]
    score = lambda p: _gain(p, bounds, g.ridge)
    parent = score(whole)[1]
    upto = hist[:, :-1].cumsum(1)
    missing = hist[:, -1:]
    ways = np.stack([upto, upto + missing])  # missing values to the right, and to the left
    rest = whole - ways
    a, ga = score(ways)
    b, gb = score(rest)
    gain = ga + gb - parent
    ok = (np.minimum(ways[..., 2], rest[..., 2]) >= g.least_rows) & (np.arange(upto.shape[1]) < n_edges[:, None]) & allowed[:, None] & ((b - a) * signs[:, None] >= 0)
    ok[1] &= missing[..., 2] > 0
    gain = np.where(ok, gain, -np.inf)
    right, left = gain.reshape(2, -1)
    top = max(right.max(), left.max())
    if not top > 1e-9:
        return None
    close = 1e-10 * max(1.0, top)  # sums of the same rows may differ in their last digits
    k = int(np.argmax(np.maximum(right, left) >= top - close))
    way = int(right[k] < top - close)
    f, e = divmod(k, upto.shape[1])
    return Split(f, e, bool(way), float(gain[way, f, e]), float(a[way, f, e]), float(b[way, f, e]))


def _gain(sums: np.ndarray, bounds: tuple[float, float], ridge: float):
    """(value, how far it lowers twice the loss) of a side from its sums of gradients and hessians."""
    p, q = sums[..., 0], sums[..., 1] + ridge
    v = np.clip(-p / np.where(q > 0, q, 1.0), *bounds)
    return v, -(2 * p * v + q * v * v)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -50, 50)))


def clean(c: str) -> Column:
    """A feature as double; null where it is NaN."""
    x = F.col(c).cast("double")
    return F.when(~F.isnan(x), x)


def bin_edges(df: DataFrame, features: list[str], bins: int) -> list[np.ndarray]:
    """Greatest values of all bins but the last, by feature: each value where there are few, otherwise quantiles."""
    at = [k / bins for k in range(1, bins)]
    counts = df.agg(*[F.approx_count_distinct(clean(c), 0.03).alias(f"c{i}") for i, c in enumerate(features)]).first()
    few = [n <= 0.9 * bins for n in counts]  # about so many: a set of them is bounded too
    every = lambda c: F.collect_set(clean(c))
    row = df.agg(*[(every(c) if few[i] else F.percentile_approx(clean(c), at, 20_000)).alias(f"q{i}") for i, c in enumerate(features)], *[F.max(clean(c)).alias(f"m{i}") for i, c in enumerate(features)]).first()
    n = len(features)
    edges = [np.unique([v for v in row[i] or [] if v < row[n + i]]).astype("float64") for i in range(n)]
    return [e if len(e) < bins else e[np.linspace(0, len(e) - 1, bins - 1).round().astype(int)] for e in edges]


ROWS = "codes binary, y double, w double, raw double, valid boolean, u long"


def _binned(df: DataFrame, features: list[str], edges: list[np.ndarray], label: str, weight: str | None, start: Column, valid: Column, key: list[str]) -> DataFrame:
    @F.pandas_udf("binary")
    def codes(vectors):
        import pandas as pd

        if not len(vectors):
            return pd.Series([], dtype=object)
        x = np.stack(vectors.to_list()).astype("float64")
        out = np.empty(x.shape, "uint8")
        for i, e in enumerate(edges):
            out[:, i] = np.where(np.isnan(x[:, i]), 255, np.searchsorted(e, x[:, i], "left"))
        return pd.Series([r.tobytes() for r in out])

    nan = F.lit(float("nan"))
    x = F.array(*[F.coalesce(clean(c), nan) for c in features])
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    return df.select(codes(x).alias("codes"), F.col(label).cast("double").alias("y"), w.alias("w"), start.cast("double").alias("raw"), valid.cast("boolean").alias("valid"), F.xxhash64(*(key or features)).alias("u"))


def _arrays(batch: pa.RecordBatch, n: int) -> tuple[np.ndarray, ...]:
    codes = np.frombuffer(b"".join(batch["codes"].to_pylist()), "uint8").reshape(-1, n)
    y, w, raw, u = (batch[c].to_numpy(zero_copy_only=False) for c in ("y", "w", "raw", "u"))
    return codes, y, w, raw, batch["valid"].to_numpy(zero_copy_only=False).astype(bool), u


def _drawn(u: np.ndarray, share: float, seed: int, tree: int) -> np.ndarray:
    """Which rows a tree sees: by a hash of the row's own, so the same in every scan of the tree."""
    if share >= 1:
        return np.ones(len(u), bool)
    with np.errstate(over="ignore"):
        z = u.astype("uint64") + np.uint64((seed * 1_000_003 + tree + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            z = (z ^ (z >> np.uint64(shift))) * np.uint64(factor)
    return (z >> np.uint64(11)) < np.uint64(int(share * (1 << 53)))


CELLS = "node int, feature int, bin int, g double, h double, n long"


class _Rows:
    """The binned rows with their scores, as a table in the shared folder, and scans of it."""

    def __init__(self, df: DataFrame, n_features: int, n_bins: int, g: Growth):
        self.spark, self.n, self.bins, self.g = df.sparkSession, n_features, n_bins, g
        self.table, self.path = kept(df, "boosting-rows")
        self.pending: list[Grown] = []

    def scan(self, tree: int, grown: Grown, wanted: dict[int, Split | None]) -> tuple[dict[int, np.ndarray], tuple[float, float, int]]:
        """Histograms of the left sides of wanted leaves by their splits (of a whole leaf without one), and the validation rows' (loss, weight, number)."""
        n, bins, g, pending = self.n, self.bins, self.g, list(self.pending)
        order = sorted(wanted)

        def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = np.zeros((3, len(order), n, bins + 1))
            loss, loss_w, rows = 0.0, 0.0, 0
            for batch in batches:
                codes, y, w, raw, valid, u = _arrays(batch, n)
                if not len(y):
                    continue
                raw = raw + sum((np.array(t.values)[t.leaf_of(codes)] for t in pending), 0.0)
                p = sigmoid(raw)
                if valid.any():
                    q = np.clip(p[valid], 1e-12, 1 - 1e-12)
                    loss -= float((w[valid] * (y[valid] * np.log(q) + (1 - y[valid]) * np.log(1 - q))).sum())
                    loss_w, rows = loss_w + float(w[valid].sum()), rows + int(valid.sum())
                use = ~valid & _drawn(u, g.rows_share, g.seed, tree)
                codes, first, second = codes[use], (w * (p - y))[use], (w * p * (1 - p))[use]
                at = grown.leaf_of(codes)
                for i, leaf in enumerate(order):
                    here = np.flatnonzero(at == leaf)
                    s = wanted[leaf]
                    if s is not None:
                        here = here[goes_left(codes[here, s.feature], s)]
                    if not len(here):
                        continue
                    inner = np.minimum(codes[here], bins).astype("int64")  # missing values last
                    for f in range(n):
                        for k, v in enumerate((first[here], second[here], None)):
                            sums[k, i, f] += np.bincount(inner[:, f], v, bins + 1)
            i, f, b = np.nonzero(sums[2])
            g1, h1, n1 = sums[:, i, f, b]
            columns = [np.append(np.array(order, "int32")[i], -1), np.append(f, 0), np.append(b, 0), np.append(g1, loss), np.append(h1, loss_w), np.append(n1, rows)]
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(t)) for c, t in zip(columns, ("int32", "int32", "int32", "float64", "float64", "int64"), strict=True)], names=["node", "feature", "bin", "g", "h", "n"])

        cells = self.table.mapInArrow(tally, CELLS).groupBy("node", "feature", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h"), F.sum("n").alias("n"))
        found = cells.toArrow()  # at most leaves x features x bins rows
        node, f, b, g1, h1, n1 = (found[c].to_numpy() for c in ("node", "feature", "bin", "g", "h", "n"))
        hists = {leaf: np.zeros((n, bins + 1, 3)) for leaf in order}
        for leaf in order:
            here = node == leaf
            hists[leaf][f[here], b[here]] = np.stack([g1[here], h1[here], n1[here]], 1)
        end = node == -1
        return hists, (float(g1[end].sum()), float(h1[end].sum()), int(n1[end].sum()))

    def refresh(self) -> None:
        """Writes the rows with scores by all trees so far."""
        n, pending, old = self.n, list(self.pending), self.path

        def moved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                codes, _, _, raw, _, _ = _arrays(batch, n)
                raw = raw + sum((np.array(t.values)[t.leaf_of(codes)] for t in pending), 0.0)
                yield batch.set_column(batch.schema.get_field_index("raw"), "raw", pa.array(raw))

        self.table, self.path = kept(self.table.mapInArrow(moved, ROWS), "boosting-rows")
        self.pending = []
        delete(self.spark, old)


@dataclass
class Boosted:
    """Trees over bins with their edges, the score they start from, and the validation loss after each number of trees."""

    features: list[str]
    edges: list[np.ndarray]
    base: float
    trees: list[Grown]
    losses: list[float]

    def plain_trees(self) -> list[dict]:
        """Trees as a model document has them; a split has its gain too, and `v` is what a node would say as a leaf."""
        out = []
        for tree in self.trees:
            t: dict[str, list] = {k: [] for k in ("f", "t", "l", "r", "d", "m", "v", "lv", "g")}

            def add(node: int, tree=tree, t=t) -> int:
                s = tree.splits[node]
                if s is None:
                    t["lv"].append(tree.values[node])
                    return ~(len(t["lv"]) - 1)
                i = len(t["f"])
                for k, v in (("f", s.feature), ("t", float(self.edges[s.feature][s.bin])), ("l", 0), ("r", 0), ("d", s.missing_left), ("m", 2), ("v", tree.values[node]), ("g", s.gain)):
                    t[k].append(v)
                t["l"][i], t["r"][i] = (add(c) for c in tree.children[node])
                return i

            add(0)
            out.append(t)
        return out

    def document(self, calibration: dict | None = None, thresholds: dict | None = None, base_rate: float = 0.5, suffix_rates: dict | None = None, prior: float = 0.5) -> dict:
        """The model in the published JSON form; ModelDocument reads it, and its raw scores are the trainer's."""
        calibration = {k: v for k, v in (calibration or {"type": "none"}).items() if k != "cv_log_loss"}
        return json.loads(json.dumps({"meta": {"version": 1, "calibration_base_rate": base_rate}, "features": self.features, "init_score": self.base, "trees": self.plain_trees(), "calibration": calibration,
                                      "thresholds": thresholds or {"fraud": 0.8, "legit": 0.2}, "tld_table": suffix_rates or {}, "tld_prior": prior}))

    def gains(self) -> dict[str, tuple[int, float]]:
        """(splits, summed gain) of each feature."""
        out = {f: (0, 0.0) for f in self.features}
        for s in (s for t in self.trees for s in t.splits if s is not None):
            n, g = out[self.features[s.feature]]
            out[self.features[s.feature]] = n + 1, g + s.gain
        return out


def train(df: DataFrame, features: list[str], label: str = "label", weight: str | None = None, start: str | None = None, validation: str | None = None, key: list[str] | None = None, growth: Growth = Growth()) -> Boosted:
    """Boosted trees for a 0/1 label, leaf by leaf.

    weight scales rows. start names a raw score to begin from (a null one counts as 0); without it all rows begin at the log odds of label 1.
    validation is a boolean column: its rows decide when to stop and how many trees stay, and teach nothing else. key names
    columns whose hash says which trees a row is drawn for; features by default, so equal rows go together.
    Missing values (null, NaN) take the side that gains more. Rows without a label are left out. Without rows, or with
    one class only, there are no trees.
    """
    g, spark = growth, df.sparkSession
    df = df.where(F.col(label).isNotNull())
    valid = F.coalesce(F.col(validation), F.lit(False)) if validation else F.lit(False)
    learn = df.where(~valid)
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    total, ones = learn.agg(F.sum(w), F.sum(w * F.col(label).cast("double"))).first()
    one_class = not total or ones <= 0 or ones >= total
    base = 0.0 if start or not total else math.log(max(ones, 1e-9) / max(total - ones, 1e-9))
    out = Boosted(list(features), [np.zeros(0)] * len(features), base, [], [])
    if one_class:
        return out
    out.edges = bin_edges(learn, features, min(g.bins, MAX_BINS))
    n_edges = np.array([len(e) for e in out.edges])
    begin = F.coalesce(F.col(start).cast("double"), F.lit(0.0)) if start else F.lit(base)
    rows = _Rows(_binned(df, features, out.edges, label, weight, begin, valid, key or []), len(features), int(n_edges.max()) + 1, g)
    signs = np.array([g.monotone.get(f, 0) for f in features])
    rng = np.random.default_rng(g.seed)
    try:
        for k in range(g.rounds + 1):
            tree = Grown()
            hists, (loss, loss_w, seen) = rows.scan(k, tree, {0: None})
            if seen:
                out.losses.append(loss / loss_w if loss_w else 0.0)
                if k - int(np.argmin(out.losses)) >= g.patience:
                    break
            if k == g.rounds:
                break
            allowed = np.zeros(len(features), bool)
            allowed[rng.permutation(len(features))[: max(1, round(g.features_share * len(features)))]] = True
            _grow(rows, k, tree, hists[0], n_edges, signs, allowed, g)
            if len(tree.splits) == 1:
                break
            tree.values = [g.rate * v for v in tree.values]
            out.trees.append(tree)
            rows.pending.append(tree)
            if len(rows.pending) == g.refresh:
                rows.refresh()
    finally:
        delete(spark, rows.path)
    if out.losses:
        out.trees = out.trees[: int(np.argmin(out.losses))]
    return out


def _grow(rows: _Rows, k: int, tree: Grown, root: np.ndarray, n_edges: np.ndarray, signs: np.ndarray, allowed: np.ndarray, g: Growth) -> None:
    """Splits the leaf that gains most until there are enough leaves or none gains."""
    hists, lefts, bounds = {0: root}, {}, {0: (-np.inf, np.inf)}
    tree.values[0] = float(_gain(root.sum(1)[0], bounds[0], g.ridge)[0])
    best = {0: best_split(root, n_edges, signs, allowed, bounds[0], g)}
    while len(hists) < g.leaves:
        open_ = sorted((leaf for leaf in hists if best[leaf] is not None), key=lambda leaf: (-best[leaf].gain, leaf))
        if not open_:
            return
        top = open_[0]
        if top not in lefts:  # only so many leaves can still be split: one scan for all of them
            lefts.update(rows.scan(k, tree, {leaf: best[leaf] for leaf in open_[: g.leaves - len(hists)] if leaf not in lefts})[0])
        s, (low, high) = best[top], bounds[top]
        left, right = tree.divide(top, s)
        hists[left] = lefts.pop(top)
        hists[right] = hists.pop(top) - hists[left]
        hists[right][hists[right][..., 2] == 0] = 0.0
        middle, sign = (s.left + s.right) / 2, signs[s.feature]
        bounds[left] = (middle if sign < 0 else low, middle if sign > 0 else high)
        bounds[right] = (middle if sign > 0 else low, middle if sign < 0 else high)
        for leaf in (left, right):
            best[leaf] = best_split(hists[leaf], n_edges, signs, allowed, bounds[leaf], g) if len(hists) < g.leaves else None


def gain_importance(model: dict, spark) -> DataFrame:
    """(feature, splits, gain) out of a model document, for all its features; a document without gains has zeros."""
    splits = [(model["features"][f], float(v)) for t in model["trees"] for f, v in zip(t["f"], t.get("g") or [0.0] * len(t["f"]), strict=True)]
    rows = spark.createDataFrame([(f, 0, 0.0) for f in model["features"]] + [(f, 1, v) for f, v in splits], "feature string, splits long, gain double")
    return rows.groupBy("feature").agg(F.sum("splits").alias("splits"), F.sum("gain").alias("gain"))
