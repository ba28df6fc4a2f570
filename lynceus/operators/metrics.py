"""Evaluation metrics of scored, labelled rows, and intervals for them.

Everything that needs rows in the order of their scores starts from `curve`: rows are first summed by score,
then scores are cut into ranges of about as many different scores each, which are summed up in two levels, so no task ever orders them all.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lynceus.operators.ranges import ranged


def curve(df: DataFrame, score: str = "score", label: str = "label", weight: str | None = None) -> DataFrame:
    """(score, pos, neg, tp, fp): rows of either label at a score, and at it or above."""
    w = F.col(weight) if weight else F.lit(1)
    by = df.groupBy(F.col(score).alias("score")).agg(F.sum(F.when(F.col(label) == 1, w).otherwise(0)).alias("pos"), F.sum(F.when(F.col(label) == 0, w).otherwise(0)).alias("neg"))
    by = ranged(by, [], "score")
    sums = by.groupBy("_r").agg(F.sum("pos").alias("_p"), F.sum("neg").alias("_n"))  # one row for each range
    above = Window.orderBy(F.desc("_r")).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("_r", F.coalesce(F.sum("_p").over(above), F.lit(0)).alias("_p"), F.coalesce(F.sum("_n").over(above), F.lit(0)).alias("_n"))
    within = Window.partitionBy("_r").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    run = by.withColumns({"tp": F.sum("pos").over(within), "fp": F.sum("neg").over(within)}).join(F.broadcast(sums), "_r")
    return run.select("score", "pos", "neg", (F.col("tp") + F.col("_p")).alias("tp"), (F.col("fp") + F.col("_n")).alias("fp"))


def _totals(c: DataFrame) -> DataFrame:
    return c.crossJoin(F.broadcast(c.agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"))))  # one row


def confusion(df: DataFrame, threshold: float = 0.5, score: str = "score", label: str = "label", by: list[str] = ()) -> DataFrame:
    """Counts and the rates they give, 0 where a rate has no cases; one row, or one for each value of by."""
    yes, bad = F.col(score) >= threshold, F.col(label) == 1
    count = lambda c, name: F.sum(F.when(c, 1).otherwise(0)).cast("long").alias(name)
    n = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), count(bad, "n_pos"), count(~bad, "n_neg"), count(yes & bad, "tp"), count(yes & ~bad, "fp"), count(~yes & ~bad, "tn"), count(~yes & bad, "fn"))
    rate = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    tp, fp, tn, fn = (F.col(k) for k in ("tp", "fp", "tn", "fn"))
    out = n.withColumns({"precision": rate(tp, tp + fp), "recall": rate(tp, tp + fn), "fpr": rate(fp, fp + tn), "fnr": rate(fn, fn + tp), "accuracy": rate(tp + tn, F.col("n"))})
    return out.withColumn("f1", rate(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def roc_auc(df: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """roc_auc, ties counting half; null without both classes."""
    c = curve(df, score, label)
    wins = F.sum(F.col("neg") * (F.col("tp") - F.col("pos") / 2.0))
    return c.agg((wins / F.nullif(F.sum("pos") * F.sum("neg"), F.lit(0))).alias("roc_auc"))


def pr_auc(df: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """Average precision: each score's gain in recall times the precision at it."""
    c = curve(df, score, label)
    return c.agg((F.sum(F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp"))) / F.nullif(F.sum("pos"), F.lit(0))).alias("pr_auc"))


def brier_logloss(df: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    p, y = F.greatest(F.least(F.col(score), F.lit(1 - 1e-7)), F.lit(1e-7)), F.col(label)
    return df.agg(F.avg(F.pow(p - y, F.lit(2.0))).alias("brier"), F.avg(-(y * F.ln(p) + (1 - y) * F.ln(1 - p))).alias("log_loss"))


def bin_of(p: Column, edges: list[float]) -> Column:
    """The number of inner edges at or below p."""
    return sum((F.when(p >= e, 1).otherwise(0) for e in edges), F.lit(0))


def ece(df: DataFrame, score: str = "score", label: str = "label", bins: int = 15) -> DataFrame:
    """Expected calibration error over equal bins; a probability on an edge belongs to the upper bin."""
    edges = [k / bins for k in range(1, bins)]
    by = df.groupBy(bin_of(F.col(score), edges).alias("b")).agg(F.count(F.lit(1)).alias("n"), F.avg(label).alias("y"), F.avg(score).alias("p"))
    return by.agg((F.sum(F.col("n") * F.abs(F.col("y") - F.col("p"))) / F.sum("n")).alias("ece"))


def reliability(df: DataFrame, edges: list[float], score: str = "score", label: str = "label") -> DataFrame:
    """(bin, n, mean_score, observed) for each bin between the given inner edges that has rows."""
    return df.groupBy(bin_of(F.col(score), edges).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(score).alias("mean_score"), F.avg(F.col(label).cast("double")).alias("observed"))


def recall_at_fpr(df: DataFrame, limit: float, score: str = "score", label: str = "label") -> DataFrame:
    """The best recall of a threshold whose false-positive rate keeps to the limit; 0 if none does."""
    c = _totals(curve(df, score, label))
    return c.agg(F.coalesce(F.max(F.when(F.col("fp") / F.col("N") <= limit, F.col("tp") / F.col("P"))), F.lit(0.0)).alias("recall"))


def threshold_at_fpr(df: DataFrame, target: float, score: str = "score", label: str = "label") -> DataFrame:
    """Just above the score of the first negative that the target rate can't spare; 0 if it spares all."""
    c = _totals(curve(df, score, label))
    k = F.floor(F.lit(target) * F.col("N"))
    return c.agg(F.coalesce(F.max(F.when(F.col("fp") > k, F.when(F.col("neg") > 0, F.col("score") + 1e-9))), F.lit(0.0)).alias("threshold"))


def weighted_thresholds(df: DataFrame, shares: dict[str, float], target_fpr: float, target_fnr: float, dataset: str = "dataset", score: str = "score", label: str = "label") -> DataFrame:
    """(fraud, legit): the least and the greatest score at which the datasets' weighted error rates meet the targets.

    Every score is a candidate. Each dataset's rates at it are shares of its own negatives at the score or
    above, and of its positives at it or below: weighting rows by share over class size makes both one curve.
    """
    sizes = df.groupBy(dataset, label).agg(F.count(F.lit(1)).alias("_n"))
    table = df.sparkSession.createDataFrame(list(shares.items()), f"{dataset} string, _share double")
    weights = sizes.join(F.broadcast(table), dataset).select(dataset, label, (F.col("_share") / F.col("_n")).alias("_w"))
    c = curve(df.join(F.broadcast(weights), [dataset, label]), score, label, "_w")
    c = _totals(c).withColumns({"_fpr": F.col("fp"), "_fnr": F.col("P") - F.col("tp") + F.col("pos")})
    fraud, legit = F.min(F.when(F.col("_fpr") <= target_fpr + 1e-12, F.col("score"))), F.max(F.when(F.col("_fnr") <= target_fnr + 1e-12, F.col("score")))
    return c.agg(fraud.alias("fraud"), legit.alias("legit")).select("fraud", F.least("legit", "fraud").alias("legit"))


def replicate_weights(df: DataFrame, key: Column, replicates: int, seed: int = 0) -> DataFrame:
    """df for each replicate (rep) with a Poisson(1) weight w of the key, rows without weight left out.

    Weighting a group resamples it as a whole. The weight comes from a hash, so it needs no shuffle and is the
    same everywhere.
    """
    reps = df.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    digits = F.substring(F.md5(F.concat_ws("|", key.cast("string"), F.col("rep").cast("string"), F.lit(str(seed)))), 1, 8)
    u = F.conv(digits, 16, 10).cast("double") / float(1 << 32)
    cdf, term, w = 0.0, 0.36787944117144233, F.lit(0)
    for k in range(8):
        cdf += term
        term /= k + 1
        w = w + F.when(u >= cdf, 1).otherwise(0)
    return reps.withColumn("w", w).where("w > 0")


def bootstrap_rate(df: DataFrame, hit: Column, key: Column, replicates: int = 500, seed: int = 0) -> DataFrame:
    """(estimate, low, high): the share of hits and its 95 % percentile interval over resampled keys.

    Rows are summed by key first, so replicates multiply keys, not rows.
    """
    groups = df.groupBy(key.alias("_k")).agg(F.sum(F.when(hit, 1).otherwise(0)).alias("h"), F.count(F.lit(1)).alias("n"))
    shares = replicate_weights(groups, F.col("_k"), replicates, seed).groupBy("rep").agg((F.sum(F.col("w") * F.col("h")) / F.sum(F.col("w") * F.col("n"))).alias("v"))
    whole = groups.agg((F.sum("h") / F.sum("n")).alias("estimate"))
    return shares.agg(F.percentile("v", F.lit(0.025)).alias("low"), F.percentile("v", F.lit(0.975)).alias("high")).crossJoin(whole)


def bootstrap_auc(df: DataFrame, key: Column, replicates: int = 100, score: str = "score", label: str = "label", other: str | None = None, seed: int = 0) -> DataFrame:
    """(low, high) of the AUC over resampled keys, or with other of its difference from the AUC of that score.

    Scores are cut into ranges once. A replicate sums weights by range, then within it, so no task orders a replicate; rows grow with keys times replicates.
    """

    def aucs(s: str) -> DataFrame:
        sums = [F.sum(F.when(F.col(label) == y, 1).otherwise(0)).alias(c) for y, c in ((1, "p"), (0, "n"))]
        each = df.where(F.col(s).isNotNull()).groupBy(key.alias("_k"), F.col(s).alias("s")).agg(*sums)
        r = replicate_weights(ranged(each, [], "s"), F.col("_k"), replicates, seed)
        by = r.groupBy("rep", "_r", "s").agg(F.sum(F.col("w") * F.col("p")).alias("p"), F.sum(F.col("w") * F.col("n")).alias("n"))
        within = Window.partitionBy("rep", "_r").orderBy(F.desc("s")).rowsBetween(Window.unboundedPreceding, -1)
        inner = by.withColumn("tp", F.coalesce(F.sum("p").over(within), F.lit(0)))
        parts = inner.groupBy("rep", "_r").agg(F.sum(F.col("n") * (F.col("tp") + F.col("p") / 2.0)).alias("wins"), F.sum("p").alias("p"), F.sum("n").alias("n"))
        above = Window.partitionBy("rep").orderBy(F.desc("_r")).rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
        parts = parts.withColumn("tp", F.coalesce(F.sum("p").over(above), F.lit(0)))
        return parts.groupBy("rep").agg((F.sum(F.col("wins") + F.col("n") * F.col("tp")) / F.nullif(F.sum("p") * F.sum("n"), F.lit(0))).alias("v"))

    v = aucs(score)
    if other:
        v = v.join(aucs(other).withColumnRenamed("v", "v2"), "rep").select("rep", (F.col("v") - F.col("v2")).alias("v"))
    return v.agg(F.percentile("v", F.lit(0.025)).alias("low"), F.percentile("v", F.lit(0.975)).alias("high"))


def incomplete_beta(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The regularised incomplete beta function, by its continued fraction, for arrays; 0 < x < 1."""
    swap = x > (a + 1) / (a + b + 2)
    x, a, b = np.where(swap, 1 - x, x), np.where(swap, b, a), np.where(swap, a, b)
    gammas = np.array([math.lgamma(p + q) - math.lgamma(p) - math.lgamma(q) for p, q in zip(a, b, strict=True)])
    front = np.exp(gammas + a * np.log(x) + b * np.log1p(-x)) / a
    tiny = 1e-300
    guard = lambda v: np.where(np.abs(v) < tiny, tiny, v)
    c, d = np.ones_like(x), 1 / guard(1 - (a + b) * x / (a + 1))
    h = d
    for m in range(1, 300):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 / guard(1 + top * d), guard(1 + top / c)
            step = d * c
            h = h * step
        if (np.abs(step - 1) < 1e-14).all():
            break
    return np.where(swap, 1 - front * h, front * h)


def beta_quantile(p: float, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Where the beta distribution's share p lies, by bisection of all cells at a time."""
    lo, hi = np.zeros(len(a)), np.ones(len(a))
    for _ in range(60):
        mid = (lo + hi) / 2
        below = incomplete_beta(mid, a, b) < p
        lo, hi = np.where(below, mid, lo), np.where(below, hi, mid)
    return (lo + hi) / 2


def exact_interval(k: Column, n: Column, level: float = 0.95) -> Column:
    """struct<low, high>: the exact (Clopper-Pearson) interval of a share k / n, in Arrow batches; the whole of 0 to 1 where n is 0."""
    tail = (1 - level) / 2

    @F.pandas_udf("low double, high double")
    def interval(ks: pd.Series, ns: pd.Series) -> pd.DataFrame:
        x, m = ks.to_numpy("float64"), ns.to_numpy("float64")
        low, high = np.zeros(len(x)), np.ones(len(x))
        some, not_all = x > 0, x < m
        low[some] = beta_quantile(tail, x[some], m[some] - x[some] + 1)
        high[not_all] = beta_quantile(1 - tail, x[not_all] + 1, m[not_all] - x[not_all])
        return pd.DataFrame({"low": low, "high": high})

    return interval(k.cast("double"), n.cast("double"))


def projection(rates: DataFrame, prevalences: list[float], n: int) -> DataFrame:
    """Expected counts among n rows at each prevalence, from a model's rates (name, tpr, fpr).

    Rates and prevalences are a few rows each.
    """
    table = rates.sparkSession.createDataFrame([(float(p),) for p in prevalences], "prevalence double")
    out = rates.crossJoin(F.broadcast(table)).withColumns({"tp": F.col("prevalence") * n * F.col("tpr"), "fp": (1 - F.col("prevalence")) * n * F.col("fpr")})
    return out.withColumns({"flagged": F.col("tp") + F.col("fp"), "precision": F.when(F.col("tp") + F.col("fp") > 0, F.col("tp") / (F.col("tp") + F.col("fp")))})


def recall_at_threshold_of(fixed_on: DataFrame, df: DataFrame, target_fpr: float, score: str = "score", label: str = "label") -> DataFrame:
    """(threshold, recall, n): the share of df's n positives at or above a threshold that another data set's false-positive rate fixes."""
    t = threshold_at_fpr(fixed_on, target_fpr, score, label)
    hits = df.where(F.col(label) == 1).crossJoin(F.broadcast(t))  # one row
    return hits.groupBy("threshold").agg(F.avg((F.col(score) >= F.col("threshold")).cast("double")).alias("recall"), F.count(F.lit(1)).alias("n"))


def count_tensor(df: DataFrame, axes: list[str], within: list[str]) -> DataFrame:
    """(axes, n, share, low, high): rows for each combination of values, their share of those with equal values of within, and its exact interval."""
    cells = df.groupBy(*axes).agg(F.count(F.lit(1)).alias("n"))
    sums = cells.groupBy(*[F.col(c).alias(f"_{c}") for c in within]).agg(F.sum("n").alias("_all"))
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in within]
    on = same[0]
    for x in same[1:]:
        on = on & x
    i = exact_interval(F.col("n"), F.col("_all"))
    return cells.join(sums, on).withColumn("_i", i).select(*axes, "n", (F.col("n") / F.col("_all")).alias("share"), "_i.low", "_i.high")
