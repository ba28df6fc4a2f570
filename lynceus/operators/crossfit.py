"""Folds of even size that no group crosses, and scores of rows by models that have not seen their group, over several data sets."""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lynceus.operators import boosting
from lynceus.operators.scoring import ModelDocument, tree_scores, vector

#: Groups below this share of all rows are dealt to folds by the bin of their hash.
PARTS = 1000


def part_of(group: Column, salt: str, parts: int = PARTS) -> Column:
    """The bin of a group, by a hash that any engine can repeat; a null group is the empty one."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{salt}|"), F.coalesce(group.cast("string"), F.lit("")))), 1, 8)
    return F.pmod(F.conv(digits, 16, 10).cast("long"), F.lit(parts)).cast("int")


@dataclass(frozen=True)
class Folds:
    """Which fold a group is in: heavy groups by name, all others by the bin of their hash. Both tables are bounded by PARTS."""

    heavy: dict[str, int]
    bins: dict[int, int]
    salt: str
    n: int

    def assign(self, df: DataFrame, group: Column, name: str = "fold") -> DataFrame:
        """df with the fold of its group; two broadcasts of at most PARTS rows each, and no shuffle."""
        spark = df.sparkSession
        heavy = spark.createDataFrame(list(self.heavy.items()), "_g string, _hf int")
        bins = spark.createDataFrame(list(self.bins.items()), "_b int, _bf int")
        g = F.coalesce(group.cast("string"), F.lit(""))
        out = df.withColumns({"_group": g, "_part": part_of(g, self.salt)})
        out = out.join(F.broadcast(heavy), F.col("_group") == F.col("_g"), "left").join(F.broadcast(bins), F.col("_part") == F.col("_b"), "left")
        return out.withColumn(name, F.coalesce("_hf", "_bf", F.lit(0))).drop("_group", "_part", "_g", "_hf", "_b", "_bf")


def balanced_folds(groups: DataFrame, group: str = "group", folds: int = 5, salt: str = "fold") -> Folds:
    """Folds over the rows of groups (one row for each row of all data sets; only the group is read).

    Groups with at least a PARTS-th of all rows, of which there are at most PARTS, are items of their own, and the others are
    items by the bin of their hash. Items go to the emptiest fold, the largest first (ties: by name, bins after groups), so two folds differ
    by no more than the largest item: a heavy group, or a bin, which has about a PARTS-th of the rows.
    """
    sizes = groups.groupBy(F.coalesce(F.col(group).cast("string"), F.lit("")).alias("g")).agg(F.count(F.lit(1)).alias("n"))
    total = groups.count()
    heavy = F.col("n") * PARTS >= total
    items = sizes.groupBy(F.when(heavy, F.col("g")).alias("g"), F.when(~heavy, part_of(F.col("g"), salt)).alias("b")).agg(F.sum("n").alias("n")).collect()  # at most 2 x PARTS rows
    load, named, binned = [(0, k) for k in range(folds)], {}, {}
    for r in sorted(items, key=lambda r: (-r.n, r.g is None, r.g or "", r.b or 0)):
        n, k = heapq.heappop(load)
        heapq.heappush(load, (n + r.n, k))
        if r.g is None:
            binned[r.b] = k
        else:
            named[r.g] = k
    return Folds(named, binned, salt, folds)


def cross_fitted(sets: dict[str, DataFrame], features: list[str], label: str = "label", group: str = "group", folds: int = 5, growth: boosting.Growth = boosting.Growth(), shares: dict[str, float] | None = None, validation: str | None = None) -> DataFrame:
    """All rows of all sets with dataset, fold and raw: the log odds by a model that has seen the row's group in no set.

    One table of folds serves all sets, so a group that is held out of one is held out of each. shares are the sets' parts of
    the training weight (by rows without them). Sets have the same columns; columns dataset, fold, raw and _w are replaced.
    """
    every = None
    for name, df in sets.items():
        rows = df.drop("dataset", "fold", "raw", "_w").withColumn("dataset", F.lit(name))
        every = rows if every is None else every.unionByName(rows)
    every = balanced_folds(every, group, folds).assign(every, F.col(group))
    out = None
    for k in range(folds):
        learn = every.where(F.col("fold") != k).withColumn("_w", F.lit(1.0))
        if shares:
            sizes = {r.dataset: r.n for r in learn.groupBy("dataset").agg(F.count(F.lit(1)).alias("n")).collect()}
            total = sum(sizes.values())
            weight = F.lit(0.0)
            for name, n in sizes.items():
                weight = F.when(F.col("dataset") == name, shares.get(name, 0.0) * total / n).otherwise(weight)
            learn = learn.withColumn("_w", weight)
        model = boosting.train(learn, features, label, weight="_w", validation=validation, key=[group], growth=growth)
        document = ModelDocument.from_json(model.document())
        held = every.where(F.col("fold") == k)
        x = vector(document, known=[], more={f: F.col(f) for f in features})
        part = held.withColumn("raw", tree_scores(held.sparkSession, document, x)["raw"])
        out = part if out is None else out.unionByName(part)
    return out


def log_odds(p: Column) -> Column:
    """The log odds of a probability, kept away from 0 and 1; null for a null one."""
    q = F.greatest(F.least(p, F.lit(1 - 1e-6)), F.lit(1e-6))
    return F.when(p.isNotNull(), F.ln(q / (1 - q)))


def logistic_by(df: DataFrame, xs: list[str], label: str, by: str, values: list, ridge: float = 1.0, rounds: int = 12) -> dict:
    """{value: coefficients, the constant last} of a ridge logistic regression on the rows whose `by` is another value.

    Newton's method: a round is one aggregate of gradients and second derivatives by value; rows of all but
    one value are the whole less that one. The constant has no ridge. values are few.
    """
    terms = [*[F.col(x).cast("double") for x in xs], F.lit(1.0)]
    d, spark = len(terms), df.sparkSession
    fitted = {v: np.zeros(d) for v in values}
    penalty = np.diag([ridge] * (d - 1) + [1e-9])
    upper = [(i, j) for i in range(d) for j in range(i, d)]
    for _ in range(rounds):
        table = F.broadcast(spark.createDataFrame([(v, [float(c) for c in w]) for v, w in fitted.items()], f"_v {df.schema[by].dataType.simpleString()}, _c array<double>"))
        z = sum((t * F.col("_c")[i] for i, t in enumerate(terms)), F.lit(0.0))
        rows = df.crossJoin(table).where(F.col(by) != F.col("_v"))  # a few models
        p = 1 / (1 + F.exp(-z))
        rows = rows.select("_v", p.alias("_p"), F.col(label).cast("double").alias("_y"), *[t.alias(f"_t{i}") for i, t in enumerate(terms)])
        g = [F.sum((F.col("_p") - F.col("_y")) * F.col(f"_t{i}")).alias(f"g{i}") for i in range(d)]
        h = [F.sum(F.col("_p") * (1 - F.col("_p")) * F.col(f"_t{i}") * F.col(f"_t{j}")).alias(f"h{i}_{j}") for i, j in upper]
        moved = 0.0
        for r in rows.groupBy("_v").agg(*g, *h).collect():  # a row for each value
            hessian = np.zeros((d, d))
            for i, j in upper:
                hessian[i, j] = hessian[j, i] = r[f"h{i}_{j}"]
            w = fitted[r["_v"]]
            step = np.linalg.solve(hessian + penalty, np.array([r[f"g{i}"] for i in range(d)]) + penalty @ w)
            fitted[r["_v"]] = w - step
            moved = max(moved, float(np.abs(step).max()))
        if moved < 1e-10:
            break
    return fitted


def stacked(df: DataFrame, scores: list[str], label: str = "label", fold: str = "fold", ridge: float = 1.0) -> DataFrame:
    """df with stack: the log odds by a second learner on log odds of several first learners, fitted on the other folds' rows.

    scores are out-of-fold probabilities; of an odd row whose scores or label are null, stack is null, and it teaches nothing.
    """
    zs = [f"_z{i}" for i in range(len(scores))]
    rows = df.withColumns({z: log_odds(F.col(s)) for z, s in zip(zs, scores, strict=True)})
    whole = F.col(label).isNotNull()
    for s in scores:
        whole = whole & F.col(s).isNotNull()
    values = [r[0] for r in df.select(fold).distinct().collect()]  # a few folds
    fitted = logistic_by(rows.where(whole), zs, label, fold, values, ridge)
    out = F.lit(None).cast("double")
    for v, w in fitted.items():
        z = sum((F.col(z) * float(c) for z, c in zip(zs, w, strict=False)), F.lit(float(w[-1])))
        out = F.when(F.col(fold) == v, z).otherwise(out)
    return rows.withColumn("stack", out).drop(*zs)
