"""Trees by leaves against a plain grower, and folds, cross-fitted and stacked scores."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lynceus.operators import boosting, crossfit, metrics
from lynceus.operators.scoring import ModelDocument
from lynceus.plans.models import QUERIES
from lynceus.plans.models_sql import ORACLE_SQL
from tests.test_queries import SF, same

NAMES = ["a", "b", "c"]


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_oracle(spark, name):
    same(QUERIES[name](spark, SF), ORACLE_SQL[name])


def made(n=600, seed=0, missing=True):
    rng = np.random.default_rng(seed)
    x = np.stack([rng.integers(0, 40, n), rng.random(n).round(2), rng.integers(0, 4, n)], 1).astype(float)
    p = 1 / (1 + np.exp(-(np.where(x[:, 0] > 20, 2, -1) * np.where(x[:, 1] > 0.5, 1, -0.5) + 0.3 * x[:, 2] - 0.5)))
    y = (rng.random(n) < p).astype(int)
    if missing:
        x[rng.random(n) < 0.15, 1] = np.nan
    return x, y


def frame(spark, x, y, **more):
    rows = [(i, *[None if np.isnan(v) else float(v) for v in r], int(t), *[c[i] for c in more.values()]) for i, (r, t) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, f"id long, a double, b double, c double, label int{''.join(f', {k} {t}' for k, t in ((k, 'boolean' if isinstance(v[0], bool) else 'string' if isinstance(v[0], str) else 'double') for k, v in more.items()))}").repartition(4)


def plain_tree(x, g, h, leaves, least, ridge, monotone=(0, 0, 0)):
    """Leaf number of each row and leaf values, splitting the leaf that gains most, every value and both sides of missing ones tried."""
    def value(rows, lo, hi):
        return float(np.clip(-g[rows].sum() / (h[rows].sum() + ridge), lo, hi))

    def loss(rows, v):
        return 2 * g[rows].sum() * v + (h[rows].sum() + ridge) * v * v

    def best(rows, lo, hi):
        found = None
        for f in range(x.shape[1]):
            v = x[rows, f]
            nan = np.isnan(v)
            for e in np.unique(x[:, f][~np.isnan(x[:, f])])[:-1]:
                for to_left in (False, True) if nan.any() else (False,):
                    left = np.where(nan, to_left, v <= e)
                    if min(left.sum(), (~left).sum()) < least:
                        continue
                    a, b = value(rows[left], lo, hi), value(rows[~left], lo, hi)
                    if (b - a) * monotone[f] < 0:
                        continue
                    gain = loss(rows, value(rows, lo, hi)) - loss(rows[left], a) - loss(rows[~left], b)
                    if gain > 1e-9 and (found is None or gain > found[0] + 1e-9):
                        found = (gain, left, a, b, f)
        return found

    parts = [(np.arange(len(x)), -np.inf, np.inf, None)]
    while len(parts) < leaves:
        options = [(b[0], -i) for i, (rows, lo, hi, _) in enumerate(parts) if (b := best(rows, lo, hi))]
        if not options:
            break
        i = -max(options)[1]
        rows, lo, hi, _ = parts[i]
        _, left, a, b, f = best(rows, lo, hi)
        m, s = (a + b) / 2, monotone[f]
        parts[i : i + 1] = [(rows[left], m if s < 0 else lo, m if s > 0 else hi, a), (rows[~left], m if s > 0 else lo, m if s < 0 else hi, b)]
    out = np.zeros(len(x))
    for rows, _, _, v in parts:
        out[rows] = v or 0.0
    return out, len(parts)


@pytest.mark.parametrize("monotone", [(0, 0, 0), (1, 0, -1)])
def test_trees_by_brute_force(spark, monotone):
    x, y = made()
    growth = boosting.Growth(rounds=3, leaves=9, rate=0.3, least_rows=15, refresh=2, monotone=dict(zip(NAMES, monotone)))
    model = boosting.train(frame(spark, x, y), NAMES, growth=growth)
    raw = np.full(len(y), np.log(y.mean() / (1 - y.mean())))
    for tree in model.trees:
        p = 1 / (1 + np.exp(-raw))
        add, leaves = plain_tree(x, p - y, p * (1 - p), 9, 15, 1.0, monotone)
        raw = raw + 0.3 * add
        assert (sum(s is None for s in tree.splits)) == leaves
    document = ModelDocument.from_json(model.document())
    assert len(model.trees) == 3 and np.allclose(document.raw(x), raw, atol=1e-9)
    parts = np.zeros_like(x)
    assert np.allclose(document.bias + (document.raw(x, parts), parts.sum(1))[1], raw)  # what each feature adds


def test_document_equals_scores_kept_while_training(spark):
    """The rows' scores after many trees, brought up to date several times, are those of the exported document."""
    x, y = made(seed=3)
    df = frame(spark, x, y)
    growth = boosting.Growth(rounds=7, leaves=15, rate=0.2, least_rows=5, refresh=3, rows_share=0.7, features_share=0.7, seed=5)
    model = boosting.train(df, NAMES, key=["id"], growth=growth)
    document, edges = ModelDocument.from_json(model.document()), model.edges
    codes = np.stack([np.where(np.isnan(x[:, i]), 255, np.searchsorted(e, x[:, i])) for i, e in enumerate(edges)], 1)
    kept = model.base + sum(np.array(t.values)[t.leaf_of(codes)] for t in model.trees)
    assert np.allclose(kept, document.raw(x)) and max(sum(s is None for s in t.splits) for t in model.trees) == 15
    again = boosting.train(df.repartition(7), NAMES, key=["id"], growth=growth)
    assert np.allclose(ModelDocument.from_json(again.document()).raw(x), document.raw(x))  # draws don't depend on partitions
    gains = {r.feature: (r.splits, r.gain) for r in boosting.gain_importance(model.document(), spark).collect()}
    assert sum(n for n, _ in gains.values()) == sum(len(t["f"]) for t in model.plain_trees()) and gains["a"][1] > gains["c"][1]


def test_early_stopping(spark):
    x, y = made(900)
    valid = [bool(i % 3 == 0) for i in range(900)]
    model = boosting.train(frame(spark, x, y, valid=valid), NAMES, validation="valid", growth=boosting.Growth(rounds=60, leaves=31, rate=0.5, least_rows=2, patience=4))
    v = np.array(valid)
    loss = []
    for n in range(len(model.losses)):
        part = ModelDocument(NAMES, ModelDocument.from_json(model.document()).trees[:n], model.base)
        p = 1 / (1 + np.exp(-part.raw(x[v])))
        loss.append(-np.mean(y[v] * np.log(p) + (1 - y[v]) * np.log(1 - p)))
    assert len(model.losses) < 61 and len(model.trees) == int(np.argmin(model.losses)) < len(model.losses) - 1
    assert np.allclose(loss[: len(model.trees) + 1], model.losses[: len(model.trees) + 1])


def test_odd_tables(spark):
    x, y = made(80)
    none = frame(spark, x, y).limit(0)
    assert boosting.train(none, NAMES).trees == [] and boosting.train(frame(spark, x, np.ones(80)), NAMES).trees == []
    flat = boosting.train(frame(spark, np.full((80, 3), np.nan), y), NAMES, growth=boosting.Growth(least_rows=1))
    assert flat.trees == [] and flat.base == pytest.approx(np.log(y.mean() / (1 - y.mean())))
    weighted = boosting.train(frame(spark, x, y, w=[2.0] * 80), NAMES, weight="w", growth=boosting.Growth(rounds=1, leaves=2, least_rows=5, ridge=2.0))
    plain = boosting.train(frame(spark, x, y), NAMES, growth=boosting.Growth(rounds=1, leaves=2, least_rows=5))
    assert np.allclose(ModelDocument.from_json(weighted.document()).raw(x), ModelDocument.from_json(plain.document()).raw(x))
    many = np.stack([np.arange(3000) / 7.0] * 3, 1)
    assert max(map(len, boosting.bin_edges(frame(spark, many, np.arange(3000) % 2), NAMES, 254))) <= 253


def test_monotone_corrections(spark):
    """Corrections to given scores, in order along a feature whatever the rows say, with missing values too."""
    rng = np.random.default_rng(0)
    x = rng.random((400, 3))
    y = (rng.random(400) < 1 / (1 + np.exp(-(3 * x[:, 0] - 1.5 + np.sin(20 * x[:, 0]))))).astype(int)
    growth = boosting.Growth(rounds=15, leaves=7, rate=0.2, least_rows=10, monotone={"a": 1})
    m = ModelDocument.from_json(boosting.train(frame(spark, x, y, given=[0.0] * 400), NAMES, start="given", growth=growth).document())
    for b in (0.1, 0.5, 0.9):
        grid = np.stack([np.linspace(0, 1, 200), np.full(200, b), np.full(200, b)], 1)
        assert (np.diff(m.raw(grid)) >= -1e-12).all() and m.raw(grid)[-1] > m.raw(grid)[0]
    x[::7, 0] = np.nan
    assert np.isfinite(ModelDocument.from_json(boosting.train(frame(spark, x, y, given=[0.5] * 400), NAMES, start="given", growth=growth).document()).raw(x)).all()


def test_folds(spark):
    """One group with a third of the rows, many small ones: folds differ by the largest item at most, and no group is in two."""
    rows = [("hot", i) for i in range(1000)] + [(f"g{i % 700}", i) for i in range(2000)] + [(None, 1)] * 3
    df = spark.createDataFrame(rows, "group string, i int")
    folds = crossfit.balanced_folds(df, folds=2)
    out = folds.assign(df, F.col("group"))
    assert out.groupBy("group").agg(F.countDistinct("fold").alias("n")).where("n > 1").isEmpty()
    sizes = [r.n for r in out.groupBy("fold").agg(F.count(F.lit(1)).alias("n")).collect()]
    assert sum(sizes) == 3003 and max(sizes) - min(sizes) <= 30
    assert crossfit.balanced_folds(df.limit(0)).assign(df.limit(0), F.col("group")).count() == 0
    assert len(folds.heavy) + len(folds.bins) <= 2 * crossfit.PARTS


def test_cross_fitted(spark):
    x, y = made(300)
    groups = [f"g{i % 20}" for i in range(300)]
    df = frame(spark, x, y, group=groups)
    leak = df.withColumn("a", F.crc32("group").cast("double")).withColumn("label", (F.crc32("group") % 2).cast("int"))  # only the group tells
    growth = boosting.Growth(rounds=10, leaves=31, rate=0.5, least_rows=1)
    out = crossfit.cross_fitted({"one": leak.where("id % 2 = 0"), "two": leak.where("id % 2 = 1")}, NAMES, folds=4, growth=growth, shares={"one": 0.7, "two": 0.3}).cache()
    assert out.count() == 300 and out.groupBy("group").agg(F.countDistinct("fold").alias("n")).where("n > 1").isEmpty()
    seen = boosting.train(leak, NAMES, growth=growth)
    fitted = ModelDocument.from_json(seen.document()).raw(np.stack([[r.a, np.nan if r.b is None else r.b, r.c] for r in leak.collect()]))
    auc = metrics.roc_auc(out.withColumn("score", F.col("raw"))).first()[0]
    assert np.std(fitted) > 1 and auc < 0.9  # scores by a model that knows the group would be perfect


def test_stacked(spark):
    rng = np.random.default_rng(1)
    y = rng.integers(0, 2, 400)
    p, q = (1 / (1 + np.exp(-(y - 0.5 + rng.normal(0, s, 400)))) for s in (1.0, 1.0))
    rows = [(i, float(a), float(b), int(t), i % 3) for i, (a, b, t) in enumerate(zip(p, q, y))] + [(900, None, 0.5, 1, 0), (901, 0.5, 0.5, None, 1)]
    out = crossfit.stacked(spark.createDataFrame(rows, "id long, p double, q double, label int, fold int"), ["p", "q"]).cache()
    auc = lambda c: metrics.roc_auc(out.where("stack IS NOT NULL AND label IS NOT NULL").withColumn("score", F.col(c))).first()[0]
    assert auc("stack") > max(auc("p"), auc("q")) and out.where("id = 900").first().stack is None and out.where("id = 901").first().stack is not None
