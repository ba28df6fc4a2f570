import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lynceus.operators import audit, datasets, encoders, metrics, training
from lynceus.functions.suffix import sample_rules
from lynceus.streaming import urls as streams


@pytest.fixture(scope="module")
def scored(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice("abc"), int(rng.random() < 0.4), round(rng.random(), 2)) for i in range(400)]
    return rows, spark.createDataFrame(rows, "id long, dataset string, label int, score double")


def test_ranking_metrics(scored):
    rows, df = scored
    y, s = np.array([r[2] for r in rows]), np.array([r[3] for r in rows])
    pos, neg = s[y == 1], s[y == 0]
    assert metrics.roc_auc(df).first()[0] == pytest.approx(np.mean([(a > b) + (a == b) / 2 for a in pos for b in neg]))
    order = sorted(set(s), reverse=True)
    ap, last = 0.0, 0.0
    for t in order:
        r, p = np.mean(pos >= t), np.sum(pos >= t) / np.sum(s >= t)
        ap, last = ap + (r - last) * p, r
    assert metrics.pr_auc(df).first()[0] == pytest.approx(ap)
    for limit in (0.0, 0.01, 0.1, 1.0):
        assert metrics.recall_at_fpr(df, limit).first()[0] == pytest.approx(max([np.mean(pos >= t) for t in order if np.mean(neg >= t) <= limit], default=0.0))
        k = int(limit * len(neg))
        assert metrics.threshold_at_fpr(df, limit).first()[0] == pytest.approx(sorted(neg)[::-1][k] + 1e-9 if k < len(neg) else 0.0)
    shares = {"a": 0.5, "b": 0.3, "c": 0.2}
    d = np.array([r[1] for r in rows])
    fpr = [sum(w * np.mean(s[(d == k) & (y == 0)] >= t) for k, w in shares.items()) for t in sorted(order)]
    fnr = [sum(w * np.mean(s[(d == k) & (y == 1)] <= t) for k, w in shares.items()) for t in sorted(order)]
    fraud = min(t for t, f in zip(sorted(order), fpr) if f <= 0.2 + 1e-12)
    legit = min(max(t for t, f in zip(sorted(order), fnr) if f <= 0.2 + 1e-12), fraud)
    assert metrics.weighted_thresholds(df, shares, 0.2, 0.2).first()[:] == pytest.approx((fraud, legit))


def test_bootstrap(spark, scored):
    _, df = scored
    r = metrics.bootstrap_rate(df, F.col("label") == 1, F.col("id"), 200).first()
    assert r.low < r.estimate < r.high and r.high - r.low < 0.2
    d = metrics.bootstrap_auc(df, F.col("id"), 20, other="score").first()
    assert d.low == d.high == 0  # a score against itself
    cells = spark.createDataFrame([(8, 10), (0, 5), (5, 5), (0, 0), (40_000, 1_000_000)], "k long, n long")
    got = {(r.k, r.n): (round(r.i.low, 4), round(r.i.high, 4)) for r in cells.withColumn("i", metrics.exact_interval(F.col("k"), F.col("n"))).collect()}
    assert got[8, 10] == (0.4439, 0.9748) and got[0, 5] == (0.0, 0.5218) and got[5, 5] == (0.4782, 1.0) and got[0, 0] == (0.0, 1.0) and got[40_000, 1_000_000] == (0.0396, 0.0404)


def test_dedupe_and_caps(spark):
    df = spark.createDataFrame([(" u1aa ", 1, 1), ("u1aa", 1, 2), ("u2aa", 0, 3), ("u2aa", 1, 4), ("x", 1, 5), ("u3aa", 0, 6)], "url string, label int, id int")
    assert [(r.url, r.id) for r in datasets.dedupe(df, order="id").orderBy("id").collect()] == [("u1aa", 1), ("u3aa", 6)]
    rows = spark.createDataFrame([(f"u{i}", f"h{i % 7}", f"g{i % 2}") for i in range(100)], "url string, host string, group string")
    capped = datasets.cap_hosts(rows, 4, 10)
    assert capped.groupBy("host").count().agg(F.max("count")).first()[0] <= 4 and capped.groupBy("group").count().agg(F.max("count")).first()[0] == 10
    again = datasets.cap_hosts(rows.repartition(7), 4, 10)
    assert {r.url for r in capped.collect()} == {r.url for r in again.collect()}
    out = datasets.cap_platforms(rows, spark.createDataFrame([("g0",)], "group string"), 100, 3, 30)
    assert {r.group: r["count"] for r in out.groupBy("group").count().collect()} == {"g0": 30, "g1": 3}
    labels = spark.createDataFrame([(f"u{i}", int(i % 4 == 0)) for i in range(100)], "url string, label int")
    assert {r.label: r["count"] for r in datasets.balanced(labels, per_class=20).groupBy("label").count().collect()} == {0: 20, 1: 20}
    assert {r.label: r["count"] for r in datasets.stratified(labels, "label", 40).groupBy("label").count().collect()} == {0: 30, 1: 10}
    assert datasets.resample_rows(labels, 500).count() == 500 and datasets.sample_rows(labels, 7).count() == 7
    ranked = spark.createDataFrame([(f"d{i}", i) for i in range(1, 200)], "domain string, rank int")
    assert datasets.tiered(ranked, 20, ((10, 0.2), (100, 0.8))).count() == 20


def test_feeds_and_groups(spark):
    lg = spark.createDataFrame([("u1", "h1", "g1", False), ("u2", "h2", "g2", False), ("u3#x", "h3", "g3", True), ("u4", "h1", "g3", True)], "url string, host string, group string, is_platform boolean")
    one = lambda c, v: spark.createDataFrame([(v,)], f"{c} string")
    assert {r.url for r in datasets.without_feeds(lg, one("host", "h1"), one("group", "g9"), one("url", "u3")).collect()} == {"u2", "u4"}
    assert datasets.unseen(spark.createDataFrame([("https://WWW.a.test/",), ("b.test",)], "url string"), spark.createDataFrame([("a.test",)], "url string")).count() == 1


def test_suffix_rates(spark):
    rows = [("co.uk", 1)] * 3 + [("co.uk", 0)] + [("uk", 0)] * 2 + [("com", 1)] * 4 + [("", 0)] * 2
    df = spark.createDataFrame([(t, y, f"g{i}") for i, (t, y) in enumerate(rows)], "tld string, label int, group string")
    got = {r.suffix: r.rate for r in encoders.suffix_rates(df, m=2).collect()}
    prior = 7 / 12
    uk = (3 + 2 * prior) / (6 + 2)
    assert got["co.uk"] == pytest.approx((3 + 2 * uk) / 6) and got["uk"] == pytest.approx((0 + 2 * uk) / 4) and set(got) == {"co.uk", "uk", "com", ""}
    assert {r.suffix for r in encoders.publishable(encoders.suffix_rates(df), df.where("tld <> 'co.uk'"), sample_rules()).collect()} == {"co.uk", "uk", "com", ""}


def test_training(spark):
    rng = random.Random(1)
    rows = [(f"g{i % 40}", float(x := rng.random()), rng.random() if i % 9 else float("nan"), int(x > 0.5)) for i in range(300)]
    df = spark.createDataFrame(rows, "group string, a double, b double, label int")
    model = training.train_trees(df, ["a", "b"], rounds=3, depth=2)
    out = training.probabilities(model.transform(training.filled(df, ["a", "b"])))
    assert metrics.roc_auc(out).first()[0] > 0.95
    raw = df.withColumn("raw", (F.col("a") - 0.5) * 4)
    assert training.fit_platt(raw)["a"] > 1 and training.choose_calibration(raw, folds=2)["type"] in ("platt", "isotonic")
    t = training.temperature(df.withColumn("score", F.col("a")))
    assert 0.05 < t < 1  # the score is underconfident
    assert training.out_of_fold(df, ["a"], folds=2, rounds=2).count() == 300
    assert training.train_tree(df, ["a"], depth=2).depth == 1  # one cut tells the labels apart
    keyed = df.withColumn("id", F.monotonically_increasing_id())
    drops = {r.feature: r["drop"] for r in training.permutation_importance(lambda d: d.withColumn("score", F.col("a")), keyed, ["a", "b"], ["id"]).collect()}
    assert drops["a"] > 0.3 and drops["b"] == 0
    flagged = keyed.withColumn("validation", F.col("id") % 3 == 0).withColumn("b", F.coalesce(F.nanvl("b", F.lit(0.0)), F.lit(0.0)))
    fit = lambda rows, names: (lambda m: lambda d: training.probabilities(m.transform(training.filled(d, names, 0.0))))(training.train_logistic(rows, names))
    assert training.forward_selection(fit, flagged, ["b", "a"], 1) == ["a"]


def test_streams(spark, tmp_path):
    for k in range(3):
        spark.createDataFrame([(k * 10 + i, f"k{i % 2}") for i in range(4)], "id long, k string").coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
    s = streams.read_files(spark, f"file://{tmp_path}/in", "id long, k string", files_per_batch=1)
    seen = []
    streams.run_available(s, lambda b: b.withColumn("x", F.col("id") * 2), f"file://{tmp_path}/out", f"file://{tmp_path}/cp", lambda n, rows: seen.append(rows))
    assert spark.read.parquet(f"file://{tmp_path}/out").count() == 12 and seen == [4, 4, 4]


def test_ranges(spark):
    """Quantiles, gaps and curves over values of which most are one, against numpy; groups without values have none."""
    import numpy as np

    from lynceus.operators import ranges

    rng = np.random.default_rng(4)
    rows = [("a", 0.0)] * 500 + [("a", float(v)) for v in rng.exponential(1, 400)] + [("b", float(v)) for v in rng.integers(0, 9, 300)] + [("c", 2.0), ("d", None), (None, 1.0), (None, 4.0)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    probabilities = [0.0, 0.1, 0.5, 0.77, 1.0]
    got = {r.g: r.quantiles for r in ranges.quantiles(df, ["g"], "v", probabilities).collect()}
    values = {g: np.array(sorted(v for k, v in rows if k == g and v is not None)) for g in ("a", "b", "c", None)}
    assert set(got) == set(values)
    for g, v in values.items():
        assert np.allclose(got[g], np.quantile(v, probabilities))
    gaps = ranges.neighbour_gaps(df, ["g"], "v").collect()
    for g, v in values.items():
        assert np.allclose(sorted(r.gap for r in gaps if r.g == g), sorted(np.diff(v)))
    assert ranges.quantiles(df.limit(0), ["g"], "v", [0.5]).count() == 0


@pytest.mark.parametrize("few", [100_000, 3])
def test_spearman(spark, monkeypatch, few):
    """Ties, rows with gaps, both zeros and a value of most rows, with ranks broadcast or dealt by value; sorting each column's rows is what grew too fast."""
    monkeypatch.setattr(audit, "FEW", few)
    draw = random.Random(5)
    rows = [(draw.choice([0.0, -0.0, 0.0, draw.random()]), draw.random(), float(draw.randint(0, 60)), 1.0) for _ in range(3000)]
    rows = [(a, b + a, c - 20 * b, d) for a, b, c, d in rows]
    gaps = [(None, 1.0, 1.0, 1.0), (float("nan"), 9.0, 9.0, 1.0), (1.0, None, 5.0, 1.0)]
    df = spark.createDataFrame(rows + gaps, "a double, `b.c` double, d double, e double")
    got = {(r.a, r.b): r.rho for r in audit.spearman(df, df.columns, 0.0).collect()}

    def ranks(values):
        _, place, n = np.unique(values, return_inverse=True, return_counts=True)
        return (np.cumsum(n) - (n - 1) / 2)[place]

    columns = dict(zip(df.columns, map(ranks, np.array(rows).T + 0.0)))
    want = {(x, y): np.corrcoef(columns[x], columns[y])[0, 1] for x, y in (("a", "b.c"), ("a", "d"), ("b.c", "d"))}
    assert got == pytest.approx(want, abs=1e-12)
    assert set(audit.spearman(df, df.columns, 0.5).select("a", "b").collect()) == {k for k, v in want.items() if abs(v) > 0.5}
    assert audit.spearman(df.where("e = 2"), df.columns, 0.0).count() == 0
    plan = audit.running(df.groupBy("d").agg(F.count(F.lit(1)).alias("n")), [], "d")
    assert plan.agg(F.max("upto")).first()[0] == 3003
    with pytest.MonkeyPatch.context() as m:
        m.setattr("pyspark.ml.stat.Correlation.corr", lambda *a: pytest.fail("sorts all rows of all columns"))
        audit.spearman(df, df.columns)
