import random
import zlib

import numpy as np
import pytest

from lynceus.llm import labelled, quality, toxicity
from tests.llm.data import docs, frame


def made(n=400, seed=0):
    """(text, quality, toxic): good text is sentences and bad text is noise; toxic text has a word or a stem among others."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(["the", "an", "er", "ing", "on", "st", "re"]) for _ in range(rng.randint(1, 3)))
    out = []
    for _ in range(n):
        words, good, toxic = [word() for _ in range(rng.randint(20, 80))], rng.random() < 0.7, rng.random() < 0.3
        if toxic:
            words.insert(rng.randrange(len(words)), rng.choice(["vilex", "grubbo"]) + rng.choice(["", word()]))
        text = " ".join(w if good else w.upper() + rng.choice(["!!", "%%%"]) for w in words)
        out.append((text, int(good), int(toxic)))
    return out


def accuracy(scores, y):
    return np.mean((np.array(scores) >= 0.5) == np.array(y))


def test_quality_learns():
    rows = made()
    model = quality.fit([(t, q) for t, q, _ in rows[:300]])
    good, bad = model.compressors()
    x = np.array([quality.features(t, good, bad) for t, _, _ in rows[300:]])
    assert accuracy(model.scores(x), [q for _, q, _ in rows[300:]]) > 0.95
    assert np.isfinite(model.scores(np.array([quality.features(t, good, bad) for t in ("", "x", "é" * 30_000)]))).all()


def test_toxicity_learns():
    rows = made(600)
    model = toxicity.fit([(t, x) for t, _, x in rows[:450]])
    scorer = toxicity.Scorer(model)
    raw = [scorer.raw(t) for t, _, _ in rows[450:]]
    assert accuracy(model.score(np.array([a for a, _ in raw]), np.array([b for _, b in raw])), [x for _, _, x in rows[450:]]) > 0.9
    long = "the an " * 60_000
    assert scorer.raw(long + " vilex")[0] > scorer.raw(long)[0]  # whole texts count, in parts too
    assert scorer.raw(None) == scorer.raw("") and scorer.raw("der und die nicht")[1] == 1 and scorer.raw("zzz")[1] == 4


@pytest.mark.parametrize("rows", [[], [("a", 1)], [("a", 1)] * 9, [("a", 0), ("b", 1)], [("", 0), ("", 1)] * 9])
def test_few_labels(rows):
    m, t = quality.fit(rows), toxicity.fit(rows)
    good, bad = m.compressors()
    assert 0 <= m.scores(np.array([quality.features("x y", good, bad)]))[0] <= 1
    z, k = toxicity.Scorer(t).raw("x y")
    assert 0 <= t.score(np.array([z]), np.array([k]))[0] <= 1


def test_queries_on_tables(spark):
    rows = [(i, t) for i, (t, _, _) in enumerate(made(300))] + docs()[-20:]
    labels = spark.createDataFrame([(i, q, x, "extra") for i, (_, q, x) in enumerate(made(300))] + [(None, 1, 1, ""), (3, None, None, ""), (9999, 0, 0, "")], "doc_id long, quality int, toxic int, text string")
    df = frame(spark, rows)
    for scored, names in ((quality.score(df, quality.train(df, labels)), ("quality_score", "quality_predicted")), (toxicity.score(df, toxicity.train(df, labels)), ("toxicity_score", "toxicity_predicted"))):
        got = scored.collect()
        assert len(got) == len(rows) and all(0 <= r[names[0]] <= 1 and r[names[1]] in (0, 1) for r in got)
        assert scored.columns[: len(df.columns)] == df.columns
    kept = quality.accepted(df, labels)
    assert kept.columns == df.columns and 0 < kept.count() < len(rows)
    empty = frame(spark, [])
    assert quality.score(empty, quality.train(empty, labels.limit(0))).count() == 0 == toxicity.score(empty, toxicity.train(empty, labels.limit(0))).count()


def test_folds(spark):
    rows = spark.range(200).select("id", labelled.held_out(__import__("pyspark.sql.functions").sql.functions.col("id")).alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 5 == 0) for r in rows)
    df = spark.createDataFrame([(i, f"t{i}") for i in range(200)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, quality int")
    drawn = labelled.sample(df, labels, "quality", 20)
    assert drawn == labelled.sample(df.repartition(5), labels.repartition(3), "quality", 20) and 10 < len(drawn) < 80
    assert not {int(t[1:]) for t, _ in drawn} & {i for i in range(200) if zlib.crc32(str(i).encode()) % 5 == 0}


def plain_toxicity(model, text):
    """The network word by word and filter by filter."""
    every = toxicity.words(text)
    x = [sum(model.embedding[model.rows.get(h, 0)] for h in toxicity._hashes(w)) for w in every]
    units = []
    for width, f in zip(toxicity.WIDTHS, model.filters):
        for u in range(toxicity.FILTERS):
            places = [sum(float(x[i + j] @ f[j, :, u]) for j in range(width)) for i in range(len(x) - width + 1)]
            units.append(max(places) if places else 0.0)
    logit = sum(max(0.0, v + b) * d for v, b, d in zip(units, model.bias, model.dense)) + model.constant
    counts = [sum(w in v.split() for w in every) for v in toxicity.FUNCTION_WORDS.values()]
    language = counts.index(max(counts)) if any(counts) else len(counts)
    return 1 / (1 + np.exp(-model.slope * (logit - model.thresholds[language])))


def plain_quality(model, text):
    """Every piece compressed by a compressor of its own."""
    import zstandard

    data, sizes = text.encode(), []
    for k in range(0, max(1, len(data)), quality.PIECE):
        size = []
        for content in (model.good, model.bad):
            d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            size.append(len(zstandard.ZstdCompressor(level=quality.LEVEL, dict_data=d).compress(data[k : k + quality.PIECE])))
        sizes.append(size)
    g, b = map(sum, zip(*sizes))
    each = [(y - x) / (x + y) for x, y in sizes]
    x = [(b - g) / (b + g), min(each), max(each), np.log(1 + len(data)), g / (len(data) + 1), b / (len(data) + 1)]
    z = sum((v - c) / s * w for v, c, s, w in zip(x, model.centre, model.scale, model.weights)) + model.weights[-1]
    return 1 / (1 + np.exp(-z))


def test_scores_by_brute_force(spark):
    rows = [(i, t) for i, (t, _, _) in enumerate(made(250))] + [(1000, None), (1001, ""), (1002, "x"), (1003, "der die und vilexan " * 300), (None, "é" * 4000)]
    labels = spark.createDataFrame([(i, q, x) for i, (_, q, x) in enumerate(made(250))], "doc_id long, quality int, toxic int")
    df = frame(spark, rows)
    t, q = toxicity.train(df, labels), quality.train(df, labels)
    for scored, name, plain, model, limit in ((toxicity.score(df, t), "toxicity", plain_toxicity, t, 0.5), (quality.score(df, q), "quality", plain_quality, q, quality.THRESHOLD)):
        got = sorted((repr((r.doc_id, r.text)), r[f"{name}_score"], r[f"{name}_predicted"]) for r in scored.collect())
        want = sorted((repr(r), plain(model, r[1] or "")) for r in rows)
        assert [g[0] for g in got] == [w[0] for w in want]
        assert np.allclose([g[1] for g in got], [w[1] for w in want], atol=2e-4)
        assert all(g[2] == (g[1] >= limit) for g in got)


@pytest.mark.parametrize("name, label, least", [("op4_toxicity", "toxic", 0.9), ("op7_quality", "quality", 0.75)])
def test_held_out(spark, name, label, least):
    """How well labels that fitting hasn't seen are told apart; the smallest tables have few of them."""
    from lynceus.llm.queries import QUERIES

    sf = "/root/testdata/sf0.01"
    rows = QUERIES[name](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    s, y = np.array([r.score for r in rows]), np.array([r[label] for r in rows])
    assert np.mean((s[y == 1][:, None] > s[y == 0]) + 0.5 * (s[y == 1][:, None] == s[y == 0])) > least
