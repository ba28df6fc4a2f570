"""Training with Spark's own learners, calibration and cut-offs, and the export to a model document."""

from __future__ import annotations

import json
import math

from pyspark.ml import Pipeline
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, LogisticRegression
from pyspark.ml.feature import HashingTF, Normalizer, StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lynceus.functions.url import canonical_text
from lynceus.operators.metrics import roc_auc


def fold_of(group: Column, folds: int = 5, salt: str = "fold") -> Column:
    """A fold by a hash of the group, which so never is in two."""
    return F.pmod(F.xxhash64(group, F.lit(salt)), F.lit(folds)).cast("int")


def filled(df: DataFrame, features: list[str], missing: float = -999.0) -> DataFrame:
    """df with a vector of its features; missing values get a number that no feature has."""
    clean = [F.when(F.col(c).isNull() | F.isnan(F.col(c).cast("double")), missing).otherwise(F.col(c).cast("double")).alias(f"_f{i}") for i, c in enumerate(features)]
    rows = df.select("*", *clean)
    return VectorAssembler(inputCols=[f"_f{i}" for i in range(len(features))], outputCol="features").transform(rows).drop(*[f"_f{i}" for i in range(len(features))])


def train_trees(df: DataFrame, features: list[str], label: str = "label", weight: str | None = None, validation: str | None = None, rounds: int = 50, depth: int = 4, seed: int = 0) -> GBTClassifier:
    """Boosted trees; with a boolean column that marks validation rows, training ends when they stop improving."""
    learner = GBTClassifier(labelCol=label, featuresCol="features", maxIter=rounds, maxDepth=depth, stepSize=0.1, subsamplingRate=0.8, seed=seed)
    learner = learner.setWeightCol(weight) if weight else learner
    learner = learner.setValidationIndicatorCol(validation) if validation else learner
    return learner.fit(filled(df, features))


def train_tree(df: DataFrame, features: list[str], label: str = "label", depth: int = 6):
    return DecisionTreeClassifier(labelCol=label, maxDepth=depth).fit(filled(df, features))


def train_logistic(df: DataFrame, features: list[str], label: str = "label", strengths: tuple[float, ...] = (0.001, 0.01, 0.1), validation: Column | None = None):
    """Logistic regression on standardised features; of several strengths the one with the best validation AUC."""
    rows = filled(df, features, 0.0)
    fit_on, check = (rows.where(~validation), rows.where(validation)) if validation is not None else (rows, rows)
    best = None
    for s in strengths if validation is not None else strengths[:1]:
        model = Pipeline(stages=[StandardScaler(inputCol="features", outputCol="scaled", withMean=True), LogisticRegression(labelCol=label, featuresCol="scaled", regParam=s)]).fit(fit_on)
        auc = roc_auc(probabilities(model.transform(check)), "score", label).first()[0] if validation is not None else 0.0
        if best is None or (auc or 0) > best[0]:
            best = (auc or 0, model)
    return best[1]


def probabilities(predicted: DataFrame) -> DataFrame:
    """With score, the probability of label 1."""
    return predicted.withColumn("score", vector_to_array("probability")[1])


def char_ngrams(text: Column, low: int = 3, high: int = 5) -> Column:
    """All runs of low to high characters, repeats included."""
    none = F.array().cast("array<string>")
    return F.flatten(F.array(*[F.when(F.length(text) >= n, _grams(text, n)).otherwise(none) for n in range(low, high + 1)]))


def _grams(text: Column, n: int) -> Column:
    return F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - n + 1, F.lit(1))), lambda i: F.substring(text, i, F.lit(n)))


def train_char_ngrams(df: DataFrame, column: str, label: str = "label", buckets: int = 1 << 18, urls: bool = False):
    """Hashed, length-normalised character n-grams and logistic regression; returns a function that scores a table."""
    grams = lambda d: d.withColumn("_grams", char_ngrams(F.lower(canonical_text(F.col(column)) if urls else F.coalesce(F.col(column), F.lit("")))))
    model = Pipeline(stages=[HashingTF(inputCol="_grams", outputCol="_tf", numFeatures=buckets), Normalizer(inputCol="_tf", outputCol="features", p=2.0), LogisticRegression(labelCol=label, regParam=1e-4, maxIter=30)]).fit(grams(df))
    return lambda d: probabilities(model.transform(grams(d))).drop("_grams", "_tf", "features", "rawPrediction", "probability", "prediction")


def train_embeddings(df: DataFrame, column: str = "embedding", label: str = "label"):
    """Logistic regression on ready-made vectors; returns a function that scores a table."""
    model = LogisticRegression(labelCol=label, regParam=1e-3, maxIter=50).fit(df.withColumn("features", array_to_vector(F.col(column).cast("array<double>"))))
    return lambda d: model.transform(d.withColumn("features", array_to_vector(F.col(column).cast("array<double>")))).drop("features", "rawPrediction", "probability")


def fit_platt(df: DataFrame, raw: str = "raw", label: str = "label") -> dict:
    m = LogisticRegression(labelCol=label, regParam=0.0, maxIter=200).fit(VectorAssembler(inputCols=[raw], outputCol="features").transform(df))
    return {"type": "platt", "a": float(m.coefficients[0]), "b": float(m.intercept)}


def fit_isotonic(df: DataFrame, raw: str = "raw", label: str = "label") -> dict:
    m = IsotonicRegression(labelCol=label).fit(VectorAssembler(inputCols=[raw], outputCol="features").transform(df.withColumn(label, F.col(label).cast("double"))))
    clip = lambda v: float(min(max(v, 1e-4), 1 - 1e-4))
    return {"type": "isotonic", "x": [float(v) for v in m.boundaries], "y": [clip(v) for v in m.predictions]}


def choose_calibration(df: DataFrame, raw: str = "raw", label: str = "label", group: str = "group", folds: int = 5) -> dict:
    """Platt or isotonic, whichever has the smaller log loss over folds by group; fitted on all rows."""
    from lynceus.operators.scoring import ModelDocument, calibrated

    rows, loss = df.withColumn("_fold", fold_of(F.col(group), folds)).cache(), {"platt": 0.0, "isotonic": 0.0}
    for kind, fit in (("platt", fit_platt), ("isotonic", fit_isotonic)):
        for k in range(folds):
            c = fit(rows.where(F.col("_fold") != k), raw, label)
            p = F.greatest(F.least(calibrated(ModelDocument([], [], calibration=c), F.col(raw)), F.lit(1 - 1e-6)), F.lit(1e-6))
            loss[kind] += (rows.where(F.col("_fold") == k).agg(F.avg(-(F.col(label) * F.ln(p) + (1 - F.col(label)) * F.ln(1 - p)))).first()[0] or 0.0) / folds
    best = min(loss, key=loss.get)
    out = (fit_platt if best == "platt" else fit_isotonic)(df, raw, label)
    rows.unpersist()
    return out | {"cv_log_loss": loss}


def export(model, features: list[str], calibration: dict, thresholds: dict, base_rate: float, suffix_rates: dict | None = None, prior: float = 0.5, missing: float = -999.0) -> dict:
    """A boosted-tree model as a document; its raw score is twice the sum of the weighted trees, as the learner's log odds are."""
    trees = []
    for tree, w in zip(model.trees, model.treeWeights, strict=True):
        t: dict[str, list] = {k: [] for k in ("f", "t", "l", "r", "d", "m", "v", "lv")}

        def add(node, t=t, w=w) -> int:
            if node.subtreeDepth() == 0:
                t["lv"].append(2.0 * w * node.prediction())
                return ~(len(t["lv"]) - 1)
            i, split = len(t["f"]), node.split()
            for k, v in (("f", split.featureIndex()), ("t", split.threshold()), ("l", 0), ("r", 0), ("d", missing <= split.threshold()), ("m", 2), ("v", 2.0 * w * node.prediction())):
                t[k].append(v)
            t["l"][i] = add(node.leftChild())
            t["r"][i] = add(node.rightChild())
            return i

        add(tree._call_java("rootNode"))
        trees.append(t)
    calibration = {k: v for k, v in calibration.items() if k != "cv_log_loss"}
    return json.loads(json.dumps({"meta": {"version": 1, "calibration_base_rate": base_rate}, "features": features, "init_score": 0.0, "trees": trees, "calibration": calibration, "thresholds": thresholds, "tld_table": suffix_rates or {}, "tld_prior": prior}))


def out_of_fold(df: DataFrame, features: list[str], label: str = "label", group: str = "group", folds: int = 5, rounds: int = 10) -> DataFrame:
    """df with oof, scores by models that have not seen the row's group."""
    rows, out = df.withColumn("_fold", fold_of(F.col(group), folds)), None
    for k in range(folds):
        model = train_trees(rows.where(F.col("_fold") != k), features, label, rounds=rounds)
        part = probabilities(model.transform(filled(rows.where(F.col("_fold") == k), features))).withColumnRenamed("score", "oof").select(*df.columns, "oof")
        out = part if out is None else out.unionByName(part)
    return out


def permutation_importance(scorer, df: DataFrame, features: list[str], key: list[str], label: str = "label", seed: int = 0) -> DataFrame:
    """(feature, drop): how far the AUC falls when a feature's values are dealt among the rows anew.

    key names columns that tell rows apart. Values are dealt by two orders of its hash within parts of about 10,000 rows, so no
    task orders all rows, and a repeated task deals alike; rows with one key share their part, and are ordered by the value.
    """
    base, n = roc_auc(scorer(df), "score", label).first()[0], df.count()
    parts = max(1, n // 10_000)
    rows = df.withColumn("_b", F.pmod(F.xxhash64(*key), F.lit(parts)))
    order = lambda *salt: [F.xxhash64(*key, *[F.lit(x) for x in salt]), *key]
    out = []
    for i, name in enumerate(features):
        a = rows.withColumn("_i", F.row_number().over(Window.partitionBy("_b").orderBy(*order(), name)))
        b = rows.select("_b", F.col(name).alias("_x"), F.row_number().over(Window.partitionBy("_b").orderBy(*order(seed, i), name)).alias("_i"))
        dealt = a.join(b, ["_b", "_i"]).withColumn(name, F.col("_x")).drop("_b", "_i", "_x")
        out.append((name, float(base - roc_auc(scorer(dealt), "score", label).first()[0])))
    return df.sparkSession.createDataFrame(out, "feature string, drop double")


def forward_selection(fit, df: DataFrame, features: list[str], n: int, label: str = "label", validation: str = "validation") -> list[str]:
    """The features that, added one at a time, raise the validation AUC most; fit(rows, names) returns a scorer."""
    chosen: list[str] = []
    while len(chosen) < n:
        gains = {f: roc_auc(fit(df.where(f"NOT {validation}"), [*chosen, f])(df.where(validation)), "score", label).first()[0] or 0.0 for f in features if f not in chosen}
        chosen.append(max(gains, key=gains.get))
    return chosen


def temperature(df: DataFrame, score: str = "score", label: str = "label", rounds: int = 40) -> float:
    """The factor by which log odds are divided for the least log loss, by golden-section search."""
    p = F.greatest(F.least(F.col(score), F.lit(1 - 1e-7)), F.lit(1e-7))
    rows = df.select(F.ln(p / (1 - p)).alias("z"), F.col(label).cast("double").alias("y")).cache()
    loss = lambda t: rows.agg(F.avg(F.ln(1 + F.exp(-F.abs(F.col("z") / t))) + F.greatest(F.col("z") / t, F.lit(0.0)) - F.col("y") * F.col("z") / t)).first()[0]
    lo, hi, g = math.log(0.05), math.log(20), (math.sqrt(5) - 1) / 2
    a, b = hi - g * (hi - lo), lo + g * (hi - lo)
    fa, fb = loss(math.exp(a)), loss(math.exp(b))
    for _ in range(rounds):
        if fa < fb:
            hi, b, fb = b, a, fa
            a = hi - g * (hi - lo)
            fa = loss(math.exp(a))
        else:
            lo, a, fa = a, b, fb
            b = lo + g * (hi - lo)
            fb = loss(math.exp(b))
        if hi - lo < 1e-4:
            break
    rows.unpersist()
    return math.exp((lo + hi) / 2)


def cascade(first: Column, second: Column, low: float, high: float) -> Column:
    """The second score where the first is between the bounds, else the first."""
    return F.when(first.between(low, high), second).otherwise(first)


def standardised(df: DataFrame, features: list[str], train: Column) -> DataFrame:
    """df with its features less the training rows' mean, over their deviation (of the whole, not a sample; 1 where it is 0)."""
    stats = df.where(train).agg(*[x for f in features for x in (F.avg(f).alias(f"_m_{f}"), F.stddev_pop(f).alias(f"_s_{f}"))])
    rows = df.crossJoin(F.broadcast(stats))  # one row
    scaled = {f: (F.col(f) - F.col(f"_m_{f}")) / F.when(F.col(f"_s_{f}") > 0, F.col(f"_s_{f}")).otherwise(1.0) for f in features}
    return rows.withColumns(scaled).drop(*[f"_{k}_{f}" for f in features for k in "ms"])


def shifted_log_odds(raw: Column, trained_rate: float, rate: float) -> Column:
    """Log odds learned at one base rate, at another."""
    odds = lambda p: math.log(p / (1 - p))
    return raw + F.lit(odds(rate) - odds(trained_rate))
