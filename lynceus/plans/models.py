"""Named queries about training: trees by leaves, corrections in order, folds, cross-fitted and stacked scores.

`lynceus.plans.models_sql` grows the same small trees in SQL, from the rows themselves.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lynceus.operators import boosting, crossfit
from lynceus.operators.scoring import ModelDocument, tree_scores, vector
from lynceus.plans.inventory import QUERIES
from lynceus.plans.queries import _table, query

__all__ = ["QUERIES"]

MEASURES = ["size", "lines", "digits", "capitals"]
GROWTH = boosting.Growth(rounds=1, leaves=3, rate=0.3, least_rows=5)


def labelled_measures(spark: SparkSession, sf: str) -> DataFrame:
    """Labelled documents with four whole numbers that say something about their quality."""
    t = F.coalesce("text", F.lit(""))
    docs = _table(spark, sf, "documents").select("doc_id", F.col("source").alias("grp"), F.col("lang").alias("lang"), F.least(F.expr("n_chars div 250"), F.lit(40)).cast("double").alias("size"), *[
        F.least(F.regexp_count(t, F.lit(p)), F.lit(n)).cast("double").alias(c) for c, p, n in (("lines", "\n", 20), ("digits", "[0-9]", 12), ("capitals", "[A-Z]", 60))
    ])
    return docs.join(_table(spark, sf, "labels").select("doc_id", F.col("quality").cast("int").alias("label")), "doc_id")


def _scores(rows: DataFrame, model: boosting.Boosted) -> DataFrame:
    document = ModelDocument.from_json(model.document())
    x = vector(document, known=[], more={f: F.col(f) for f in document.features})
    return rows.withColumn("raw", tree_scores(rows.sparkSession, document, x)["raw"])


@query
def leafwise_trees(spark, sf):
    """Scores by a tree of three leaves, each split where the most is gained."""
    rows = labelled_measures(spark, sf)
    return _scores(rows, boosting.train(rows, MEASURES, growth=GROWTH)).select("doc_id", F.round("raw", 6).alias("raw"))


@query
def leafwise_importance(spark, sf):
    """What each feature's splits have gained, out of the model document."""
    rows = labelled_measures(spark, sf)
    model = boosting.train(rows, MEASURES, growth=GROWTH)
    return boosting.gain_importance(model.document(), spark).select("feature", "splits", F.round("gain", 6).alias("gain"))


@query
def monotone_residual(spark, sf):
    """Corrections to given raw scores that may not fall as a text has more digits, nor rise with its size."""
    rows = labelled_measures(spark, sf).withColumn("given", F.col("doc_id") % 7 / 7.0 - 0.5)
    growth = boosting.Growth(rounds=1, leaves=3, rate=0.3, least_rows=5, monotone={"digits": 1, "size": -1})
    return _scores(rows, boosting.train(rows, MEASURES, start="given", growth=growth)).select("doc_id", F.round(F.col("given") + F.col("raw"), 6).alias("raw"))


@query
def monotone_order(spark, sf):
    """Many such corrections: how often scores of two sizes, all else equal, are in the wrong order (never), among how many."""
    rows = labelled_measures(spark, sf).withColumn("given", F.lit(0.0))
    growth = boosting.Growth(rounds=8, leaves=7, rate=0.2, least_rows=5, monotone={"digits": 1, "size": -1})
    model = boosting.train(rows, MEASURES, start="given", growth=growth)
    other = rows.select("lang", "lines", "digits", "capitals", "size").distinct()
    scored = _scores(other.where("lang IS NOT NULL"), model).groupBy("lines", "digits", "capitals", "size").agg(F.max("raw").alias("raw"))
    a, b = scored.alias("a"), scored.withColumnRenamed("size", "more").withColumnRenamed("raw", "later").alias("b")
    pairs = a.join(b, ["lines", "digits", "capitals"]).where("size < more")
    return pairs.groupBy("digits").agg(F.count(F.lit(1)).alias("pairs"), F.sum((F.col("later") > F.col("raw") + 1e-12).cast("long")).alias("wrong"))


@query
def balanced_folds(spark, sf):
    """Orders by fold: no customer is in two, and the folds are as even as the largest customer or bin allows."""
    orders = _table(spark, sf, "orders")
    folds = crossfit.balanced_folds(orders, "o_custkey", 5)
    return folds.assign(orders, F.col("o_custkey")).groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("o_custkey").alias("groups"), F.min("o_custkey").alias("least"))


@query
def cross_fitted_scores(spark, sf):
    """Three data sets that share groups: each row's score is by a model that has seen its group in none of them."""
    rows = labelled_measures(spark, sf)
    sets = {f"part {k}": rows.where(F.col("doc_id") % 3 == k) for k in range(3)}
    out = crossfit.cross_fitted(sets, MEASURES, group="grp", folds=3, growth=GROWTH)
    return out.select("doc_id", "dataset", F.col("fold").cast("int").alias("fold"), F.round("raw", 6).alias("raw"))


@query
def stacked_scores(spark, sf):
    """A second learner on the log odds of two scores, fitted on the other folds."""
    rows = labelled_measures(spark, sf).select("doc_id", "label", (F.col("doc_id") % 2).cast("int").alias("fold"), (F.col("size") / 50 + 0.05).alias("first"), (F.col("digits") / 15 + 0.1).alias("second"))
    return crossfit.stacked(rows, ["first", "second"]).select("doc_id", F.round("stack", 5).alias("stack"))
