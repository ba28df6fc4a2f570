"""Reputation of suffixes: rates shrunk towards their last label's and those towards the whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lynceus.functions.suffix import SuffixRules
from lynceus.functions.text import bucket


def last_label(suffix: Column) -> Column:
    return F.substring_index(suffix, ".", -1)


def suffix_rates(df: DataFrame, suffix: str = "tld", label: str = "label", m: float = 20.0) -> DataFrame:
    """(suffix, rate, prior) for every suffix and every last label; a whole suffix overrides a label of its name.

    rate is (positives + m * parent's rate) / (rows + m).
    """
    s = df.groupBy(F.coalesce(F.col(suffix), F.lit("")).alias("suffix")).agg(F.sum(F.col(label).cast("double")).alias("y"), F.count(F.lit(1)).alias("n"))
    prior = F.broadcast(s.agg((F.sum("y") / F.sum("n")).alias("prior")))  # one row
    top = s.groupBy(last_label(F.col("suffix")).alias("top")).agg(F.sum("y").alias("ty"), F.sum("n").alias("tn")).crossJoin(prior)
    top = top.withColumn("parent", (F.col("ty") + m * F.col("prior")) / (F.col("tn") + m)).select("top", "parent", "prior")
    full = s.withColumn("top", last_label(F.col("suffix"))).join(top, "top")
    full = full.select("suffix", ((F.col("y") + m * F.col("parent")) / (F.col("n") + m)).alias("rate"), "prior")
    labels = top.select(F.col("top").alias("suffix"), F.col("parent").alias("rate"), "prior").join(full.select("suffix"), "suffix", "left_anti")
    return full.unionByName(labels)


def publishable(rates: DataFrame, df: DataFrame, rules: SuffixRules, suffix: str = "tld", group: str = "group") -> DataFrame:
    """rates without suffixes that stand for a single site: bare labels, literal rules and those of two groups or more stay."""
    literal = [name for kind, name in rules.rules if kind == "normal"]
    named = df.sparkSession.createDataFrame([(n,) for n in literal], "suffix string")
    sites = df.groupBy(F.coalesce(F.col(suffix), F.lit("")).alias("suffix")).agg(F.countDistinct(group).alias("_sites")).where("_sites >= 2").select("suffix")
    known = named.unionByName(sites).distinct().withColumn("_ok", F.lit(True))
    return rates.join(known, "suffix", "left").where(F.col("_ok") | ~F.contains("suffix", F.lit("."))).drop("_ok")


def out_of_fold_rates(df: DataFrame, group: Column, folds: int = 5, suffix: str = "tld", label: str = "label", strength: float = 20.0, salt: str = "fold") -> DataFrame:
    """df with fold and rate: the smoothed rate of the row's suffix, learned only from rows of other folds.

    A group is never in two folds. Sums by suffix and fold are taken once; what another fold would have
    learned is the whole less its own, so the encoder is refitted for every fold without another pass over the rows.
    A suffix that the other folds don't have gets their overall rate.
    """
    rows = df.withColumn("fold", bucket(group, salt) % folds)
    cells = rows.groupBy(suffix, "fold").agg(F.sum(label).alias("_y"), F.count(F.lit(1)).alias("_n"))
    of = lambda by, name: cells.groupBy(*by).agg(F.sum("_y").alias(f"{name}y"), F.sum("_n").alias(f"{name}n"))
    every = of([], "_a").crossJoin(of(["fold"], "_f"))  # one row for each fold
    prior = every.select("fold", ((F.col("_ay") - F.col("_fy")) / F.nullif(F.col("_an") - F.col("_fn"), F.lit(0))).alias("_prior"))
    rates = cells.join(of([suffix], "_s"), suffix).join(F.broadcast(prior), "fold")
    rates = rates.select(F.col(suffix).alias("_k"), F.col("fold").alias("_kf"), ((F.col("_sy") - F.col("_y") + strength * F.col("_prior")) / (F.col("_sn") - F.col("_n") + strength)).alias("rate"))
    return rows.join(rates, (F.col(suffix) == F.col("_k")) & (F.col("fold") == F.col("_kf")), "left").drop("_k", "_kf")
