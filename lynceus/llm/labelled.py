"""A bounded sample of labelled documents to fit a classifier on, and small numeric helpers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(doc_id: Column) -> Column:
    """The fold that fitting never sees: crc32 of the id as text is 0 modulo 5. False for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int) -> list[tuple[str, int]]:
    """(text, label) of about per_class labelled documents of each class outside the held-out fold.

    Labels are drawn by a hash of the id, so the draw doesn't depend on partitions; as it is bounded, it may
    be broadcast and brought to the driver. Rows with a null id or label are no labels; null texts are empty.
    """
    rows = labels.select(F.col("doc_id").alias("_id"), F.col(label).cast("int").alias("_y")).where(F.col("_y").isin(0, 1) & F.col("_id").isNotNull() & ~held_out(F.col("_id")))
    sizes = dict(rows.groupBy("_y").count().collect())
    share = F.lit(0)
    for y, n in sizes.items():
        share = F.when(F.col("_y") == y, int(min(1.0, per_class / n) * (1 << 30))).otherwise(share)
    drawn = rows.where(F.pmod(F.xxhash64("_id", F.lit(7)), F.lit(1 << 30)) < share).distinct().limit(3 * per_class)
    found = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(drawn), F.col("doc_id") == F.col("_id"))
    return [(r.text, r._y) for r in found.select("text", "_y", F.xxhash64("_id", F.lit(8)).alias("_o")).orderBy("_o", "text").limit(6 * per_class).select("text", "_y").collect()]


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, ridge: float = 1e-2, rounds: int = 30) -> np.ndarray:
    """Coefficients, the constant last, of a ridge logistic regression by Newton's method."""
    a = np.c_[x, np.ones(len(x))]
    w, v = np.zeros(a.shape[1]), np.ones(len(a)) if weight is None else weight
    for _ in range(rounds):
        p = sigmoid(a @ w)
        hessian = (a * (v * p * (1 - p))[:, None]).T @ a + ridge * np.eye(len(w))
        w -= np.linalg.solve(hessian, a.T @ (v * (p - y)) + ridge * w)
    return w
