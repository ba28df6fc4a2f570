"""Running sums and quantiles of values in order, in two levels, so that no task ever orders all rows of a group.

Values are counted first, then cut into ranges with about as many values each; the ranges' sums are few, and within a
range a window does the rest. Edges come from a sketch: a poor edge makes ranges uneven, never a result wrong.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranges of a group.
RANGES = 64


def ranged(df: DataFrame, by: list[str], value: str, out: str = "_r", ranges: int = RANGES) -> DataFrame:
    """df with the number of the range that a value is in, from 0, within its group; the edges of a group are one array."""
    probabilities = F.array(*[F.lit(k / ranges) for k in range(1, ranges)])
    edges = df.groupBy(*[F.col(c).alias(f"_g_{c}") for c in by]).agg(F.percentile_approx(F.col(value).cast("double"), probabilities, F.lit(20 * ranges)).alias("_edges"))
    if by:
        same = F.lit(True)
        for c in by:
            same = same & F.col(c).eqNullSafe(F.col(f"_g_{c}"))
        rows = df.join(edges, same, "left")
    else:
        rows = df.crossJoin(F.broadcast(edges))  # one row
    place = F.size(F.filter("_edges", lambda e: e <= F.col(value).cast("double")))
    return rows.withColumn(out, F.coalesce(place, F.lit(0))).drop("_edges", *[f"_g_{c}" for c in by])


def counted(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by, value, n, upto): each different value of a group, how often it occurs, and how many are it or less; nulls are left out."""
    return running(df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("n")), by, value)


def running(counts: DataFrame, by: list[str], value: str) -> DataFrame:
    """counts, which has each different value of a group once and how often it occurs (n), with upto: how many are it or less."""
    names, counts = counts.columns, ranged(counts, by, value)
    sums = counts.groupBy(*by, "_r").agg(F.sum("n").alias("_n"))
    below = Window.partitionBy(*by).orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("_below", F.coalesce(F.sum("_n").over(below), F.lit(0))).drop("_n")  # RANGES rows a group
    within = Window.partitionBy(*by, "_r").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    rows = counts.withColumn("_upto", F.sum("n").over(within))
    joined = rows.join(sums.withColumnRenamed("_r", "_s").select(*[F.col(c).alias(f"_t_{c}") for c in by], "_s", "_below"), _same(by) & (F.col("_r") == F.col("_s")))
    return joined.select(*names, (F.col("_upto") + F.col("_below")).alias("upto"))


def _same(by: list[str]) -> Column:
    on = F.lit(True)
    for c in by:
        on = on & F.col(c).eqNullSafe(F.col(f"_t_{c}"))
    return on


def quantiles(df: DataFrame, by: list[str], value: str, probabilities: list[float], out: str = "quantiles") -> DataFrame:
    """(by, out): exact quantiles of each group with linear interpolation, as an array; groups of nulls alone have none."""
    c = counted(df, by, value)
    sizes = c.groupBy(*[F.col(k).alias(f"_t_{k}") for k in by]).agg(F.max("upto").alias("_all"))
    rows = c.join(sizes, _same(by)) if by else c.crossJoin(F.broadcast(sizes))  # one row
    x, parts = F.col(value).cast("double"), []
    for i, p in enumerate(probabilities):
        place = F.lit(p) * (F.col("_all") - 1)
        at = lambda k, i=i: F.min(F.when(F.col("upto") > k, x))
        parts += [at(F.floor(place)).alias(f"_lo{i}"), at(F.ceil(place)).alias(f"_hi{i}"), F.first(place - F.floor(place)).alias(f"_w{i}")]
    found = rows.groupBy(*by).agg(*parts)
    return found.select(*by, F.array(*[F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * F.col(f"_w{i}") for i in range(len(probabilities))]).alias(out))


def neighbour_gaps(df: DataFrame, by: list[str], value: str, out: str = "gap") -> DataFrame:
    """(by, out): what each value of a group is greater by than the one before it, the first one left out.

    Neighbours in one range meet in a window; over the ends of ranges, the least of a range follows the greatest of the last one that has any.
    """
    rows = ranged(df.where(F.col(value).isNotNull()).select(*by, value), by, value)
    order = Window.partitionBy(*by, "_r").orderBy(value)
    inside = rows.select(*by, (F.col(value) - F.lag(value).over(order)).alias(out))
    ends = rows.groupBy(*by, "_r").agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    across = ends.select(*by, (F.col("_lo") - F.lag("_hi").over(Window.partitionBy(*by).orderBy("_r"))).alias(out))
    return inside.unionByName(across).where(F.col(out).isNotNull())
