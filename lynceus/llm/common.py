"""Shared plumbing: the shared folder, lineage cuts, and joins that survive hot keys."""

from __future__ import annotations

import math
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key counts as hot from this share of all rows on, so at most this many keys are hot.
MAX_HOT_KEYS = 10_000
#: Below this many rows a key is never hot.
MIN_HOT_ROWS = 100


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a local master may do without it."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='lynceus-')}"
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other run uses."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def table(df: DataFrame, name: str) -> DataFrame:
    """Writes df once as Parquet in the shared folder and reads it back; this cuts its lineage."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables that `table` wrote and nothing reads any more."""
    for t in tables:
        jpath = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t._written_at)
        jpath.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(jpath, True)


def path_exists(spark: SparkSession, path: str) -> bool:
    """Asks Hadoop's file system, so that any store Spark reads will do."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jpath)


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z and nothing else; texts that are all ASCII take the faster way."""
    other = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(other)


def small(df: DataFrame, rows: int) -> DataFrame:
    """df, to be broadcast if it has at most so many rows; otherwise as it is, for a shuffled join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def hot_keys(stats: DataFrame, key: str) -> DataFrame:
    """The rows of stats (unique by key, with a column n of rows per key) whose key is hot.

    With N rows in all, n >= max(MIN_HOT_ROWS, N / MAX_HOT_KEYS) holds for at most MAX_HOT_KEYS keys
    (or N / MIN_HOT_ROWS of them where N is small, which is no more), so the result may be broadcast.
    """
    total = stats.agg(F.sum("n")).first()[0] or 0
    return stats.where(F.col("n") >= max(MIN_HOT_ROWS, math.ceil(total / MAX_HOT_KEYS)))


def lookup(rows: DataFrame, stats: DataFrame, key: str, spread: Column) -> DataFrame:
    """Adds the columns of stats to every row of rows by key; like a left join, but no key's rows meet in one task.

    stats is unique by key and has n, the number of rows with the key (n isn't added). Hot keys, of which
    there is a proven maximum, come by broadcast and the others by a shuffled join, in which a row with a hot
    key goes anywhere: spread says where. stats should be cheap to read, such as a written table. Rows with
    a null key get nulls.
    """
    values = [c for c in stats.columns if c not in (key, "n")]
    hot = hot_keys(stats, key).select(F.col(key).alias("_hk"), *[F.col(c).alias(f"_h_{c}") for c in values])
    cold = stats.join(F.broadcast(hot.select("_hk")), F.col(key) == F.col("_hk"), "left_anti")
    cold = cold.select(F.col(key).alias("_ck"), F.lit(-1).alias("_cs"), *[F.col(c).alias(f"_c_{c}") for c in values])
    out = rows.join(F.broadcast(hot), F.col(key) == F.col("_hk"), "left")
    loose = F.col("_hk").isNotNull() | F.col(key).isNull()
    out = out.withColumn("_s", F.when(loose, F.pmod(spread, F.lit(1 << 20)).cast("int")).otherwise(F.lit(-1)))
    out = out.join(cold, (F.col(key) == F.col("_ck")) & (F.col("_s") == F.col("_cs")), "left")
    keep = [F.col(f"`{c}`") for c in rows.columns]
    return out.select(*keep, *[F.coalesce(f"_h_{c}", f"_c_{c}").alias(c) for c in values])


def matched(rows: DataFrame, stats: DataFrame, key: str) -> DataFrame:
    """The inner join of rows with stats by key (n isn't added), in which no key's rows meet in one task.

    stats is as for `lookup`. Rows with hot keys never leave their tasks; the others are joined by a shuffle.
    """
    hot = F.broadcast(hot_keys(stats, key).drop("n"))
    seldom = stats.join(hot.select(key), key, "left_anti").drop("n")
    return rows.join(hot, key).unionByName(rows.join(hot.select(key), key, "left_anti").join(seldom, key))
