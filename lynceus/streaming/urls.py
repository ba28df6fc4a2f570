"""Scoring as a stream: the same plan over files as they arrive, and state that outlives a batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def read_files(spark: SparkSession, path: str, schema: str, fmt: str = "parquet", files_per_batch: int = 16) -> DataFrame:
    """A stream of the files of a folder, so many at a time: a batch's memory is bounded."""
    return spark.readStream.schema(schema).format(fmt).option("maxFilesPerTrigger", files_per_batch).load(path)


def run_available(stream: DataFrame, step: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, progress: Callable[[int, int], None] | None = None) -> None:
    """Applies step to everything there is now and adds the results to a Parquet table.

    Each batch writes a folder of its own, and replaces it if the batch has to be repeated, so no row comes twice.
    """

    def write(batch: DataFrame, number: int) -> None:
        seen = Observation()
        step(batch).observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("overwrite").parquet(f"{out}/batch={number}")
        if progress:
            progress(number, seen.get["rows"])

    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def windowed_counts(stream: DataFrame, time: str = "ts", by: str = "event_type", width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts of each value in tumbling windows; windows close when the watermark has passed them."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width), by).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), by, "n")


def sessions(stream: DataFrame, key: str, time: str = "ts", gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(key, start, end, n): runs of a key's rows with no gap as long as the given one; end is the last row's time and the gap.

    Appended, a session comes when the watermark has passed its end, and rows later than that are dropped.
    """
    window = F.session_window(time, gap)
    return stream.withWatermark(time, late).groupBy(window.alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def upsert_available(stream: DataFrame, out: str, checkpoint: str, mode: str = "update") -> None:
    """Runs a stream of updates (or, in mode complete, of whole results) over everything there is now; each batch's rows go to a folder of its own, with its number."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def newest(updates: DataFrame, *keys: str) -> DataFrame:
    """The last row of each key by batch."""
    values = [c for c in updates.columns if c not in (*keys, "batch")]
    return updates.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("_v")).select(*keys, "_v.*")
