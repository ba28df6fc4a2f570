"""The look-up cache: an append-only log of (k, t, v) in which a key's last line counts while it is young enough.

A cache is a folder of data folders, which tasks write, and of a log of numbered entries, which say which of them count and
in which order. Several processes may read it and add to it at a time.
"""

from __future__ import annotations

import json
import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_log(spark: SparkSession, path: str | list[str], value_schema: str) -> DataFrame:
    """(k, t, v, file, line) of JSON lines; torn or foreign lines are skipped."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("line"))
    j = F.from_json("value", f"k string, t double, v struct<{value_schema}>", {"mode": "PERMISSIVE"})
    return lines.select(j.alias("j"), "file", "line").where("j.k IS NOT NULL AND j.t IS NOT NULL AND j.v IS NOT NULL").select("j.k", "j.t", "j.v", "file", "line")


def last_written(log: DataFrame, order: Column | None = None) -> DataFrame:
    """(k, t, v): the last line of each key in file order, whatever its time says."""
    order = F.struct("file", "line") if order is None else order
    return log.groupBy("k").agg(F.max_by(F.struct("t", "v"), order).alias("_r")).select("k", "_r.t", "_r.v")


def fresh(cache: DataFrame, now: float, ttl_days: float) -> DataFrame:
    """The entries that are young enough."""
    return cache.where(F.lit(float(now)) - F.col("t") <= ttl_days * 86_400)


def append(facts: DataFrame, path: str, key: str, status: str, keep: tuple[str, ...], now: float) -> int:
    """Adds facts with a status worth keeping to the cache in a folder, in one step, and returns its new version; see `commit`."""
    rows = facts.where(F.col(status).isin(*keep))
    folder = f"data-{uuid.uuid4().hex}"
    rows.select(F.to_json(F.struct(F.col(key).alias("k"), F.lit(float(now)).alias("t"), F.struct(*rows.columns).alias("v"))).alias("value")).write.text(f"{path}/{folder}")
    return commit(facts.sparkSession, path, {"add": folder})


def commit(spark: SparkSession, path: str, entry: dict) -> int:
    """Writes the next entry of the cache's log and returns its number.

    An entry is a file with a number for its name that must not exist yet. Of two writers that reach for one number, one gets it
    and the other takes the next, so both count, whichever processes they are in. Data folders that no entry names don't exist for readers.
    """
    while True:
        number = max((n for n, _ in _entries(spark, path)), default=0) + 1
        if "remove" in entry:
            there = {e["add"] for _, e in _state(spark, path)}
            if not set(entry["remove"]) <= there:
                raise CacheConflict(f"{path} was compacted by another process")
        if _create(spark, f"{path}/_log/{number:012d}.json", json.dumps(entry).encode()):
            return number


class CacheConflict(RuntimeError):
    """What an entry removes is gone already."""


def _create(spark: SparkSession, path: str, data: bytes) -> bool:
    """Whether this process has made the file; no other can have made it too, and nobody sees half of it."""
    jvm = spark._jvm.org.apache.hadoop.fs
    fs, whole = jvm.Path(path).getFileSystem(spark._jsc.hadoopConfiguration()), jvm.Path(f"{path}.{uuid.uuid4().hex}.part")
    out = fs.create(whole)
    out.write(bytearray(data))
    out.close()
    try:
        if fs.getUri().getScheme() == "file":  # a local rename replaces; a link doesn't
            try:
                os.link(whole.toUri().getPath(), jvm.Path(path).toUri().getPath())
                return True
            except FileExistsError:
                return False
        return fs.rename(whole, jvm.Path(path)) and not fs.exists(whole)
    finally:
        fs.delete(whole, False)


def _entries(spark: SparkSession, path: str) -> list[tuple[int, str]]:
    """(number, file) of the log's entries in order."""
    jvm = spark._jvm.org.apache.hadoop.fs
    found = jvm.Path(path).getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(jvm.Path(f"{path}/_log/*.json"))
    names = [f.getPath().toString() for f in found] if found is not None else []
    return sorted((int(n.rpartition("/")[2].removesuffix(".json")), n) for n in names)


def _state(spark: SparkSession, path: str) -> list[tuple[int, dict]]:
    """(order, entry) of the data folders that count, each read in its place; a compacted one stands where the last that it holds stood."""
    files = dict((name, n) for n, name in _entries(spark, path))
    if not files:
        return []
    out: dict[str, tuple[int, dict]] = {}
    for r in sorted(spark.read.text(list(files), wholetext=True).select("value", F.col("_metadata.file_name").alias("name")).collect(), key=lambda r: r.name):  # one row an entry
        entry = json.loads(r.value)
        for gone in entry.get("remove", ()):
            out.pop(gone, None)
        out[entry["add"]] = (entry.get("as_of", int(r.name.removesuffix(".json"))), entry)
    return sorted(out.values(), key=lambda x: x[0])


def snapshot(spark: SparkSession, path: str, value_schema: str) -> DataFrame:
    """(k, t, v) of the cache in a folder as it stands now: the last line of each key by the order of the log; empty if there is none."""
    state = _state(spark, path)
    if not state:
        return spark.createDataFrame([], f"k string, t double, v struct<{value_schema}>")
    log = read_log(spark, [f"{path}/{e['add']}" for _, e in state], value_schema)
    folder = F.regexp_extract("file", "(data-[0-9a-f]+)/[^/]*$", 1)
    places = spark.createDataFrame([(e["add"], n) for n, e in state], "_folder string, _place long")  # as many as entries
    log = log.withColumn("_folder", folder).join(F.broadcast(places), "_folder")
    return last_written(log, F.struct("_place", "file", "line"))


def compact(spark: SparkSession, path: str, value_schema: str, now: float | None = None, ttl_days: float | None = None) -> int:
    """Replaces what the cache holds now by the last line of each key (that is young enough, if a time is given).

    Entries that others add meanwhile stay, and count after it. A second compaction at the same time ends in CacheConflict.
    """
    state = _state(spark, path)
    if not state:
        return 0
    rows = snapshot(spark, path, value_schema)
    rows = fresh(rows, now, ttl_days) if now is not None and ttl_days is not None else rows
    folder = f"data-{uuid.uuid4().hex}"
    rows.select(F.to_json(F.struct("k", "t", "v")).alias("value")).write.text(f"{path}/{folder}")
    return commit(spark, path, {"add": folder, "remove": [e["add"] for _, e in state], "as_of": state[-1][0]})
