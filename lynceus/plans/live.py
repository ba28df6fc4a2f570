"""Named queries about streams with state, their progress, and sources read as they grow."""

from __future__ import annotations

import gzip
import json
import posixpath
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from lynceus.operators.scoring import score_urls
from lynceus.operators.toy import offline_model
from lynceus.plans.inventory import _made_up
from lynceus.plans.lookups import looking_up
from lynceus.plans.models import QUERIES
from lynceus.plans.queries import _pages, _table, query
from lynceus.sources import cache, feeds, remote
from lynceus.sources.folder import kept, shared_folder
from lynceus.streaming import facts, progress
from lynceus.streaming import urls as streams

__all__ = ["QUERIES"]

#: For how long a user's fact counts, on the clock of the events.
TTL = 5 * 86_400
FACT = StructType([StructField("fact", LongType())])


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def made_up(user: int, at: float) -> dict:
    """A look-up whose answer tells when it was made."""
    return {"fact": (user * 7 + int(at)) % 1_000_003}


def _thirds(spark: SparkSession, sf: str) -> list[DataFrame]:
    """All events in three parts, the earliest first."""
    events = _table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    a, b = events.agg(F.percentile_approx(F.unix_micros("ts"), [1 / 3, 2 / 3])).first()[0]
    at = F.unix_micros("ts")
    return [events.where(at <= a), events.where((at > a) & (at <= b)), events.where(at > b)]


@query
def stream_ttl_state(spark, sf):
    """Events with their user's fact: asked for once, reused by later events, in later batches and after restarts too, expired and asked for again."""
    path, out = _folder(spark, "arrivals"), _folder(spark, "facts")
    for part in _thirds(spark, sf):  # the stream stops after each and goes on from its checkpoint
        part.select("event_id", "user_id", "ts").write.mode("append").parquet(path)
        stream = spark.readStream.schema("event_id long, user_id long, ts timestamp").parquet(path)
        streams.upsert_available(facts.with_facts(stream, "user_id", "ts", made_up, FACT, TTL), f"{out}/t", f"{out}/c", "append")
    rows = spark.read.parquet(f"{out}/t")
    return rows.select("event_id", "user_id", "fact", F.col("asked").cast("long").alias("asked"), "reused")


@query
def stream_progress(spark, sf):
    """What a stream of all events told of its batches: together they have read every row once."""
    out = _folder(spark, "progress")
    stream = streams.read_files(spark, f"{sf}/events*", _table(spark, sf, "events").schema, files_per_batch=1)
    with progress.ProgressTable(spark, f"{out}/p") as told:
        streams.run_available(stream.select("event_type"), lambda b: b.groupBy("event_type").count(), f"{out}/t", f"{out}/c")
    rows = spark.read.parquet(f"{out}/t").groupBy().agg(F.sum("count").alias("counted"))
    return told.table().agg(F.sum("rows_read").alias("rows_read"), F.max("late_rows").alias("late")).crossJoin(rows)  # one row each


@query
def stream_sessions(spark, sf):
    """Sessions of users in a stream of three arrivals; whole results, so open sessions are there too."""
    path, out = _folder(spark, "arrivals"), _folder(spark, "sessions")
    for part in _thirds(spark, sf):
        part.select("user_id", "ts").write.mode("append").parquet(path)
        stream = spark.readStream.schema("user_id long, ts timestamp").parquet(path)
        streams.upsert_available(streams.sessions(stream, "user_id", gap="6 hours 7 seconds"), f"{out}/t", f"{out}/c", "complete")
    rows = spark.read.parquet(f"{out}/t")
    last = rows.agg(F.max("batch").alias("last"))
    rows = rows.join(F.broadcast(last), F.col("batch") == F.col("last"))  # one row
    return rows.select("user_id", F.unix_seconds("start").alias("start"), (F.unix_seconds("end") - 21_607).alias("stop"), "n")


def _store(path: str):
    """(file system, path) of any store that Arrow reads."""
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(path)


def read_range(url: str, offset: int, length: int) -> bytes:
    """A transport: the bytes of a range of a file in the shared folder."""
    fs, path = _store(url)
    with fs.open_input_file(path) as f:
        data = f.read_at(length, offset)
    if len(data) != length:
        raise OSError("CutOff")
    return data


BROKEN: set = set()


def cut_once(url: str, offset: int, length: int) -> bytes:
    """The same, but the first answer for every third block is cut off."""
    data = read_range(url, offset, length)
    if offset % 3 == 0 and (url, offset) not in BROKEN:
        BROKEN.add((url, offset))
        return data[: length // 2]
    return data


def write_blocks(captures: DataFrame, path: str, per_block: int = 40) -> DataFrame:
    """Lines (key, value) as files of gzip members, a block each, written by tasks; returns the index (key, file, offset, length).

    Files of a task that is repeated have other names, and the index, which is written once, knows only one of them.
    """

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name, offset, index = f"{uuid.uuid4().hex}.gz", 0, []
        fs, root = _store(path)
        fs.create_dir(root, recursive=True)
        with fs.open_output_stream(posixpath.join(root, name), compression=None) as f:
            for b in batches:
                for k in range(0, len(b), per_block):
                    part = b.iloc[k : k + per_block]
                    data = gzip.compress("\n".join(part["value"]).encode(), mtime=0)
                    f.write(data)
                    index.append((part["key"].iloc[0], name, offset, len(data)))
                    offset += len(data)
        yield pd.DataFrame(index, columns=["key", "file", "offset", "length"])

    ranged = captures.repartitionByRange("key").sortWithinPartitions("key", "value")
    return kept(ranged.mapInPandas(write, "key string, file string, offset long, length long"), "block-index")[0]


@query
def capture_blocks(spark, sf):
    """All blocks of a capture index made from the pages, fetched by byte ranges; every third answer is cut off at first."""
    host = F.regexp_extract("url", "^[a-z]+://([^/?#]+)", 1)
    line = F.concat(host, F.lit(" 20260101 "), F.to_json(F.struct("url", F.when(F.col("page_id") % 4 == 0, "404").otherwise("200").alias("status"), F.lit("text/html").alias("mime"))))
    path = _folder(spark, "blocks")
    index = write_blocks(_pages(spark, sf).select(host.alias("key"), line.alias("value")), path)
    spark.dataSource.register(remote.block_source(cut_once))
    rows = spark.read.format("capture_blocks").option("blocks", remote.sample_blocks(index, index.count())).option("base", f"{path}/").option("wait", "0.01").load()
    found = feeds.captures(rows.where("failure IS NULL"))
    return found.groupBy("surt", "status").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("url").alias("urls"))


def _pages_of_days(spark: SparkSession, sf: str, path: str, size: int = 100) -> None:
    """An API's answers, made from the events: for each day its pages, which repeat the last event of the page before."""
    e = _table(spark, sf, "events").select(F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd").alias("day"), "event_id", "user_id")
    e = e.withColumn("k", F.pmod(F.xxhash64("event_id"), F.lit(1 << 30)))
    sizes = e.groupBy("day").agg(F.count(F.lit(1)).alias("n"))
    part = F.floor(F.col("k") * F.ceil(F.col("n") / size) / (1 << 30)).cast("int")
    dealt = e.join(F.broadcast(sizes), "day").withColumn("page", part)  # a row a day
    value = F.to_json(F.struct("event_id", "user_id"))
    again = dealt.where("event_id % 10 = 0 AND page > 0").withColumn("page", F.col("page") - 1)
    both = dealt.unionByName(again).withColumn("last", F.ceil(F.col("n") / size).cast("int") - 1)
    both.select("day", F.col("page"), F.concat_ws("\t", F.col("last").cast("string"), value).alias("value")).repartition("day", "page").write.partitionBy("day", "page").text(path)


def _answer(path: str, broken: str | None = None):
    """The API: a day's page from the folder, and whether there are more; one day can't be had."""

    def fetch(day: str, page: int) -> tuple[list[str], bool]:
        from pyarrow.fs import FileSelector

        if day == broken:
            raise ConnectionError(day)
        fs, root = _store(path)
        files = fs.get_file_info(FileSelector(posixpath.join(root, f"day={day}", f"page={page}"), allow_not_found=True))
        lines = [x for f in files if f.is_file and not f.base_name.startswith((".", "_")) for x in fs.open_input_stream(f.path).read().decode().split("\n") if x]
        if not lines:
            last = [int(f.base_name.partition("=")[2]) for f in fs.get_file_info(FileSelector(posixpath.join(root, f"day={day}"), allow_not_found=True)) if "page=" in f.base_name]
            return [], bool(last) and page < max(last)
        return [x.partition("\t")[2] for x in lines], page < int(lines[0].partition("\t")[0])

    return fetch


@query
def day_pull_stream(spark, sf):
    """An API pulled day by day as a stream that breaks off in the middle, and goes on where it was; the first event of each user."""
    path, out = _folder(spark, "days"), _folder(spark, "pulled")
    _pages_of_days(spark, sf, path)
    first, last = _table(spark, sf, "events").agg(F.min(F.to_date("ts")), F.max(F.to_date("ts"))).first()
    middle, end = first + (last - first) / 2, last + pd.Timedelta(days=1)

    def pull(until, broken: str | None) -> None:
        spark.dataSource.register(remote.day_source(_answer(path, broken)))
        stream = spark.readStream.format("days").option("since", first.isoformat()).option("until", str(until)[:10]).option("wait", "0.01").load()
        streams.upsert_available(stream, f"{out}/t", f"{out}/c", "append")

    pull(middle, None)
    try:
        pull(end, last.isoformat())
    except Exception:  # the day that can't be had stops the stream, and nothing of its batch counts
        pass
    pull(end, None)
    rows = spark.read.parquet(f"{out}/t")
    e = F.from_json("value", "event_id long, user_id long")
    rows = rows.select("day", e["event_id"].alias("event_id"), e["user_id"].alias("user_id"))
    return remote.first_of(rows, F.col("user_id"), [F.col("event_id")]).select("user_id", "event_id", "day")


def index_answer(url: str, accept: str) -> tuple[int, str, float]:
    """A capture index whose answers tell what was asked; it has nothing for some domains, and is down for others."""
    from urllib.parse import parse_qs, urlsplit

    domain = parse_qs(urlsplit(url).query)["url"][0]
    if len(domain) % 5 == 0:
        return 404, "", 0.0
    if len(domain) % 5 == 1:
        raise ConnectionError
    return 200, "\n".join(json.dumps({"url": f"http://{domain}/{k}", "status": "200", "mime": "text/html", "timestamp": "20260101"}) for k in range(len(domain) % 5)) + "\n", 0.0


@query
def capture_index(spark, sf):
    """What a capture index has for each of the pages' hosts."""
    host = F.regexp_extract("url", "^[a-z]+://([^/?#]+)", 1)
    found = remote.captures_of(_pages(spark, sf).select(host.alias("domain")), "https://index.example/x-index", fetch=index_answer, per_second=10_000.0)
    return found.groupBy("domain", "status").agg(F.count("url").alias("n"))


def _silent(url: str, accept: str) -> tuple[int, str, float]:
    raise ConnectionError(url)


@query
def lookups_kept(spark, sf):
    """Facts of a second run that can ask nobody: what the first run's answers left in the cache, and no more."""
    folder, now = _folder(spark, "cache"), 1_735_689_600.0
    scored = score_urls(_pages(spark, sf), offline_model()).withColumn("list_kind", F.lit(None).cast("string"))
    looking_up("all", "url", _made_up, now, folder, 10_000.0)(scored)
    dns, _ = looking_up("all", "url", _silent, now + 86_400, folder, 10_000.0)(scored)
    return dns.select("host", "a_status")


@query
def cache_log(spark, sf):
    """A cache that is added to twice, compacted, and added to again: the last line of each key."""
    folder = _folder(spark, "log")
    e = _table(spark, sf, "events").select(F.col("user_id").cast("string").alias("host"), F.lit("ok").alias("status"), "event_id")
    last = lambda rows: rows.groupBy("host", "status").agg(F.max("event_id").alias("event_id"))
    for k in (0, 1):
        cache.append(last(e.where(F.col("event_id") % 4 == k)), folder, "host", "status", ("ok",), 1.0 + k)
    cache.compact(spark, folder, "host: string, status: string, event_id: bigint")
    cache.append(last(e.where(F.col("event_id") % 4 == 2)), folder, "host", "status", ("ok",), 3.0)
    found = cache.snapshot(spark, folder, "host: string, status: string, event_id: bigint")
    return found.select("k", "t", F.col("v.event_id").alias("event_id"))
