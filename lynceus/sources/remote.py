"""Remote sources as Spark data sources: blocks of capture indexes by byte ranges, and an API pulled day by day.

The transport is a function that tests and closed networks replace. It is part of the source's class, so sources are made by
`block_source` and `day_source`, registered once a session and read by name:

    spark.dataSource.register(block_source(fetch)); spark.read.format("capture_blocks").option("blocks", ...).load()
"""

from __future__ import annotations

import json
import time
import zlib
from collections.abc import Callable, Iterator
from datetime import date, timedelta
from urllib.parse import urlencode

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from lynceus.sources.lookup import Fetch, answers, http_get

RETRIES = 4
BLOCK_ROWS = "file string, offset long, line long, value string, failure string"
DAY_ROWS = "day string, page int, value string, failure string"
#: What a transport raises for a request that may be tried again.
FAULTS = (OSError, EOFError, ValueError, zlib.error)


def http_range(url: str, offset: int, length: int, timeout: float = 60.0) -> bytes:
    """The bytes of a range of a remote file; raises OSError where they can't be had whole."""
    import http.client
    import urllib.request

    request = urllib.request.Request(url, headers={"Range": f"bytes={offset}-{offset + length - 1}"})
    try:
        with urllib.request.urlopen(request, timeout=timeout) as r:
            data = r.read()
    except http.client.HTTPException as e:
        raise OSError(type(e).__name__) from e
    if len(data) != length:
        raise OSError("CutOff")
    return data


def members(data: bytes) -> Iterator[bytes]:
    """The contents of gzip members that stand one after the other; raises EOFError if the last is cut off."""
    while data:
        d = zlib.decompressobj(31)
        yield d.decompress(data) + d.flush()
        if not d.eof:
            raise EOFError("a gzip member is cut off")
        data = d.unused_data


def tried(call: Callable[[], object], wait: float, sleep: Callable[[float], None] = time.sleep) -> tuple[object, str | None]:
    """(result, None), or (None, the kind of the last fault) after RETRIES tries, each after a longer wait."""
    failure = None
    for turn in range(RETRIES):
        if turn:
            sleep(wait * turn)
        try:
            return call(), None
        except FAULTS as e:
            failure = type(e).__name__
    return None, failure


def sample_blocks(index: DataFrame, n: int, seed: int = 0) -> str:
    """n blocks of an index (file, offset, length), drawn by a hash and so the same in every run, as the option of the source.

    n bounds what comes to the driver; all of an index is drawn by an n that is as large.
    """
    rows = index.select("file", "offset", "length").orderBy(F.xxhash64("file", "offset", F.lit(seed)), "file", "offset").limit(n).collect()
    return json.dumps(sorted([r.file, r.offset, r.length] for r in rows))


class _Blocks(InputPartition):
    def __init__(self, blocks: list):
        super().__init__(0)
        self.blocks = blocks


class _BlockReader(DataSourceReader):
    def __init__(self, options: dict, fetch: Callable[[str, int, int], bytes]):
        self.blocks, self.base, self.fetch = json.loads(options["blocks"]), options.get("base", ""), fetch
        self.tasks, self.wait = int(options.get("tasks", 64)), float(options.get("wait", 1.0))

    def partitions(self) -> list[InputPartition]:
        n = max(1, min(self.tasks, len(self.blocks)))
        return [_Blocks(self.blocks[k::n]) for k in range(n)]

    def read(self, partition: _Blocks) -> Iterator[tuple]:
        for file, offset, length in partition.blocks:
            lines, failure = tried(lambda f=file, o=offset, n=length: [x for m in members(self.fetch(self.base + f, o, n)) for x in m.decode("utf-8", "replace").split("\n") if x], self.wait)
            if failure:
                yield file, offset, None, None, failure
            for k, value in enumerate(lines or ()):
                yield file, offset, k, value, None


def block_source(fetch: Callable[[str, int, int], bytes] = http_range) -> type[DataSource]:
    """The source capture_blocks: a row for each line of the blocks, and one with a failure for a block that can't be had.

    fetch gives (file, offset, length)'s bytes, gzip members. Options: blocks (as sample_blocks gives), base (before each file's
    name), tasks (at most so many read at a time, 64), wait (seconds before a second try, 1).
    """

    class CaptureBlocks(DataSource):
        @classmethod
        def name(cls) -> str:
            return "capture_blocks"

        def schema(self) -> str:
            return BLOCK_ROWS

        def reader(self, schema) -> DataSourceReader:
            return _BlockReader(self.options, fetch)

    return CaptureBlocks


class _Day(InputPartition):
    def __init__(self, day: str):
        super().__init__(day)
        self.day = day


class _Days:
    """Days from since on, until the day before until; a task each."""

    def __init__(self, options: dict, fetch: Callable[[str, int], tuple[list[str], bool]]):
        self.since, self.until = (date.fromisoformat(options[k]) for k in ("since", "until"))
        self.fetch, self.wait = fetch, float(options.get("wait", 1.0))

    def between(self, first: date, end: date) -> list[InputPartition]:
        return [_Day((first + timedelta(k)).isoformat()) for k in range((end - first).days)]

    def pages(self, day: str, strict: bool) -> Iterator[tuple]:
        page, more = 0, True
        while more:
            got, failure = tried(lambda p=page: self.fetch(day, p), self.wait)
            if failure:
                if strict:  # a stream stops here, and asks for the whole day again when it goes on
                    raise OSError(f"page {page} of {day}: {failure}")
                yield day, page, None, failure
                return
            values, more = got
            for v in values:
                yield day, page, v, None
            page += 1


class _DayReader(_Days, DataSourceReader):
    def partitions(self) -> list[InputPartition]:
        return self.between(self.since, self.until)

    def read(self, partition: _Day) -> Iterator[tuple]:
        return self.pages(partition.day, False)


class _DayStream(_Days, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {"day": self.since.isoformat()}

    def latestOffset(self) -> dict:
        return {"day": max(self.since, self.until).isoformat()}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return self.between(*(date.fromisoformat(x["day"]) for x in (start, end)))

    def read(self, partition: _Day) -> Iterator[tuple]:
        return self.pages(partition.day, True)

    def commit(self, end: dict) -> None:
        pass


def day_source(fetch: Callable[[str, int], tuple[list[str], bool]]) -> type[DataSource]:
    """The source days: a row for each value of each page of each day, for reading once or as a stream whose offset is the day.

    fetch gives (day, page)'s values, and whether there are more pages. Options: since and until (days; until itself isn't
    read), wait (seconds before a second try). Read once, a day that can't be had ends with a row that has a failure; a
    stream stops, keeps the days of the batches before, and goes on from there when it is started again.
    """

    class Days(DataSource):
        @classmethod
        def name(cls) -> str:
            return "days"

        def schema(self) -> str:
            return DAY_ROWS

        def reader(self, schema) -> DataSourceReader:
            return _DayReader(self.options, fetch)

        def streamReader(self, schema) -> DataSourceStreamReader:
            return _DayStream(self.options, fetch)

    return Days


def captures_of(domains: DataFrame, index: str, limit: int = 100, fetch: Fetch = http_get, per_second: float = 2.5, tasks: int = 4) -> DataFrame:
    """(domain, status, url, http_status, mime, time) of a capture index that is asked for each domain; domains has domain.

    status is ok, no_captures (the index has none) or failed; of those two, and of an answer without captures, there is one row without a url. A domain is asked for
    once however often it stands there; null domains are left out. Each of the tasks keeps to per_second.
    """
    asked = domains.where("domain IS NOT NULL").select("domain").distinct()
    fixed = urlencode([("matchType", "domain"), ("output", "json"), ("limit", limit), ("fl", "url,status,mime,timestamp"), ("filter", "status:200"), ("filter", "mime:text/html")])
    url = F.concat(F.lit(f"{index}?url="), F.url_encode("domain"), F.lit(f"&{fixed}"))
    got = answers(asked.withColumn("urls", F.array(url)).repartition(tasks, "domain"), fetch, "application/json", per_second)
    status = F.when(F.col("code") == 200, "ok").when(F.col("code") == 404, "no_captures").otherwise("failed")
    lines = F.filter(F.split(F.coalesce("body", F.lit("")), "\n"), lambda x: F.startswith(x, F.lit("{")))
    rows = got.select("domain", status.alias("status"), F.explode_outer(F.when(status == "ok", lines)).alias("line"))
    j = F.from_json("line", "url string, status string, mime string, timestamp string")
    return rows.select("domain", "status", j["url"].alias("url"), j["status"].alias("http_status"), j["mime"].alias("mime"), j["timestamp"].alias("time"))


def first_of(rows: DataFrame, key: Column, order: list[Column]) -> DataFrame:
    """The first row of each key in the given order; pulls repeat what overlapping pages and days have in common."""
    names = rows.columns
    kept = rows.groupBy(key.alias("_k")).agg(F.min_by(F.struct(*names), F.struct(*order)).alias("_r"))
    return kept.select("_r.*")
