"""Streams with state, remote sources, the cache that processes share, and look-ups from the command line."""

import gzip
import json
import threading
import time
import uuid
from http.client import IncompleteRead
from urllib.parse import parse_qs, urlsplit

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from lynceus.cli import run
from lynceus.plans.live import QUERIES
from lynceus.plans.live_sql import ORACLE_SQL
from lynceus.sources import cache, lookup, remote
from lynceus.streaming import facts, progress
from lynceus.streaming import urls as streams
from tests.test_queries import SF, same


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_oracle(spark, name):
    same(QUERIES[name](spark, SF), ORACLE_SQL[name])


def test_facts_expire(spark, tmp_path):
    """Two batches on a clock: reused while young, asked again when old; a hot key dealt to several states asks once for each."""
    fact = StructType([StructField("fact", LongType())])
    schema = "id long, k string, ts timestamp"

    def batch(rows):
        spark.createDataFrame(rows, "id long, k string, s double").select("id", "k", F.timestamp_seconds("s").alias("ts")).write.mode("append").parquet(f"file://{tmp_path}/in")
        stream = spark.readStream.schema(schema).parquet(f"file://{tmp_path}/in")
        asked = facts.with_facts(stream, "k", "ts", lambda k, at: {"fact": int(at)}, fact, 100, late_seconds=10_000)
        streams.upsert_available(asked, f"file://{tmp_path}/out", f"file://{tmp_path}/cp", "append")
        return {r.id: (r.fact, r.reused) for r in spark.read.parquet(f"file://{tmp_path}/out").collect()}

    batch([(1, "a", 1000.0), (2, "a", 1050.0), (3, "b", 1000.0), (4, None, 1000.0)])
    got = batch([(5, "a", 1100.0), (6, "a", 1101.0), (7, "b", 1200.0), (8, None, 1001.0), (9, "a", 1150.0)])
    assert got == {1: (1000, False), 2: (1000, True), 3: (1000, False), 4: (1000, False), 5: (1000, True), 6: (1101, False), 7: (1200, False), 8: (1000, True), 9: (1101, True)}
    spark.createDataFrame([(i, "hot", 5.0) for i in range(400)], "id long, k string, s double").select("id", "k", F.timestamp_seconds("s").alias("ts")).write.parquet(f"file://{tmp_path}/hot")
    dealt = facts.with_facts(spark.readStream.schema(schema).parquet(f"file://{tmp_path}/hot"), "k", "ts", lambda k, at: {"fact": 1}, fact, 100, spread=4)
    streams.upsert_available(dealt, f"file://{tmp_path}/o2", f"file://{tmp_path}/c2", "append")
    out = spark.read.parquet(f"file://{tmp_path}/o2")
    assert out.count() == 400 and out.where("NOT reused").count() == 4


def test_facts_of_many_keys(spark, tmp_path):
    """Keys share states, so calls and states don't grow with them; each fact still expires by itself, and whole numbers with nulls among them stay exact."""
    fact, big = StructType([StructField("fact", LongType())]), 2**60 + 1
    schema = "id long, k long, x double, ts timestamp"

    def batch(rows, key, told):
        spark.createDataFrame(rows, "id long, k long, x double, s double").select("id", "k", "x", F.timestamp_seconds("s").alias("ts")).write.mode("append").parquet(f"file://{tmp_path}/{key}/in")
        stream = spark.readStream.schema(schema).parquet(f"file://{tmp_path}/{key}/in")
        asked = facts.with_facts(stream, key, "ts", lambda k, at: {"fact": int(at) + big if at < 2000 else None}, fact, 100, late_seconds=10, states=4)
        with progress.ProgressTable(spark, f"file://{tmp_path}/{key}/{told}") as table:
            streams.upsert_available(asked, f"file://{tmp_path}/{key}/out", f"file://{tmp_path}/{key}/cp", "append")
        got = {(r.id, r.k, r.ts.timestamp()): (r.fact, r.asked, r.reused) for r in spark.read.parquet(f"file://{tmp_path}/{key}/out").collect()}
        return got, table.table().orderBy("batch").collect()

    keys = [big + i for i in range(50)]
    got, told = batch([(None if i % 3 == 0 else big + i, k, None, 1000.0 + i) for i, k in enumerate(keys)] + [(7, None, None, 1000.0)], "k", "one")
    assert got == {**{(None if i % 3 == 0 else big + i, k, 1000.0 + i): (big + 1000 + i, 1000.0 + i, False) for i, k in enumerate(keys)}, (7, None, 1000.0): (big + 1000, 1000.0, False)}
    assert 0 < max(r.state_rows for r in told) <= 5
    got, told = batch([(1, k, None, 1110.0) for k in keys] + [(8, None, None, 1100.0)], "k", "two")
    assert [got[1, k, 1110.0] for k in keys] == [(big + 1110, 1110.0, False) if i < 10 else (big + 1000 + i, 1000.0 + i, True) for i, k in enumerate(keys)] and got[8, None, 1100.0] == (big + 1000, 1000.0, True)
    got, told = batch([(2, keys[0], None, 3000.0)], "k", "three")
    assert got[2, keys[0], 3000.0] == (None, 3000.0, False) and told[-1].state_rows == 1  # the watermark has passed all other facts
    got, _ = batch([(1, 1, float("nan"), 1000.0), (2, 2, -0.0, 1001.0)], "x", "one")
    got, _ = batch([(3, 3, float("nan"), 1050.0), (4, 4, 0.0, 1051.0)], "x", "two")
    assert [v[1:] for _, v in sorted(got.items())] == [(1000.0, False), (1001.0, False), (1000.0, True), (1001.0, True)]


def test_progress_and_sessions(spark, tmp_path):
    for k in range(3):
        spark.createDataFrame([(f"u{i}", k * 7200.0 + i * 60) for i in range(5)], "u string, s double").select("u", F.timestamp_seconds("s").alias("ts")).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
        time.sleep(0.02)
    with progress.ProgressTable(spark, f"file://{tmp_path}/told") as told:
        s = streams.read_files(spark, f"file://{tmp_path}/in", "u string, ts timestamp", files_per_batch=1)
        streams.upsert_available(streams.sessions(s, "u", gap="10 minutes", late="1 minute"), f"file://{tmp_path}/out", f"file://{tmp_path}/cp", "append")
    rows = told.table().collect()
    assert sum(r.rows_read for r in rows) == 15 and len({r.batch for r in rows}) == len(rows) >= 3 and max(r.state_rows for r in rows) >= 5
    closed = spark.read.parquet(f"file://{tmp_path}/out")
    assert closed.count() == 10 and closed.agg(F.max("n")).first()[0] == 1  # the last ones are still open
    assert progress.ProgressTable(spark, f"file://{tmp_path}/nothing").table().count() == 0


def test_blocks(spark, tmp_path):
    """Members one after the other, cut-off answers tried again, a block that can't be had told as a failure."""
    data = gzip.compress(b"one\ntwo\n") + gzip.compress("dréi\n".encode())
    assert list(remote.members(data)) == [b"one\ntwo\n", "dréi\n".encode()]
    with pytest.raises(EOFError):
        list(remote.members(data[:-3]))
    waits, calls = [], iter([OSError("a"), EOFError("b")])

    def call():
        x = next(calls, None)
        if x:
            raise x
        return "ok"

    assert remote.tried(call, 2.0, waits.append) == ("ok", None) and waits == [2.0, 4.0]
    spark.dataSource.register(remote.block_source(lambda url, o, n: (_ for _ in ()).throw(ConnectionError()) if url.endswith("bad") else data))
    df = spark.read.format("capture_blocks").option("blocks", json.dumps([["a", 0, 9], ["bad", 0, 9], ["b", 5, 9]])).option("wait", "0").option("tasks", "2").load()
    assert sorted(map(tuple, df.collect()), key=str) == sorted([(f, o, k, v, None) for f, o in (("a", 0), ("b", 5)) for k, v in enumerate(("one", "two", "dréi"))] + [("bad", 0, None, None, "ConnectionError")], key=str)
    index = spark.createDataFrame([(f"f{i % 3}", i, 10) for i in range(50)], "file string, offset long, length long")
    assert remote.sample_blocks(index, 7) == remote.sample_blocks(index.repartition(5), 7) and len(json.loads(remote.sample_blocks(index, 7))) == 7
    spark.dataSource.register(remote.day_source(lambda day, page: (["x"], page < 1) if day != "2026-01-02" else (_ for _ in ()).throw(OSError())))
    once = spark.read.format("days").option("since", "2026-01-01").option("until", "2026-01-04").option("wait", "0").load()
    assert sorted(map(tuple, once.collect()), key=str) == [("2026-01-01", 0, "x", None), ("2026-01-01", 1, "x", None), ("2026-01-02", 0, None, "OSError"), ("2026-01-03", 0, "x", None), ("2026-01-03", 1, "x", None)]


def test_cache_of_two_writers(spark, tmp_path):
    """Two writers at once lose and tear no line; a compaction keeps each key's last line, and what is added meanwhile."""
    path, schema, errors = f"file://{tmp_path}/cache", "k: string, s: string, x: bigint", []

    def writer(w):
        try:
            for i in range(4):
                cache.append(spark.createDataFrame([(f"w{w}-{i}", "ok", i), ("both", "ok", 10 * i + w), ("no", "timeout", 1)], "k string, s string, x long"), path, "k", "s", ("ok",), float(i))
        except Exception as e:
            errors.append(e)

    threads = [threading.Thread(target=writer, args=(w,)) for w in range(3)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    found = {r.k: r.v.x for r in cache.snapshot(spark, path, schema).collect()}
    assert not errors and set(found) == {f"w{w}-{i}" for w in range(3) for i in range(4)} | {"both"}
    assert [n for n, _ in cache._entries(spark, path)] == list(range(1, 13)) and found["both"] // 10 == 3
    before = cache._state(spark, path)
    cache.compact(spark, path, schema)
    assert {r.k: r.v.x for r in cache.snapshot(spark, path, schema).collect()} == found and len(cache._state(spark, path)) == 1
    with pytest.raises(cache.CacheConflict):
        cache.commit(spark, path, {"add": "data-0", "remove": [before[0][1]["add"]]})
    assert cache.snapshot(spark, f"file://{tmp_path}/none", schema).count() == 0 == cache.compact(spark, f"file://{tmp_path}/none", schema)
    assert not cache._create(spark, f"{path}/_log/{1:012d}.json", b"{}")


def registry(marks, cut):
    """A made-up network: counts its requests as files, cuts every first answer off, and knows some names."""

    def fetch(url, accept):
        (marks / uuid.uuid4().hex).write_text(url)
        parts = urlsplit(url)
        if url == lookup.BOOTSTRAP_URL:
            if cut == "bootstrap":
                raise IncompleteRead(b"")
            return 200, json.dumps({"services": [[["test"], ["https://r.example/"]]]}), 0.0
        seen = marks.parent / f"seen-{abs(hash(url))}"
        if not seen.exists():
            seen.write_text("")
            raise IncompleteRead(b"half")
        if parts.netloc == "r.example":
            return (404, "", 0.0) if "gone" in url else (200, json.dumps({"events": [{"eventAction": "registration", "eventDate": "2020-01-01T00:00:00Z"}], "status": []}), 0.0)
        name, kind = (parse_qs(parts.query)[k][0] for k in ("name", "type"))
        return 200, json.dumps({"Status": 3 if "gone" in name else 0, "Answer": [] if "gone" in name else [{"type": lookup.RECORDS[kind], "TTL": 60, "data": "192.0.2.1"}]}), 0.0

    return fetch


def test_lookups_from_the_command_line(spark, tmp_path):
    """Answers that are cut off are asked for again and stop nothing; a second run finds everything in the cache."""
    marks = tmp_path / "marks"
    marks.mkdir()
    (tmp_path / "in.csv").write_text("id,url\n1,http://a.example.test/x\n2,http://gone.test/\n3,http://a.example.test/y\n4,http://b.other/\n5,http://192.0.2.9/\n")
    kw = {"fmt": "json", "enrich": "all", "cache_dir": f"file://{tmp_path}/cache", "now": 1_767_225_600.0}
    run(spark, f"file://{tmp_path}/in.csv", str(tmp_path / "one.json"), fetch=registry(marks, None), **kw)
    first = len(list(marks.iterdir()))
    run(spark, f"file://{tmp_path}/in.csv", str(tmp_path / "two.json"), fetch=registry(marks, None), **kw)
    one, two = ((tmp_path / f"{n}.json").read_text() for n in ("one", "two"))
    assert one == two and first > 0 and len(list(marks.iterdir())) == first
    status = [json.loads(x)["lookup_status"] for x in one.splitlines()]
    assert status[0] == "dns=ok; rdap=ok" and status[1].startswith("dns=nxdomain; rdap=not_found") and status[3] == "dns=ok; rdap=no_rdap_server" and status[4].startswith("skipped")
    later = run(spark, f"file://{tmp_path}/in.csv", str(tmp_path / "three.json"), fetch=registry(marks, None), **(kw | {"now": kw["now"] + 8 * 86_400}))
    assert later["rows"] == 5 and len(list(marks.iterdir())) > first  # names are asked again after a week
    run(spark, f"file://{tmp_path}/in.csv", str(tmp_path / "four.json"), fetch=registry(marks, "bootstrap"), **(kw | {"cache_dir": f"file://{tmp_path}/other"}))
    assert "rdap=rdap_bootstrap_unavailable" in (tmp_path / "four.json").read_text()
    kept = cache.snapshot(spark, f"file://{tmp_path}/other/rdap", "reg: string, status: string")
    assert kept.count() == 0  # not knowing who to ask is no answer


def test_parts_from_the_command_line(spark, tmp_path):
    (tmp_path / "in.csv").write_text("url\n" + "".join(f"http://h{i}.test/\n" for i in range(40)))
    whole, parts = str(tmp_path / "whole.csv"), tmp_path / "parts"
    for fmt in ("csv", "json"):
        run(spark, f"file://{tmp_path}/in.csv", whole, fmt=fmt)
        summary = run(spark, f"file://{tmp_path}/in.csv", str(parts), fmt=fmt, parts=4)
        files = sorted(parts.glob("part-*"))
        assert summary["rows"] == 40 and len(files) == 4
        bodies = [f.read_bytes().decode("utf-8-sig").splitlines() for f in files]
        lines, want = [x for b in bodies for x in (b[1:] if fmt == "csv" else b)], open(whole, encoding="utf-8-sig").read().splitlines()
        assert lines == want[1:] if fmt == "csv" else list(map(json.loads, lines)) == list(map(json.loads, want))
