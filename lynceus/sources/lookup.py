"""Providers of DNS and registration facts for the keys that the cache lacks.

A provider maps a table of keys to a table of facts. The live ones make requests in tasks, by a function that tests
and closed networks replace: it gets a URL and gives a status, a body and how long to wait. What the answers
say is read by column expressions. Nothing is looked up unless a provider is given.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterator
from http.client import HTTPException

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from lynceus.operators.enrich import parse_registration, server_of

DNS_FACT = "host string, a_status string, a array<string>, ttl_a int, aaaa array<string>, cname string, ns_status string, ns array<string>, mx_status string, mx array<string>"
REGISTRATION_FACT = "reg string, status string, created string, expires string, changed string, registrar string, registrar_iana string, domain_status array<string>, ns array<string>"
RETRIES, MAX_WAIT, PER_SECOND = 3, 15.0, 2.0


def read_bootstrap(spark, path: str) -> DataFrame:
    """(tld, base_url) of the registries' published bootstrap file: the first https server of each service."""
    j = F.from_json("value", "services array<array<array<string>>>")
    rows = spark.read.text(path, wholetext=True).select(F.explode(j["services"]).alias("s"))
    url = F.coalesce(F.get(F.filter(F.col("s")[1], lambda u: F.startswith(u, F.lit("https://"))), F.lit(0)), F.col("s")[1][0])
    return rows.select(F.explode(F.col("s")[0]).alias("tld"), url.alias("base_url")).select(F.lower("tld").alias("tld"), "base_url")


#: Resolvers that answer in JSON, tried in turn; record types by their numbers, and response codes (fixed values).
DNS_SERVERS = ("1.1.1.1", "1.0.0.1")
RECORDS = {"A": 1, "AAAA": 28, "NS": 2, "MX": 15}
ALIAS = 5
CODES = {0: "ok", 2: "servfail", 3: "nxdomain", 5: "refused"}
BOOTSTRAP_URL = "https://data.iana.org/rdap/dns.json"
Fetch = Callable[[str, str], tuple[int, str, float]]


def http_get(url: str, accept: str, timeout: float = 8.0) -> tuple[int, str, float]:
    """(status, body, seconds to wait before another try) of a GET request; raises OSError where there is no answer."""
    import http.client
    import urllib.error
    import urllib.request

    try:
        with urllib.request.urlopen(urllib.request.Request(url, headers={"Accept": accept}), timeout=timeout) as r:
            return r.status, r.read(2_000_000).decode("utf-8", "replace"), 0.0
    except http.client.HTTPException as e:  # an answer that is cut off or isn't one
        raise OSError(type(e).__name__) from e
    except urllib.error.HTTPError as e:
        wait = e.headers.get("Retry-After", "5") if e.headers else "5"
        return e.code, "", float(wait) if wait.isdigit() else 5.0


def is_json(body: str) -> bool:
    """Whether a body is a JSON object."""
    try:
        return isinstance(json.loads(body), dict)
    except ValueError:
        return False


def answers(requests: DataFrame, fetch: Fetch, accept: str, per_second: float | None = None, sound: Callable[[str], bool] | None = None, server_errors: bool = True) -> DataFrame:
    """requests (with urls, an array of equal alternatives) with code, body and failure, the kind of the last exception.

    A request is tried up to RETRIES times, over its URLs in turn: after an exception (also one of an answer that is cut off), after a status that isn't an
    answer (a server's own errors only with server_errors), after a body that isn't sound, and after a 429 once the wait is over.
    No exception of a request ends the task. With a rate, each task keeps to it; deal requests so that a server has one task.
    """
    schema = StructType([*requests.schema.fields, StructField("code", IntegerType()), StructField("body", StringType()), StructField("failure", StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        free = 0.0
        for b in batches:
            got = []
            for urls in b["urls"]:
                code, body, failure = None, None, None
                for turn in range(RETRIES if len(urls) else 0):
                    if per_second:
                        time.sleep(max(0.0, free - time.monotonic()))
                        free = time.monotonic() + 1 / per_second
                    try:
                        code, body, wait = fetch(urls[turn % len(urls)], accept)
                        failure = None
                    except (OSError, HTTPException) as e:
                        code, body, failure = None, None, type(e).__name__
                        continue
                    if code == 200 and sound is not None and not sound(body):
                        continue
                    if code in (200, 400, 404) or (code >= 500 and not server_errors):
                        break
                    if code == 429 and turn < RETRIES - 1:
                        time.sleep(min(wait, MAX_WAIT))
                got.append((code, body, failure))
            yield b.assign(code=pd.array([g[0] for g in got], dtype="Int32"), body=[g[1] for g in got], failure=[g[2] for g in got])

    return requests.mapInPandas(run, schema)


def dns_facts(keys: DataFrame, fetch: Fetch = http_get, servers: tuple[str, ...] = DNS_SERVERS, tasks: int = 8) -> DataFrame:
    """The DNS facts of keys (host, reg): addresses of the host, name and mail servers of the domain, if there is one."""
    kinds = F.array(*[F.struct(F.lit(k).alias("record"), F.lit(n).alias("number"), (F.col("host") if k in ("A", "AAAA") else F.col("reg")).alias("name")) for k, n in RECORDS.items()])
    asked = keys.select("host", F.explode(kinds).alias("q")).select("host", "q.*")
    urls = F.array(*[F.concat(F.lit(f"https://{s}/dns-query?name="), F.url_encode("name"), F.lit("&type="), F.col("record")) for s in servers])
    asked = asked.withColumn("urls", F.when(F.col("name").isNotNull(), urls).otherwise(F.array().cast("array<string>")))
    got = answers(asked.repartition(tasks, "host", "record"), fetch, "application/dns-json", sound=is_json)
    j = F.from_json("body", "Status int, Answer array<struct<type:int,TTL:int,data:string>>")
    got = got.select("host", "record", "number", "name", "code", j.alias("j"))
    none = F.array().cast("array<struct<type:int,TTL:int,data:string>>")
    own = lambda number: F.filter(F.coalesce("j.Answer", none), lambda x: x["type"] == number)
    code = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in CODES.items() for x in pair]), F.col("j.Status")), F.concat(F.lit("rcode_"), F.col("j.Status").cast("string")))
    status = F.when(F.col("name").isNull(), "skip").when(F.col("code") == 400, "bad_name").when((F.col("code") != 200) | F.col("code").isNull() | F.col("j.Status").isNull(), "timeout").when((code == "ok") & (F.size(own(F.col("number"))) == 0), "nodata").otherwise(code)
    facts = got.select("host", "record", status.alias("status"), F.transform(own(F.col("number")), lambda x: x["data"]).alias("values"), F.array_min(F.transform(own(F.col("number")), lambda x: x["TTL"])).alias("ttl"), F.rtrim(F.try_element_at(F.transform(own(F.lit(ALIAS)), lambda x: x["data"]), F.lit(-1)), F.lit(".")).alias("alias"))
    of = lambda record, column: F.max(F.when(F.col("record") == record, F.col(column)))
    plain = lambda names: F.transform(names, lambda x: F.lower(F.rtrim(x, F.lit("."))))
    return facts.groupBy("host").agg(
        of("A", "status").alias("a_status"), F.slice(of("A", "values"), 1, 8).alias("a"), of("A", "ttl").alias("ttl_a"), F.slice(of("AAAA", "values"), 1, 4).alias("aaaa"), of("A", "alias").alias("cname"),
        of("NS", "status").alias("ns_status"), F.slice(plain(of("NS", "values")), 1, 8).alias("ns"), of("MX", "status").alias("mx_status"), F.slice(of("MX", "values"), 1, 8).alias("mx"),
    )


def registration_facts(keys: DataFrame, bootstrap: DataFrame | None, fetch: Fetch = http_get, per_second: float = PER_SECOND) -> DataFrame:
    """The registration facts of keys (reg). A registry's domains share a task, which keeps to its rate limit; rows stream.

    Domains that no registry serves need no request and no task. Without a bootstrap it isn't known who serves a domain:
    that is rdap_bootstrap_unavailable, which no cache keeps.
    """
    own = keys.select("reg").distinct()
    empty = [F.lit(None).cast(t.split()[1]).alias(t.split()[0]) for t in REGISTRATION_FACT.split(", ")[2:]]
    if bootstrap is None:
        return own.select("reg", F.lit("rdap_bootstrap_unavailable").alias("status"), *empty)
    served = server_of(own, bootstrap)
    none = served.where("base_url IS NULL").select("reg", F.lit("no_rdap_server").alias("status"), *empty)
    url = F.concat(F.rtrim("base_url", F.lit("/")), F.lit("/domain/"), F.col("reg"))
    asked = served.where("base_url IS NOT NULL").withColumn("urls", F.array(url))
    got = answers(asked.repartition("base_url"), fetch, "application/rdap+json", per_second, server_errors=False)
    code = F.col("code")
    sound = F.get_json_object("body", "$").isNotNull()
    status = (
        F.when(F.col("failure").isNotNull(), F.concat(F.lit("error:"), F.col("failure"))).when(code == 404, "not_found").when(code == 429, "rate_limited")
        .when(code != 200, F.concat(F.lit("http_"), code.cast("string"))).when(~sound, "bad_json").otherwise("ok")
    )
    read = got.select("reg", status.alias("status"), F.when(status == "ok", parse_registration(F.col("body"))).alias("f"))
    return read.select("reg", "status", *[F.col(f"f.{c}") for c in ("created", "expires", "changed", "registrar", "registrar_iana", "domain_status", "ns")]).unionByName(none)


def kept_bootstrap(spark, path: str, fetch: Fetch = http_get, days: float = 30.0, now: float | None = None) -> DataFrame | None:
    """The registries' bootstrap as read_bootstrap, from a copy at path that is renewed once it is too old.

    Copies are never written over: each has a name of its own (its time, then a number), and the newest whole one counts, so a crash loses
    none. Older copies are deleted once a newer one stands. If none can be had, the old one serves; without either there is None.
    """
    jvm = spark._jvm.org.apache.hadoop.fs
    fs = jvm.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    now = time.time() if now is None else now

    def copies() -> list[tuple[float, str]]:
        found = fs.globStatus(jvm.Path(f"{path}.*.json"))
        names = [f.getPath().toString() for f in found] if found is not None else []
        return sorted((float(n.rsplit(".", 3)[1]), n) for n in names)

    old = copies()
    if not old or now - old[-1][0] > days * 86_400:
        try:
            code, body, _ = fetch(BOOTSTRAP_URL, "application/json")
            good = code == 200 and "services" in json.loads(body)
        except (OSError, HTTPException, ValueError):
            good = False
        if good:
            fresh, part = f"{path}.{int(now)}.{uuid.uuid4().hex}.json", f"{path}.{uuid.uuid4().hex}.part"
            stream = fs.create(jvm.Path(part))
            stream.write(body.encode())
            stream.close()
            if fs.rename(jvm.Path(part), jvm.Path(fresh)):
                for _, name in old:
                    fs.delete(jvm.Path(name), False)
    left = copies()
    return read_bootstrap(spark, left[-1][1]) if left else None
