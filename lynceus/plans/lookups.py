"""Look-ups for a run: what the cache has, what it lacks is asked for, and what is worth it is kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lynceus.operators.enrich import CACHEABLE, TTL_DAYS, missing_keys, wanted_keys
from lynceus.sources import cache
from lynceus.sources.folder import kept, shared_folder
from lynceus.sources.lookup import DNS_FACT, PER_SECOND, REGISTRATION_FACT, Fetch, dns_facts, kept_bootstrap, registration_facts


def _fields(ddl: str) -> str:
    return ", ".join(f"{c.split()[0]}: {c.split()[1]}" for c in ddl.split(", "))


def facts_of(keys: DataFrame, kind: str, key: str, ddl: str, status: str, folder: str | None, ask: Callable[[DataFrame], DataFrame], now: float) -> DataFrame:
    """Facts for all keys (unique, not null): those in the cache that are young enough, and answers for the others.

    Answers are written before they are used, so no request is made twice; those worth keeping go to the cache in one step.
    """
    spark, names = keys.sparkSession, [c.split()[0] for c in ddl.split(", ")]
    known = spark.createDataFrame([], ddl)
    if folder:
        young = cache.fresh(cache.snapshot(spark, f"{folder}/{kind}", _fields(ddl)), now, TTL_DAYS[kind])
        known, _ = kept(young.select("v.*").join(keys.select(key), key, "left_semi").select(*names), f"known-{kind}")
    missing, _ = kept(missing_keys(keys, known, key).join(keys, key), f"missing-{kind}")
    if missing.isEmpty():
        return known
    new, _ = kept(ask(missing).select(*names), f"answers-{kind}")
    if folder:
        cache.append(new, f"{folder}/{kind}", key, status, CACHEABLE[kind], now)
    return known.unionByName(new)


def looking_up(mode: str, column: str, fetch: Fetch, now: float, folder: str | None = None, per_second: float = PER_SECOND) -> Callable[[DataFrame], tuple[DataFrame, DataFrame]]:
    """What `analyse` takes as look_up: both tables of facts for the hosts and domains that the mode looks up.

    folder is the cache's; without one nothing is kept. fetch makes the requests, in tasks.
    """

    def look_up(scored: DataFrame) -> tuple[DataFrame, DataFrame]:
        spark = scored.sparkSession
        keys, _ = kept(wanted_keys(scored, mode, column), "looked-up")
        dns = facts_of(keys, "dns", "host", DNS_FACT, "a_status", folder, lambda k: dns_facts(k, fetch), now)
        regs = keys.where(F.col("reg").isNotNull()).select("reg").distinct()
        servers: list = []

        def ask(k: DataFrame) -> DataFrame:  # the bootstrap is only wanted where something has to be asked
            servers.append(kept_bootstrap(spark, f"{folder or shared_folder(spark)}/bootstrap", fetch, now=now))
            return registration_facts(k, servers[0], fetch, per_second)

        return dns, facts_of(regs, "rdap", "reg", REGISTRATION_FACT, "status", folder, ask, now)

    return look_up
