"""The user's allow and block lists: reading them, and matching parsed URLs against them.

Matching is a look-up of each parent domain in a table keyed by host, so a broadcast of the (counted) table
serves every depth and rows are neither exploded nor shuffled. A list that is too long for a broadcast is
joined by a shuffle instead.
"""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from lynceus.functions.text import settled, strip
from lynceus.functions.url import _legacy_part, normal_target, parse, prefix_candidates

#: Hosts up to which the table of a list is broadcast (about 100 bytes each).
MAX_BROADCAST = 500_000
HOSTS_FILE_IPS = ("0.0.0.0", "127.0.0.1", "::1", "::")
PLAIN_HOST, HOSTNAME = "^[A-Za-z0-9_-]+(\\.[A-Za-z0-9_-]+)+\\.?$", "^[a-z0-9_-]+(\\.[a-z0-9_-]+)+$"
KINDS = ("block", "allow")


class ListError(ValueError):
    """A list file that can't be used."""


def _ipv6_text(h: Column) -> Column:
    """The shortest spelling of a valid IPv6 address: the first longest run of zero groups becomes ::."""
    full = F.regexp_replace(F.try_reflect(F.lit("java.net.InetAddress"), F.lit("getByName"), h), "^.*/|%.*$", "")
    out = full
    for k in range(2, 9):  # the longest run is tried last, and so wins
        run = f"^(.*?)(?:(?<![^:])|:)0(?::0){{{k - 1}}}(?::|$)(.*)$"
        out = F.when(full.rlike(f"(^|:)0(:0){{{k - 1}}}(:|$)"), F.regexp_replace(F.regexp_replace(full, run, "$1::$2"), ":{3,}", "::")).otherwise(out)
    return out


def canonical_ip(host: Column) -> Column:
    """One spelling for each address; a host that isn't a valid one stays as it is."""
    h = F.regexp_replace(host, "^[\\[\\]]+|[\\[\\]]+$", "")
    values = F.transform(F.split(h, "\\.", -1), _legacy_part)
    n = F.size(values)
    heads = F.slice(values, 1, F.greatest(n - 1, F.lit(0)))
    room = F.element_at(F.array(*[F.lit(256**k) for k in (4, 3, 2, 1)]), F.least(n, F.lit(4)))
    valid = (n <= 4) & ~F.exists(values, lambda v: v.isNull()) & ~F.exists(heads, lambda v: v > 255) & (F.element_at(values, -1) < room)
    start = F.aggregate(heads, F.lit(0).cast("long"), lambda a, v: a * 256 + v.cast("long"))
    number = start * room + F.element_at(values, -1).cast("long")
    dotted = F.concat_ws(".", *[F.shiftright(number, s).bitwiseAND(255).cast("string") for s in (24, 16, 8, 0)])
    return F.when(F.contains(h, F.lit(":")), F.coalesce(_ipv6_text(h), h)).when(valid, dotted).otherwise(host)


@F.pandas_udf(StringType())
def _kept_letters(hosts: pd.Series) -> pd.Series:
    """The spelling of hosts in which sharp s and final sigma stay letters of their own; null stays null."""
    import unicodedata

    def label(x: str) -> str:
        x = unicodedata.normalize("NFC", x.lower())
        if x.isascii():
            return x
        try:
            return x.encode("idna").decode() if not set(x) & {"ß", "ς"} else "xn--" + x.encode("punycode").decode()
        except UnicodeError:
            return "xn--" + x.encode("punycode", "replace").decode()

    return hosts.map(lambda h: None if h is None else ".".join(map(label, h.split("."))))


def list_host(p: Column) -> Column:
    """The host by which lists know a parsed URL."""
    special = p["host_unicode"].rlike("[ßς]")
    return F.when(p["ip"] > 0, canonical_ip(p["host"])).when(special, _kept_letters(F.when(special, p["host_unicode"]))).otherwise(p["host"])


@dataclass
class UserLists:
    """entries: (kind, host, prefix or null, wild); notes: what to tell about skipped lines; counts: entries by kind."""

    entries: DataFrame
    notes: list[str]
    counts: dict[str, int]


def read_lists(spark: SparkSession, allow: list[str] = (), block: list[str] = ()) -> UserLists | None:
    """Reads list files: one domain, IP or URL prefix on a line, with comments, notes and hosts-file lines.

    None without files. A file without a valid entry, or a missing one, raises ListError.
    """
    frames = []
    for kind, paths in (("block", block), ("allow", allow)):
        for path in paths:
            try:
                text = spark.read.text(path, wholetext=True)
            except Exception as e:
                raise ListError(f"the {kind} list {path} can't be read") from e
            frames.append(text.select(F.lit(kind).alias("kind"), F.lit(path).alias("file"), F.posexplode(F.split("value", "\r\n|\n|\r")).alias("line", "text")))
    if not frames:
        return None
    lines = frames[0]
    for f in frames[1:]:
        lines = lines.unionByName(f)
    lines = lines.withColumn("text", strip(F.replace("text", F.lit("﻿"), F.lit("")))).where((F.col("text") != "") & ~F.startswith("text", F.lit("#")))
    words = F.split("text", "\\s+")
    entry = F.when((F.size(words) > 1) & words[0].isin(*HOSTS_FILE_IPS), words[1]).otherwise(words[0])
    lines = lines.withColumn("entry", entry).withColumn("wild", F.startswith("entry", F.lit("*.")))
    lines = lines.withColumn("entry", F.regexp_replace(F.regexp_replace("entry", "^\\*\\.", ""), "^\\.+", ""))
    plain = F.col("entry").rlike(PLAIN_HOST) & F.col("entry").rlike("[g-wyzG-WYZ]")  # no spelling of an IP
    parsed = parse(lines.withColumn("plain", plain), "entry")
    parsed = parsed.withColumn("host", F.when(F.col("plain"), F.regexp_replace(F.lower("entry"), "\\.+$", "")).otherwise(list_host(F.col("p"))))
    target = normal_target(F.col("p.path"), F.col("p.query"))
    parsed = parsed.withColumn("prefix", F.when(~F.col("plain") & (target != "/"), target))
    parsed = parsed.withColumn("good", F.col("plain") | ((F.col("host") != "") & ((F.col("p.ip") > 0) | F.col("host").rlike(HOSTNAME))))
    parsed = parsed.select("kind", "file", "line", "host", "prefix", (F.col("wild") & F.col("prefix").isNotNull()).alias("wild"), "good").cache()
    seen = {(r.kind, r.file): r for r in parsed.groupBy("kind", "file").agg(F.sum(F.col("good").cast("int")).alias("good"), F.sum((~F.col("good")).cast("int")).alias("bad"), F.min(F.when(~F.col("good"), F.col("line") + 1)).alias("first")).collect()}
    notes, counts = [], {}
    for kind, paths in (("block", block), ("allow", allow)):
        for path in paths:
            r = seen.get((kind, path))
            if r is None or not r.good:
                raise ListError(f"nothing in the {kind} list {path} is a domain, an address or a URL: no valid entries")
            if r.bad:
                notes.append(f"{r.bad} of the lines of the {kind} list {path} are no entries and were left out (first: line {r['first']})")
            counts[kind] = counts.get(kind, 0) + r.good
    return UserLists(parsed.where("good").select("kind", "host", "prefix", "wild"), notes, counts)


def _table(entries: DataFrame) -> DataFrame:
    """One row per host: for each kind, whether the host is listed, and its plain and wild prefixes."""
    columns = []
    for kind in KINDS:
        own = F.col("kind") == kind
        columns += [
            F.max(own & F.col("prefix").isNull()).alias(f"{kind}_host"),
            F.collect_set(F.when(own & ~F.col("wild"), F.col("prefix"))).alias(f"{kind}_prefixes"),
            F.collect_set(F.when(own & F.col("wild"), F.col("prefix"))).alias(f"{kind}_wild"),
        ]
    return entries.groupBy("host").agg(*columns)


def match_lists(df: DataFrame, entries: DataFrame, p: str = "p") -> DataFrame:
    """df with list_kind (block or allow) and list_entry, null where no list has the URL.

    The block list comes first. In a list, prefixes of the host itself come before wild prefixes and those before
    hosts; of several parents the nearest counts, of several prefixes the longest.
    """
    table = _table(entries).cache()
    n, depth = table.agg(F.count(F.lit(1)), F.max(F.size(F.split("host", "\\.")))).first()
    side = F.broadcast(table) if n <= MAX_BROADCAST else table
    kept = [F.col(f"`{c}`") for c in df.columns if c not in ("list_kind", "list_entry")]
    step = settled(df, {"_h": list_host(F.col(p)), "_t": normal_target(F.col(f"{p}.path"), F.col(f"{p}.query"))})
    step = settled(step, {"_c": prefix_candidates(F.col("_t")), "_l": F.split("_h", "\\.")})
    levels = []
    for k in [0, *range(depth or 0, 0, -1)]:  # 0 is the whole host, which may be an IP
        at = side.select(*[F.col(c).alias(f"_{k}_{c}") for c in table.columns])
        tail = F.array_join(F.slice("_l", -k, k), ".") if k else None
        key = F.col("_h") if k == 0 else F.when((F.size("_l") > k) & (F.col(f"{p}.ip") == 0), tail)
        step = step.withColumn(f"_k{k}", F.when(F.col(f"{p}.host") != "", key)).join(at, F.col(f"_k{k}") == F.col(f"_{k}_host"), "left")
        levels.append(k)

    def longest(prefixes: Column) -> Column:
        hits = F.array_intersect("_c", prefixes)
        best = F.element_at(F.array_sort(F.transform(hits, lambda x: F.struct((-F.length(x)).alias("n"), x.alias("x")))), 1)
        return F.when(F.size(hits) > 0, best["x"])

    choices = []
    for kind in KINDS:
        hit = lambda text, kind=kind: F.when(text.isNotNull(), F.struct(F.lit(kind).alias("kind"), text.alias("entry")))
        choices.append(hit(F.concat("_h", longest(F.col(f"_0_{kind}_prefixes")))))
        choices += [hit(F.concat(F.lit("*."), F.col(f"_k{k}"), longest(F.col(f"_{k}_{kind}_wild")))) for k in levels]
        choices += [hit(F.when(F.col(f"_{k}_{kind}_host"), F.col(f"_k{k}"))) for k in levels]
    step = step.withColumn("_hit", F.coalesce(*choices))
    return step.select(*kept, F.col("_hit.kind").alias("list_kind"), F.col("_hit.entry").alias("list_entry"))
