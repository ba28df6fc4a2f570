"""The second pass: DNS and registration facts joined to the rows that need them.

Facts come from tables (a cache, or a provider's answers); no look-up happens in a projection. Keys are
deduplicated and matched against the cache before a provider sees them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lynceus.functions import values as V
from lynceus.functions.text import has_space, one_zero, settled, strip
from lynceus.operators.scoring import FAILED, MODES, ModelDocument, judged, tree_scores, vector

NAN = float("nan")
ANSWERED = ("ok", "nodata", "nxdomain")
#: Statuses worth keeping, and days for which they are.
CACHEABLE = {"dns": ANSWERED, "rdap": ("ok", "not_found", "no_rdap_server")}
TTL_DAYS = {"dns": 7, "rdap": 28}
#: IPv4 networks that aren't public (fixed values), as first address and prefix length.
PRIVATE_NETWORKS = "0.0.0.0/8 10.0.0.0/8 127.0.0.0/8 169.254.0.0/16 172.16.0.0/12 192.0.0.0/29 192.0.0.170/31 192.0.2.0/24 192.168.0.0/16 198.18.0.0/15 198.51.100.0/24 203.0.113.0/24 240.0.0.0/4".split()
DNS_FEATURES = "dns_ok dns_resolves dns_nxdomain dns_n_a dns_has_aaaa dns_has_cname dns_ttl_a_log dns_private_ip dns_n_ns dns_has_mx".split()
RDAP_FEATURES = "rdap_ok rdap_not_found domain_age_days_log days_to_expiry_log reg_period_years days_since_changed_log status_hold status_n".split()
TIMESTAMP = "(?i)^(\\d{4})-(\\d{2})-(\\d{2})(?:[T ](\\d{2}):(\\d{2})(?::(\\d{2})(?:[.,](\\d+))?)?)?\\s*(Z|[+-]\\d{2}:?\\d{2})?$"
PLATFORM_NOTE = "skipped (shared hosting platform: domain data would describe the platform, not this page)"
DNS_NOTES = {"nxdomain": "domain does not exist in DNS (dead link or taken down)", "nodata": "domain has no address records"}


def is_platform(p: Column) -> Column:
    """Domains that many users share: their registration says nothing about a page."""
    return p["private_suffix"] | p["host"].isin(V.USER_CONTENT_HOSTS + V.SHORTENERS) | p["reg"].isin(V.USER_CONTENT_HOSTS + V.SHORTENERS) | p["suffix"].isin(V.USER_CONTENT_HOSTS)


def is_private_ip(ip: Column) -> Column:
    """Whether an IPv4 address in dotted form is private, local or reserved; false for anything else."""
    ok = ip.rlike("^(25[0-5]|2[0-4]\\d|1\\d\\d|[1-9]?\\d)(\\.(25[0-5]|2[0-4]\\d|1\\d\\d|[1-9]?\\d)){3}$")
    number = F.aggregate(F.split(ip, "\\."), F.lit(0).cast("long"), lambda a, x: a * 256 + x.cast("long"))
    inside = F.lit(False)
    for net in PRIVATE_NETWORKS:
        first, bits = net.split("/")
        low = int.from_bytes(bytes(map(int, first.split("."))), "big")
        inside = inside | number.between(low, low + (1 << (32 - int(bits))) - 1)
    return F.coalesce(ok & inside, F.lit(False))


def seconds(text: Column) -> Column:
    """The time of an ISO timestamp in four shapes, with or without an offset, as seconds since 1970; null otherwise."""
    s = strip(text)
    part = lambda k: F.nullif(F.regexp_extract(s, TIMESTAMP, k), F.lit(""))
    number = lambda k: F.coalesce(part(k).cast("int"), F.lit(0))
    day = F.unix_date(F.try_to_date(F.concat_ws("-", part(1), part(2), part(3)), "yyyy-MM-dd")).cast("double")
    time = number(4) * 3600 + number(5) * 60 + number(6) + F.coalesce(F.concat(F.lit("0."), F.substring(part(7), 1, 6)).cast("double"), F.lit(0.0))
    zone = F.upper(F.coalesce(part(8), F.lit("Z")))
    shift = F.when(zone == "Z", 0).otherwise(F.when(F.startswith(zone, F.lit("-")), -1).otherwise(1) * (F.substring(zone, 2, 2).cast("int") * 3600 + F.substring(zone, -2, 2).cast("int") * 60))
    return F.when(s.rlike(TIMESTAMP) & (number(4) < 24) & (number(5) < 60) & (number(6) < 60), day * 86400 + time - shift)


def whole_days(later: Column, earlier: Column) -> Column:
    """Whole days between two times in seconds, rounded down."""
    return F.floor((later - earlier) / 86400).cast("double")


def _filled(d: Column, features: dict[str, Column]) -> dict[str, Column]:
    """NaN where nothing is known."""
    return {k: F.when(d.isNull(), NAN).otherwise(F.coalesce(v.cast("double"), F.lit(NAN))) for k, v in features.items()}


def dns_features(d: Column) -> dict[str, Column]:
    """Ten features of a DNS fact (a struct); NaN where there is no authoritative answer."""
    some = lambda a: F.coalesce(F.size(a), F.lit(0)) > 0
    answered = lambda s: F.coalesce(s.isin(*ANSWERED), F.lit(False))
    ok, known = answered(d["a_status"]), lambda c, s: F.when(answered(s), c)
    return _filled(d, {
        "dns_ok": one_zero(ok), "dns_resolves": F.when(ok, one_zero(some(d["a"]) | some(d["aaaa"]))),
        "dns_nxdomain": F.when(d["a_status"] == "nxdomain", 1.0).when(ok, 0.0), "dns_n_a": F.when(ok, F.greatest(F.coalesce(F.size(d["a"]), F.lit(0)), F.lit(0))),
        "dns_has_aaaa": F.when(ok, one_zero(some(d["aaaa"]))), "dns_has_cname": F.when(ok, one_zero(F.coalesce(d["cname"], F.lit("")) != "")),
        "dns_ttl_a_log": F.log10(1 + d["ttl_a"]), "dns_private_ip": F.when(some(d["a"]), one_zero(F.exists(d["a"], is_private_ip))),
        "dns_n_ns": known(F.greatest(F.coalesce(F.size(d["ns"]), F.lit(0)), F.lit(0)), d["ns_status"]), "dns_has_mx": known(one_zero(some(d["mx"])), d["mx_status"]),
    })


def rdap_features(d: Column, now: Column) -> dict[str, Column]:
    """Eight features of a registration fact (a struct) as of now (seconds); NaN where the registry has none."""
    ok = F.coalesce(d["status"] == "ok", F.lit(False))
    made, ends, changed = (seconds(d[k]) for k in ("created", "expires", "changed"))
    log_days = lambda a, b: F.when(ok & a.isNotNull() & b.isNotNull(), F.log10(1 + F.greatest(F.lit(0.0), whole_days(a, b))))
    return _filled(d, {
        "rdap_ok": one_zero(ok), "rdap_not_found": F.when(d["status"] == "not_found", 1.0).when(ok, 0.0),
        "domain_age_days_log": log_days(now, made), "days_to_expiry_log": log_days(ends, now), "reg_period_years": F.when(ok, whole_days(ends, made) / 365.25), "days_since_changed_log": log_days(now, changed),
        "status_hold": F.when(ok, one_zero(F.coalesce(F.exists(d["domain_status"], lambda s: F.contains(s, F.lit("hold"))), F.lit(False)))),
        "status_n": F.when(ok, F.coalesce(F.greatest(F.size(d["domain_status"]), F.lit(0)), F.lit(0))),
    })


def parse_registration(json: Column) -> Column:
    """A registration fact from a registry's JSON answer."""
    schema = "events array<struct<eventAction:string,eventDate:string>>, entities array<struct<roles:array<string>,vcardArray:string,publicIds:array<struct<type:string,identifier:string>>>>, status array<string>, nameservers array<struct<ldhName:string>>"
    j = F.from_json(json, schema)
    event = lambda name: F.get(F.filter(j["events"], lambda e: e["eventAction"] == name), F.lit(0))["eventDate"]
    registrar = F.get(F.reverse(F.filter(j["entities"], lambda e: F.array_contains(e["roles"], "registrar"))), F.lit(0))
    card = F.from_json(F.get_json_object(registrar["vcardArray"], "$[1]"), "array<array<string>>")
    name = F.get(F.get(F.filter(card, lambda item: item[0] == "fn"), F.lit(0)), F.lit(3))
    iana = F.get(F.reverse(F.filter(registrar["publicIds"], lambda x: F.contains(x["type"], F.lit("IANA")))), F.lit(0))["identifier"]
    none = F.array().cast("array<string>")
    return F.struct(
        F.lit("ok").alias("status"), event("registration").alias("created"), event("expiration").alias("expires"), event("last changed").alias("changed"), name.alias("registrar"), iana.alias("registrar_iana"),
        F.slice(F.coalesce(F.transform(j["status"], F.lower), none), 1, 12).alias("domain_status"), F.slice(F.coalesce(F.transform(j["nameservers"], lambda n: F.lower(F.coalesce(n["ldhName"], F.lit("")))), none), 1, 8).alias("ns"),
    )


def server_of(keys: DataFrame, bootstrap: DataFrame, reg: str = "reg") -> DataFrame:
    """keys with base_url, the registry that knows the domain by its last label; bootstrap is (tld, base_url)."""
    return keys.withColumn("_tld", F.substring_index(reg, ".", -1)).join(F.broadcast(bootstrap), F.col("_tld") == F.col("tld"), "left").drop("_tld", "tld")


def missing_keys(keys: DataFrame, cache: DataFrame, key: str) -> DataFrame:
    """The different keys that the cache lacks."""
    return keys.select(key).where(F.col(key).isNotNull()).distinct().join(cache.select(key), key, "left_anti")


def gather(keys: DataFrame, key: str, cache: DataFrame, provider: Callable[[DataFrame], DataFrame] | None) -> DataFrame:
    """Facts for all keys: those in the cache and, for the others, what the provider answers (nothing by default)."""
    known = cache.join(keys.select(key).distinct(), key, "left_semi")
    if provider is None:
        return known
    missing = missing_keys(keys, cache, key)
    return known if missing.isEmpty() else known.unionByName(provider(missing), allowMissingColumns=True)


def has_domain(column: str) -> Column:
    """Whether a scored row's cell names a host that may be looked up."""
    p, s = F.col("p"), strip(F.coalesce(F.col(f"`{column}`"), F.lit("")))
    return (s != "") & ~has_space(s) & (p["host"] != "") & ((p["ip"] > 0) | F.contains(p["host"], F.lit(".")))


def gated(scored: DataFrame, mode: str, column: str = "url") -> DataFrame:
    """scored with _gate (whether the mode looks the row up), _can (whether it can be), and _host and _reg, its keys if it can."""
    if mode not in ("review", "all"):
        raise ValueError(f"enrich mode must be 'review' or 'all', not {mode!r}")
    listed = F.col("list_kind").isNotNull() if "list_kind" in scored.columns else F.lit(False)
    gate = ~listed if mode == "all" else ~listed & (F.col("fraud_verdict") == "REVIEW")
    p = F.col("p")
    step = scored.withColumns({"_gate": gate, "_can": gate & has_domain(column) & (p["ip"] == 0) & ~is_platform(p)})
    return settled(step, {"_host": F.when(F.col("_can"), p["host"]), "_reg": F.when(F.col("_can") & ~p["private_suffix"], p["reg"])})


def wanted_keys(scored: DataFrame, mode: str, column: str = "url") -> DataFrame:
    """(host, reg): the different hosts that the mode looks up, and their domains; reg is null for a hosting platform's."""
    return gated(scored, mode, column).where("_host IS NOT NULL").groupBy(F.col("_host").alias("host")).agg(F.max("_reg").alias("reg"))


def enrich(scored: DataFrame, model: ModelDocument, second: ModelDocument, dns: DataFrame, rdap: DataFrame, now: float, mode: str = "review", column: str = "url", base_rate: float | None = None) -> DataFrame:
    """scored (of score_urls, with list_kind if lists were matched), with a second opinion where facts allow it.

    dns is keyed by host and rdap by reg, each with the fields of a fact. mode is review (only rows in REVIEW) or
    all (every row that no list decides). A row whose domain resolves is judged by both models' raw scores
    together; others keep their verdict. Adds analysis_mode, lookup_status and evidence.
    """
    first = ["raw", "x", "contributions", "probability", "adjusted", "fraud_verdict", "confidence", "reasons"]
    step, p = gated(scored, mode, column).withColumn("_first", F.struct(*first)), F.col("p")
    listed = F.col("list_kind").isNotNull() if "list_kind" in scored.columns else F.lit(False)
    domain = has_domain(column)
    facts = dns.select(F.col("host").alias("_dk"), F.struct("*").alias("_d"))
    records = rdap.select(F.col("reg").alias("_rk"), F.struct("*").alias("_r"))
    step = step.join(facts, F.col("_host") == F.col("_dk"), "left").join(records, F.col("_reg") == F.col("_rk"), "left").drop("_dk", "_rk")
    more = dns_features(F.col("_d")) | rdap_features(F.col("_r"), F.lit(float(now)))
    step = step.withColumn("_e", F.struct(*[v.alias(k) for k, v in more.items()]))
    step = step.withColumn("_use", F.coalesce(F.col("_can") & F.col("error").isNull() & (F.col("_e.dns_resolves") == 1.0), F.lit(False)))
    step = step.withColumn("_x2", F.when(F.col("_use"), vector(second, "_e", DNS_FEATURES + RDAP_FEATURES)))
    step = step.withColumn("_s", tree_scores(scored.sparkSession, second, F.col("_x2")))
    step = step.withColumns({"error": F.coalesce("error", F.concat(F.lit(FAILED), F.col("_s.failure"))), "raw": F.col("raw") + F.col("_s.raw"), "x": F.concat("x", "_x2"), "contributions": F.concat("contributions", "_s.contributions")})
    step = judged(step, second, model.features + second.features, base_rate)
    step = step.withColumns({c: F.when(F.col("_use"), F.col(c)).otherwise(F.col(f"_first.{c}")) for c in first})

    a_status = F.coalesce("_d.a_status", F.lit("unavailable"))
    r_status = F.when(p["private_suffix"], "not applicable (hosting platform)").otherwise(F.coalesce("_r.status", F.lit("unavailable")))
    note = F.concat(F.lit("dns="), a_status, F.lit("; rdap="), r_status)
    dead = F.coalesce(*[F.when(a_status == k, v) for k, v in DNS_NOTES.items()], F.concat(F.lit("DNS lookup failed ("), a_status, F.lit(")")))
    looked = F.when(~domain, "skipped (no domain)").when(p["ip"] > 0, "skipped (IP host)").when(is_platform(p), PLATFORM_NOTE).when(F.col("_use"), note).otherwise(F.concat(note, F.lit("; "), dead))
    clear = F.lit(mode == "review") & ~listed & F.col("_first.fraud_verdict").isin("FRAUD", "LEGITIMATE")
    evidence = F.struct(F.col("_d").alias("dns"), F.col("_r").alias("registration"), whole_days(F.lit(float(now)), seconds(F.col("_r.created"))).cast("long").alias("domain_age_days"))
    return step.withColumns({
        "analysis_mode": F.when(listed, F.concat(F.lit("your "), F.col("list_kind"), F.lit(" list")) if "list_kind" in scored.columns else F.lit(None)).when(F.col("_use"), MODES["enriched"]).when(F.col("_gate"), MODES["unavailable"]).when(clear, MODES["clear"]).otherwise(MODES["offline"]),
        "lookup_status": F.when(F.col("_gate"), looked).when(clear, "not looked up (verdict already clear)").otherwise(""),
        "evidence": F.when(F.col("_can"), evidence),
    }).drop("_gate", "_can", "_first", "_host", "_reg", "_d", "_r", "_e", "_use", "_x2", "_s")


def live(parsed: DataFrame, dns: DataFrame, p: str = "p") -> DataFrame:
    """Rows whose host resolves and that aren't on a shared platform: those for which domain facts mean something."""
    up = dns.where(dns_features(F.struct(*[F.col(c) for c in dns.columns]))["dns_resolves"] == 1.0).select(F.col("host").alias("_live")).distinct()
    rows = settled(parsed.where(~is_platform(F.col(p))), {"_h": F.col(f"{p}.host")})
    return rows.join(up, F.col("_h") == F.col("_live"), "left_semi").drop("_h")


def log_age(created: Column, seen: Column) -> Column:
    """log10(1 + days) from a registration to the day on which a row was seen, rather than to now; null where either is unknown."""
    return F.log10(1 + F.greatest(F.lit(0.0), whole_days(seconds(seen), seconds(created))))
