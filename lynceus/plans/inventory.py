"""More named queries: sources and sinks as round trips, samples, look-ups, wording and streams.

`lynceus.plans.inventory_sql` has the same results in SQL. Files are written to the folder that all executors share.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lynceus.functions import text as X
from lynceus.functions import url as U
from lynceus.functions.features import extract, popularity
from lynceus.functions.reasons import signals_text, worded
from lynceus.functions.suffix import SuffixRules, split_hosts
from lynceus.operators import audit, datasets, encoders, enrich, lists, metrics, scoring, training
from lynceus.operators.toy import offline_model, second_model
from lynceus.plans.queries import QUERIES, _by_host, _entries, _facts, _pages, _scored, _table, query
from lynceus.plans.urls import analyse, json_records, result_cells
from lynceus.sources import delimited, feeds, lookup, sinks
from lynceus.sources.folder import shared_folder
from lynceus.streaming import urls as streams

__all__ = ["QUERIES"]


def _file(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _lines(df: DataFrame, line: Column, name: str, header: str | None = None) -> str:
    """A folder of text files with a line for each row, each file under the header if there is one."""
    path = _file(df.sparkSession, name)
    writer = df.select(line.alias("value")).write
    if header is None:
        writer.text(path)
    else:
        df.select(line.alias(header)).write.option("header", True).option("quote", "\u0000").option("emptyValue", "").csv(path)
    return path


# Sources.


@query
def sniff_quoted(spark, sf):
    """Documents as a CSV with quotes and line breaks in cells, sniffed and read again."""
    path = _file(spark, "quoted")
    docs = _table(spark, sf, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "lang")
    docs.write.csv(path, header=True, escape='"', quoteAll=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    rows, _ = delimited.read_delimited(spark, path)
    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", F.sha2("text", 256).alias("text"))


@query
def sniff_utf16(spark, sf):
    path = _file(spark, "utf16")
    _pages(spark, sf).write.csv(path, header=True, sep="\t", encoding="UTF-16")
    rows, layout = delimited.read_delimited(spark, path)
    return rows.select(F.col("page_id").cast("long").alias("page_id"), F.col(layout.url_column).alias("url"), F.lit(layout.encoding).alias("encoding"))


@query
def sniff_latin(spark, sf):
    """Names with letters that aren't UTF-8 as they stand in the file."""
    path = _file(spark, "latin")
    rows = _table(spark, sf, "customer").select("c_custkey", F.concat(F.lit("http://example.com/"), F.col("c_custkey").cast("string")).alias("link"), F.concat(F.lit("é ü ñ "), "c_name").alias("note"))
    rows.write.csv(path, header=True, sep=";", encoding="ISO-8859-1")
    back, layout = delimited.read_delimited(spark, path)
    return back.select(F.col("c_custkey").cast("long").alias("c_custkey"), F.col(layout.url_column).alias("link"), "note", F.lit(layout.encoding).alias("encoding"))


@query
def sniff_ragged(spark, sf):
    """Rows with extra and with missing fields."""
    extra = F.when(F.col("page_id") % 3 == 0, ",x,y").when(F.col("page_id") % 3 == 1, ",x").otherwise("")
    path = _lines(_pages(spark, sf), F.concat(F.col("page_id").cast("string"), F.lit(","), F.regexp_replace("url", ",", "%2C"), extra), "ragged")
    rows, layout = delimited.read_delimited(spark, path, layout=delimited.Layout("utf-8", ",", ["id", "url", "note"], False, 1, delimited.splits_of(spark, path, ",")))
    return rows.select(F.col("id").cast("long").alias("page_id"), "url", "note")


@query
def sniff_lines(spark, sf):
    """One URL on a line; some have commas."""
    path = _lines(_pages(spark, sf), F.concat("url", F.when(F.col("page_id") % 4 == 0, ",x").otherwise("")), "lines")
    rows, layout = delimited.read_delimited(spark, path)
    return rows.select(F.col(layout.url_column).alias("url"))


@query
def url_column_choice(spark, sf):
    """Which column each of a few headers gets, by name and by cells (the first hundred rows of the file are its head)."""
    heads = [["domain", "url"], ["S.No", "Site Link"], ["a", "b"], ["mail link", "x url"], ["website", "href"], ["id", "note"]]
    sample = ["1", "http://example.com/x"]
    out = [(" ".join(h), delimited.Cells.of(spark, [h, sample, sample]).url_index(None, True)) for h in heads]
    return spark.createDataFrame(out, "header string, place int")


@query
def url_list_source(spark, sf):
    """URLs given as a list, as the command line has them, with bytes that aren't text."""
    return delimited.from_urls(spark, ["http://a.test/", "x\udcff.test", "é.test", "a\udcc3\udca9.test"]).select(F.col("_row_id").alias("row"), "url")


@query
def list_file(spark, sf):
    """A list file with comments, notes, hosts-file lines, wildcards and prefixes, a line for each page."""
    host = F.regexp_extract("url", "^[a-z]+://([^/?#]+)", 1)
    kind = F.col("page_id") % 5
    line = F.when(kind == 0, F.concat(F.lit("# "), host)).when(kind == 1, F.concat(host, F.lit(" a note"))).when(kind == 2, F.concat(F.lit("0.0.0.0 "), host)).when(kind == 3, F.concat(F.lit("*."), host, F.lit("/Login"))).otherwise(F.concat(F.lit("http://"), host, F.lit("/a/./b?x=1")))
    path = _file(spark, "list")
    _pages(spark, sf).select(line.alias("value")).coalesce(1).write.text(path)
    return lists.read_lists(spark, block=[path]).entries.groupBy("kind", "host", "prefix", "wild").agg(F.count(F.lit(1)).alias("n"))


@query
def feed_files(spark, sf):
    """A line feed, an array of JSON objects and an SQL dump, each from the pages' URLs."""
    pages = _pages(spark, sf)
    line = _lines(pages, F.when(F.col("page_id") % 2 == 0, F.col("url")).otherwise(F.concat(F.lit("# "), "url")), "feed")
    dump = _lines(pages, F.concat(F.lit("INSERT INTO t VALUES ("), F.col("page_id").cast("string"), F.lit(",'"), F.replace("url", F.lit("'"), F.lit("")), F.lit("',1);")), "dump")
    a = feeds.line_feed(spark, line).select(F.lit("line").alias("feed"), "url")
    b = feeds.dump_rows(spark, dump, "\\((\\d+),'([^']*)',(\\d)\\)", {"id": 1, "url": 2, "label": 3}).select(F.lit("dump").alias("feed"), "url").distinct()
    path, host = _file(spark, "json"), F.regexp_extract("url", "^[a-z]+://([^/?#]+)", 1)
    part = F.pmod(F.xxhash64(host), F.lit(1 + pages.count() // 1000))  # an array of about a thousand hosts a file
    arrays = pages.groupBy(part.alias("part")).agg(F.to_json(F.collect_set(F.struct(F.upper(host).alias("domain")))).alias("value"))
    arrays.repartition("part").write.partitionBy("part").text(path)
    c = feeds.json_domains(spark, f"{path}/*", "domain").select(F.lit("json").alias("feed"), F.col("host").alias("url"))
    return a.unionByName(b).unionByName(c)


@query
def newest_snapshot(spark, sf):
    rows = _table(spark, sf, "orders").select(F.date_format("o_orderdate", "yyyy-MM").alias("path"), "o_orderkey")
    return feeds.newest_snapshot(rows)


@query
def index_range(spark, sf):
    """Index blocks that belong to a domain: keys from the domain's own to the last of its hosts."""
    keys = _by_host(spark, sf).select(F.concat(U.surt(F.col("host")), F.lit(")/"), F.col("page_id").cast("string")).alias("key"))
    return keys.where(feeds.index_range(keys, F.lit("example.com")))


@query
def paged_pull(spark, sf):
    """Days of an API with repeats: the first event of each user."""
    e = _table(spark, sf, "events").select(F.col("user_id").alias("url"), "event_id", "event_type")
    return feeds.latest_by_day(e, "url", "event_id")


@query
def date_texts(spark, sf):
    rows = _table(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("T00:00Z"))).otherwise(F.lit("n/a")).alias("t"))
    return rows.select("o_orderkey", feeds.day_of(F.col("t")).alias("day"))


# URLs, hosts and addresses.


@query
def cell_errors(spark, sf):
    """Cells that can't be scored, and why."""
    k = F.col("page_id") % 6
    cell = F.when(k == 0, "").when(k == 1, "  ").when(k == 2, "http://").when(k == 3, F.concat(F.lit("a "), "url")).when(k == 4, "localhost").otherwise(F.col("url"))
    rows = _pages(spark, sf).select("page_id", cell.alias("url"))
    p = U.parse(rows)
    return p.select("page_id", scoring.error_of(F.col("url"), F.col("p")).alias("error"))


@query
def authority_parts(spark, sf):
    """User part, port and host of URLs with each kind of authority."""
    n = F.col("page_id")
    host = F.when(n % 4 == 0, "a:b@example.com:8080").when(n % 4 == 1, "EXAMPLE.com.:").when(n % 4 == 2, "[2001:db8::1]:99999").otherwise("u@v@example.org")
    rows = _pages(spark, sf).select("page_id", F.concat(F.lit("http:/"), host, F.lit("/x")).alias("url"))
    return U.parse(rows).select("page_id", "p.userinfo", "p.host", "p.port", "p.port_error", "p.ip")


@query
def ip_forms(spark, sf):
    """Spellings of IPv4 addresses: one number, hexadecimal, octal parts and two parts."""
    n = F.col("c_custkey") * 7919 * 65537 % 4278190080 + 16777216
    part = lambda s: F.shiftright(n, s).bitwiseAND(255)
    k = F.col("c_custkey") % 4
    octal = F.concat_ws(".", *[F.concat(F.lit("0"), F.conv(part(s).cast("string"), 10, 8)) for s in (24, 16, 8, 0)])
    host = F.when(k == 0, n.cast("string")).when(k == 1, F.concat(F.lit("0x"), F.hex(n))).when(k == 2, octal).otherwise(F.concat_ws(".", part(24).cast("string"), n.bitwiseAND(16777215).cast("string")))
    rows = _table(spark, sf, "customer").select("c_custkey", host.alias("host"))
    return rows.select("c_custkey", U.ip_version(F.col("host")).alias("version"), lists.canonical_ip(F.col("host")).alias("address"))


@query
def host_spelling(spark, sf):
    """How lists spell hosts with sharp s, and the ASCII form of others."""
    rows = _table(spark, sf, "supplier").select("s_suppkey", F.concat(F.lit("http://"), F.when(F.col("s_suppkey") % 2 == 0, "faß").otherwise("münchen"), F.lit(".de/"), F.col("s_suppkey").cast("string")).alias("url"))
    p = U.parse(rows)
    return p.select("s_suppkey", lists.list_host(F.col("p")).alias("listed"), "p.host")


@query
def suffix_split_public(spark, sf):
    """The split without private rules."""
    hosts = spark.createDataFrame([("user.github.io",), ("a.b.example.co.uk",), ("github.io",), ("x.foo.ck",)], "host string").unionByName(_by_host(spark, sf).select("host").distinct())
    out = split_hosts(hosts, F.col("host"), private=False)
    return out.select("host", F.col("_reg").alias("reg"), F.col("_suffix").alias("suffix"))


@query
def popular_ranks(spark, sf):
    ranks = _by_host(spark, sf).groupBy("host").agg(F.min("page_id").alias("rank")).where("rank % 2 = 0")
    rows = _by_host(spark, sf).join(ranks, "host", "left")
    return rows.select("page_id", *[F.round(v, 6).alias(k) for k, v in popularity(F.col("host"), F.col("rank")).items()])


def _made_up(url: str, accept: str) -> tuple[int, str, float]:
    """Answers of servers that don't exist, by a hash of the name asked for; some fail at first, some always."""
    import hashlib
    import json
    from urllib.parse import parse_qs, urlsplit

    parts = urlsplit(url)
    asked = parse_qs(parts.query)
    name = asked["name"][0] if asked else parts.path.rpartition("/")[2]
    h = int(hashlib.md5(f"f|{name}".encode()).hexdigest()[:8], 16) % 100
    if not asked:
        if h < 10:
            return 404, "", 0.0
        return (503, "", 0.0) if h < 20 else (200, "no JSON" if h < 30 else json.dumps({"events": [{"eventAction": "registration", "eventDate": "2020-01-01T00:00:00Z"}], "status": ["Active"]}), 0.0)
    if parts.netloc == "1.1.1.1" and h % 3 == 0:
        raise ConnectionError
    if h < 20:
        return 200, json.dumps({"Status": 3}), 0.0
    record = asked["type"][0]
    if record == "AAAA" and h < 90:
        return 200, json.dumps({"Status": 0, "Answer": []}), 0.0
    data = {"A": "192.0.2.1", "AAAA": "2001:db8::1", "NS": "NS1.Example.", "MX": "10 mx.example."}[record]
    return 200, json.dumps({"Status": 0, "Answer": [{"type": 5, "TTL": 9, "data": f"alias.{name}."}, {"type": lookup.RECORDS[record], "TTL": h, "data": data}]}), 0.0


@query
def dns_client(spark, sf):
    """DNS facts of the pages' hosts from resolvers that answer in JSON; the answers are made up."""
    facts = lookup.dns_facts(_by_host(spark, sf).select("host", F.col("group").alias("reg")).distinct(), _made_up)
    lists_ = [F.array_join(c, " ").alias(c) for c in ("a", "aaaa", "ns", "mx")]
    return facts.select("host", "a_status", "ttl_a", "cname", "ns_status", "mx_status", *lists_)


@query
def registration_client(spark, sf):
    """Registration facts of the pages' hosts, as if each were a domain, from registries whose answers are made up."""
    servers = spark.createDataFrame([("com", "https://a.example/"), ("org", "https://b.example")], "tld string, base_url string")
    facts = lookup.registration_facts(_by_host(spark, sf).select(F.col("host").alias("reg")), servers, _made_up, per_second=10_000.0)
    return facts.select("reg", "status", "created", F.array_join("domain_status", ",").alias("flags"))


@query
def signal_texts(spark, sf):
    """Signals of each URL in words."""
    f = extract(U.parse(_pages(spark, sf)))
    return f.select("page_id", signals_text(F.col("f")).alias("signals"))


# Wording, cells and sinks.


@query
def fixed_numbers(spark, sf):
    """Numbers with three digits and with one, halves by the binary value."""
    v = F.col("l_extendedprice") / 1000
    rows = _table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_discount").alias("d"), (F.col("l_quantity") / 16).alias("q"))
    return rows.select("l_orderkey", "l_linenumber", X.fixed(F.col("d"), 3).alias("d3"), X.fixed(F.col("q"), 1).alias("q1"), X.fixed(F.col("q"), 3).alias("q3"))


@query
def phrases(spark, sf):
    """What numbers mean as counts, lengths, shares, days and switches."""
    names = ["n_params", "path_len", "digit_ratio", "domain_age_days_log", "has_port", "reg_period_years", "odd_one"]
    n = F.col("o_orderkey") % 900
    values = [n % 4, n % 5, (n % 101) / 100, F.log10(F.lit(1.0) + n), n % 2, (n % 5).cast("double"), n / 8]
    top = F.array(*[F.struct(F.lit(i).alias("index"), v.cast("double").alias("value"), F.when(n % 3 == 0, -1.0).otherwise(1.0).alias("contribution")) for i, v in enumerate(values)])
    said = worded(names, top, F.lit("com"))
    return _table(spark, sf, "orders").select("o_orderkey", *[said[i].alias(name) for i, name in enumerate(names)])


def _listed(spark: SparkSession, sf: str) -> DataFrame:
    return analyse(_pages(spark, sf).withColumn("_row_id", F.col("page_id")), offline_model(), lists=lists.UserLists(_entries(spark), [], {}))


@query
def url_json(spark, sf):
    """The JSON record of each page's URL."""
    a = _listed(spark, sf)
    return a.select("page_id", json_records(a, "url").alias("json"))


@query
def csv_sink(spark, sf):
    """Result rows as CSV files in row order, read back line by line without the headers."""
    path = _file(spark, "csv")
    sinks.write_csv_parts(_listed(spark, sf), path, ["page_id", "url"], ["id", "url"])
    lines = spark.read.text(path, lineSep="\r\n").select(F.col("value").alias("line"))
    return lines.where(~F.ltrim("line", F.lit("\ufeff")).startswith("id,url,fraud_verdict"))  # Spark itself may drop the mark


@query
def partitioned_sink(spark, sf):
    """A table written by split, read back with the split from its folders."""
    path = _file(spark, "splits")
    c = _table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("grp"))
    sinks.write_table(c.withColumn("split", datasets.split_of(F.col("grp"), "s")), path, ["split"])
    return spark.read.parquet(path).select("grp", F.col("split").cast("string").alias("split"))


@query
def row_chunks(spark, sf):
    rows = _table(spark, sf, "orders").select("o_orderkey")
    return rows.select("o_orderkey", *[v.alias(k) for k, v in audit.chunks(F.col("o_orderkey")).items()])


# Data sets.


@query
def feed_exclusion(spark, sf):
    """Legitimate rows without what feeds name: URLs on platforms, hosts and domains elsewhere."""
    rows = _by_host(spark, sf).join(_pages(spark, sf), "page_id").withColumn("is_platform", F.col("group") == "example.net")
    feed = rows.where("page_id % 5 = 0")
    return datasets.without_feeds(rows, feed.select("host"), feed.where("page_id % 35 = 0").select("group"), feed.select(F.substring_index("url", "#", 1).alias("url"))).select("page_id")


@query
def unseen_domains(spark, sf):
    rows = _by_host(spark, sf)
    return datasets.unseen_groups(rows, rows.where("page_id % 50 = 1")).select("page_id")


@query
def tier_sample(spark, sf):
    """Customers as a ranked list, so many from each tier."""
    ranked = _table(spark, sf, "customer").select(F.col("c_name").alias("domain"), F.col("c_custkey").alias("rank"))
    return datasets.tiered(ranked, 50, ((40, 0.2), (100, 0.3), (1_000_000, 0.5)))


@query
def stratified_sample(spark, sf):
    rows = _scored(spark, sf).withColumn("url", F.col("doc_id").cast("string"))
    return datasets.stratified(rows, "label", 60).select("doc_id", "label")


@query
def hash_sample(spark, sf):
    """A sample without replacement: the feature is its size."""
    return datasets.sample_rows(_table(spark, sf, "orders").select("o_orderkey"), 100, "o_orderkey")


@query
def host_caps(spark, sf):
    rows = _by_host(spark, sf).withColumn("url", F.col("page_id").cast("string"))
    return datasets.cap_hosts(rows, 2, 25).select("page_id")


@query
def label_filters(spark, sf):
    """URLs of some length, of labelled domains, seen since a day."""
    rows = _by_host(spark, sf).join(_pages(spark, sf), "page_id").withColumn("date", F.when(F.col("page_id") % 2 == 0, "2026-01-02").otherwise("2025-12-31"))
    wanted = spark.createDataFrame([("example.com",), ("example.org",)], "group string")
    return datasets.usable(rows, least=30, since="2026-01-01", groups=wanted).select("page_id")


@query
def live_rows(spark, sf):
    """Rows whose host resolves and that aren't on a platform."""
    dns, _ = _facts(spark, sf)
    return enrich.live(U.parse(_pages(spark, sf)), dns).select("page_id")


@query
def publishable_suffixes(spark, sf):
    rows = _scored(spark, sf).select(F.concat_ws(".", "grp", "dataset").alias("tld"), (F.col("doc_id") % 3).alias("group"), "label")
    rules = SuffixRules({("normal", "web.en"): False})
    return encoders.publishable(encoders.suffix_rates(rows), rows, rules).select("suffix", F.round("rate", 6).alias("rate"))


@query
def registry_of(spark, sf):
    """Which registry knows each domain, by its last label."""
    servers = spark.createDataFrame([("com", "https://a.example/"), ("org", "https://b.example/")], "tld string, base_url string")
    return enrich.server_of(_by_host(spark, sf).select(F.col("group").alias("reg")).distinct(), servers)


@query
def registry_workload(spark, sf):
    """Look-ups by registry: hosts, domains and queries."""
    servers = spark.createDataFrame([("com", "https://a.example/"), ("org", "https://b.example/")], "tld string, base_url string")
    return audit.registry_workload(U.parse(_pages(spark, sf)), servers)


@query
def workload_order(spark, sf):
    """Hosts in the order of reversed labels, with their places."""
    return audit.reverse_host_order(_by_host(spark, sf).select("host").distinct(), "host")


# Scores and models.


@query
def score_alignment(spark, sf):
    """Scores of two systems side by side, by URL."""
    a = _scored(spark, sf).select(F.col("doc_id").alias("url"), "score")
    b = a.where("url % 3 <> 0").select("url", (1 - F.col("score")).alias("score"))
    return audit.align_scores(a, b, "url").select("url", "score", F.round("other", 6).alias("other"))


@query
def age_when_seen(spark, sf):
    """Days from registration to the day on which a row was seen."""
    rows = _table(spark, sf, "orders").select("o_orderkey", F.lit("1990-01-01T12:00:00Z").alias("created"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"))
    return rows.select("o_orderkey", F.round(enrich.log_age(F.col("created"), F.col("date")), 6).alias("age"))


@query
def recall_elsewhere(spark, sf):
    """The share of one data set's positives above a threshold that another data set fixes."""
    s = _scored(spark, sf)
    return metrics.recall_at_threshold_of(s.where("dataset = 'en'"), s.where("dataset <> 'en'"), 0.1).select(F.round("threshold", 9).alias("threshold"), F.round("recall", 6).alias("recall"), "n")


@query
def standardised_features(spark, sf):
    """Two feature sets side by side, scaled by the training rows' means and deviations."""
    s = _scored(spark, sf).select("doc_id", "score", F.length("grp").cast("double").alias("len"), (F.col("doc_id") % 5 != 0).alias("train"))
    return training.standardised(s, ["score", "len"], F.col("train")).select("doc_id", F.round("score", 6).alias("score"), F.round("len", 6).alias("len"))


@query
def shifted_odds(spark, sf):
    """Raw scores whose log odds are moved from one base rate to another before they are calibrated."""
    s = _scored(spark, sf)
    return s.select("doc_id", F.round(training.shifted_log_odds(F.col("score") * 4 - 2, 0.3, 0.05), 6).alias("raw"))


@query
def folded_rates(spark, sf):
    """Suffix rates by fold: each row's is learned from the other folds."""
    rows = _scored(spark, sf).select("doc_id", "grp", F.col("dataset").alias("tld"), "label")
    return encoders.out_of_fold_rates(rows, F.col("grp"), 3).select("doc_id", F.col("fold").cast("int").alias("fold"), F.round("rate", 6).alias("rate"))


@query
def cascade_scores(spark, sf):
    """The second score inside the first one's uncertain band."""
    s = _scored(spark, sf)
    return s.select("doc_id", F.round(training.cascade(F.col("score"), 1 - F.col("score") / 2, 0.4, 0.6), 6).alias("score"))


@query
def count_tensor(spark, sf):
    """Rows by data set, label and verdict, with each count's share of its data set and label, and the share's exact interval."""
    s = _scored(spark, sf).withColumn("verdict", F.when(F.col("score") >= 0.7, "FRAUD").when(F.col("score") <= 0.3, "LEGITIMATE").otherwise("REVIEW"))
    cells = metrics.count_tensor(s, ["dataset", "label", "verdict"], ["dataset", "label"])
    return cells.select("dataset", "label", "verdict", "n", *[F.round(c, 6).alias(c) for c in ("share", "low", "high")])


@query
def crosstab_columns(spark, sf):
    """Shares of each column of a cross table."""
    c = audit.crosstab(_scored(spark, sf), "dataset", "label", [0, 1], by_column=True)
    return c.select("dataset", "n_0", "n_1", F.round("share_0", 6).alias("share_0"), F.round("share_1", 6).alias("share_1"))


@query
def lookup_evidence(spark, sf):
    """What look-ups found, for the rows that may be looked up."""
    dns, rdap = _facts(spark, sf)
    a = analyse(_pages(spark, sf), offline_model(), second=second_model(), dns=dns, rdap=rdap, now=1_735_689_600.0, mode="all")
    return a.select("page_id", F.col("evidence.dns.a_status").alias("a_status"), F.col("evidence.registration.status").alias("status"), F.col("evidence.domain_age_days").alias("age"), "lookup_status", "analysis_mode", F.round("model_probability", 6).alias("probability"))


# Streams.


@query
def stream_windows(spark, sf):
    """Events by hour and type; a window appears as soon as it has rows and is replaced as it grows."""
    out = _file(spark, "windows")
    stream = spark.readStream.schema(_table(spark, sf, "events").schema).parquet(f"{sf}/events*")
    streams.upsert_available(streams.windowed_counts(stream.withColumn("ts", F.col("ts").cast("timestamp"))), f"{out}/t", f"{out}/c")
    rows = streams.newest(spark.read.parquet(f"{out}/t"), "start", "event_type")
    return rows.select(F.unix_seconds("start").alias("start"), "event_type", "n")
