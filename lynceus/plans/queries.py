"""Named queries over the given tables, one for each operator or a few that belong together.

Each is called with (spark, sf_dir). `lynceus.plans.oracle` has the same results in SQL wherever SQL can say it.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lynceus.functions import text as X
from lynceus.functions import url as U
from lynceus.functions.features import FEATURES, extract, folded, is_typo
from lynceus.operators import audit, datasets, encoders, enrich, lists, metrics, scoring, training
from lynceus.operators.toy import offline_model, second_model
from lynceus.plans.urls import analyse, result_cells
from lynceus.sources import cache, delimited, feeds
from lynceus.sources.folder import shared_folder
from lynceus.streaming import urls as streams

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
#: Hosts, URLs and facts that the tables lack (examples and reserved names only).
HOSTS = ["a.b.example.co.uk", "example.co.uk", "co.uk", "x.foo.ck", "www.ck", "a.city.kawasaki.jp", "b.c.kawasaki.jp", "user.github.io", "deep.user.github.io", "example.zz", "localhost"]
WORDS = ["paypal", "paypa1", "paypall", "paypl", "g00gle", "google", "rnicrosoft", "microsof", "amazom", "vvalmart", "netflix", "example", "appel", "apple", "applex", "xapplex"]
CELLS = ["https://example.com", "example.com", "a@example.com", "1.2.3.4", "example", "a b.com", "www.example.org", "example.com/x", "x..y", "", "ab.c1", "foo.com?x=1", "ftp://q"]
PATHS = [("/a/./b/../c", ""), ("", "x=1"), ("/A/%2e%2E/b", "q=1&r=2"), ("/a/b/", ""), ("/..", ""), ("/x/y/.", "k")]


def query(f: Callable) -> Callable:
    QUERIES[f.__name__] = f
    return f


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _pages(spark: SparkSession, sf: str) -> DataFrame:
    return _table(spark, sf, "pages").select("page_id", "url")


def _scored(spark: SparkSession, sf: str) -> DataFrame:
    """Labelled documents with a score that comes from their length."""
    d = _table(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars")
    rows = _table(spark, sf, "labels").join(d, "doc_id")
    return rows.select("doc_id", F.col("lang").alias("dataset"), F.col("source").alias("grp"), F.col("quality").cast("int").alias("label"), ((F.col("n_chars") % 1000) / 1000.0).alias("score"))


def _features(spark: SparkSession, sf: str, names: str) -> DataFrame:
    wanted = names.split()
    f = extract(U.parse(_pages(spark, sf)), names=wanted)
    return f.select("page_id", *[F.round(f"f.{n}", 6).alias(n) for n in wanted])


@query
def url_parse(spark, sf):
    p = U.parse(_pages(spark, sf))
    return p.select("page_id", "p.scheme", "p.host", "p.path", "p.query", "p.fragment", "p.reg", "p.sub", U.canonical(F.col("p")).alias("canonical"))


@query
def url_keys(spark, sf):
    p = U.parse(_pages(spark, sf))
    return p.select("page_id", U.canonical_text(F.col("url")).alias("canonical_text"), U.loose_key(F.col("url")).alias("loose_key"), U.surt(F.col("p.reg")).alias("surt"))


@query
def url_features_counts(spark, sf):
    return _features(spark, sf, "url_len scheme_http n_at n_dot n_hyphen n_slash n_qmark n_equal n_amp n_percent n_hash n_pct_encoded non_ascii has_port query_len path_len host_len")


@query
def url_features_ratio(spark, sf):
    return _features(spark, sf, "digit_ratio letter_ratio upper_ratio special_ratio host_digit_ratio path_digit_ratio")


@query
def url_entropy(spark, sf):
    return _features(spark, sf, "url_entropy host_entropy path_entropy")


@query
def url_structure(spark, sf):
    return _features(spark, sf, "host_n_labels n_sub_labels sub_len www_prefix host_max_label_len path_depth path_max_seg_len is_homepage sld_len tld_len suffix_n_labels")


@query
def url_features_all(spark, sf):
    f = extract(U.parse(_pages(spark, sf)))
    return f.select("page_id", "tld", *[F.round(f"f.{n}", 6).alias(n) for n in FEATURES])


@query
def url_tokens_words(spark, sf):
    rest = F.lower(X.unquote(F.concat("p.path", F.lit("?"), F.col("p.query"))))
    return U.parse(_pages(spark, sf)).select("page_id", F.size(X.tokens(rest)).cast("long").alias("n_tokens"), F.size(F.filter(X.tokens(rest), lambda t: t.isin("login", "page", "ref", "update", "free"))).cast("long").alias("n_words"))


@query
def query_params(spark, sf):
    p = U.parse(_pages(spark, sf))
    names = F.transform(F.array_remove(F.split("p.query", "&", -1), ""), lambda kv: F.lower(F.substring_index(kv, "=", 1)))
    return p.select("page_id", F.array_join(names, ",").alias("params"), F.size(names).cast("long").alias("n_params"))


@query
def brand_typo(spark, sf):
    w = spark.createDataFrame([(x,) for x in WORDS], "word string")
    return w.select("word", is_typo("word").alias("typo"), folded(F.col("word")).alias("folded"))


@query
def suffix_split(spark, sf):
    hosts = U.parse(_pages(spark, sf)).select("p.host").distinct().unionByName(spark.createDataFrame([(h,) for h in HOSTS], "host string"))
    return U.parse(hosts, "host").select("host", "p.sub", "p.reg", "p.suffix", F.col("p.private_suffix").alias("private"))


@query
def path_norm_prefix(spark, sf):
    rows = spark.createDataFrame(PATHS, "path string, query string")
    t = U.normal_target(F.col("path"), F.col("query"))
    return rows.select("path", "query", t.alias("target"), F.array_join(F.sort_array(U.prefix_candidates(t)), " ").alias("candidates"))


@query
def looks_like_url(spark, sf):
    rows = spark.createDataFrame([(c,) for c in CELLS], "cell string").unionByName(_pages(spark, sf).select(F.col("url").alias("cell")))
    return rows.select("cell", U.looks_like_url(F.col("cell")).alias("looks"), U.strong_url(F.col("cell")).alias("strong"))


def _entries(spark: SparkSession) -> DataFrame:
    rows = [("block", "example.net", None, False), ("block", "example.com", "/fr", False), ("block", "example.org", "/en", True), ("allow", "example.org", None, False), ("allow", "m.example.com", None, False)]
    return spark.createDataFrame(rows, "kind string, host string, prefix string, wild boolean")


@query
def list_match(spark, sf):
    return lists.match_lists(U.parse(_pages(spark, sf)), _entries(spark)).select("page_id", "list_kind", "list_entry")


@query
def grouped_split(spark, sf):
    c = _table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("grp"))
    return c.select("grp", X.bucket(F.col("grp"), "s").cast("long").alias("bucket"), datasets.split_of(F.col("grp"), "s").alias("split"))


@query
def dedupe_conflict(spark, sf):
    rows = _table(spark, sf, "documents").join(_table(spark, sf, "labels"), "doc_id").select(F.col("text").alias("url"), F.col("quality").alias("label"), "doc_id")
    return datasets.dedupe(rows, order="doc_id").select("doc_id", "label", F.md5("url").alias("key"))


def _by_host(spark: SparkSession, sf: str) -> DataFrame:
    return U.parse(_pages(spark, sf)).select("page_id", F.col("p.host").alias("host"), F.col("p.reg").alias("group"))


@query
def cap_per_group(spark, sf):
    by_host = datasets.cap(_by_host(spark, sf), "host", 2, F.col("page_id"))
    return datasets.cap(by_host, "group", 20, F.col("page_id"))


@query
def cap_by_kind(spark, sf):
    return datasets.cap(_by_host(spark, sf), "group", F.when(F.col("group") == "example.com", 30).otherwise(3), F.col("page_id"), 30)


@query
def anti_seen(spark, sf):
    d, b = _table(spark, sf, "documents"), _table(spark, sf, "benchmark")
    return datasets.unseen(d.select("doc_id", "text"), b.unionByName(d.where("doc_id % 7 = 0").select(F.col("doc_id").alias("item_id"), "text")), "text", "text").select("doc_id")


@query
def class_exclusion(spark, sf):
    rows = _by_host(spark, sf)
    a, b = rows.where("page_id % 2 = 0"), rows.where("page_id % 3 = 0 AND group <> 'example.org'")
    platforms = spark.createDataFrame([("example.net",)], "group string")
    x, y = datasets.single_class(a, b, platforms)
    return x.select("page_id", F.lit("a").alias("class")).unionByName(y.select("page_id", F.lit("b").alias("class")))


@query
def class_balance(spark, sf):
    rows = _table(spark, sf, "labels").select("doc_id", F.col("quality").alias("label"))
    return datasets.balanced(rows, key="doc_id").select("doc_id", F.col("label").cast("int").alias("label"))


@query
def suffix_rate(spark, sf):
    rows = _scored(spark, sf).select(F.concat_ws(".", "grp", "dataset").alias("tld"), "label")
    return encoders.suffix_rates(rows).select("suffix", F.round("rate", 6).alias("rate"))


@query
def weights(spark, sf):
    w = datasets.sample_weights(_scored(spark, sf), {"en": 0.4, "de": 0.3, "fr": 0.2, "es": 0.1})
    return w.select("doc_id", F.round("weight", 6).alias("weight"))


@query
def confusion_metrics(spark, sf):
    m = metrics.confusion(_scored(spark, sf), 0.5)
    return m.select("n", "n_pos", "n_neg", "tp", "fp", "tn", "fn", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1", "fpr", "fnr", "accuracy")])


@query
def roc_auc(spark, sf):
    return metrics.roc_auc(_scored(spark, sf)).select(F.round("roc_auc", 6).alias("roc_auc"))


@query
def pr_auc(spark, sf):
    return metrics.pr_auc(_scored(spark, sf)).select(F.round("pr_auc", 6).alias("pr_auc"))


@query
def brier_logloss(spark, sf):
    return metrics.brier_logloss(_scored(spark, sf)).select(F.round("brier", 6).alias("brier"), F.round("log_loss", 5).alias("log_loss"))


@query
def ece(spark, sf):
    return metrics.ece(_scored(spark, sf)).select(F.round("ece", 6).alias("ece"))


@query
def reliability(spark, sf):
    return metrics.reliability(_scored(spark, sf), [0.1, 0.3, 0.5, 0.7, 0.9]).select(F.col("bin").cast("int").alias("bin"), "n", F.round("mean_score", 6).alias("mean_score"), F.round("observed", 6).alias("observed"))


@query
def recall_at_fpr(spark, sf):
    return metrics.recall_at_fpr(_scored(spark, sf), 0.1).select(F.round("recall", 6).alias("recall"))


@query
def threshold_at_fpr(spark, sf):
    return metrics.threshold_at_fpr(_scored(spark, sf), 0.1).select(F.round("threshold", 9).alias("threshold"))


@query
def weighted_threshold(spark, sf):
    return metrics.weighted_thresholds(_scored(spark, sf), {"en": 0.4, "de": 0.3, "fr": 0.2, "es": 0.1}, 0.1, 0.1)


@query
def calibration_forms(spark, sf):
    raw = (F.col("score") - 0.5) * 6
    model = lambda **c: scoring.ModelDocument([], [], calibration=c)
    return _scored(spark, sf).select("doc_id", F.round(scoring.calibrated(model(type="platt", a=1.7, b=0.1), raw), 6).alias("platt"), F.round(scoring.calibrated(model(type="isotonic", x=[-2.0, 0.0, 1.0, 2.5], y=[0.1, 0.3, 0.3, 0.9]), raw), 6).alias("isotonic"), F.round(scoring.calibrated(model(type="none"), raw), 6).alias("logistic"))


@query
def verdict_three_way(spark, sf):
    p = F.col("score")
    adjusted = scoring.prior_shifted(p, 0.1, 0.4712)
    kind, confidence = scoring.verdict(p, adjusted, 0.8727, 0.1009)
    return _scored(spark, sf).select("doc_id", F.round(adjusted, 6).alias("adjusted"), kind.alias("verdict"), F.round(confidence, 6).alias("confidence"))


@query
def tree_score(spark, sf):
    return scoring.score_urls(_pages(spark, sf), offline_model()).select("page_id", F.round("raw", 6).alias("raw"), F.round("probability", 6).alias("probability"))


@query
def tree_contributions(spark, sf):
    s = scoring.score_urls(_pages(spark, sf), offline_model())
    total = F.aggregate("contributions", F.lit(0.0), lambda a, x: a + x)
    return s.select("page_id", F.round(F.col("raw") - total, 6).alias("bias"), *[F.round(F.col("contributions")[i], 6).alias(n) for i, n in enumerate(offline_model().features)])


@query
def url_verdicts(spark, sf):
    a = analyse(_pages(spark, sf), offline_model())
    return a.select("page_id", "fraud_verdict", F.round("model_probability", 6).alias("probability"), "registrable_domain")


@query
def url_report(spark, sf):
    a = analyse(_pages(spark, sf), offline_model(), lists=lists.UserLists(_entries(spark), [], {}))
    cells = result_cells(a)
    return a.select("page_id", *[v.alias(k) for k, v in cells.items()])


def _facts(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Facts about the hosts of pages, made up from a hash of each."""
    rows = _by_host(spark, sf)
    h = X.bucket(F.col("host"), "f")
    one = lambda c: F.when(c, F.array(F.lit("192.0.2.1"))).otherwise(F.array().cast("array<string>"))
    dns = rows.select("host").distinct().select("host", F.when(h < 20, "nxdomain").otherwise("ok").alias("a_status"), one(h >= 20).alias("a"), F.lit(300).alias("ttl_a"), one(h > 90).alias("aaaa"), F.lit("").alias("cname"), F.lit("ok").alias("ns_status"), one(h > 5).alias("ns"), F.lit("ok").alias("mx_status"), one(h % 2 == 0).alias("mx"))
    rdap = rows.select(F.col("group").alias("reg")).distinct().select("reg", F.lit("ok").alias("status"), F.lit("2020-01-01T00:00:00Z").alias("created"), F.lit("2026-01-01").alias("expires"), F.lit(None).cast("string").alias("changed"), F.array(F.lit("client transfer prohibited")).alias("domain_status"))
    return dns, rdap


@query
def two_pass_gate(spark, sf):
    dns, rdap = _facts(spark, sf)
    a = analyse(_pages(spark, sf), offline_model(), second=second_model(), dns=dns, rdap=rdap, now=1_735_689_600.0, mode="review")
    return a.select("page_id", "offline_verdict", "fraud_verdict", "analysis_mode", "lookup_status", F.round("model_probability", 6).alias("probability"))


@query
def dns_features(spark, sf):
    dns, _ = _facts(spark, sf)
    f = enrich.dns_features(F.struct(*dns.columns))
    return dns.select("host", *[F.when(~F.isnan(v), F.round(v, 6)).alias(k) for k, v in f.items()])


@query
def rdap_features(spark, sf):
    rows = [("a", "ok", "2020-01-01T00:00:00Z", "2026-01-01", "2024-06-01T12:00:00+02:00", ["client hold"]), ("b", "not_found", None, None, None, None), ("c", "ok", "2024-12-31 23:59:59", "bad", None, []), ("d", "timeout", None, None, None, None)]
    t = spark.createDataFrame(rows, "reg string, status string, created string, expires string, changed string, domain_status array<string>")
    f = enrich.rdap_features(F.struct(*t.columns), F.lit(1_735_689_600.0))
    return t.select("reg", *[F.when(~F.isnan(v), F.round(v, 6)).alias(k) for k, v in f.items()])


@query
def registration_json(spark, sf):
    j = '{"events":[{"eventAction":"registration","eventDate":"2020-01-01T00:00:00Z"}],"entities":[{"roles":["registrar"],"vcardArray":["vcard",[["version",{},"text","4.0"],["fn",{},"text","Example Registrar"]]],"publicIds":[{"type":"IANA Registrar ID","identifier":"9999"}]}],"status":["Active"],"nameservers":[{"ldhName":"NS1.EXAMPLE.COM"}]}'
    t = spark.createDataFrame([(j,)], "json string")
    return t.select(enrich.parse_registration(F.col("json")).alias("r")).select("r.created", "r.registrar", "r.registrar_iana", F.array_join("r.domain_status", ",").alias("status"), F.array_join("r.ns", ",").alias("ns"))


@query
def cache_lww_ttl(spark, sf):
    e = _table(spark, sf, "events").select(F.col("user_id").alias("k"), F.unix_seconds(F.col("ts").cast("timestamp")).cast("double").alias("t"), F.col("value").alias("v"), F.col("event_id").alias("line"))
    now = e.agg(F.max("t")).first()[0]
    return cache.fresh(cache.last_written(e, F.col("line")), now, 7).select("k", "v")


@query
def lookup_missing(spark, sf):
    dns, _ = _facts(spark, sf)
    return enrich.missing_keys(_by_host(spark, sf), dns.where(F.col("a_status") == "ok"), "host")


@query
def session_gap(spark, sf):
    s = audit.sessions(_table(spark, sf, "events").select("event_id", "user_id", "ts"), "user_id", "ts", 3600)
    return s.groupBy("user_id").agg((F.max("session") + 1).alias("sessions"), F.count(F.lit(1)).alias("n"))


@query
def median_gap(spark, sf):
    return audit.median_gap(_table(spark, sf, "events"), "event_type", "ts").select("event_type", F.round("median_gap", 3).alias("median_gap"))


@query
def verdict_counts(spark, sf):
    return audit.verdict_counts(_table(spark, sf, "events"), "event_type")


@query
def crosstab(spark, sf):
    c = audit.crosstab(_scored(spark, sf), "dataset", "label", [0, 1])
    return c.select("dataset", "n_0", "n_1", F.round("share_0", 6).alias("share_0"), F.round("share_1", 6).alias("share_1"))


@query
def deciles(spark, sf):
    d = audit.deciles(_table(spark, sf, "orders"), "o_totalprice", "o_orderstatus")
    return d.select("o_orderstatus", *[F.round(F.col("deciles")[k], 3).alias(f"d{k}") for k in range(11)])


@query
def medians_missing(spark, sf):
    e = _table(spark, sf, "events").select("event_type", F.when(F.col("event_id") % 5 != 0, F.col("value")).alias("value"))
    return audit.medians_missing(e, ["value"], "event_type").select("event_type", F.round("median_value", 6).alias("median_value"), F.round("missing_value", 6).alias("missing_value"))


@query
def topn_groups(spark, sf):
    return datasets.platform_counts(_by_host(spark, sf), 10, "host")


@query
def arg_min_max(spark, sf):
    r = _table(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.sum("l_quantity").alias("q"), F.avg("l_discount").alias("d"))
    return audit.arg_ranges(r.select("l_returnflag", F.round("q", 2).alias("q"), F.round("d", 6).alias("d")), "l_returnflag", ["q", "d"])


@query
def determinism_audit(spark, sf):
    rows = _by_host(spark, sf).select("host", (F.col("page_id") % 2).alias("a"), F.lit("x").alias("b"))
    return audit.determinism(rows, "host", ["a", "b"])


@query
def explode_reasons(spark, sf):
    rows = _table(spark, sf, "events").select("event_type", F.array(F.concat(F.lit("value "), F.floor("value").cast("string")), F.concat(F.lit("type "), "event_type")).alias("reasons"))
    return audit.top_reasons(rows, 10, "reasons", "event_type").select("event_type", "template", "n", F.col("rank").cast("int").alias("rank"))


@query
def bytes_by_column(spark, sf):
    return audit.bytes_by_column(_table(spark, sf, "pages"), ["page_id", "url", "html"])


@query
def multi_line_cells(spark, sf):
    return audit.multi_line(_table(spark, sf, "documents").withColumn("_row_id", F.col("doc_id")), ["text", "lang"])


@query
def compare_outputs(spark, sf):
    a = _table(spark, sf, "labels").select("doc_id", "quality", "toxic").distinct()
    b = a.where("doc_id % 10 <> 0").withColumn("toxic", F.when(F.col("doc_id") % 7 == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    return audit.compare_outputs(a, b, "doc_id", ["quality", "toxic"])


@query
def lookup_workload(spark, sf):
    return audit.lookup_workload(U.parse(_pages(spark, sf)), "page_id", 100)


@query
def nearest_threshold(spark, sf):
    return audit.nearest(_scored(spark, sf), F.col("score"), 0.5, 20, "doc_id").select("doc_id", F.round("score", 6).alias("score"))


@query
def source_ranges(spark, sf):
    rows = _table(spark, sf, "orders").select((F.col("o_orderkey") % 2).cast("int").alias("label"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"), F.col("o_orderstatus").alias("source"))
    return audit.source_ranges(rows)


@query
def spearman(spark, sf):
    rows = _table(spark, sf, "lineitem").select(*[F.col(c).cast("double").alias(c) for c in ("l_quantity", "l_extendedprice", "l_discount")])
    return audit.spearman(rows, rows.columns, 0.0).select("a", "b", F.round("rho", 5).alias("rho"))


@query
def bootstrap_share(spark, sf):
    b = metrics.bootstrap_rate(_scored(spark, sf), F.col("label") == 1, F.col("grp"), 200)
    return b.select(F.round("estimate", 6).alias("estimate"), F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


@query
def bootstrap_difference(spark, sf):
    rows = _scored(spark, sf).withColumn("other", F.col("doc_id") * 7919 % 1000 / 1000.0)
    return metrics.bootstrap_auc(rows, F.col("grp"), 50, other="other").select(F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


@query
def project_prevalence(spark, sf):
    m = metrics.confusion(_scored(spark, sf), 0.5, by=["dataset"]).select(F.col("dataset").alias("name"), F.col("recall").alias("tpr"), "fpr")
    return metrics.projection(m, [0.01, 0.1, 0.5], 1_000_000).select("name", "prevalence", *[F.round(c, 3).alias(c) for c in ("tp", "fp", "flagged")], F.round("precision", 6).alias("precision"))


@query
def domain_ranks(spark, sf):
    rows = _by_host(spark, sf).select(F.col("host").alias("domain"), (F.col("page_id") % 97 + 1).alias("rank"))
    return datasets.domain_ranks(rows, 60)


@query
def first_seen(spark, sf):
    e = _table(spark, sf, "events").select(F.col("user_id").alias("url"), "ts")
    return datasets.first_seen(e).select("url", F.unix_micros(F.col("first_seen").cast("timestamp")).alias("first_seen"))


@query
def capture_filter(spark, sf):
    rows = _by_host(spark, sf).select(F.col("group").alias("domain"), F.concat(F.lit("http://"), "host", F.when(F.col("page_id") % 11 == 0, "/robots.txt").otherwise("/x")).alias("url"), F.when(F.col("page_id") % 5 == 0, "404").otherwise("200").alias("status"), F.when(F.col("page_id") % 3 == 0, "image/png").otherwise("text/HTML").alias("mime"), "page_id")
    one = lambda d: spark.createDataFrame([(x,) for x in d], "domain string")
    return datasets.capture_filter(rows, one(["example.com", "example.net"]), one(["example.net"])).select("page_id")


@query
def union_sources(spark, sf):
    a = _table(spark, sf, "supplier").select(F.col("s_name").alias("name"), F.lit("").alias("date"))
    b = _table(spark, sf, "customer").select(F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    return feeds.union_of([a, b], "2026-01-01").select("name", "date", "segment")


@query
def json_lists(spark, sf):
    rows = _table(spark, sf, "events").select("event_id", F.concat(F.lit("com,example)/ 20260101 "), F.to_json(F.struct(F.concat(F.lit("http://example.com/"), F.col("event_id").cast("string")).alias("url"), F.lit("200").alias("status"), F.lit("text/html").alias("mime")))).alias("value"))
    return feeds.captures(rows)


def _sniffed(spark: SparkSession, sf: str) -> DataFrame:
    """All pages as a semicolon file without a header: written by Spark to the shared folder, sniffed and read again."""
    path = f"{shared_folder(spark)}/sniffed-{uuid.uuid4().hex}"
    _pages(spark, sf).write.csv(path, sep=";", escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    t, layout = delimited.read_delimited(spark, path)
    return t.select(F.col(layout.header[0]).cast("long").alias("page_id"), F.col(layout.url_column).alias("url"))


@query
def input_sniffing(spark, sf):
    return _sniffed(spark, sf)


@query
def emb_lr(spark, sf):
    e = _table(spark, sf, "embeddings")
    return training.train_embeddings(e)(e).select("vec_id", F.col("prediction").cast("int").alias("prediction"))


@query
def gbt_train(spark, sf):
    rows = extract(U.parse(_pages(spark, sf)), names=["url_len", "n_slash", "path_depth", "n_params"]).select("page_id", "f.*", (F.col("page_id") % 3 == 0).cast("int").alias("label"))
    names = ["url_len", "n_slash", "path_depth", "n_params"]
    model = training.train_trees(rows, names, rounds=5, depth=3)
    document = scoring.ModelDocument.from_json(training.export(model, names, {"type": "none"}, {"fraud": 0.8, "legit": 0.2}, 0.33))
    x = F.array(*[F.col(n) for n in names])
    both = training.probabilities(model.transform(training.filled(rows, names))).withColumn("s", scoring.tree_scores(spark, document, x))
    return both.select("page_id", F.round("score", 6).alias("score"), F.round(scoring.calibrated(document, F.col("s.raw")), 6).alias("exported"))


@query
def char_ngram_lr(spark, sf):
    rows = _pages(spark, sf).withColumn("label", (F.length("url") % 2).cast("int"))
    return training.train_char_ngrams(rows, "url", urls=True)(rows).select("page_id", F.round("score", 4).alias("score"))


@query
def stream_file_score(spark, sf):
    out = f"{shared_folder(spark)}/scored-{uuid.uuid4().hex}"
    stream = streams.read_files(spark, f"{sf}/pages*", "page_id long, url string, html string")
    streams.run_available(stream.select("page_id", "url"), lambda b: scoring.score_urls(b, offline_model()).select("page_id", "fraud_verdict", "probability"), f"{out}/t", f"{out}/c")
    return spark.read.parquet(f"{out}/t").select("page_id", "fraud_verdict", F.round("probability", 6).alias("probability"))
