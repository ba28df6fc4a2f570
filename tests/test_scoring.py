import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lynceus.functions.reasons import worded
from lynceus.functions.text import fixed
from lynceus.operators import enrich
from lynceus.operators.lists import ListError, match_lists, read_lists
from lynceus.operators.scoring import ModelDocument, Tree, calibrated, guarded, prior_shifted, score_urls, verdict
from lynceus.operators.toy import offline_model, second_model
from lynceus.plans.urls import analyse, result_cells


def walk(t, x):
    """A plain walk through one tree, for comparison."""
    if not len(t.feature):
        return t.leaf[0]
    i = 0
    while i >= 0:
        v, m = x[t.feature[i]], t.missing[i]
        if math.isnan(v) and m == 2:
            left = t.default_left[i]
        else:
            v = 0.0 if math.isnan(v) else v
            left = t.default_left[i] if m == 1 and abs(v) <= 1e-35 else v <= t.threshold[i]
        i = int(t.left[i] if left else t.right[i])
    return t.leaf[~i]


def test_trees_and_attribution():
    rng = np.random.default_rng(0)
    model = offline_model()
    x = rng.normal(0, 30, (500, 6)).round(1)
    x[rng.random(x.shape) < 0.2] = np.nan
    x[rng.random(x.shape) < 0.2] = 0
    parts = np.zeros_like(x)
    raw = model.raw(x, parts)
    assert np.allclose(raw, [model.base + sum(walk(t, r) for t in model.trees) for r in x])
    assert np.allclose(raw, model.bias + parts.sum(1), atol=1e-9)
    one = ModelDocument.from_json({"features": ["a"], "trees": [{"f": [], "t": [], "l": [], "r": [], "d": [], "m": [], "v": [], "lv": [0.5]}], "calibration": {"type": "none"}, "thresholds": {}})
    assert one.raw(np.zeros((2, 1)), np.zeros((2, 1))).tolist() == [0.5, 0.5]


def test_calibration(spark):
    df = spark.createDataFrame([(v,) for v in (-1e4, -2.0, 0.0, 0.7, 9.0)] + [(None,)], "r double")
    iso = ModelDocument([], [], calibration={"type": "isotonic", "x": [-2.0, 0.0, 1.0], "y": [0.1, 0.3, 0.9]})
    platt = ModelDocument([], [], calibration={"type": "platt", "a": 1.0, "b": 0.0})
    got = df.select(calibrated(iso, F.col("r")), calibrated(platt, F.col("r"))).collect()
    assert [None if r[0] is None else round(r[0], 9) for r in got] == [0.1, 0.1, 0.3, 0.72, 0.9, None]
    assert got[0][1] == 0.0 and got[2][1] == 0.5 and got[5][1] is None


def test_prior_and_verdict(spark):
    p = F.col("p")
    rows = spark.createDataFrame([(0.95,), (0.05,), (0.5,)], "p double")
    a = [r[0] for r in rows.select(prior_shifted(p, 0.01, 0.47)).collect()]
    assert a[0] < 0.95 and a == sorted(a, reverse=True)[:1] + a[1:]
    got = [r[0] for r in rows.select(verdict(p, prior_shifted(p, 0.01, 0.47), 0.9, 0.1)[0]).collect()]
    assert got == ["REVIEW", "LEGITIMATE", "REVIEW"]  # the shift contradicts the first
    assert [r[0] for r in rows.select(verdict(p, p, 0.9, 0.1)[0]).collect()] == ["FRAUD", "LEGITIMATE", "REVIEW"]


def test_errors_and_order(spark):
    urls = ["", None, "   ", "hello world", "localhost", "http://", "a b.test", "http://x.test", "http://10.0.0.1/"]
    got = {r.i: (r.fraud_verdict, r.error) for r in score_urls(spark.createDataFrame(list(enumerate(urls)), "i int, url string"), offline_model()).collect()}
    assert [got[i][0] for i in range(9)] == ["ERROR"] * 7 + [got[7][0], got[8][0]] and "ERROR" not in (got[7][0], got[8][0])
    assert [got[i][1] for i in (0, 1, 2)] == ["empty URL"] * 3 and got[5][1].startswith("could not parse")
    assert all(got[i][1].startswith("not a URL") for i in (3, 4, 6))


def test_reasons(spark):
    def reason(name, value, contribution, suffix=""):
        row = spark.createDataFrame([([(0, float(value), float(contribution))], suffix)], "t array<struct<index:int,value:double,contribution:double>>, s string")
        return "".join(row.select(worded([name], F.col("t"), F.col("s"))).first()[0])

    assert reason("path_len", 1, 0.2) == "no path (raises risk)" and reason("n_params", 2, -1) == "2 query parameters (lowers risk)"
    assert reason("tld_logit", 0.0, 1, "test") == "domain ending '.test' (50% of training URLs with it were phishing) (raises risk)"
    assert reason("url_len", float("nan"), 1) == "" and reason("domain_age_days_log", math.log10(401), 1) == "domain registered about 13 months ago (raises risk)"
    assert reason("sld_vowel_ratio", 0.1, 1) == "domain name is 10% vowels (unpronounceable) (raises risk)" and reason("odd_one", 2.5, 1) == "odd one = 2.5 (raises risk)"
    assert reason("url_entropy", 4.25, 1) == "URL randomness 4.2 bits/char (raises risk)" and reason("digit_ratio", 0.125, 1) == "12% of characters are digits (raises risk)"


def test_fixed(spark):
    values = [k / 2000 for k in range(2001)] + [k / 16 for k in range(160)] + np.random.default_rng(3).random(2000).tolist() + [-0.0625, -2.5]
    got = spark.createDataFrame([(v,) for v in values], "v double").select("v", fixed(F.col("v"), 3).alias("a"), fixed(F.col("v"), 1).alias("b")).collect()
    assert all((r.a, r.b) == (f"{r.v:.3f}", f"{r.v:.1f}") for r in got)


def test_failed_rows(spark):
    """A row whose scoring raises is an ERROR and doesn't stop the others."""
    broken = {"f": [0, 99], "t": [30.5, 0.0], "l": [-1, -2], "r": [1, -3], "d": [True, True], "m": [0, 0], "v": [0.0, 0.0], "lv": [0.1, 0.2, 0.3]}
    odd = offline_model()
    odd.trees.append(Tree.of(broken))  # long URLs reach a split on a feature that there isn't
    got = {r.url: r for r in score_urls(spark.createDataFrame([("http://a.test/",), ("http://a-long-one.test/" + "x" * 30,), ("",)], "url string"), odd).collect()}
    bad = got["http://a-long-one.test/" + "x" * 30]
    assert bad.fraud_verdict == "ERROR" and bad.error == "scoring failed: IndexError" and bad.probability is None and bad.reasons is None
    assert got["http://a.test/"].fraud_verdict != "ERROR" and got[""].error == "empty URL"


def test_guard(spark):
    got = [r[0] for r in spark.createDataFrame([("=1",), ("+a",), ("-",), ("@x",), ("\tq",), ("ok",), (None,)], "c string").select(guarded(F.col("c"))).collect()]
    assert got == ["'=1", "'+a", "'-", "'@x", "'\tq", "ok", ""]


BLOCK = "# c\nevil.test note\n0.0.0.0 bad.example.com\n*.example.net/login\nhttp://example.org/a/b?x=1\n1.2.3.4\n%% %%\nfaß.de\n"
LISTED = {
    "http://a.evil.test/x": ("block", "evil.test"), "https://s.bad.example.com/": ("block", "bad.example.com"), "http://x.example.net/LOGIN/q": ("block", "*.example.net/login"),
    "http://example.net/loginx": None, "http://example.net/a/../login?z": ("block", "*.example.net/login"), "http://example.org/a/./c/../b?x=1&y": ("block", "example.org/a/b?x=1"),
    "http://x.example.org/a/b?x=1": None, "http://0x01020304/p": ("block", "1.2.3.4"), "http://16909060": ("block", "1.2.3.4"), "http://faß.de/": ("block", "xn--fa-hia.de"), "http://fass.de/": None,
    "http://www.example.com/": ("allow", "example.com"), "not a url": None,
}


def test_lists(spark, tmp_path):
    (tmp_path / "b").write_text(BLOCK, encoding="utf-8")
    (tmp_path / "a").write_text("example.com\nbad.example.com\n", encoding="utf-8")
    found = read_lists(spark, [f"file://{tmp_path}/a"], [f"file://{tmp_path}/b"])
    assert found.counts == {"block": 6, "allow": 2} and len(found.notes) == 1 and "first: line 7" in found.notes[0]
    out = analyse(spark.createDataFrame([(u,) for u in LISTED], "url string"), offline_model(), lists=found)
    for r in out.collect():
        want = LISTED[r.url] or (None, None)
        assert (r.list_kind, r.list_entry) == want, r.url
        assert r.fraud_verdict == {"block": "FRAUD", "allow": "LEGITIMATE"}.get(r.list_kind, r.model_verdict)
    (tmp_path / "e").write_text("# nothing\n")
    with pytest.raises(ListError, match="no valid entries"):
        read_lists(spark, [f"file://{tmp_path}/e"])
    assert read_lists(spark) is None and match_lists  # without files there is nothing to match


def test_second_pass(spark):
    urls = ["http://old.test/a", "http://young.test/a", "http://gone.test/a", "http://u.github.io/a", "http://10.0.0.1/a", "hello world"]
    df = spark.createDataFrame(list(enumerate(urls)), "i int, url string")
    fact = lambda h, st, a: (h, st, a, 60, [], "", "ok", ["n"], "ok", ["m"])
    dns = spark.createDataFrame([fact("old.test", "ok", ["198.18.0.1"]), fact("young.test", "ok", ["8.8.8.8"]), fact("gone.test", "nxdomain", [])], "host string, a_status string, a array<string>, ttl_a int, aaaa array<string>, cname string, ns_status string, ns array<string>, mx_status string, mx array<string>")
    rdap = spark.createDataFrame([("old.test", "ok", "2001-01-01", None, None, []), ("young.test", "ok", "2024-12-30", None, None, [])], "reg string, status string, created string, expires string, changed string, domain_status array<string>")
    run = lambda mode: {r.i: r for r in analyse(df, offline_model(), second=second_model(), dns=dns, rdap=rdap, now=1_735_689_600.0, mode=mode).collect()}
    every, plain = run("all"), {r.i: r for r in analyse(df, offline_model()).collect()}
    assert every[1].model_probability > every[0].model_probability
    assert every[2].model_probability == plain[2].model_probability and "does not exist" in every[2].lookup_status
    assert every[3].lookup_status.startswith("skipped (shared") and every[4].lookup_status == "skipped (IP host)" and every[5].lookup_status == "skipped (no domain)"
    assert every[5].fraud_verdict == "ERROR" and every[0].analysis_mode.startswith("enriched")
    review = run("review")
    for i, r in review.items():
        if plain[i].fraud_verdict == "REVIEW":
            assert r.model_probability == every[i].model_probability
        elif plain[i].fraud_verdict != "ERROR":
            assert r.lookup_status == "not looked up (verdict already clear)"
    f = enrich.dns_features(F.struct(*dns.columns))
    private = {r.host: r.v for r in dns.select("host", f["dns_private_ip"].alias("v")).collect()}
    assert private["old.test"] == 1 and private["young.test"] == 0 and math.isnan(private["gone.test"])
    asked = []
    known = dns.where("host = 'old.test'")
    found = enrich.gather(dns.select("host"), "host", known, lambda missing: asked.extend(r[0] for r in missing.collect()) or dns.join(missing, "host", "left_semi"))
    assert sorted(asked) == ["gone.test", "young.test"] and found.count() == 3
    enrich.gather(known.select("host"), "host", known, lambda missing: pytest.fail("nothing is missing"))


def test_cells(spark):
    cells = result_cells(a := analyse(spark.createDataFrame([("http://x.test/",), ("",)], "url string"), offline_model()))
    rows = a.select(*[c.alias(k) for k, c in cells.items()]).collect()
    assert rows[0].fraud_probability == f"{float(rows[0].fraud_probability):.3f}" and rows[1].fraud_probability == "" and rows[1].error == "empty URL"
