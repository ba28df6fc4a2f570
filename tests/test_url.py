import pytest
from pyspark.sql import functions as F

from lynceus.functions.features import FEATURES, extract
from lynceus.functions.suffix import SuffixRules
from lynceus.functions.url import canonical_text, loose_key, normal_target, parse, prefix_candidates

#: url, host, reg, port, path, ip
CASES = [
    ("https://Example.com/a?b=1#c", "example.com", "example.com", None, "/a", 0),
    ("example.co.uk", "example.co.uk", "example.co.uk", None, "", 0),
    ("http://user:p@w@EXAMPLE.com:8080/x", "example.com", "example.com", "8080", "/x", 0),
    ("http://[2001:db8::1]:80/", "[2001:db8::1]", "[2001:db8::1]", "80", "/", 6),
    ("http://[bad/", "bad", "", None, "/", 0),
    ("http://bücher.example/", "xn--bcher-kva.example", "xn--bcher-kva.example", None, "/", 0),
    ("http:\\\\www.example.com\\login", "www.example.com", "example.com", None, "/login", 0),
    ('  "http:/foo.github.io/" ', "foo.github.io", "foo.github.io", None, "/", 0),
    ("0x7f.1", "0x7f.1", "0x7f.1", None, "", 4),
    ("3232235777", "3232235777", "3232235777", None, "", 4),
    ("12345", "12345", "", None, "", 0),
    ("9" * 5000, "9" * 5000, "", None, "", 0),
    ("http://a_b.example.test:", "a_b.example.test", "example.test", None, "", 0),
    ("ftp://h.test./p", "h.test", "h.test", None, "/p", 0),
    ("", "", "", None, "", 0),
    (None, "", "", None, "", 0),
]


def test_parse(spark):
    rows = spark.createDataFrame([(i, c[0]) for i, c in enumerate(CASES)], "i int, url string")
    got = {r.i: r.p for r in parse(rows).collect()}
    for i, (_, host, reg, port, path, ip) in enumerate(CASES):
        assert (got[i].host, got[i].reg, got[i].port, got[i].path, got[i].ip) == (host, reg, port, path, ip), CASES[i]


@pytest.mark.parametrize(
    "host, reg, suffix, private",
    [("a.b.example.co.uk", "example.co.uk", "co.uk", False), ("co.uk", "", "co.uk", False), ("a.b.foo.ck", "b.foo.ck", "foo.ck", False), ("www.ck", "www.ck", "ck", False),
     ("x.city.kawasaki.jp", "city.kawasaki.jp", "kawasaki.jp", False), ("c.b.kawasaki.jp", "c.b.kawasaki.jp", "b.kawasaki.jp", False), ("u.github.io", "u.github.io", "github.io", True), ("example.zz", "example.zz", "zz", False)],
)
def test_suffixes(spark, host, reg, suffix, private):
    p = parse(spark.createDataFrame([(host,)], "url string")).first().p
    assert (p.reg, p.suffix, p.private_suffix) == (reg, suffix, private)


def test_longest_rule_wins(spark):
    rules = SuffixRules.parse("test\n*.a.test\nb.a.test\n!c.b.a.test\n// ===BEGIN PRIVATE DOMAINS===\nx.test\n")
    got = {r.url: (r.p.reg, r.p.private_suffix) for r in parse(spark.createDataFrame([(h,) for h in ("q.b.a.test", "z.y.a.test", "d.c.b.a.test", "m.x.test")], "url string"), rules=rules).collect()}
    assert got == {"q.b.a.test": ("q.b.a.test", False), "z.y.a.test": ("z.y.a.test", False), "d.c.b.a.test": ("c.b.a.test", False), "m.x.test": ("m.x.test", True)}


JUNK = ["", " ", "\x00", "http://", "://", "?", "#", "@", "http://[", "http://]:1", "http://a" + "/x" * 10_000, "‮.test", "http://%zz.test/%", "//////"]


def test_features_never_fail(spark):
    out = extract(parse(spark.createDataFrame([(x,) for x in JUNK], "url string"))).collect()
    assert len(out) == len(JUNK) and all(r.f is None or all(v == v for v in r.f) for r in out)


def test_features(spark):
    f = extract(parse(spark.createDataFrame([("http://verify-login12.sub1.examp1e-secure.test:81/2fa/x.PHP?Next=http://q&u=%41é",)], "url string"))).first().f
    want = dict(scheme_http=1, has_port=1, port_nonstd=1, n_params=2, redirect_param=1, ext_server=1, embedded_url=1, n_pct_encoded=1, non_ascii=1, sus_words_host=3, sus_words_path=1, host_n_labels=4, n_sub_labels=2, sld_digit_letter_switches=2, sub_has_digit=1, path_depth=2, n_equal=2)
    assert {k: f[k] for k in want} == want
    assert len(FEATURES) == 82


def test_invariance(spark):
    pairs = [("https://x.example.com", "https://x.example.com/"), ("x.example.com/a", "https://x.example.com/a"), ("https://x.example.com/a#b", "https://x.example.com/a")]
    got = {r.url: r.f for r in extract(parse(spark.createDataFrame([(x,) for p in pairs for x in p], "url string").distinct())).collect()}
    for a, b in pairs:
        assert got[a] == got[b]


def test_brands(spark):
    urls = {"https://paypa1.com": "brand_typo", "https://paypal.example.com": "brand_in_sub", "https://paypal-help.com": "brand_in_sld_not_equal", "https://x.test/paypal": "brand_in_path", "https://paypal.com": "brand_is_sld"}
    for r in extract(parse(spark.createDataFrame([(u,) for u in urls], "url string"))).collect():
        on = {k for k in ("brand_typo", "brand_in_sub", "brand_in_sld_not_equal", "brand_in_path", "brand_is_sld") if r.f[k]}
        assert on == {urls[r.url]}, r.url


def test_keys(spark):
    df = spark.createDataFrame([("HTTP://www.Example.com/A/#x",)], "u string")
    assert df.select(loose_key(F.col("u")), canonical_text(F.col("u"))).first()[:] == ("example.com/a", "HTTP://www.Example.com/A/")
    t = spark.createDataFrame([("/a/../b/./c", "x=1&y")], "p string, q string").select(normal_target(F.col("p"), F.col("q")).alias("t"))
    r = t.select("t", prefix_candidates(F.col("t")).alias("c")).first()
    assert r.t == "/b/c?x=1&y" and set(r.c) == {"", "/", "/b", "/b/", "/b/c", "/b/c?", "/b/c?x=1", "/b/c?x=1&", "/b/c?x=1&y"}
