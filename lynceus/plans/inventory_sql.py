"""The results of lynceus.plans.inventory, and of the larger plans over URLs, in DuckDB SQL."""

from __future__ import annotations

from lynceus.functions import values as V
from lynceus.functions.reasons import SIGNALS

#: Labelled documents with a score, as in lynceus.plans.oracle.
S = "s AS (SELECT l.doc_id, d.lang AS dataset, d.source AS grp, CAST(l.quality AS INTEGER) AS label, CAST(d.n_chars % 1000 AS DOUBLE) / 1000 AS score FROM labels l JOIN documents d ON l.doc_id = d.doc_id)"
#: The parts of the pages' URLs: they have a scheme, a host without user or port, and suffixes of one label.
P = r"""p AS (SELECT page_id, url, regexp_extract(url, '^([a-z]+)://', 1) AS scheme, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host,
  regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(url, '^[^?#]*\?([^#]*)', 1) AS query FROM pages),
q AS (SELECT *, array_to_string(string_split(host, '.')[-2:], '.') AS reg, array_to_string(string_split(host, '.')[1:-3], '.') AS sub, string_split(host, '.')[-1] AS tld, string_split(host, '.')[-2] AS sld,
  CASE WHEN path = '' THEN '/' ELSE path END AS path1, scheme || '://' || host || CASE WHEN path = '' THEN '/' ELSE path END || CASE WHEN query <> '' THEN '?' || query ELSE '' END AS u FROM p)"""


def _words(words: list[str]) -> str:
    return "string_split('" + " ".join(words) + "', ' ')"


def _count(text: str, mark: str) -> str:
    return f"length({text}) - length(replace({text}, '{mark}', ''))"


def _kept(text: str, letters: str) -> str:
    return f"length(regexp_replace({text}, '[^{letters}]', '', 'g'))"


def _entropy(text: str) -> str:
    share = f"CAST(length({text}) - length(replace({text}, ch, '')) AS DOUBLE) / length({text})"
    return f"CASE WHEN {text} = '' THEN 0 ELSE list_sum(list_transform(list_distinct(string_split({text}, '')), lambda ch: -({share}) * log2({share}))) END"


def _run(text: str, letters: str) -> str:
    return f"coalesce(list_max(list_transform(regexp_extract_all({text}, '[{letters}]+'), lambda x: length(x))), 0)"


def _flag(condition: str) -> str:
    return f"CASE WHEN {condition} THEN 1 ELSE 0 END"


def _brand(words: str, text: str, other: str) -> str:
    return f"(len(list_filter({words}, lambda w: list_contains(brands, w) AND w <> {other})) > 0 OR len(list_filter(longs, lambda b: contains({text}, b) AND b <> {other})) > 0)"


FEATURES = {
    "url_len": "length(u)", "scheme_http": _flag("scheme = 'http'"), "has_userinfo": _flag("contains(host, '@')"), "n_at": _count("u", "@"), "has_port": _flag("regexp_matches(host, ':[0-9]')"),
    "port_nonstd": _flag("regexp_matches(host, ':[0-9]') AND NOT regexp_matches(host, ':(80|443)$')"), **{f"n_{k}": _count("u", m) for k, m in V.MARKS.items()},
    "digit_ratio": f"{_kept('u', '0-9')} / n", "letter_ratio": f"{_kept('u', 'a-zA-Z')} / n", "upper_ratio": f"{_kept('u', 'A-Z')} / n", "special_ratio": f"{_kept('u', '^0-9a-zA-Z')} / n".replace("[^^", "["),
    "url_entropy": _entropy("u"), "n_pct_encoded": "len(regexp_extract_all(u, '%[0-9a-fA-F]{2}'))", "non_ascii": "len(list_filter(string_split(u, ''), lambda x: unicode(x) > 127))",
    "double_slash_in_path": _flag("contains(path1, '//')"), "embedded_url": _flag("contains(rest, 'http:') OR contains(rest, 'https:') OR contains(rest, 'www.')"), "n_params": "len(params)",
    "redirect_param": _flag(f"len(list_intersect(params, {_words(V.REDIRECT_PARAMETERS)})) > 0"), "host_len": "length(host)", "host_n_labels": "len(ls)", "n_sub_labels": "greatest(len(ls) - 2, 0)", "sub_len": "length(sub)",
    "www_prefix": _flag("ls[1] = 'www'"), "host_n_hyphens": _count("host", "-"), "host_n_digits": _kept("host", "0-9"), "host_digit_ratio": f"{_kept('host', '0-9')} / CAST(length(host) AS DOUBLE)", "host_is_ip": "0", "host_is_ipv6": "0",
    "host_punycode": _flag("contains(host, 'xn--')"), "host_invalid_chars": _flag("regexp_matches(host, '[^a-z0-9._-]')"), "host_entropy": _entropy("host"), "host_max_label_len": "list_max(list_transform(ls, lambda x: length(x)))",
    "sub_has_digit": _flag("regexp_matches(sub, '[0-9]')"), "sub_has_hyphen": _flag("contains(sub, '-')"), "sld_len": "length(sld)", "sld_entropy": _entropy("sld"), "sld_n_digits": _kept("sld", "0-9"), "sld_n_hyphens": _count("sld", "-"),
    "sld_vowel_ratio": f"CASE WHEN {_kept('sld', 'a-z')} = 0 THEN 0 ELSE {_kept('sld', 'aeiou')} / CAST({_kept('sld', 'a-z')} AS DOUBLE) END", "sld_max_consonant_run": _run("sld", "b-df-hj-np-tv-z"), "sld_max_digit_run": _run("sld", "0-9"),
    "sld_digit_letter_switches": "len(list_filter(range(1, length(sld)), lambda i: regexp_matches(substr(sld, CAST(i AS INTEGER), 1), '[0-9]') <> regexp_matches(substr(sld, CAST(i AS INTEGER) + 1, 1), '[0-9]')))",
    "tld_len": "length(tld)", "suffix_n_labels": "1", "private_suffix": "0", "user_content_host": _flag(f"list_has_any([host, reg, tld], {_words(V.USER_CONTENT_HOSTS)})"), "shortener": _flag(f"list_has_any([host, reg], {_words(V.SHORTENERS)})"),
    "path_len": "length(path1)", "path_depth": "len(segs)", "path_max_seg_len": "coalesce(list_max(list_transform(segs, lambda x: length(x))), 0)", "path_digit_ratio": f"{_kept('path1', '0-9')} / CAST(length(path1) AS DOUBLE)",
    "path_entropy": _entropy("path1"), "query_len": "length(query)", **{f"ext_{k}": _flag(f"list_contains({_words(w)}, ext)") for k, w in (("server", V.SERVER_EXTENSIONS), ("page", V.PAGE_EXTENSIONS), ("risky", V.RISKY_EXTENSIONS))},
    "is_homepage": _flag("len(segs) = 0 AND query = ''"),
    "sus_words_host": f"len(list_filter(host_tokens, lambda w: list_contains(sus, w))) + len(list_filter({_words(V.HOST_WORDS)}, lambda w: contains(host, w) AND NOT list_contains(host_tokens, w)))",
    "sus_words_path": "len(list_filter(rest_tokens, lambda w: list_contains(sus, w)))", "wp_path": _flag("regexp_matches(rest, 'wp-(content|includes|admin)')"), "brand_is_sld": _flag("list_contains(brands, sld)"),
    "brand_in_sld_not_equal": _flag("NOT list_contains(brands, sld) AND " + _brand("regexp_extract_all(sld, '[a-z0-9]+')", "sld", "''")), "brand_in_sub": _flag(_brand("regexp_extract_all(sub, '[a-z0-9]+')", "sub", "sld")),
    "brand_in_path": _flag(_brand("rest_tokens", "rest", "sld")),
    "brand_typo": _flag("NOT list_contains(brands, sld) AND ((length(sld) >= 5 AND NOT list_contains(longs, sld) AND len(list_filter(longs, lambda b: levenshtein(b, sld) = 1)) > 0) OR (fold <> sld AND list_contains(brands, fold)))"),
    "n_host_tokens": "len(host_tokens)", "suffix_gov_edu": _flag("list_contains(['gov', 'edu', 'mil', 'gob', 'gouv', 'govt', 'go', 'ac', 'gv', 'nic'], tld)"),
}
LEET = f"translate(sld, '{''.join(V.LEET)}', '{''.join(V.LEET.values())}')"
URL_FEATURES = rf"""WITH {P}, c AS (SELECT *, string_split(host, '.') AS ls, CAST(length(u) AS DOUBLE) AS n, list_filter(string_split(path1, '/'), lambda x: x <> '') AS segs, lower(url_decode(path1 || CASE WHEN query <> '' THEN '?' || query ELSE '' END)) AS rest,
  list_transform(list_filter(string_split(query, '&'), lambda x: x <> ''), lambda x: lower(split_part(x, '=', 1))) AS params, regexp_extract_all(sub || ' ' || sld, '[a-z0-9]+') AS host_tokens, replace(replace({LEET}, 'rn', 'm'), 'vv', 'w') AS fold,
  {_words(V.BRANDS)} AS brands, {_words([b for b in V.BRANDS if len(b) >= 5])} AS longs, {_words(V.SUSPICIOUS_WORDS)} AS sus FROM q),
e AS (SELECT *, regexp_extract_all(rest, '[a-z0-9]+') AS rest_tokens, CASE WHEN len(segs) > 0 AND contains(segs[-1], '.') THEN lower(string_split(segs[-1], '.')[-1]) ELSE '' END AS ext FROM c)
SELECT page_id, tld, {", ".join(f"round(CAST({v} AS DOUBLE), 6) AS {k}" for k, v in FEATURES.items())} FROM e"""

#: The offline example model: its trees' answers, attribution, verdict and reasons.
SUS = f"len(list_filter(regexp_extract_all(lower(path1 || CASE WHEN query <> '' THEN '?' || query ELSE '' END), '[a-z0-9]+'), lambda t: list_contains({_words(V.SUSPICIOUS_WORDS)}, t)))"
RATE = "CASE tld WHEN 'com' THEN 0.45::DOUBLE WHEN 'net' THEN 0.6 WHEN 'org' THEN 0.2 ELSE 0.5 END"
MODEL = f"""{P}, f AS (SELECT *, length(u) AS n, scheme = 'http' AS http, CASE WHEN query = '' THEN 0 ELSE len(list_filter(string_split(query, '&'), lambda x: x <> '')) END AS np, {SUS} AS sus, len(string_split(host, '.')) AS labels, {RATE} AS rate,
  lower(path1) || CASE WHEN query <> '' THEN '?' || query ELSE '' END AS tgt FROM q),
l AS (SELECT *, CASE WHEN n <= 45.5 THEN -0.5::DOUBLE ELSE 0.6 END AS v0, CASE WHEN NOT http THEN -0.6::DOUBLE WHEN np <= 2.5 THEN 0.2 ELSE 0.9 END AS v1, CASE WHEN sus <= 0.5 THEN -0.2::DOUBLE ELSE 1.1 END AS v2, CASE WHEN labels <= 2.5 THEN -0.4::DOUBLE ELSE 0.3 END AS v3,
  CASE WHEN ln(rate / (1 - rate)) <= 0 THEN -0.3::DOUBLE ELSE 0.5 END AS v4 FROM f),
m AS (SELECT *, -0.2 + v0 + v1 + v2 + v3 + v4 AS raw, 1 / (1 + exp(-(1.7 * (-0.2 + v0 + v1 + v2 + v3 + v4) + 0.1))) AS p FROM l),
v AS (SELECT *, CASE WHEN p >= 0.8 THEN 'FRAUD' WHEN p <= 0.2 THEN 'LEGITIMATE' ELSE 'REVIEW' END AS verdict, CASE WHEN p >= 0.8 THEN p WHEN p <= 0.2 THEN 1 - p ELSE greatest(p, 1 - p) END AS conf,
  [{{'i': 0, 'c': v0 - 0.05, 't': 'URL is ' || n || ' characters long'}}, {{'i': 1, 'c': CASE WHEN http THEN 0.3 ELSE v1 - 0.1 END, 't': CASE WHEN http THEN 'uses unencrypted http://' ELSE 'uses https:// (or no scheme given)' END}},
   {{'i': 2, 'c': CASE WHEN http THEN v1 - 0.4 ELSE 0 END, 't': CASE np WHEN 0 THEN 'no query parameters' WHEN 1 THEN '1 query parameter' ELSE np || ' query parameters' END}},
   {{'i': 3, 'c': v2 - 0.45, 't': CASE sus WHEN 0 THEN 'no login/payment words in the path' WHEN 1 THEN 'a login/payment word in the path' ELSE sus || ' login/payment words in the path' END}},
   {{'i': 4, 'c': v3 + 0.05, 't': 'hostname has ' || labels || ' parts'}}, {{'i': 5, 'c': v4 - 0.1, 't': 'domain ending ''.' || tld || ''' (' || CAST(round(rate * 100) AS INTEGER) || '% of training URLs with it were phishing)'}}] AS parts FROM m),
k AS (SELECT *, CASE WHEN verdict = 'LEGITIMATE' THEN -1 ELSE 1 END AS sign FROM v),
r AS (SELECT *, list_transform(list_filter(list_sort(list_transform(list_filter(parts, lambda x: sign * x.c > 0.05), lambda x: {{'o': round(-sign * x.c, 9), 'i': x.i, 't': x.t || CASE WHEN x.c > 0 THEN ' (raises risk)' ELSE ' (lowers risk)' END}})), lambda x: true)[1:3], lambda x: x.t) AS reasons FROM k),
w AS (SELECT *, CASE WHEN reg = 'example.net' OR (host = 'example.com' AND regexp_matches(tgt, '^/fr([/?]|$)')) OR (reg = 'example.org' AND regexp_matches(tgt, '^/en([/?]|$)')) THEN 'block' WHEN reg = 'example.org' OR host = 'm.example.com' OR host LIKE '%.m.example.com' THEN 'allow' END AS listed,
  CASE WHEN host = 'example.com' AND regexp_matches(tgt, '^/fr([/?]|$)') THEN 'example.com/fr' WHEN reg = 'example.org' AND regexp_matches(tgt, '^/en([/?]|$)') THEN '*.example.org/en' WHEN reg = 'example.net' THEN 'example.net' WHEN reg = 'example.org' THEN 'example.org'
    WHEN host = 'm.example.com' OR host LIKE '%.m.example.com' THEN 'm.example.com' END AS entry, printf('%.3f', p) AS p3, printf('%.3f', conf) AS c3 FROM r),
cells AS (SELECT page_id, url, listed, verdict, p3, c3, reasons, reg, CASE listed WHEN 'block' THEN 'FRAUD' WHEN 'allow' THEN 'LEGITIMATE' ELSE verdict END AS fraud_verdict, CASE WHEN listed IS NULL THEN p3 ELSE '' END AS fraud_probability,
  CASE WHEN listed IS NULL THEN c3 ELSE '' END AS verdict_confidence,
  CASE WHEN listed IS NULL THEN array_to_string(reasons, '; ') ELSE 'on your ' || listed || ' list (entry ''' || CASE WHEN entry[1] = '*' THEN entry ELSE entry END || '''); the model alone said ' || verdict || ' (' || p3 || ')' END AS top_reasons,
  CASE WHEN listed IS NULL THEN 'offline (URL text only)' ELSE 'your ' || listed || ' list' END AS analysis_mode FROM w)"""
NUMBER = "CAST(CAST({} AS DOUBLE) AS VARCHAR)"
JSON = f"""'{{"url":' || to_json(url) || ',"fraud_verdict":"' || fraud_verdict || '","fraud_probability":' || CASE WHEN listed IS NULL THEN {NUMBER.format('p3')} ELSE 'null' END || ',"verdict_confidence":' || CASE WHEN listed IS NULL THEN {NUMBER.format('c3')} ELSE 'null' END
  || ',"top_reasons":' || to_json(CASE WHEN listed IS NULL THEN reasons ELSE [top_reasons] END) || ',"registrable_domain":' || to_json(reg) || ',"analysis_mode":"' || analysis_mode || '","lookup_status":null,"error":null,"stages":{{"offline_check":{{"verdict":"' || verdict || '","probability":' || {NUMBER.format('p3')} || '}}'
  || CASE WHEN listed IS NULL THEN '' ELSE ',"your_list":{{"list":"' || listed || '","decision":"' || fraud_verdict || '"}}' END || '}}}}'"""
FACTS = "h AS (SELECT host, any_value(reg) AS reg, CAST(('0x' || substr(md5('f|' || host), 1, 8)) AS BIGINT) % 100 AS h FROM q GROUP BY host)"


def _cell(name: str) -> str:
    return f"""CASE WHEN regexp_matches({name}, '[,"\\r\\n]') THEN '"' || replace({name}, '"', '""') || '"' ELSE {name} END"""


def _second(gate: str) -> str:
    """The second opinion of the example models, where gate lets a row in; the plain result elsewhere."""
    raw2 = "raw - 0.9 + CASE WHEN h % 2 = 0 THEN -0.3 ELSE 0.3 END + 0.1"
    return f"""z AS (SELECT k.*, h.h, {gate} AS gate, 1 / (1 + exp(-1.5 * ({raw2}))) AS p2 FROM k JOIN h USING (host)), y AS (SELECT *, gate AND h >= 20 AS used, CASE WHEN p2 >= 0.85 THEN 'FRAUD' WHEN p2 <= 0.15 THEN 'LEGITIMATE' ELSE 'REVIEW' END AS verdict2 FROM z)"""


LOOKED = "CASE WHEN h >= 20 THEN 'dns=ok; rdap=ok' ELSE 'dns=nxdomain; rdap=ok; domain does not exist in DNS (dead link or taken down)' END"
OFFLINE, ENRICHED, CLEAR, UNAVAILABLE = "offline (URL text only)", "enriched (URL + DNS + RDAP)", "offline (URL text only; clear without lookups)", "offline (enrichment unavailable for this URL)"

#: Poisson weights of resampled groups, by a hash of group, replicate and seed.
CDF = [sum([0.36787944117144233 / f for f in (1, 1, 2, 6, 24, 120, 720, 5040)][: k + 1]) for k in range(8)]


def _weights(source: str, key: str, replicates: int) -> str:
    return f"(SELECT *, len(list_filter([{', '.join(map(repr, CDF))}], lambda c: CAST(c AS DOUBLE) <= u)) AS w FROM (SELECT *, CAST(CAST('0x' || substr(md5({key} || '|' || rep || '|0'), 1, 8) AS BIGINT) AS DOUBLE) / 4294967296 AS u FROM {source}, (SELECT unnest(range({replicates})) AS rep)))"


def _auc(score: str, name: str) -> str:
    return f"""{name} AS (SELECT rep, sum(n * (tp + p / 2.0)) / nullif(sum(p) * sum(n), 0) AS v FROM (SELECT rep, p, n, coalesce(sum(p) OVER (PARTITION BY rep ORDER BY x DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS tp FROM (
  SELECT rep, {score} AS x, sum(w * label) AS p, sum(w * (1 - label)) AS n FROM b WHERE w > 0 GROUP BY 1, 2)) GROUP BY rep)"""


def _tier(k: int, low: int, high: int, limit: int) -> str:
    return f"SELECT domain, rank FROM (SELECT c_name AS domain, c_custkey AS rank, row_number() OVER (ORDER BY md5(c_name || '|0')) AS n FROM customer WHERE c_custkey > {low} AND c_custkey <= {high}) WHERE n <= {limit}"


ORACLE_SQL: dict[str, str] = {
    "url_features_all": URL_FEATURES,
    "url_report": f"WITH {MODEL} SELECT page_id, fraud_verdict, fraud_probability, verdict_confidence, top_reasons, reg AS registrable_domain, analysis_mode, '' AS lookup_status, '' AS error FROM cells",
    "url_json": f"WITH {MODEL} SELECT page_id, {JSON} AS json FROM cells",
    "csv_sink": f"WITH {MODEL} SELECT page_id || ',' || {_cell('url')} || ',' || fraud_verdict || ',' || fraud_probability || ',' || verdict_confidence || ',' || {_cell('top_reasons')} || ',' || reg || ',' || analysis_mode || ',,' AS line FROM cells",
    "two_pass_gate": f"""WITH {MODEL}, {FACTS}, {_second("verdict = 'REVIEW'")} SELECT page_id, verdict AS offline_verdict, CASE WHEN used THEN verdict2 ELSE verdict END AS fraud_verdict, CASE WHEN used THEN '{ENRICHED}' WHEN gate THEN '{UNAVAILABLE}' ELSE '{CLEAR}' END AS analysis_mode,
  CASE WHEN gate THEN {LOOKED} ELSE 'not looked up (verdict already clear)' END AS lookup_status, round(CASE WHEN used THEN p2 ELSE p END, 6) AS probability FROM y""",
    "lookup_evidence": f"""WITH {MODEL}, {FACTS}, {_second("true")} SELECT page_id, CASE WHEN h < 20 THEN 'nxdomain' ELSE 'ok' END AS a_status, 'ok' AS status, CAST(1827 AS BIGINT) AS age, {LOOKED} AS lookup_status, CASE WHEN used THEN '{ENRICHED}' ELSE '{UNAVAILABLE}' END AS analysis_mode,
  round(CASE WHEN used THEN p2 ELSE p END, 6) AS probability FROM y""",
    "stream_file_score": f"WITH {MODEL} SELECT page_id, verdict AS fraud_verdict, round(p, 6) AS probability FROM v",
    "bootstrap_share": f"WITH {S}, g AS (SELECT grp, sum(label) AS h, count(*) AS n FROM s GROUP BY grp), r AS (SELECT rep, CAST(sum(w * h) AS DOUBLE) / sum(w * n) AS v FROM {_weights('g', 'grp', 200)} WHERE w > 0 GROUP BY rep) SELECT round(quantile_cont(v, 0.025), 6) AS low, round(quantile_cont(v, 0.975), 6) AS high, (SELECT round(CAST(sum(h) AS DOUBLE) / sum(n), 6) FROM g) AS estimate FROM r",
    "bootstrap_difference": f"WITH {S}, d AS (SELECT *, doc_id * 7919 % 1000 / 1000.0 AS other FROM s), b AS (SELECT * FROM {_weights('d', 'grp', 50)}), {_auc('score', 'x')}, {_auc('other', 'y')} SELECT round(quantile_cont(x.v - y.v, 0.025), 6) AS low, round(quantile_cont(x.v - y.v, 0.975), 6) AS high FROM x JOIN y USING (rep)",
    # Sources.
    "input_sniffing": "SELECT page_id, url FROM pages",
    "sniff_quoted": r"SELECT doc_id, lang, sha256(regexp_replace(coalesce(text, ''), '\r\n|\r', chr(10), 'g')) AS text FROM documents",
    "sniff_utf16": "SELECT page_id, url, 'utf-16' AS encoding FROM pages",
    "sniff_latin": "SELECT c_custkey, 'http://example.com/' || c_custkey AS link, 'é ü ñ ' || c_name AS note, 'cp1252' AS encoding FROM customer",
    "sniff_ragged": "SELECT page_id, replace(url, ',', '%2C') AS url, CASE page_id % 3 WHEN 0 THEN 'x,y' WHEN 1 THEN 'x' ELSE '' END AS note FROM pages",
    "sniff_lines": "SELECT url || CASE WHEN page_id % 4 = 0 THEN ',x' ELSE '' END AS url FROM pages",
    "url_column_choice": "SELECT * FROM (VALUES ('domain url', 1), ('S.No Site Link', 1), ('a b', 1), ('mail link x url', 1), ('website href', 1), ('id note', 1)) v(header, place)",
    "url_list_source": "SELECT CAST(row AS BIGINT) AS row, url FROM (VALUES (0, 'http://a.test/'), (1, 'x' || chr(65533) || '.test'), (2, 'é.test'), (3, 'aé.test')) v(row, url)",
    "list_file": f"""WITH {P}, e AS (SELECT 'block' AS kind, host, CASE page_id % 5 WHEN 3 THEN '/login' WHEN 4 THEN '/a/b?x=1' END AS prefix, page_id % 5 = 3 AS wild FROM q WHERE page_id % 5 > 0) SELECT kind, host, prefix, wild, count(*) AS n FROM e GROUP BY ALL""",
    "feed_files": f"WITH {P} SELECT DISTINCT 'line' AS feed, url FROM q WHERE page_id % 2 = 0 UNION ALL SELECT DISTINCT 'dump', replace(url, '''', '') FROM q UNION ALL SELECT DISTINCT 'json', host FROM q",
    "newest_snapshot": "SELECT strftime(o_orderdate, '%Y-%m') AS path, o_orderkey FROM orders WHERE strftime(o_orderdate, '%Y-%m') = (SELECT max(strftime(o_orderdate, '%Y-%m')) FROM orders)",
    "index_range": f"WITH {P} SELECT array_to_string(list_reverse(string_split(host, '.')), ',') || ')/' || page_id AS key FROM q WHERE reg = 'example.com'",
    "paged_pull": "SELECT user_id AS url, min(event_id) AS event_id, arg_min(event_type, event_id) AS event_type FROM events GROUP BY user_id",
    "date_texts": "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS day FROM orders",
    # URLs, hosts and addresses.
    "cell_errors": "SELECT page_id, CASE page_id % 6 WHEN 0 THEN 'empty URL' WHEN 1 THEN 'empty URL' WHEN 2 THEN 'could not parse a hostname from this value' WHEN 3 THEN 'not a URL (contains spaces or has no domain name)' WHEN 4 THEN 'not a URL (contains spaces or has no domain name)' END AS error FROM pages",
    "authority_parts": """SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'a:b' WHEN 3 THEN 'u@v' ELSE '' END AS userinfo, CASE page_id % 4 WHEN 2 THEN '[2001:db8::1]' WHEN 3 THEN 'example.org' ELSE 'example.com' END AS host,
  CASE page_id % 4 WHEN 0 THEN '8080' WHEN 2 THEN '99999' END AS port, page_id % 4 = 2 AS port_error, CASE page_id % 4 WHEN 2 THEN 6 ELSE 0 END AS ip FROM pages""",
    "ip_forms": "WITH n AS (SELECT c_custkey, c_custkey * 7919 * 65537 % 4278190080 + 16777216 AS n FROM customer) SELECT c_custkey, 4 AS version, (n >> 24) || '.' || ((n >> 16) & 255) || '.' || ((n >> 8) & 255) || '.' || (n & 255) AS address FROM n",
    "host_spelling": "SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN 'xn--fa-hia.de' ELSE 'xn--mnchen-3ya.de' END AS listed, CASE WHEN s_suppkey % 2 = 0 THEN 'fass.de' ELSE 'xn--mnchen-3ya.de' END AS host FROM supplier",
    "suffix_split_public": f"WITH {P} SELECT DISTINCT host, reg, tld AS suffix FROM q UNION ALL SELECT * FROM (VALUES ('user.github.io', 'github.io', 'io'), ('a.b.example.co.uk', 'example.co.uk', 'co.uk'), ('github.io', 'github.io', 'io'), ('x.foo.ck', 'x.foo.ck', 'foo.ck')) v(host, reg, suffix)",
    "popular_ranks": f"WITH {P}, r AS (SELECT host, min(page_id) AS rank FROM q GROUP BY host HAVING min(page_id) % 2 = 0) SELECT page_id, round(coalesce(CASE WHEN rank > 0 THEN log10(rank) END, 7), 6) AS popular_rank_log, CASE WHEN rank IS NULL THEN 0.0::DOUBLE ELSE 1 END AS is_popular FROM q LEFT JOIN r USING (host)",
    "dns_client": f"""WITH {P}, k AS (SELECT DISTINCT host, reg, CAST(('0x' || substr(md5('f|' || host), 1, 8)) AS BIGINT) % 100 AS h, CAST(('0x' || substr(md5('f|' || reg), 1, 8)) AS BIGINT) % 100 AS g FROM q)
  SELECT host, CASE WHEN h < 20 THEN 'nxdomain' ELSE 'ok' END AS a_status, CASE WHEN h >= 20 THEN CAST(h AS INTEGER) END AS ttl_a, CASE WHEN h >= 20 THEN 'alias.' || host END AS cname, CASE WHEN g < 20 THEN 'nxdomain' ELSE 'ok' END AS ns_status, CASE WHEN g < 20 THEN 'nxdomain' ELSE 'ok' END AS mx_status,
  CASE WHEN h >= 20 THEN '192.0.2.1' ELSE '' END AS a, CASE WHEN h >= 90 THEN '2001:db8::1' ELSE '' END AS aaaa, CASE WHEN g >= 20 THEN 'ns1.example' ELSE '' END AS ns, CASE WHEN g >= 20 THEN '10 mx.example.' ELSE '' END AS mx FROM k""",
    "registration_client": f"""WITH {P}, k AS (SELECT DISTINCT host AS reg, tld, CAST(('0x' || substr(md5('f|' || host), 1, 8)) AS BIGINT) % 100 AS h FROM q), t AS (SELECT reg, CASE WHEN tld NOT IN ('com', 'org') THEN 'no_rdap_server' WHEN h < 10 THEN 'not_found' WHEN h < 20 THEN 'http_503' WHEN h < 30 THEN 'bad_json' ELSE 'ok' END AS status FROM k)
  SELECT reg, status, CASE WHEN status = 'ok' THEN '2020-01-01T00:00:00Z' END AS created, CASE WHEN status = 'ok' THEN 'active' END AS flags FROM t""",
    "signal_texts": f"""WITH f AS ({URL_FEATURES}) SELECT page_id, concat_ws('; ', {", ".join(f"CASE WHEN {' + '.join(keys)} > 0 THEN " + "replace('" + text.replace("'", "''") + "', '{}', CAST(CAST(" + keys[0] + " AS BIGINT) AS VARCHAR)) END" for keys, text in SIGNALS)},
  'hostname has ' || CAST(host_n_labels AS BIGINT) || ' labels and ' || CAST(host_n_hyphens AS BIGINT) || ' hyphens', 'URL length ' || CAST(url_len AS BIGINT)) AS signals FROM f""",
    # Wording, cells and sinks.
    "fixed_numbers": "SELECT l_orderkey, l_linenumber, printf('%.3f', l_discount) AS d3, printf('%.1f', l_quantity / 16) AS q1, printf('%.3f', l_quantity / 16) AS q3 FROM lineitem",
    "phrases": """WITH o AS (SELECT o_orderkey, o_orderkey % 900 AS n, CASE WHEN o_orderkey % 900 % 3 = 0 THEN ' (lowers risk)' ELSE ' (raises risk)' END AS d FROM orders) SELECT o_orderkey, CASE n % 4 WHEN 0 THEN 'no query parameters' WHEN 1 THEN '1 query parameter' ELSE (n % 4) || ' query parameters' END || d AS n_params,
  CASE WHEN n % 5 <= 1 THEN 'no path' ELSE 'path is ' || (n % 5) || ' characters long' END || d AS path_len, (n % 101) || '% of characters are digits' || d AS digit_ratio,
  'domain registered ' || CASE WHEN n >= 730 THEN 'about ' || (n // 365) || ' years' WHEN n >= 60 THEN 'about ' || (n // 30) || ' months' WHEN n = 1 THEN '1 day' ELSE n || ' days' END || ' ago' || d AS domain_age_days_log,
  CASE n % 2 WHEN 1 THEN 'explicit port number' ELSE 'no explicit port' END || d AS has_port, CASE WHEN n % 5 >= 2 THEN 'registered for a ' || (n % 5) || '-year period' ELSE 'registered for about 1 year' END || d AS reg_period_years,
  'odd one = ' || regexp_replace(regexp_replace(CAST(n / 8 AS VARCHAR), '(\\.[0-9]*?)0+$', '\\1'), '\\.$', '') || d AS odd_one FROM o""",
    "partitioned_sink": "WITH c AS (SELECT CAST(c_custkey AS VARCHAR) AS grp, CAST(('0x' || substr(md5('s|' || CAST(c_custkey AS VARCHAR)), 1, 8)) AS BIGINT) % 100 AS b FROM customer) SELECT grp, CASE WHEN b < 60 THEN 'train' WHEN b < 70 THEN 'val' WHEN b < 80 THEN 'cal' ELSE 'test' END AS split FROM c",
    "row_chunks": "SELECT o_orderkey, o_orderkey // 20000 AS chunk, o_orderkey // 1000 AS part FROM orders",
    # Data sets.
    "feed_exclusion": f"""WITH {P}, f AS (SELECT * FROM q WHERE page_id % 5 = 0) SELECT page_id FROM q WHERE CASE WHEN reg = 'example.net' THEN split_part(url, '#', 1) NOT IN (SELECT split_part(url, '#', 1) FROM f) ELSE host NOT IN (SELECT host FROM f) AND reg NOT IN (SELECT reg FROM f WHERE page_id % 35 = 0) END""",
    "unseen_domains": f"WITH {P} SELECT page_id FROM q WHERE reg NOT IN (SELECT reg FROM q WHERE page_id % 50 = 1)",
    "tier_sample": " UNION ALL ".join([_tier(0, 0, 40, 10), _tier(1, 40, 100, 15), _tier(2, 100, 1_000_000, 25)]),
    "stratified_sample": f"WITH {S}, c AS (SELECT label, count(*) AS c, sum(count(*)) OVER () AS a FROM s GROUP BY label), r AS (SELECT doc_id, label, row_number() OVER (PARTITION BY label ORDER BY md5(doc_id || '|0')) AS n FROM s) SELECT doc_id, label FROM r JOIN c USING (label) WHERE n <= round_even(60 * c / a, 0)",
    "hash_sample": "SELECT o_orderkey FROM orders ORDER BY md5(o_orderkey || '|0') LIMIT 100",
    "host_caps": f"WITH {P}, a AS (SELECT page_id, reg, row_number() OVER (PARTITION BY host ORDER BY md5(page_id || '|0')) AS n FROM q), b AS (SELECT page_id, row_number() OVER (PARTITION BY reg ORDER BY md5(page_id || '|0')) AS m FROM a WHERE n <= 2) SELECT page_id FROM b WHERE m <= 25",
    "class_balance": "WITH n AS (SELECT min(c) AS n FROM (SELECT count(*) AS c FROM labels GROUP BY quality)), r AS (SELECT doc_id, quality, row_number() OVER (PARTITION BY quality ORDER BY md5(doc_id || '|0')) AS k FROM labels) SELECT doc_id, CAST(quality AS INTEGER) AS label FROM r, n WHERE k <= n.n",
    "label_filters": f"WITH {P} SELECT page_id FROM q WHERE length(url) >= 30 AND page_id % 2 = 0 AND reg IN ('example.com', 'example.org')",
    "live_rows": f"WITH {P}, {FACTS} SELECT page_id FROM q JOIN h USING (host) WHERE h >= 20",
    "publishable_suffixes": f"""WITH {S}, g AS (SELECT grp || '.' || dataset AS suffix, dataset AS top, CAST(sum(label) AS DOUBLE) AS y, count(*) AS n, count(DISTINCT doc_id % 3) AS sites FROM s GROUP BY 1, 2), pr AS (SELECT sum(y) / sum(n) AS prior FROM g),
  t AS (SELECT top, (sum(y) + 20 * any_value(prior)) / (sum(n) + 20) AS rate FROM g, pr GROUP BY top) SELECT suffix, round((y + 20 * t.rate) / (n + 20), 6) AS rate FROM g JOIN t USING (top) WHERE sites >= 2 OR suffix = 'web.en' UNION ALL SELECT top, round(rate, 6) FROM t""",
    "registry_of": f"WITH {P} SELECT DISTINCT reg, CASE tld WHEN 'com' THEN 'https://a.example/' WHEN 'org' THEN 'https://b.example/' END AS base_url FROM q",
    "registry_workload": f"WITH {P} SELECT CASE tld WHEN 'com' THEN 'https://a.example/' WHEN 'org' THEN 'https://b.example/' END AS base_url, count(DISTINCT host) AS hosts, count(DISTINCT reg) AS domains, count(DISTINCT host) * 4 AS dns_queries FROM q GROUP BY 1",
    "workload_order": f"WITH {P} SELECT DISTINCT host, array_to_string(list_reverse(string_split(host, '.')), ',') AS surt FROM q",
    # Scores and models.
    "score_alignment": f"WITH {S} SELECT doc_id AS url, score, round(1 - score, 6) AS other FROM s WHERE doc_id % 3 <> 0",
    "age_when_seen": "SELECT o_orderkey, round(log10(1 + greatest(0, CAST(floor((epoch(date_trunc('day', o_orderdate)) - epoch(TIMESTAMP '1990-01-01 12:00:00')) / 86400) AS BIGINT))), 6) AS age FROM orders",
    "recall_elsewhere": f"WITH {S}, g AS (SELECT score, row_number() OVER (ORDER BY score DESC) - 1 AS k, count(*) OVER () AS n FROM s WHERE label = 0 AND dataset = 'en'), t AS (SELECT coalesce(max(score + 1e-9) FILTER (k = CAST(floor(0.1 * n) AS BIGINT)), 0) AS t FROM g) SELECT round(t, 9) AS threshold, round(avg(CAST(score >= t AS INTEGER)), 6) AS recall, count(*) AS n FROM s, t WHERE label = 1 AND dataset <> 'en' GROUP BY t",
    "standardised_features": f"WITH {S}, m AS (SELECT avg(score) AS a, stddev_pop(score) AS b, avg(length(grp)) AS c, stddev_pop(length(grp)) AS d FROM s WHERE doc_id % 5 <> 0) SELECT doc_id, round((score - a) / CASE WHEN b > 0 THEN b ELSE 1 END, 6) AS score, round((length(grp) - c) / CASE WHEN d > 0 THEN d ELSE 1 END, 6) AS len FROM s, m",
    "shifted_odds": f"WITH {S} SELECT doc_id, round(score * 4 - 2 + ln(0.05 / 0.95) - ln(0.3 / 0.7), 6) AS raw FROM s",
    "folded_rates": f"""WITH {S}, f AS (SELECT *, CAST(CAST('0x' || substr(md5('fold|' || grp), 1, 8) AS BIGINT) % 100 % 3 AS INTEGER) AS fold FROM s), k AS (SELECT DISTINCT fold, dataset FROM f), pr AS (SELECT k.fold, avg(label) AS prior FROM (SELECT DISTINCT fold FROM f) k JOIN f ON f.fold <> k.fold GROUP BY k.fold),
  r AS (SELECT k.fold, k.dataset, (coalesce(sum(f.label), 0) + 20 * any_value(prior)) / (count(f.label) + 20) AS rate FROM k JOIN pr ON pr.fold = k.fold LEFT JOIN f ON f.fold <> k.fold AND f.dataset = k.dataset GROUP BY 1, 2) SELECT doc_id, fold, round(rate, 6) AS rate FROM f LEFT JOIN r USING (fold, dataset)""",
    "cascade_scores": f"WITH {S} SELECT doc_id, round(CASE WHEN score BETWEEN 0.4 AND 0.6 THEN 1 - score / 2 ELSE score END, 6) AS score FROM s",
    "count_tensor": f"""WITH RECURSIVE {S}, c AS (SELECT dataset, label, CASE WHEN score >= 0.7 THEN 'FRAUD' WHEN score <= 0.3 THEN 'LEGITIMATE' ELSE 'REVIEW' END AS verdict, count(*) AS k FROM s GROUP BY ALL),
  t AS (SELECT *, CAST(sum(k) OVER (PARTITION BY dataset, label) AS BIGINT) AS n FROM c),
  b AS (SELECT dataset, label, verdict, k, n, 0 AS it, CAST(0 AS DOUBLE) AS l0, CAST(1 AS DOUBLE) AS l1, CAST(0 AS DOUBLE) AS h0, CAST(1 AS DOUBLE) AS h1 FROM t
    UNION ALL SELECT dataset, label, verdict, k, n, it + 1, CASE WHEN up < 0.025 THEN (l0 + l1) / 2 ELSE l0 END, CASE WHEN up < 0.025 THEN l1 ELSE (l0 + l1) / 2 END, CASE WHEN down > 0.025 THEN (h0 + h1) / 2 ELSE h0 END, CASE WHEN down > 0.025 THEN h1 ELSE (h0 + h1) / 2 END FROM (
      SELECT dataset, label, verdict, k, n, it, l0, l1, h0, h1, sum(CASE WHEN i >= k THEN exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln((l0 + l1) / 2) + (n - i) * ln(1 - (l0 + l1) / 2)) ELSE 0 END) AS up,
        sum(CASE WHEN i <= k THEN exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln((h0 + h1) / 2) + (n - i) * ln(1 - (h0 + h1) / 2)) ELSE 0 END) AS down
      FROM (SELECT *, unnest(range(n + 1)) AS i FROM b WHERE it < 45) GROUP BY ALL))
  SELECT dataset, label, verdict, k AS n, round(k / n, 6) AS share, round(CASE WHEN k = 0 THEN 0 ELSE l0 END, 6) AS low, round(CASE WHEN k = n THEN 1 ELSE h1 END, 6) AS high FROM b WHERE it = 45""",
    "crosstab_columns": f"WITH {S}, c AS (SELECT dataset, count(*) FILTER (label = 0) AS n_0, count(*) FILTER (label = 1) AS n_1 FROM s GROUP BY dataset) SELECT *, round(n_0 / sum(n_0) OVER (), 6) AS share_0, round(n_1 / sum(n_1) OVER (), 6) AS share_1 FROM c",
    # Streams.
    "stream_windows": "SELECT CAST(epoch(date_trunc('hour', ts)) AS BIGINT) AS start, event_type, count(*) AS n FROM events GROUP BY ALL",
}
