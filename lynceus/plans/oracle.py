"""The queries' results in DuckDB SQL."""

from __future__ import annotations

S = "s AS (SELECT l.doc_id, d.lang AS dataset, d.source AS grp, CAST(l.quality AS INTEGER) AS label, CAST(d.n_chars % 1000 AS DOUBLE) / 1000 AS score FROM labels l JOIN documents d ON l.doc_id = d.doc_id)"
P = r"""p AS (SELECT page_id, url, regexp_extract(url, '^([a-z]+)://', 1) AS scheme, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host,
  regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(url, '^[^?#]*\?([^#]*)', 1) AS query, regexp_extract(url, '#(.*)$', 1) AS fragment FROM pages),
q AS (SELECT *, array_to_string(string_split(host, '.')[-2:], '.') AS reg, array_to_string(string_split(host, '.')[1:-3], '.') AS sub,
  CASE WHEN path = '' THEN '/' ELSE path END AS path1, scheme || '://' || host || CASE WHEN path = '' THEN '/' ELSE path END || CASE WHEN query <> '' THEN '?' || query ELSE '' END AS u FROM p)"""
VALUES_HOSTS = "('a.b.example.co.uk'), ('example.co.uk'), ('co.uk'), ('x.foo.ck'), ('www.ck'), ('a.city.kawasaki.jp'), ('b.c.kawasaki.jp'), ('user.github.io'), ('deep.user.github.io'), ('example.zz'), ('localhost')"


def _count(mark: str) -> str:
    return f"CAST(length(u) - length(replace(u, '{mark}', '')) AS DOUBLE)"


def _entropy(source: str, name: str) -> str:
    return f"{name} AS (SELECT page_id, -sum(c / n * log2(c / n)) AS e FROM (SELECT page_id, ch, CAST(count(*) AS DOUBLE) AS c, CAST(sum(count(*)) OVER (PARTITION BY page_id) AS DOUBLE) AS n FROM (SELECT page_id, unnest(string_split({source}, '')) AS ch FROM q) GROUP BY page_id, ch) GROUP BY page_id)"


RAW = """CASE WHEN length(u) <= 45.5 THEN -0.5 ELSE 0.6 END AS t_len, CASE WHEN scheme = 'http' THEN 1 ELSE 0 END AS http, CASE WHEN query = '' THEN 0 ELSE len(list_filter(string_split(query, '&'), lambda x: x <> '')) END AS np,
  len(list_filter(regexp_extract_all(lower(path1 || CASE WHEN query <> '' THEN '?' || query ELSE '' END), '[a-z0-9]+'), lambda t: list_contains(string_split('login logon signin signon verify verification validate account accounts update secure security banking confirm password passwd credential wallet recover recovery unlock suspend suspended locked billing invoice payment pay support service alert webscr cmd auth authenticate session limited restore reactivate customer helpdesk bonus gift prize winner claim refund tax delivery parcel package track tracking shipment webmail mail admin portal token seed airdrop giveaway free promo reward redeem kyc 2fa otp', ' '), t))) AS sus,
  len(string_split(host, '.')) AS labels, CASE regexp_extract(host, '([^.]*)$', 1) WHEN 'com' THEN ln(0.45 / 0.55) WHEN 'net' THEN ln(0.6 / 0.4) WHEN 'org' THEN ln(0.2 / 0.8) ELSE 0 END AS lo"""
TREES = f"""{P}, r AS (SELECT page_id, host, reg, {RAW} FROM q), t AS (SELECT *, t_len AS c0, CASE WHEN http <= 0.5 THEN -0.6 WHEN np <= 2.5 THEN 0.2 ELSE 0.9 END AS l1, CASE WHEN sus <= 0.5 THEN -0.2 ELSE 1.1 END AS l2, CASE WHEN labels <= 2.5 THEN -0.4 ELSE 0.3 END AS l3, CASE WHEN lo <= 0 THEN -0.3 ELSE 0.5 END AS l4 FROM r),
x AS (SELECT *, -0.2 + c0 + l1 + l2 + l3 + l4 AS raw FROM t), y AS (SELECT *, 1 / (1 + exp(-(1.7 * raw + 0.1))) AS p FROM x)"""

ORACLE_SQL: dict[str, str] = {
    "url_parse": f"WITH {P} SELECT page_id, scheme, host, path, query, fragment, reg, sub, u AS canonical FROM q",
    "url_keys": rf"WITH {P} SELECT page_id, split_part(url, '#', 1) AS canonical_text, regexp_replace(regexp_replace(regexp_replace(split_part(lower(url), '#', 1), '^[a-z]+://', ''), '^www\.', ''), '/+$', '') AS loose_key, array_to_string(list_reverse(string_split(reg, '.')), ',') AS surt FROM q",
    "url_features_counts": rf"""WITH {P} SELECT page_id, CAST(length(u) AS DOUBLE) AS url_len, CASE WHEN scheme = 'http' THEN 1.0::DOUBLE ELSE 0 END AS scheme_http, {_count('@')} AS n_at, {_count('.')} AS n_dot, {_count('-')} AS n_hyphen, {_count('/')} AS n_slash,
  {_count('?')} AS n_qmark, {_count('=')} AS n_equal, {_count('&')} AS n_amp, {_count('%')} AS n_percent, {_count('#')} AS n_hash, CAST(len(regexp_extract_all(u, '%[0-9a-fA-F]{{2}}')) AS DOUBLE) AS n_pct_encoded,
  CAST(len(list_filter(string_split(u, ''), lambda x: unicode(x) > 127)) AS DOUBLE) AS non_ascii, CAST(0 AS DOUBLE) AS has_port, CAST(length(query) AS DOUBLE) AS query_len, CAST(length(path1) AS DOUBLE) AS path_len, CAST(length(host) AS DOUBLE) AS host_len FROM q""",
    "url_features_ratio": rf"""WITH {P}, c AS (SELECT *, CAST(length(u) AS DOUBLE) AS n, length(regexp_replace(u, '[^0-9]', '', 'g')) AS d, length(regexp_replace(u, '[^a-zA-Z]', '', 'g')) AS a, length(regexp_replace(u, '[^A-Z]', '', 'g')) AS up FROM q)
  SELECT page_id, round(d / n, 6) AS digit_ratio, round(a / n, 6) AS letter_ratio, round(up / n, 6) AS upper_ratio, round((n - d - a) / n, 6) AS special_ratio, round(length(regexp_replace(host, '[^0-9]', '', 'g')) / CAST(length(host) AS DOUBLE), 6) AS host_digit_ratio, round(length(regexp_replace(path1, '[^0-9]', '', 'g')) / CAST(length(path1) AS DOUBLE), 6) AS path_digit_ratio FROM c""",
    "url_entropy": f"WITH {P}, {_entropy('u', 'a')}, {_entropy('host', 'b')}, {_entropy('path1', 'c')} SELECT page_id, round(a.e, 6) AS url_entropy, round(b.e, 6) AS host_entropy, round(c.e, 6) AS path_entropy FROM a JOIN b USING (page_id) JOIN c USING (page_id)",
    "url_structure": f"""WITH {P}, c AS (SELECT *, string_split(host, '.') AS ls, list_filter(string_split(path1, '/'), lambda x: x <> '') AS segs FROM q)
  SELECT page_id, CAST(len(ls) AS DOUBLE) AS host_n_labels, CAST(greatest(len(ls) - 2, 0) AS DOUBLE) AS n_sub_labels, CAST(length(sub) AS DOUBLE) AS sub_len, CASE WHEN ls[1] = 'www' THEN 1.0::DOUBLE ELSE 0 END AS www_prefix, CAST(list_max(list_transform(ls, lambda x: length(x))) AS DOUBLE) AS host_max_label_len,
  CAST(len(segs) AS DOUBLE) AS path_depth, CAST(coalesce(list_max(list_transform(segs, lambda x: length(x))), 0) AS DOUBLE) AS path_max_seg_len, CASE WHEN len(segs) = 0 AND query = '' THEN 1.0::DOUBLE ELSE 0 END AS is_homepage, CAST(length(ls[-2]) AS DOUBLE) AS sld_len, CAST(length(ls[-1]) AS DOUBLE) AS tld_len, CAST(1 AS DOUBLE) AS suffix_n_labels FROM c""",
    "url_tokens_words": f"WITH {P}, c AS (SELECT page_id, regexp_extract_all(lower(path || '?' || query), '[a-z0-9]+') AS t FROM q) SELECT page_id, CAST(len(t) AS BIGINT) AS n_tokens, CAST(len(list_filter(t, lambda x: x IN ('login', 'page', 'ref', 'update', 'free'))) AS BIGINT) AS n_words FROM c",
    "query_params": f"WITH {P}, c AS (SELECT page_id, list_transform(list_filter(string_split(query, '&'), lambda x: x <> ''), lambda x: lower(split_part(x, '=', 1))) AS n FROM q) SELECT page_id, array_to_string(n, ',') AS params, CAST(len(n) AS BIGINT) AS n_params FROM c",
    "suffix_split": rf"""WITH {P}, h AS (SELECT DISTINCT host FROM q UNION ALL SELECT * FROM (VALUES {VALUES_HOSTS}) v(host)),
rules(kind, name, own) AS (VALUES (2, 'com', false), (2, 'net', false), (2, 'org', false), (2, 'io', false), (2, 'uk', false), (2, 'co.uk', false), (2, 'jp', false), (3, 'ck', false), (1, 'www.ck', false), (3, 'kawasaki.jp', false), (1, 'city.kawasaki.jp', false), (2, 'github.io', true)),
c AS (SELECT host, string_split(host, '.') AS ls, unnest(range(1, len(string_split(host, '.')) + 1)) AS i FROM h),
m AS (SELECT c.host, c.ls, c.i, r.kind, r.own, CASE WHEN r.kind = 1 THEN len(ls) - i ELSE len(ls) - i + 1 END AS size FROM c JOIN rules r ON (r.kind < 3 AND r.name = array_to_string(ls[i:], '.')) OR (r.kind = 3 AND i < len(ls) AND r.name = array_to_string(ls[i + 1:], '.'))),
b AS (SELECT host, arg_min(size, i * 10 + kind) AS size, arg_min(own, i * 10 + kind) AS own FROM m GROUP BY host),
z AS (SELECT h.host, string_split(h.host, '.') AS ls, coalesce(b.size, 1) AS size, coalesce(b.own, false) AS own FROM h LEFT JOIN b ON h.host = b.host)
SELECT host, CASE WHEN size >= len(ls) THEN '' ELSE array_to_string(ls[1 : len(ls) - size - 1], '.') END AS sub, CASE WHEN size >= len(ls) THEN '' ELSE array_to_string(ls[len(ls) - size :], '.') END AS reg, array_to_string(ls[len(ls) - size + 1 :], '.') AS suffix, own AS private FROM z""",
    "list_match": f"""WITH {P}, t AS (SELECT *, lower(path1) || CASE WHEN query <> '' THEN '?' || query ELSE '' END AS tgt FROM q)
  SELECT page_id, CASE WHEN reg = 'example.net' OR (host = 'example.com' AND (tgt = '/fr' OR tgt LIKE '/fr/%' OR tgt LIKE '/fr?%')) OR (reg = 'example.org' AND (tgt = '/en' OR tgt LIKE '/en/%' OR tgt LIKE '/en?%')) THEN 'block' WHEN reg = 'example.org' OR host = 'm.example.com' OR host LIKE '%.m.example.com' THEN 'allow' END AS list_kind,
  CASE WHEN host = 'example.com' AND (tgt = '/fr' OR tgt LIKE '/fr/%' OR tgt LIKE '/fr?%') THEN 'example.com/fr' WHEN reg = 'example.org' AND (tgt = '/en' OR tgt LIKE '/en/%' OR tgt LIKE '/en?%') THEN '*.example.org/en' WHEN reg = 'example.net' THEN 'example.net' WHEN reg = 'example.org' THEN 'example.org' WHEN host = 'm.example.com' OR host LIKE '%.m.example.com' THEN 'm.example.com' END AS list_entry FROM t""",
    "grouped_split": "WITH c AS (SELECT CAST(c_custkey AS VARCHAR) AS grp, CAST(('0x' || substr(md5('s|' || CAST(c_custkey AS VARCHAR)), 1, 8)) AS BIGINT) % 100 AS bucket FROM customer) SELECT grp, CAST(bucket AS BIGINT) AS bucket, CASE WHEN bucket < 60 THEN 'train' WHEN bucket < 70 THEN 'val' WHEN bucket < 80 THEN 'cal' ELSE 'test' END AS split FROM c",
    "dedupe_conflict": r"WITH d AS (SELECT doc_id, regexp_replace(regexp_replace(text, '^\s+', ''), '\s+$', '') AS url, quality AS label FROM documents JOIN labels USING (doc_id)), k AS (SELECT url FROM d WHERE length(url) > 3 GROUP BY url HAVING min(label) = max(label)) SELECT doc_id, label, md5(url) AS key FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY doc_id) AS n FROM d JOIN k USING (url)) WHERE n = 1",
    "cap_per_group": f'WITH {P}, a AS (SELECT page_id, host, reg, row_number() OVER (PARTITION BY host ORDER BY page_id) AS n FROM q), b AS (SELECT page_id, host, reg, row_number() OVER (PARTITION BY reg ORDER BY page_id) AS m FROM a WHERE n <= 2) SELECT page_id, host, reg AS "group" FROM b WHERE m <= 20',
    "cap_by_kind": f"WITH {P}, a AS (SELECT page_id, host, reg, row_number() OVER (PARTITION BY reg ORDER BY page_id) AS n FROM q) SELECT page_id, host, reg AS \"group\" FROM a WHERE n <= CASE WHEN reg = 'example.com' THEN 30 ELSE 3 END",
    "anti_seen": r"""WITH k AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(split_part(lower(regexp_replace(regexp_replace(text, '^\s+', ''), '\s+$', '')), '#', 1), '^[a-z]+://', ''), '^www\.', ''), '/+$', '') AS k FROM documents),
  b AS (SELECT k FROM k WHERE doc_id % 7 = 0 UNION SELECT regexp_replace(regexp_replace(split_part(lower(text), '#', 1), '^www\.', ''), '/+$', '') FROM benchmark) SELECT doc_id FROM k WHERE k NOT IN (SELECT k FROM b)""",
    "class_exclusion": f"""WITH {P}, a AS (SELECT page_id, reg FROM q WHERE page_id % 2 = 0), b AS (SELECT page_id, reg FROM q WHERE page_id % 3 = 0 AND reg <> 'example.org'), both AS (SELECT reg FROM a INTERSECT SELECT reg FROM b EXCEPT SELECT 'example.net')
  SELECT page_id, 'a' AS class FROM a WHERE reg NOT IN (SELECT reg FROM both) UNION ALL SELECT page_id, 'b' FROM b WHERE reg NOT IN (SELECT reg FROM both)""".replace("both AS", "bth AS").replace("FROM both", "FROM bth"),
    "suffix_rate": f"""WITH {S}, g AS (SELECT grp || '.' || dataset AS suffix, dataset AS top, CAST(sum(label) AS DOUBLE) AS y, count(*) AS n FROM s GROUP BY 1, 2), pr AS (SELECT sum(y) / sum(n) AS prior FROM g), t AS (SELECT top, (sum(y) + 20 * any_value(prior)) / (sum(n) + 20) AS rate FROM g, pr GROUP BY top)
  SELECT suffix, round((y + 20 * t.rate) / (n + 20), 6) AS rate FROM g JOIN t USING (top) UNION ALL SELECT top, round(rate, 6) FROM t""",
    "weights": f"WITH {S}, n AS (SELECT dataset, count(*) AS n FROM s GROUP BY dataset), w(dataset, share) AS (VALUES ('en', 0.4::DOUBLE), ('de', 0.3::DOUBLE), ('fr', 0.2::DOUBLE), ('es', 0.1::DOUBLE)) SELECT doc_id, round(share / n * (SELECT sum(n.n) FROM n JOIN w USING (dataset)), 6) AS weight FROM s JOIN n USING (dataset) JOIN w USING (dataset)",
    "confusion_metrics": f"""WITH {S}, c AS (SELECT count(*) AS n, count(*) FILTER (label = 1) AS n_pos, count(*) FILTER (label = 0) AS n_neg, count(*) FILTER (label = 1 AND score >= 0.5) AS tp, count(*) FILTER (label = 0 AND score >= 0.5) AS fp, count(*) FILTER (label = 0 AND score < 0.5) AS tn, count(*) FILTER (label = 1 AND score < 0.5) AS fn FROM s)
  SELECT *, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1, round(fp / (fp + tn), 6) AS fpr, round(fn / (fn + tp), 6) AS fnr, round((tp + tn) / n, 6) AS accuracy FROM c""",
    "roc_auc": f"WITH {S}, r AS (SELECT label, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS r FROM s) SELECT round(CAST((sum(r) FILTER (label = 1) - count(*) FILTER (label = 1) * (count(*) FILTER (label = 1) + 1) / 2.0) / (count(*) FILTER (label = 1) * count(*) FILTER (label = 0)) AS DOUBLE), 6) AS roc_auc FROM r",
    "pr_auc": f"WITH {S}, g AS (SELECT score, CAST(sum(label) AS DOUBLE) AS p, count(*) AS n FROM s GROUP BY score), c AS (SELECT p, sum(p) OVER (ORDER BY score DESC) AS tp, sum(n) OVER (ORDER BY score DESC) AS n FROM g) SELECT round(sum(p * tp / n) / sum(p), 6) AS pr_auc FROM c",
    "brier_logloss": f"WITH {S}, c AS (SELECT label AS y, greatest(least(score, 1 - 1e-7), 1e-7) AS p FROM s) SELECT round(avg((p - y) * (p - y)), 6) AS brier, round(avg(-(y * ln(p) + (1 - y) * ln(1 - p))), 5) AS log_loss FROM c",
    "ece": f"WITH {S}, e AS (SELECT [k / 15::DOUBLE for k in range(1, 15)] AS e), b AS (SELECT len(list_filter(e, lambda x: x <= score)) AS b, label, score FROM s, e), g AS (SELECT count(*) AS n, abs(avg(label) - avg(score)) AS d FROM b GROUP BY b) SELECT round(sum(n * d) / sum(n), 6) AS ece FROM g",
    "reliability": f"WITH {S} SELECT CAST(len(list_filter([0.1, 0.3, 0.5, 0.7, 0.9], lambda x: CAST(x AS DOUBLE) <= score)) AS INTEGER) AS bin, count(*) AS n, round(avg(score), 6) AS mean_score, round(avg(label), 6) AS observed FROM s GROUP BY 1",
    "recall_at_fpr": f"WITH {S}, c AS (SELECT score, sum(sum(label)) OVER (ORDER BY score DESC) AS tp, sum(sum(1 - label)) OVER (ORDER BY score DESC) AS fp FROM s GROUP BY score), n AS (SELECT sum(label) AS p, sum(1 - label) AS q FROM s) SELECT round(coalesce(max(CAST(tp AS DOUBLE) / p) FILTER (CAST(fp AS DOUBLE) / q <= 0.1), 0), 6) AS recall FROM c, n",
    "threshold_at_fpr": f"WITH {S}, g AS (SELECT score, row_number() OVER (ORDER BY score DESC) - 1 AS k, count(*) OVER () AS n FROM s WHERE label = 0) SELECT round(coalesce(max(score + 1e-9) FILTER (k = CAST(floor(0.1 * n) AS BIGINT)), 0), 9) AS threshold FROM g",
    "weighted_threshold": f"""WITH {S}, w(dataset, share) AS (VALUES ('en', 0.4::DOUBLE), ('de', 0.3::DOUBLE), ('fr', 0.2::DOUBLE), ('es', 0.1::DOUBLE)), z AS (SELECT dataset, label, count(*) AS n FROM s GROUP BY 1, 2), v AS (SELECT s.score, s.label, share / n AS w FROM s JOIN w USING (dataset) JOIN z USING (dataset, label)),
  g AS (SELECT score, sum(w) FILTER (label = 1) AS p, sum(w) FILTER (label = 0) AS q FROM v GROUP BY score), c AS (SELECT score, sum(coalesce(q, 0)) OVER (ORDER BY score DESC) AS fpr, sum(coalesce(p, 0)) OVER (ORDER BY score) AS fnr FROM g)
  SELECT min(score) FILTER (fpr <= 0.1 + 1e-12) AS fraud, least(max(score) FILTER (fnr <= 0.1 + 1e-12), min(score) FILTER (fpr <= 0.1 + 1e-12)) AS legit FROM c""",
    "calibration_forms": f"WITH {S}, r AS (SELECT doc_id, (score - 0.5) * 6 AS r FROM s) SELECT doc_id, round(1 / (1 + exp(-(1.7 * r + 0.1))), 6) AS platt, round(CASE WHEN r <= -2 THEN 0.1::DOUBLE WHEN r >= 2.5 THEN 0.9 WHEN r < 0 THEN 0.1 + (r + 2) / 2 * 0.2 WHEN r < 1 THEN 0.3 ELSE 0.3 + (r - 1) / 1.5 * 0.6 END, 6) AS isotonic, round(1 / (1 + exp(-r)), 6) AS logistic FROM r",
    "verdict_three_way": f"WITH {S}, c AS (SELECT doc_id, score AS p, greatest(least(score, 1 - 1e-9), 1e-9) AS q FROM s), o AS (SELECT doc_id, p, q / (1 - q) * (0.1::DOUBLE / 0.9) / (0.4712::DOUBLE / (1 - 0.4712::DOUBLE)) AS o FROM c), a AS (SELECT doc_id, p, o / (1 + o) AS a FROM o) SELECT doc_id, round(a, 6) AS adjusted, CASE WHEN p >= 0.8727 AND a >= 0.5 THEN 'FRAUD' WHEN p <= 0.1009 AND a <= 0.5 THEN 'LEGITIMATE' ELSE 'REVIEW' END AS verdict, round(CASE WHEN p >= 0.8727 AND a >= 0.5 THEN a WHEN p <= 0.1009 AND a <= 0.5 THEN 1 - a ELSE greatest(a, 1 - a) END, 6) AS confidence FROM a",
    "tree_score": f"WITH {TREES} SELECT page_id, round(CAST(raw AS DOUBLE), 6) AS raw, round(CAST(p AS DOUBLE), 6) AS probability FROM y",
    "tree_contributions": f"WITH {TREES} SELECT page_id, round(CAST(-0.2 + 0.05 + 0.1 + 0.45 - 0.05 + 0.1 AS DOUBLE), 6) AS bias, round(CAST(c0 - 0.05 AS DOUBLE), 6) AS url_len, round(CAST(CASE WHEN http <= 0.5 THEN l1 - 0.1 ELSE 0.3 END AS DOUBLE), 6) AS scheme_http, round(CAST(CASE WHEN http <= 0.5 THEN 0 ELSE l1 - 0.4 END AS DOUBLE), 6) AS n_params, round(CAST(l2 - 0.45 AS DOUBLE), 6) AS sus_words_path, round(CAST(l3 + 0.05 AS DOUBLE), 6) AS host_n_labels, round(CAST(l4 - 0.1 AS DOUBLE), 6) AS tld_logit FROM y",
    "url_verdicts": f"WITH {TREES} SELECT page_id, CASE WHEN p >= 0.8 THEN 'FRAUD' WHEN p <= 0.2 THEN 'LEGITIMATE' ELSE 'REVIEW' END AS fraud_verdict, round(CAST(p AS DOUBLE), 6) AS probability, reg AS registrable_domain FROM y",
    "cache_lww_ttl": "WITH l AS (SELECT user_id AS k, arg_max(value, event_id) AS v, arg_max(ts, event_id) AS t FROM events GROUP BY user_id) SELECT k, v FROM l WHERE epoch((SELECT max(date_trunc('second', ts)) FROM events)) - epoch(date_trunc('second', t)) <= 7 * 86400",
    "session_gap": "WITH g AS (SELECT user_id, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) > INTERVAL 3600 SECOND THEN 1 ELSE 0 END AS new FROM events) SELECT user_id, CAST(sum(new) + 1 AS BIGINT) AS sessions, count(*) AS n FROM g GROUP BY user_id",
    "median_gap": "WITH g AS (SELECT event_type, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY event_type ORDER BY ts)) / 1e6 AS g FROM events) SELECT event_type, round(quantile_cont(g, 0.5), 3) AS median_gap FROM g GROUP BY event_type",
    "verdict_counts": "SELECT event_type, count(*) AS n FROM events GROUP BY event_type",
    "crosstab": f"WITH {S}, c AS (SELECT dataset, count(*) FILTER (label = 0) AS n_0, count(*) FILTER (label = 1) AS n_1 FROM s GROUP BY dataset) SELECT *, round(n_0 / (n_0 + n_1), 6) AS share_0, round(n_1 / (n_0 + n_1), 6) AS share_1 FROM c",
    "deciles": "SELECT o_orderstatus, " + ", ".join(f"round(quantile_cont(o_totalprice, {k / 10}), 3) AS d{k}" for k in range(11)) + " FROM orders GROUP BY o_orderstatus",
    "medians_missing": "SELECT event_type, round(quantile_cont(CASE WHEN event_id % 5 <> 0 THEN value END, 0.5), 6) AS median_value, round(avg(CASE WHEN event_id % 5 <> 0 AND value IS NOT NULL THEN 0 ELSE 1 END), 6) AS missing_value FROM events GROUP BY event_type",
    "topn_groups": f"WITH {P} SELECT host, count(*) AS n FROM q GROUP BY host ORDER BY n DESC, host LIMIT 10",
    "arg_min_max": "WITH r AS (SELECT l_returnflag AS f, round(sum(l_quantity), 2) AS q, round(avg(l_discount), 6) AS d FROM lineitem GROUP BY 1) SELECT min(q) AS min_q, arg_min(f, q) AS argmin_q, max(q) AS max_q, arg_max(f, q) AS argmax_q, min(d) AS min_d, (SELECT f FROM r ORDER BY d, f LIMIT 1) AS argmin_d, max(d) AS max_d, (SELECT f FROM r ORDER BY d DESC, f LIMIT 1) AS argmax_d FROM r",
    "determinism_audit": f'WITH {P} SELECT host, count(*) AS "rows", count(DISTINCT page_id % 2) AS variants FROM q GROUP BY host HAVING count(DISTINCT page_id % 2) > 1',
    "explode_reasons": "WITH e AS (SELECT event_type, unnest(['value ' || CAST(CAST(floor(value) AS BIGINT) AS VARCHAR), 'type ' || event_type]) AS r FROM events), c AS (SELECT event_type, regexp_replace(r, '[0-9]+(\\.[0-9]+)?', '#', 'g') AS template, count(*) AS n FROM e GROUP BY 1, 2) SELECT event_type, template, n, CAST(row_number() OVER (PARTITION BY event_type ORDER BY n DESC, template) AS INTEGER) AS rank FROM c QUALIFY rank <= 10",
    "bytes_by_column": r"""WITH c AS (SELECT unnest(['page_id', 'url', 'html']) AS "column", unnest([CAST(page_id AS VARCHAR), url, coalesce(html, '')]) AS v FROM pages) SELECT "column", CAST(sum(CASE WHEN regexp_matches(v, '[,"\r\n]') THEN octet_length(encode(v)) + 2 + length(v) - length(replace(v, '"', '')) ELSE octet_length(encode(v)) END) AS BIGINT) AS bytes FROM c GROUP BY 1""",
    "multi_line_cells": r"SELECT CAST(count(*) FILTER (regexp_matches(text, '[\r\n]')) AS BIGINT) AS n, min(doc_id + 1) FILTER (regexp_matches(text, '[\r\n]')) AS first FROM documents",
    "compare_outputs": "WITH a AS (SELECT DISTINCT doc_id, quality, toxic FROM labels) SELECT count(*) FILTER (doc_id % 10 = 0) AS rows_only_before, CAST(0 AS BIGINT) AS rows_only_after, count(*) FILTER (doc_id % 10 <> 0 AND doc_id % 7 = 0) AS differing FROM a",
    "lookup_workload": f"WITH {P}, h AS (SELECT host, min(page_id // 100) AS chunk FROM q GROUP BY host), d AS (SELECT reg, min(page_id // 100) AS chunk FROM q GROUP BY reg), a AS (SELECT chunk, count(*) AS hosts FROM h GROUP BY chunk), b AS (SELECT chunk, count(*) AS domains FROM d GROUP BY chunk) SELECT coalesce(a.chunk, b.chunk) AS chunk, coalesce(hosts, 0) AS hosts, coalesce(domains, 0) AS domains, coalesce(hosts, 0) * 4 AS dns_queries FROM a FULL JOIN b ON a.chunk = b.chunk",
    "nearest_threshold": f"WITH {S} SELECT doc_id, round(score, 6) AS score FROM s ORDER BY abs(score - 0.5), doc_id LIMIT 20",
    "source_ranges": "SELECT CAST(o_orderkey % 2 AS INTEGER) AS label, o_orderstatus AS source, count(*) AS n, strftime(min(o_orderdate), '%Y-%m-%d') AS first_date, strftime(max(o_orderdate), '%Y-%m-%d') AS last_date FROM orders GROUP BY 1, 2",
    "spearman": "WITH r AS (" + "SELECT " + ", ".join(f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0 AS {c}" for c in ("l_quantity", "l_extendedprice", "l_discount")) + " FROM lineitem) "
    + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr(r.{a}, r.{b}), 5) AS rho FROM r" for a, b in (("l_quantity", "l_extendedprice"), ("l_quantity", "l_discount"), ("l_extendedprice", "l_discount"))),
    "project_prevalence": f"""WITH {S}, m AS (SELECT dataset AS name, coalesce(CAST(count(*) FILTER (label = 1 AND score >= 0.5) AS DOUBLE) / nullif(count(*) FILTER (label = 1), 0), 0) AS tpr, coalesce(CAST(count(*) FILTER (label = 0 AND score >= 0.5) AS DOUBLE) / nullif(count(*) FILTER (label = 0), 0), 0) AS fpr FROM s GROUP BY 1), v(prevalence) AS (VALUES (0.01::DOUBLE), (0.1::DOUBLE), (0.5::DOUBLE)),
  c AS (SELECT name, prevalence, prevalence * 1000000 * tpr AS tp, (1 - prevalence) * 1000000 * fpr AS fp FROM m, v) SELECT name, prevalence, round(tp, 3) AS tp, round(fp, 3) AS fp, round(tp + fp, 3) AS flagged, CASE WHEN tp + fp > 0 THEN round(tp / (tp + fp), 6) END AS precision FROM c""",
    "domain_ranks": f"WITH {P} SELECT host AS domain, min(page_id % 97 + 1) AS rank FROM q WHERE page_id % 97 + 1 <= 60 GROUP BY host",
    "first_seen": "SELECT user_id AS url, epoch_us(min(ts)) AS first_seen FROM events GROUP BY user_id",
    "capture_filter": f"WITH {P} SELECT page_id FROM q WHERE reg = 'example.com' AND page_id % 11 <> 0 AND page_id % 5 <> 0 AND page_id % 3 <> 0",
    "union_sources": "SELECT s_name AS name, '2026-01-01' AS date, CAST(NULL AS VARCHAR) AS segment FROM supplier UNION ALL SELECT c_name, '2026-01-01', c_mktsegment FROM customer",
    "json_lists": "SELECT 'com,example)/' AS surt, '20260101' AS time, 'http://example.com/' || CAST(event_id AS VARCHAR) AS url, '200' AS status, 'text/html' AS mime FROM events",
    "brand_typo": """WITH w(word, folded) AS (VALUES ('paypal', 'paypal'), ('paypa1', 'paypal'), ('paypall', 'paypall'), ('paypl', 'paypl'), ('g00gle', 'google'), ('google', 'google'), ('rnicrosoft', 'microsoft'), ('microsof', 'microsof'), ('amazom', 'amazom'), ('vvalmart', 'walmart'), ('netflix', 'netflix'), ('example', 'example'), ('appel', 'appel'), ('apple', 'apple'), ('applex', 'applex'), ('xapplex', 'xapplex')),
  b(brand) AS (VALUES ('paypal'), ('google'), ('microsoft'), ('amazon'), ('walmart'), ('netflix'), ('apple')) SELECT word, bool_or(levenshtein(word, brand) = 1) AND NOT bool_or(word = brand) AS typo, folded FROM w, b GROUP BY word, folded""",
    "path_norm_prefix": "SELECT * FROM (VALUES ('/a/./b/../c', '', '/a/c', ' / /a /a/ /a/c'), ('', 'x=1', '/?x=1', ' / /? /?x=1'), ('/A/%2e%2E/b', 'q=1&r=2', '/b?q=1&r=2', ' / /b /b? /b?q=1 /b?q=1& /b?q=1&r=2'), ('/a/b/', '', '/a/b/', ' / /a /a/ /a/b /a/b/'), ('/..', '', '/', ' /'), ('/x/y/.', 'k', '/x/y/?k', ' / /x /x/ /x/y /x/y/ /x/y/? /x/y/?k')) v(path, query, target, candidates)",
    "looks_like_url": "SELECT * FROM (VALUES ('https://example.com', true, true), ('example.com', true, false), ('a@example.com', false, false), ('1.2.3.4', true, false), ('example', false, false), ('a b.com', false, false), ('www.example.org', true, true), ('example.com/x', true, true), ('x..y', false, false), ('', false, false), ('ab.c1', false, false), ('foo.com?x=1', true, false), ('ftp://q', true, true)) v(cell, looks, strong) UNION ALL SELECT url, true, true FROM pages",
    "rdap_features": """SELECT reg, CAST(rdap_ok AS DOUBLE) AS rdap_ok, CAST(rdap_not_found AS DOUBLE) AS rdap_not_found, CAST(domain_age_days_log AS DOUBLE) AS domain_age_days_log, days_to_expiry_log, reg_period_years, days_since_changed_log, CAST(status_hold AS DOUBLE) AS status_hold, CAST(status_n AS DOUBLE) AS status_n FROM (VALUES ('a', 1.0, 0.0, round(log10(1 + 1827), 6), round(log10(1 + 365), 6), round(2192 / 365.25, 6), round(log10(1 + 213), 6), 1.0, 1.0), ('b', 0.0, 1.0, NULL, NULL, NULL, NULL, NULL, NULL), ('c', 1.0, 0.0, 0.0, NULL, NULL, NULL, 0.0, 0.0), ('d', 0.0, NULL, NULL, NULL, NULL, NULL, NULL, NULL))
  v(reg, rdap_ok, rdap_not_found, domain_age_days_log, days_to_expiry_log, reg_period_years, days_since_changed_log, status_hold, status_n)""",
    "registration_json": "SELECT '2020-01-01T00:00:00Z' AS created, 'Example Registrar' AS registrar, '9999' AS registrar_iana, 'active' AS status, 'ns1.example.com' AS ns",
    "lookup_missing": f"WITH {P}, h AS (SELECT DISTINCT host, CAST(('0x' || substr(md5('f|' || host), 1, 8)) AS BIGINT) % 100 AS h FROM q) SELECT host FROM h WHERE h < 20",
    "dns_features": f"""WITH {P}, h AS (SELECT DISTINCT host, CAST(('0x' || substr(md5('f|' || host), 1, 8)) AS BIGINT) % 100 AS h FROM q)
  SELECT host, 1.0::DOUBLE AS dns_ok, CAST(h >= 20 AS DOUBLE) AS dns_resolves, CAST(h < 20 AS DOUBLE) AS dns_nxdomain, CAST(h >= 20 AS DOUBLE) AS dns_n_a, CAST(h > 90 AS DOUBLE) AS dns_has_aaaa, 0.0::DOUBLE AS dns_has_cname, round(log10(301), 6) AS dns_ttl_a_log,
  CASE WHEN h >= 20 THEN 1.0::DOUBLE END AS dns_private_ip, CAST(h > 5 AS DOUBLE) AS dns_n_ns, CAST(h % 2 = 0 AS DOUBLE) AS dns_has_mx FROM h""",
}
