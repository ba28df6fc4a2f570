"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

OP9 = r"""
WITH d AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents
), g AS (
  SELECT norm, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY norm
)
SELECT d.doc_id, g.keep_id, CAST(g.group_size AS BIGINT) AS group_size, d.doc_id = g.keep_id AS kept, sha256(d.norm) AS text_sha256
FROM d JOIN g USING (norm)
"""

OP10 = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), lens AS (
  SELECT DISTINCT least(10, len(w)) AS n FROM b WHERE len(w) > 0
), bw AS (
  SELECT DISTINCT item, least(10, len(w)) AS n, array_to_string(w[s : s + least(10, len(w)) - 1], ' ') AS win
  FROM (SELECT item, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS s FROM b WHERE len(w) > 0)
), dw AS (
  SELECT doc_id, s, n, array_to_string(w[s : s + n - 1], ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, lens WHERE len(w) >= n)
), m AS (
  SELECT doc_id, s, dw.n, item FROM dw JOIN bw USING (n, win)
), hit AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM m) GROUP BY doc_id
), it AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM m) GROUP BY doc_id
), win AS (
  SELECT row_number() OVER () AS wid, win, n FROM (SELECT DISTINCT win, n FROM bw)
), tok AS (
  SELECT doc_id, unnest(w) AS term, unnest(range(0, len(w))) AS pos FROM d
), wt AS (
  SELECT wid, n, term, min(k) AS k, count(*) AS times FROM (SELECT wid, n, unnest(string_split(win, ' ')) AS term, unnest(range(0, n)) AS k FROM win) GROUP BY ALL
), cf AS (
  SELECT term, count(*) AS cf FROM tok WHERE term IN (SELECT term FROM wt) GROUP BY term
), ranked AS (
  SELECT wid, n, term, k, row_number() OVER (PARTITION BY wid ORDER BY cf, term, k) - 1 AS r, sum(times) OVER (PARTITION BY wid) AS there, least(4, count(*) OVER (PARTITION BY wid)) AS found FROM wt JOIN cf USING (term)
), roles AS (
  SELECT wid, term, k, r, CASE WHEN there = n THEN least(found, 2) END AS needed FROM ranked WHERE r < 4 AND ((n > 4 AND found >= 3) OR (there = n AND r < least(found, 2)))
), st AS (
  SELECT wid, doc_id, r, needed, pos - k AS start FROM tok JOIN roles USING (term) WHERE pos >= k AND (needed IS NULL OR needed > 1)
), near AS (
  SELECT doc_id, count(DISTINCT wid) AS n_near FROM (
    SELECT wid, doc_id FROM (SELECT DISTINCT wid, doc_id, start FROM st) a JOIN st b USING (wid, doc_id) WHERE b.start BETWEEN a.start - 3 AND a.start
    GROUP BY wid, doc_id, a.start HAVING count(DISTINCT r) >= 3 OR (bool_or(needed IS NOT NULL AND r = 0) AND bool_or(needed IS NOT NULL AND r = 1))
  ) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, CAST(coalesce(n_near, 0) AS BIGINT) AS n_near
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id) LEFT JOIN near USING (doc_id)
"""

OP2 = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), t AS (
  SELECT doc_id, w[p] AS w0, CASE WHEN p > 1 THEN w[p - 1] END AS w1, CASE WHEN p > 2 THEN w[p - 2] END AS w2 FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM d)
), one AS (SELECT w0, count(*) - 1 AS c FROM t GROUP BY w0),
two AS (SELECT w1, w0, count(*) - 1 AS c FROM t WHERE w1 IS NOT NULL GROUP BY w1, w0),
three AS (SELECT w2, w1, w0, count(*) - 1 AS c FROM t WHERE w2 IS NOT NULL GROUP BY w2, w1, w0),
n AS (SELECT greatest(count(*) - 1, 1) AS c FROM t),
s AS (
  SELECT t.doc_id, CASE
    WHEN three.c > 0 THEN log10(three.c) - log10(begin3.c)
    WHEN two.c > 0 THEN CASE WHEN t.w2 IS NULL THEN 0 ELSE log10(0.4) END + log10(two.c) - log10(begin2.c)
    ELSE CASE WHEN t.w1 IS NULL THEN 0 WHEN t.w2 IS NULL THEN log10(0.4) ELSE 2 * log10(0.4) END + CASE WHEN one.c > 0 THEN log10(one.c) ELSE log10(0.4) END - log10((SELECT c FROM n)) END AS v
  FROM t JOIN one ON one.w0 = t.w0 LEFT JOIN one begin2 ON begin2.w0 = t.w1 LEFT JOIN two ON two.w1 = t.w1 AND two.w0 = t.w0
  LEFT JOIN two begin3 ON begin3.w1 = t.w2 AND begin3.w0 = t.w1 LEFT JOIN three ON three.w2 = t.w2 AND three.w1 = t.w1 AND three.w0 = t.w0
), a AS (SELECT doc_id, sum(v) AS v FROM s GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_tokens, round(coalesce(a.v, 0), 4) AS log10_score,
  CASE WHEN len(d.w) > 0 THEN round(a.v / len(d.w), 6) END AS mean_log10
FROM d LEFT JOIN a USING (doc_id)
"""

#: Kinds of secrets with their patterns, in the order in which they are listed; groups of the first are the keyword with what follows it, and the value.
KINDS = {
    "assign": r"""(?:(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?)[A-Za-z0-9+/_.=-]+""",
    "access": "AKIA[A-Z0-9]+", "hex": "[0-9a-f]+", "private_key": "-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----", "web_token": r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+",
    "github": "gh[opsur]_[A-Za-z0-9]{36,}", "slack": "xox[abprs]-[A-Za-z0-9-]{10,}", "google": "AIza[A-Za-z0-9_-]{35}", "stripe": "[rs]k_(?:live|test)_[A-Za-z0-9]{16,}",
}
LEAST = {"assign": r"""length(regexp_extract(m, '^[A-Za-z_]+["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)$', 1)) >= 6""", "access": "length(m) >= 20", "hex": "length(m) >= 24"}


def _matches(order: int, kind: str, pattern: str) -> str:
    return f"""SELECT doc_id, {order} AS o, '{kind}' AS kind, e - length(m) AS a, e AS b FROM (
  SELECT doc_id, k, m, sum(length(gap) + length(m)) OVER (PARTITION BY doc_id ORDER BY k) AS e FROM (
    SELECT doc_id, unnest(found) AS m, unnest(gaps[1 : len(found)]) AS gap, unnest(range(len(found))) AS k FROM (SELECT doc_id, regexp_extract_all(t, '{pattern}') AS found, string_split_regex(t, '{pattern}') AS gaps FROM d)
  )) WHERE {LEAST.get(kind, 'true')}"""


OP8 = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), s AS (
{" UNION ALL ".join(_matches(i, k, p) for i, (k, p) in enumerate(KINDS.items()))}
), g AS (
  SELECT doc_id, count(*) FILTER (o = 0) AS n_assign, count(*) FILTER (o = 1) AS n_access, count(*) FILTER (o = 2) AS n_hex,
    string_agg(kind || ':' || CAST(a AS BIGINT) || ':' || CAST(b AS BIGINT), ',' ORDER BY a, o) FILTER (o < 3) AS base, string_agg(kind || ':' || CAST(a AS BIGINT) || ':' || CAST(b AS BIGINT), ',' ORDER BY a, o) AS spans
  FROM s GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g USING (doc_id)
"""

#: The page with the smallest page_id of those with equal payloads is the response. Base32 takes five hexadecimal digits to four letters.
OP3 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages), f AS (SELECT page_id, h, sha1(h) AS d, min(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, CAST(octet_length(encode(h)) AS BIGINT) AS payload_bytes, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || substr(d, CAST(i // 4 * 5 + 1 AS INTEGER), 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31 AS INTEGER) + 1, 1)), '') AS payload_digest
FROM f
"""

#: Every prefix is the list of its turns' digests; h is CRC-32 worked out bit by bit.
OP11 = r"""
WITH t AS (
  SELECT conv_id, sha256(CAST(octet_length(encode(coalesce(role, ''))) AS VARCHAR) || ':' || coalesce(role, '') || coalesce(text, '')) AS link, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words, turn
  FROM conversations WHERE conv_id IS NOT NULL
), r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, link) AS r FROM t),
b AS (SELECT DISTINCT conv_id, conv_id - conv_id % 20 AS base, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ord(x) AS BIGINT)) AS bytes FROM t),
c AS (
  SELECT conv_id, base, xor(list_reduce(list_prepend(4294967295, bytes), lambda x, y: list_reduce(list_prepend(xor(x, y), range(8)), lambda v, i: xor(v >> 1, (v & 1) * 3988292384))), 4294967295) % 4 AS h FROM b
), o AS (
  SELECT c.conv_id, r.r - h AS place, link, words FROM c JOIN r USING (conv_id) WHERE r.r > h
  UNION ALL SELECT c.conv_id, r.r - 100 AS place, link, words FROM c JOIN r ON r.conv_id = c.base WHERE r.r <= h
), l AS (SELECT c.conv_id, coalesce(list(link ORDER BY place) FILTER (link IS NOT NULL), []) AS links, list(words ORDER BY place) AS words FROM c LEFT JOIN o USING (conv_id) GROUP BY c.conv_id),
p AS (SELECT conv_id, d, links[1 : d] AS node, CASE WHEN d > 0 THEN words[d] ELSE 0 END AS words, d = len(links) AS ends FROM (SELECT *, unnest(range(len(links) + 1)) AS d FROM l)),
n AS (
  SELECT d, node, min(conv_id) AS conv_id, count(*) AS n_convs, max(words) AS words, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256 FROM p GROUP BY d, node
), k AS (SELECT d - 1 AS d, node[1 : d - 1] AS node, count(*) AS n FROM n WHERE d > 0 GROUP BY ALL),
v AS (SELECT n.*, coalesce(k.n, 0) AS n_children FROM n LEFT JOIN k USING (d, node)),
s AS (
  SELECT a AS d, node[1 : a] AS node, sum(CAST(n_children = 0 AS BIGINT)) AS n_leaves, sum((n_convs - 1) * words) AS saved FROM (SELECT *, unnest(range(d + 1)) AS a FROM v) GROUP BY ALL
)
SELECT v.conv_id, v.d AS depth, u.conv_id AS parent_conv_id, v.n_convs, v.n_children, CAST(s.n_leaves AS BIGINT) AS n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, v.ends_sha256
FROM v JOIN s USING (d, node) LEFT JOIN v u ON u.d = v.d - 1 AND u.node = v.node[1 : v.d - 1]
"""

#: Each order walks through the documents' flags, counted by part; nothing is looked up by set.
OP12 = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(source, '') AS part FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, min(doc_id) OVER (PARTITION BY t) AS first FROM d),
f AS (
  SELECT doc_id, part, {'A': len(w) < 50, 'B': 100 * len(list_distinct(w)) < 65 * len(w), 'C': 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t), 'D': regexp_matches(t, '[#$%&*|]'), 'E': coalesce(doc_id > first, false)} AS x FROM w
), lab AS (SELECT doc_id, max(CAST(quality = 1 AS INTEGER)) AS good, max(CAST(toxic = 1 AS INTEGER)) AS toxic FROM labels GROUP BY doc_id),
m AS (
  SELECT part, {'A': x.A, 'B': x.B, 'C': x.C, 'D': x.D, 'E': x.E} AS x, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic FROM f LEFT JOIN lab USING (doc_id) GROUP BY ALL
), one AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS k),
o AS (
  SELECT a.k || b.k || c.k || d.k || e.k AS o FROM one a, one b, one c, one d, one e WHERE len(list_distinct([a.k, b.k, c.k, d.k, e.k])) = 5
), st AS (SELECT o, unnest(range(1, 6)) AS step FROM o),
fails AS (
  SELECT part, n, good, toxic, o, step, o[step] AS f, list_reduce([true] || list_transform(range(1, step), lambda i: NOT CASE o[i] WHEN 'A' THEN x.A WHEN 'B' THEN x.B WHEN 'C' THEN x.C WHEN 'D' THEN x.D ELSE x.E END), lambda p, q: p AND q) AS here,
    CASE o[step] WHEN 'A' THEN x.A WHEN 'B' THEN x.B WHEN 'C' THEN x.C WHEN 'D' THEN x.D ELSE x.E END AS bad, CAST(x.A AS INTEGER) + CAST(x.B AS INTEGER) + CAST(x.C AS INTEGER) + CAST(x.D AS INTEGER) + CAST(x.E AS INTEGER) AS n_bad
  FROM m, st
), r AS (
  SELECT part, o, step, f, coalesce(sum(n) FILTER (here AND NOT bad), 0) AS kept, coalesce(sum(n) FILTER (here AND bad), 0) AS removed, coalesce(sum(n) FILTER (NOT here AND bad), 0) AS redundant,
    coalesce(sum(n) FILTER (bad AND n_bad = 1), 0) AS unique_fails, coalesce(sum(good) FILTER (here AND bad), 0) AS good_lost, coalesce(sum(toxic) FILTER (here AND bad), 0) AS toxic_lost FROM fails GROUP BY ALL
)
SELECT part, o AS filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley
FROM r
"""

ORACLE_SQL = {
    "op11_prefix_trie": OP11,
    "op12_filter_audit": OP12,
    "op3_warc": OP3,
    "op8_secrets": OP8,
    "op2_lm_score": OP2,
    "op10_decontaminate": OP10,
    "op9_exact_dedup": OP9,
}
