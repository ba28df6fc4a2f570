"""The results of lynceus.plans.live in DuckDB SQL."""

from __future__ import annotations

from lynceus.plans.inventory_sql import ORACLE_SQL as INVENTORY_SQL

ORACLE_SQL = {
    "stream_ttl_state": """WITH RECURSIVE e AS (SELECT event_id, user_id, epoch(ts) AS t FROM events), a AS (
  SELECT user_id, min(t) AS t FROM e GROUP BY user_id UNION ALL SELECT a.user_id, (SELECT min(e.t) FROM e WHERE e.user_id = a.user_id AND e.t > a.t + 432000) FROM a WHERE a.t IS NOT NULL
), r AS (SELECT e.event_id, e.user_id, e.t, max(a.t) AS asked FROM e JOIN a ON a.user_id = e.user_id AND a.t <= e.t GROUP BY ALL)
SELECT event_id, user_id, (user_id * 7 + CAST(floor(asked) AS BIGINT)) % 1000003 AS fact, CAST(floor(asked) AS BIGINT) AS asked, t > asked AS reused FROM r""",
    "stream_progress": "SELECT count(*) AS rows_read, CAST(0 AS BIGINT) AS late, count(*) AS counted FROM events",
    "stream_sessions": """WITH g AS (SELECT user_id, ts, CASE WHEN ts <= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL '6 hours 7 seconds' THEN 0 ELSE 1 END AS first FROM events),
s AS (SELECT user_id, ts, sum(first) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g)
SELECT user_id, CAST(floor(epoch(min(ts))) AS BIGINT) AS start, CAST(floor(epoch(max(ts))) AS BIGINT) AS stop, count(*) AS n FROM s GROUP BY user_id, s""",
    "capture_blocks": r"""WITH p AS (SELECT regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS surt, CASE WHEN page_id % 4 = 0 THEN '404' ELSE '200' END AS status, url FROM pages)
SELECT surt, status, count(*) AS n, count(DISTINCT url) AS urls FROM p GROUP BY ALL""",
    "day_pull_stream": "SELECT user_id, min(event_id) AS event_id, strftime(arg_min(ts, event_id), '%Y-%m-%d') AS day FROM events GROUP BY user_id",
    "capture_index": r"""WITH h AS (SELECT DISTINCT regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS domain FROM pages)
SELECT domain, CASE length(domain) % 5 WHEN 0 THEN 'no_captures' WHEN 1 THEN 'failed' ELSE 'ok' END AS status, CAST(CASE WHEN length(domain) % 5 > 1 THEN length(domain) % 5 ELSE 0 END AS BIGINT) AS n FROM h""",
    "lookups_kept": f"SELECT host, a_status FROM ({INVENTORY_SQL['dns_client']})",
    "cache_log": """WITH m AS (SELECT CAST(user_id AS VARCHAR) AS k, event_id % 4 AS part, max(event_id) AS event_id FROM events WHERE event_id % 4 < 3 GROUP BY ALL)
SELECT k, CAST(max(part) + 1 AS DOUBLE) AS t, arg_max(event_id, part) AS event_id FROM m GROUP BY k""",
}
