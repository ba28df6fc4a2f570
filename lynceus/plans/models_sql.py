"""The results of lynceus.plans.models in DuckDB SQL: the trees are grown from the rows, value by value, without bins."""

from __future__ import annotations

MEASURES = ["size", "lines", "digits", "capitals"]
#: Labelled documents with four whole numbers.
R = r"""r AS (SELECT doc_id, source AS grp, lang, CAST(quality AS INTEGER) AS y, CAST(least(n_chars // 250, 40) AS DOUBLE) AS size, CAST(least(length(regexp_replace(t, '[^\n]', '', 'g')), 20) AS DOUBLE) AS lines,
  CAST(least(length(regexp_replace(t, '[^0-9]', '', 'g')), 12) AS DOUBLE) AS digits, CAST(least(length(regexp_replace(t, '[^A-Z]', '', 'g')), 60) AS DOUBLE) AS capitals
  FROM (SELECT *, coalesce(text, '') AS t FROM documents) JOIN labels USING (doc_id))"""


def _of(f: str, names: list[str] = MEASURES) -> str:
    """The value of the feature with a number."""
    return f"CASE {f} " + " ".join(f"WHEN {i} THEN {n}" for i, n in enumerate(names)) + " END"


def _best(name: str, source: str, signs: dict[str, int]) -> str:
    """The split that gains most for each model k, over all nodes of source (k, node, lo, hi, g, h and the features)."""
    sign = f"CASE f {' '.join(f'WHEN {i} THEN {signs.get(n, 0)}' for i, n in enumerate(MEASURES))} END"
    return f"""{name}_x AS (SELECT k, node, lo, hi, g, h, unnest([0, 1, 2, 3]) AS f, unnest([{", ".join(MEASURES)}]) AS x FROM {source}),
{name}_v AS (SELECT k, node, lo, hi, f, x, sum(g) AS g, sum(h) AS h, count(*) AS n FROM {name}_x GROUP BY ALL),
{name}_c AS (SELECT k, node, lo, hi, f, x, sum(g) OVER w AS gl, sum(h) OVER w AS hl, sum(n) OVER w AS nl, sum(g) OVER a AS gt, sum(h) OVER a AS ht, sum(n) OVER a AS nt FROM {name}_v WINDOW w AS (PARTITION BY k, node, f ORDER BY x), a AS (PARTITION BY k, node, f)),
{name}_s AS (SELECT *, least(greatest(-gl / (hl + 1), lo), hi) AS vl, least(greatest(-(gt - gl) / (ht - hl + 1), lo), hi) AS vr, least(greatest(-gt / (ht + 1), lo), hi) AS vt FROM {name}_c WHERE nl >= 5 AND nt - nl >= 5),
{name}_g AS (SELECT *, -(2 * gl * vl + (hl + 1) * vl * vl) - (2 * (gt - gl) * vr + (ht - hl + 1) * vr * vr) + (2 * gt * vt + (ht + 1) * vt * vt) AS gain, {sign} AS sign FROM {name}_s),
{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY round(gain, 8) DESC, node, f, x) AS r FROM {name}_g WHERE (vr - vl) * sign >= 0 AND gain > 1e-9) WHERE r = 1)"""


def _tree(signs: dict[str, int] | None = None) -> str:
    """CTEs over learn (k, y, start, features): b1 and b2, the two splits of a tree of three leaves."""
    signs = signs or {}
    mid = "(vl + vr) / 2"
    return f"""l0 AS (SELECT *, 0 AS node, CAST('-infinity' AS DOUBLE) AS lo, CAST('infinity' AS DOUBLE) AS hi, 1 / (1 + exp(-start)) - y AS g, 1 / (1 + exp(-start)) * (1 - 1 / (1 + exp(-start))) AS h FROM learn),
{_best("b1", "l0", signs)},
l1 AS (SELECT l0.* EXCLUDE (node, lo, hi), CASE WHEN {_of("b1.f")} <= b1.x THEN 1 ELSE 2 END AS node,
  CASE WHEN ({_of("b1.f")} <= b1.x AND sign < 0) OR ({_of("b1.f")} > b1.x AND sign > 0) THEN {mid} ELSE l0.lo END AS lo, CASE WHEN ({_of("b1.f")} <= b1.x AND sign > 0) OR ({_of("b1.f")} > b1.x AND sign < 0) THEN {mid} ELSE l0.hi END AS hi FROM l0 JOIN b1 USING (k)),
{_best("b2", "l1", signs)}"""


#: What the tree adds to a row of a table that is joined with b1 and b2 by k.
VALUE = f"0.3 * coalesce(CASE WHEN b2.node = CASE WHEN {_of('b1.f')} <= b1.x THEN 1 ELSE 2 END THEN CASE WHEN {_of('b2.f')} <= b2.x THEN b2.vl ELSE b2.vr END WHEN {_of('b1.f')} <= b1.x THEN b1.vl ELSE b1.vr END, 0)"
ALL = "b AS (SELECT ln(sum(y) / (count(*) - sum(y))) AS base FROM r), learn AS (SELECT 0 AS k, r.*, base AS start FROM r, b)"


def _greedy(group: str, table: str, folds: int) -> str:
    """CTEs: f (the group's name, fold), every group of a table in the fold that was emptiest."""
    return f"""n AS (SELECT coalesce(CAST({group} AS VARCHAR), '') AS name, count(*) AS n FROM {table} GROUP BY 1), a AS (SELECT sum(n) AS a FROM n),
h AS (SELECT name, n, n * 1000 >= a AS heavy, CAST('0x' || substr(md5('fold|' || name), 1, 8) AS BIGINT) % 1000 AS bin FROM n, a),
i AS (SELECT CASE WHEN heavy THEN name END AS name, CASE WHEN NOT heavy THEN bin END AS bin, CAST(sum(n) AS BIGINT) AS n FROM h GROUP BY 1, 2),
o AS (SELECT *, row_number() OVER (ORDER BY n DESC, name IS NULL, coalesce(name, ''), coalesce(bin, 0)) AS place FROM i),
w AS (SELECT CAST(0 AS BIGINT) AS place, CAST([{", ".join(["0"] * folds)}] AS BIGINT[]) AS load, -1 AS fold
  UNION ALL SELECT o.place, list_transform(load, lambda v, j: CASE WHEN j = list_position(load, list_min(load)) THEN v + o.n ELSE v END), CAST(list_position(load, list_min(load)) - 1 AS INTEGER) FROM w JOIN o ON o.place = w.place + 1),
f AS (SELECT h.name, w.fold FROM h JOIN o ON CASE WHEN h.heavy THEN o.name = h.name ELSE o.bin = h.bin END JOIN w USING (place))"""


ORACLE_SQL = {
    "leafwise_trees": f"WITH {R}, {ALL}, {_tree()} SELECT doc_id, round(start + {VALUE}, 6) AS raw FROM learn LEFT JOIN b1 USING (k) LEFT JOIN b2 USING (k)",
    "leafwise_importance": f"WITH {R}, {ALL}, {_tree()}, s AS (SELECT f, gain FROM b1 UNION ALL SELECT f, gain FROM b2) SELECT m.name AS feature, count(s.f) AS splits, round(coalesce(sum(gain), 0), 6) AS gain FROM (SELECT unnest([0, 1, 2, 3]) AS f, unnest({MEASURES}) AS name) m LEFT JOIN s USING (f) GROUP BY m.name",
    "monotone_residual": f"WITH {R}, learn AS (SELECT 0 AS k, *, CAST(doc_id % 7 AS DOUBLE) / 7 - 0.5 AS start FROM r), {_tree({'digits': 1, 'size': -1})} SELECT doc_id, round(start + {VALUE}, 6) AS raw FROM learn LEFT JOIN b1 USING (k) LEFT JOIN b2 USING (k)",
    "monotone_order": f"WITH {R}, d AS (SELECT DISTINCT lines, digits, capitals, size FROM r WHERE lang IS NOT NULL) SELECT digits, count(*) AS pairs, CAST(0 AS BIGINT) AS wrong FROM d JOIN d e USING (lines, digits, capitals) WHERE d.size < e.size GROUP BY digits",
    "balanced_folds": f"WITH RECURSIVE {_greedy('o_custkey', 'orders', 5)} SELECT fold, count(*) AS n, count(DISTINCT o_custkey) AS groups, min(o_custkey) AS least FROM orders JOIN f ON f.name = CAST(o_custkey AS VARCHAR) GROUP BY fold",
    "cross_fitted_scores": f"""WITH RECURSIVE {R}, {_greedy("grp", "r", 3)}, q AS (SELECT r.*, fold FROM r JOIN f ON f.name = coalesce(grp, '')), b AS (SELECT k.k, ln(sum(y) / (count(*) - sum(y))) AS base FROM q JOIN (SELECT unnest([0, 1, 2]) AS k) k ON fold <> k.k GROUP BY k.k),
learn AS (SELECT b.k, q.*, base AS start FROM q JOIN b ON fold <> b.k), {_tree()} SELECT doc_id, 'part ' || (doc_id % 3) AS dataset, CAST(fold AS INTEGER) AS fold, round(base + {VALUE}, 6) AS raw FROM q JOIN b ON b.k = q.fold LEFT JOIN b1 ON b1.k = b.k LEFT JOIN b2 ON b2.k = b.k""",
    "stacked_scores": f"""WITH RECURSIVE {R}, z AS (SELECT doc_id, y, CAST(doc_id % 2 AS INTEGER) AS fold, ln(p / (1 - p)) AS z1, ln(q / (1 - q)) AS z2 FROM (SELECT *, size / 50 + 0.05 AS p, digits / 15 + 0.1 AS q FROM r)),
w AS (
  SELECT k, 0 AS it, CAST(0 AS DOUBLE) AS a, CAST(0 AS DOUBLE) AS b, CAST(0 AS DOUBLE) AS c FROM (SELECT DISTINCT fold AS k FROM z)
  UNION ALL SELECT k, it + 1, a - (a11 * g1 + a12 * g2 + a13 * g3) / det, b - (a12 * g1 + a22 * g2 + a23 * g3) / det, c - (a13 * g1 + a23 * g2 + a33 * g3) / det FROM (
    SELECT *, s * u - t * t AS a11, t * r - q * u AS a12, q * t - s * r AS a13, p * u - r * r AS a22, q * r - p * t AS a23, p * s - q * q AS a33, p * (s * u - t * t) - q * (q * u - t * r) + r * (q * t - s * r) AS det FROM (
      SELECT k, it, a, b, c, sum((e - y) * z1) + a AS g1, sum((e - y) * z2) + b AS g2, sum(e - y) + 1e-9 * c AS g3, sum(e * (1 - e) * z1 * z1) + 1 AS p, sum(e * (1 - e) * z1 * z2) AS q, sum(e * (1 - e) * z1) AS r, sum(e * (1 - e) * z2 * z2) + 1 AS s, sum(e * (1 - e) * z2) AS t, sum(e * (1 - e)) + 1e-9 AS u
      FROM (SELECT k, it, a, b, c, y, z1, z2, 1 / (1 + exp(-(a * z1 + b * z2 + c))) AS e FROM w JOIN z ON z.fold <> w.k WHERE it < 12) GROUP BY k, it, a, b, c)))
SELECT doc_id, round(a * z1 + b * z2 + c, 5) AS stack FROM z JOIN w ON w.k = z.fold AND w.it = 12""",
}
