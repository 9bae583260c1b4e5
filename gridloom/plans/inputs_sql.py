"""The derived inputs once more, as common table expressions for the SQL check."""

from __future__ import annotations

import re

CTES: dict[str, str] = {}

CTES["li"] = """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag,
       CAST(l_quantity AS BIGINT) AS qty, CAST(l_extendedprice AS DECIMAL(18,2)) AS price,
       CAST(l_discount AS DECIMAL(4,2)) AS disc, CAST(l_tax AS DECIMAL(4,2)) AS tax
FROM lineitem"""

CTES["survey"] = """
SELECT lpad(CAST(l_orderkey AS VARCHAR), 12, '0') || '-' || CAST(l_linenumber AS VARCHAR) || '-' ||
       lpad(CAST(l_partkey AS VARCHAR), 12, '0') || '-' || lpad(CAST(l_suppkey AS VARCHAR), 12, '0') AS row_number,
       CASE WHEN tax = 0.08 AND disc = 0.10 AND qty < 5 THEN '  ' ELSE sn.n_name END AS source,
       dn.n_name AS destination,
       CASE l_returnflag WHEN 'A' THEN 'hydro' WHEN 'N' THEN 'thermal' END AS line_type,
       CASE WHEN sn.n_nationkey <> 13 AND disc > 0
            THEN CAST(sn.n_nationkey * 1.5 - 20 + CASE WHEN tax = 0.08 THEN 0.25 ELSE 0 END AS DECIMAL(9,4)) END AS src_lat,
       CASE WHEN sn.n_nationkey <> 13 THEN CAST(sn.n_nationkey * 3.0 - 40 AS DECIMAL(9,4)) END AS src_lon,
       CASE WHEN dn.n_nationkey <> 13 AND disc > 0.01 THEN CAST(dn.n_nationkey * 1.5 - 20 AS DECIMAL(9,4)) END AS dst_lat,
       CASE WHEN dn.n_nationkey <> 13 THEN CAST(dn.n_nationkey * 3.0 - 40 AS DECIMAL(9,4)) END AS dst_lon,
       CASE WHEN tax = 0 AND disc = 0.10 THEN NULL WHEN tax = 0 AND disc = 0 THEN CAST(0 AS DECIMAL(18,3))
            ELSE CAST(price AS DECIMAL(18,3)) END AS distance_km,
       qty * 10 AS voltage_kv,
       CASE WHEN disc <> 0.05 THEN CAST(price * 2 AS DECIMAL(18,3)) END AS capacity_mw,
       CAST(disc * 100 AS DECIMAL(9,3)) AS loss_percent,
       CASE WHEN tax <> 0.01 THEN CAST(price * disc AS DECIMAL(18,4)) END AS energy_loss_mw
FROM li
JOIN orders ON o_orderkey = l_orderkey
JOIN customer ON c_custkey = o_custkey
JOIN supplier ON s_suppkey = l_suppkey
JOIN nation sn ON sn.n_nationkey = s_nationkey
JOIN nation dn ON dn.n_nationkey = c_nationkey"""

CTES["lines_raw"] = """
SELECT row_number, ' ' || source || chr(9) AS source, destination || '  ' AS destination, line_type,
       CAST(src_lat AS VARCHAR) AS src_lat, CAST(src_lon AS VARCHAR) AS src_lon,
       CAST(dst_lat AS VARCHAR) AS dst_lat, CAST(dst_lon AS VARCHAR) AS dst_lon,
       CAST(voltage_kv AS VARCHAR) AS voltage_kv, CAST(capacity_mw AS VARCHAR) AS capacity_mw,
       CAST(energy_loss_mw AS VARCHAR) AS energy_loss_mw,
       CASE WHEN distance_km IS NULL THEN 'n/a' WHEN distance_km = 0 THEN ' -1e3 '
            ELSE CAST(distance_km AS VARCHAR) END AS distance_km,
       CASE WHEN loss_percent = 1 THEN 'nan' WHEN loss_percent = 2 THEN '2d'
            ELSE CAST(loss_percent AS VARCHAR) || ' ' END AS loss_percent
FROM survey"""

CTES["stations"] = """
SELECT name, min(CASE WHEN lat IS NOT NULL AND lon IS NOT NULL
                      THEN struct_pack(r := row_number, s := side, lat := lat, lon := lon) END) AS f,
       coalesce(list_sort(list(DISTINCT type) FILTER (type IS NOT NULL)), []) AS types
FROM readings GROUP BY name"""

CTES["readings"] = """
SELECT row_number, 0 AS side, source AS name, line_type AS type, src_lat AS lat, src_lon AS lon FROM survey_clean
UNION ALL
SELECT row_number, 1, destination, NULL, dst_lat, dst_lon FROM survey_clean"""

CTES["survey_clean"] = """
SELECT * REPLACE (CASE WHEN distance_km > 0 THEN distance_km END AS distance_km)
FROM survey WHERE trim(source) <> ''"""

CTES["net_pairs"] = """
SELECT least(source, destination) AS a, greatest(source, destination) AS b,
       CAST(sum(voltage_kv) // 10 AS BIGINT) AS qty, sum(energy_loss_mw) AS loss,
       max(loss_percent) AS loss_percent, max(voltage_kv) AS voltage_kv, max(capacity_mw) AS capacity_mw
FROM survey WHERE trim(source) <> '' AND source <> destination GROUP BY 1, 2"""

CTES["net"] = """
SELECT a, b, CAST(CAST((200000000 + qty) // (2 * qty) AS DECIMAL(18,0)) * 0.001 AS DECIMAL(18,3)) AS distance_km,
       voltage_kv, capacity_mw, loss_percent,
       CASE WHEN a <> 'NATION_3' AND b <> 'NATION_3' THEN CAST(loss AS DECIMAL(24,4)) END AS energy_loss_mw
FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY qty DESC, b) AS ra,
             row_number() OVER (PARTITION BY b ORDER BY qty DESC, a) AS rb FROM net_pairs)
WHERE ra <= 2 OR rb <= 2"""

CTES["net_adj"] = """
SELECT a AS src, b AS dst, distance_km AS km FROM net UNION ALL SELECT b, a, distance_km FROM net"""

CTES["grid_pairs"] = """
SELECT 'C' || o_custkey AS a, 'S' || l_suppkey AS b, CAST(sum(qty) AS BIGINT) AS qty, sum(CAST(price * disc AS DECIMAL(18,4))) AS loss
FROM li JOIN orders ON o_orderkey = l_orderkey GROUP BY 1, 2"""

CTES["grid"] = """
SELECT a, b, CAST(CAST((200000000 + qty) // (2 * qty) AS DECIMAL(18,0)) * 0.001 AS DECIMAL(18,3)) AS distance_km,
       CASE WHEN loss > 0 THEN CAST(loss AS DECIMAL(24,4)) END AS energy_loss_mw
FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY qty DESC, b) AS ra,
             row_number() OVER (PARTITION BY b ORDER BY qty DESC, a) AS rb FROM grid_pairs)
WHERE ra <= 2 OR rb <= 2"""

CTES["grid_stations"] = """
SELECT 'C' || c_custkey AS name FROM customer UNION ALL SELECT 'S' || s_suppkey FROM supplier"""

CTES["grid_adj"] = """
SELECT a AS src, b AS dst, distance_km AS km FROM grid UNION ALL SELECT b, a, distance_km FROM grid"""

CTES["net_walks"] = """
SELECT n_name AS origin, n_name AS node, CAST(0 AS DECIMAL(18,3)) AS km, 0 AS hops, [n_name] AS path FROM nation
UNION ALL
SELECT w.origin, a.dst, CAST(w.km + a.km AS DECIMAL(18,3)), w.hops + 1, list_append(w.path, a.dst)
FROM net_walks w JOIN net_adj a ON a.src = w.node WHERE w.hops < 6 AND NOT list_contains(w.path, a.dst)"""

CTES["net_closure"] = """
SELECT origin, node, km, hops, path FROM (
  SELECT *, row_number() OVER (PARTITION BY origin, node ORDER BY km, hops, path) AS rn FROM net_walks) WHERE rn = 1"""

CTES["grid_top"] = """
SELECT src, dst, km FROM (
  SELECT *, row_number() OVER (PARTITION BY src ORDER BY km, dst) AS rn FROM grid_adj) WHERE rn <= 6"""

CTES["grid_bound"] = """
SELECT origin, max(km) AS bound FROM (
  SELECT origin, km, row_number() OVER (PARTITION BY origin ORDER BY km) AS rn FROM (
    SELECT origin, node, min(km) AS km FROM (
      SELECT src AS origin, dst AS node, km FROM grid_top
      UNION ALL SELECT x.src, y.dst, x.km + y.km FROM grid_top x JOIN grid_top y ON y.src = x.dst
      UNION ALL SELECT x.src, z.dst, x.km + y.km + z.km FROM grid_top x
                JOIN grid_top y ON y.src = x.dst JOIN grid_top z ON z.src = y.dst
    ) WHERE origin <> node GROUP BY 1, 2)) WHERE rn <= 5 GROUP BY 1 HAVING count(*) = 5"""

CTES["grid_ball"] = """(origin, node, km) USING KEY (origin, node) AS (
  SELECT name, name, CAST(0 AS DECIMAL(18,3)) FROM grid_stations
  UNION
  SELECT b.origin, a.dst, CAST(min(b.km + a.km) AS DECIMAL(18,3))
  FROM grid_ball b JOIN grid_adj a ON a.src = b.node
  LEFT JOIN grid_bound g ON g.origin = b.origin
  LEFT JOIN recurring.grid_ball r ON r.origin = b.origin AND r.node = a.dst
  WHERE (g.bound IS NULL OR b.km + a.km <= g.bound) AND (r.km IS NULL OR b.km + a.km < r.km)
  GROUP BY b.origin, a.dst)"""

CTES["grid_near"] = """
SELECT origin AS start, node, km, CAST(rn - 1 AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY origin ORDER BY km, node) AS rn FROM grid_ball) WHERE rn <= 6"""

CTES["event_kinds"] = """
SELECT event_type, count(*) AS n, sum(CAST(value AS DECIMAL(18,2))) AS v FROM events GROUP BY 1"""

CTES["event_lines"] = """
SELECT l.event_type AS a, r.event_type AS b, CAST(l.n + r.n AS DECIMAL(18,3)) AS distance_km,
       CASE WHEN NOT (l.event_type = 'click' AND r.event_type = 'view')
            THEN CAST(l.v + r.v AS DECIMAL(18,4)) END AS energy_loss_mw
FROM event_kinds l JOIN event_kinds r ON l.event_type < r.event_type
WHERE NOT (l.event_type = 'error' AND r.event_type = 'signup')"""

CTES["feeders"] = """
SELECT a, b, CAST(qty AS DECIMAL(18,3)) AS distance_km
FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY qty DESC, b) AS ra,
             row_number() OVER (PARTITION BY b ORDER BY qty DESC, a) AS rb FROM grid_pairs)
WHERE qty >= 70 AND (ra = 1 OR rb = 1)"""

CTES["feeder_adj"] = """
SELECT a AS src, b AS dst, distance_km AS km FROM feeders UNION ALL SELECT b, a, distance_km FROM feeders"""

CTES["inst"] = """
SELECT start AS instance_id, node AS name, km, rank FROM grid_near
WHERE start IN (SELECT start FROM grid_near GROUP BY start HAVING count(*) = 6)"""

CTES["inst_bound"] = """
SELECT i.name AS origin, max(i.km + r.far) AS bound
FROM inst i JOIN (SELECT instance_id, max(km) AS far FROM inst GROUP BY 1) r ON r.instance_id = i.instance_id
GROUP BY 1"""

CTES["inst_ball"] = """(origin, node, km) USING KEY (origin, node) AS (
  SELECT origin, origin, CAST(0 AS DECIMAL(18,3)) FROM inst_bound
  UNION
  SELECT b.origin, a.dst, CAST(min(b.km + a.km) AS DECIMAL(18,3))
  FROM inst_ball b JOIN grid_adj a ON a.src = b.node
  JOIN inst_bound g ON g.origin = b.origin
  LEFT JOIN recurring.inst_ball r ON r.origin = b.origin AND r.node = a.dst
  WHERE b.km + a.km <= g.bound AND (r.km IS NULL OR b.km + a.km < r.km)
  GROUP BY b.origin, a.dst)"""

CTES["inst_costs"] = """
SELECT i.instance_id, i.name AS origin, j.name AS node, b.km
FROM inst i JOIN inst j ON j.instance_id = i.instance_id
LEFT JOIN inst_ball b ON b.origin = i.name AND b.node = j.name"""

CTES["inst_nn"] = """(instance_id, cur, stops, km) AS (
  SELECT instance_id, name, [name], CAST(0 AS DECIMAL(18,3)) FROM inst WHERE rank = 0
  UNION ALL
  SELECT instance_id, node, stops, km FROM (
    SELECT t.instance_id, c.node, list_append(t.stops, c.node) AS stops, CAST(t.km + c.km AS DECIMAL(18,3)) AS km,
           row_number() OVER (PARTITION BY t.instance_id ORDER BY c.km, c.node) AS rn
    FROM inst_nn t JOIN inst_costs c ON c.instance_id = t.instance_id AND c.origin = t.cur
    WHERE NOT list_contains(t.stops, c.node)) WHERE rn = 1)"""

CTES["inst_tours"] = """
SELECT t.instance_id, t.stops, CAST(t.km + c.km AS DECIMAL(18,3)) AS total_km
FROM inst_nn t JOIN inst_costs c ON c.instance_id = t.instance_id AND c.origin = t.cur AND c.node = t.instance_id
WHERE len(t.stops) = 6"""

CTES["inst_exact"] = """
SELECT instance_id, stops, total_km FROM (
  SELECT *, row_number() OVER (PARTITION BY instance_id ORDER BY total_km, stops) AS rn FROM (
    SELECT c1.instance_id, [c1.origin, c1.node, c2.node, c3.node, c4.node, c5.node] AS stops,
           CAST(c1.km + c2.km + c3.km + c4.km + c5.km + c6.km AS DECIMAL(18,3)) AS total_km
    FROM inst_costs c1
    JOIN inst_costs c2 ON c2.instance_id = c1.instance_id AND c2.origin = c1.node
    JOIN inst_costs c3 ON c3.instance_id = c1.instance_id AND c3.origin = c2.node
    JOIN inst_costs c4 ON c4.instance_id = c1.instance_id AND c4.origin = c3.node
    JOIN inst_costs c5 ON c5.instance_id = c1.instance_id AND c5.origin = c4.node
    JOIN inst_costs c6 ON c6.instance_id = c1.instance_id AND c6.origin = c5.node
    WHERE c1.origin = c1.instance_id AND c6.node = c1.instance_id
      AND len(list_distinct([c1.origin, c1.node, c2.node, c3.node, c4.node, c5.node])) = 6)) WHERE rn = 1"""

CTES["net_nn"] = """(start, cur, stops, km) AS (
  SELECT n_name, n_name, [n_name], CAST(0 AS DECIMAL(18,3)) FROM nation
  UNION ALL
  SELECT start, node, stops, km FROM (
    SELECT t.start, c.node, list_append(t.stops, c.node) AS stops, CAST(t.km + c.km AS DECIMAL(18,3)) AS km,
           row_number() OVER (PARTITION BY t.start ORDER BY c.km, c.node) AS rn
    FROM net_nn t JOIN net_closure c ON c.origin = t.cur
    WHERE NOT list_contains(t.stops, c.node)) WHERE rn = 1)"""

CTES["net_orders"] = """
SELECT t.start AS tour_id, t.start, t.stops, CAST(t.km + c.km AS DECIMAL(18,3)) AS total_km
FROM net_nn t JOIN net_closure c ON c.origin = t.cur AND c.node = t.start
WHERE len(t.stops) = (SELECT count(*) FROM nation)"""

CTES["net_legs"] = """
SELECT tour_id, CAST(i AS INTEGER) AS step, l.origin, l.destination, c.km, c.path, a.src IS NOT NULL AS is_direct
FROM (SELECT tour_id, unnest(range(1, len(stops) + 1)) AS i, unnest(stops) AS origin,
             unnest(list_append(stops[2:], stops[1])) AS destination FROM net_orders) l
LEFT JOIN net_closure c ON c.origin = l.origin AND c.node = l.destination
LEFT JOIN net_adj a ON a.src = l.origin AND a.dst = l.destination"""

CTES["walk_stops"] = """
SELECT user_id, event_id, event_type, prev_event_type, value,
       row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos, count(*) OVER (PARTITION BY user_id) AS n
FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev_event_type FROM events)
WHERE prev_event_type IS NULL OR prev_event_type <> event_type"""

CTES["walk_legs"] = """
SELECT CAST(user_id AS VARCHAR) AS route_id, pos - 1 AS step, prev_event_type AS origin, event_type AS destination,
       value >= 1 AS has_path, least(prev_event_type, event_type) AS a, greatest(prev_event_type, event_type) AS b,
       CASE WHEN 2 * (pos - 1) <= n - 1 THEN 'classical' ELSE 'hybrid' END AS label
FROM walk_stops WHERE prev_event_type IS NOT NULL"""

CTES["walk_counts"] = """
SELECT l.*, e.a IS NOT NULL AND l.has_path AS matched, e.distance_km, e.energy_loss_mw
FROM (SELECT route_id, has_path, a, b, count(*) AS traversals FROM walk_legs GROUP BY ALL) l
LEFT JOIN event_lines e ON e.a = l.a AND e.b = l.b"""

CTES["half_counts"] = """
SELECT l.*, e.a IS NOT NULL AND l.has_path AS matched, e.distance_km, e.energy_loss_mw
FROM (SELECT route_id AS user_id, label, has_path, a, b, count(*) AS traversals FROM walk_legs GROUP BY ALL) l
LEFT JOIN event_lines e ON e.a = l.a AND e.b = l.b"""

CTES["walk_loss"] = """
SELECT route_id, line_count, traversal_count, revisited_lines, total_energy_loss_mw, traversal_energy_loss_mw,
       lines_missing_loss, unmatched_steps, lines_missing_loss = 0 AND unmatched_steps = 0 AS complete,
       CAST(total_energy_loss_mw * 1000 AS DECIMAL(28,4)) AS energy_loss_kwh_per_hour,
       CAST(total_energy_loss_mw * 1000 * 6.60 AS DECIMAL(30,4)) AS loss_cost_per_hour_inr,
       CAST(CAST(total_energy_loss_mw * 1000 * 6.60 AS DECIMAL(30,4)) * 8760 AS DECIMAL(34,4)) AS loss_cost_per_year_inr,
       missing
FROM (SELECT route_id, count(*) FILTER (matched) AS line_count,
             CAST(coalesce(sum(traversals) FILTER (matched), 0) AS BIGINT) AS traversal_count,
             count(*) FILTER (matched AND traversals > 1) AS revisited_lines,
             CAST(coalesce(sum(energy_loss_mw) FILTER (matched), 0) AS DECIMAL(28,4)) AS total_energy_loss_mw,
             CAST(coalesce(sum(energy_loss_mw * traversals) FILTER (matched), 0) AS DECIMAL(28,4)) AS traversal_energy_loss_mw,
             count(*) FILTER (matched AND energy_loss_mw IS NULL) AS lines_missing_loss,
             CAST(coalesce(sum(traversals) FILTER (NOT matched), 0) AS BIGINT) AS unmatched_steps,
             coalesce(string_agg(a || ' - ' || b, ', ' ORDER BY a || ' - ' || b)
                      FILTER (matched AND energy_loss_mw IS NULL), '') AS missing
      FROM walk_counts GROUP BY route_id)"""

CTES["corpus"] = """
SELECT 'index' AS corpus_id, 'doc:' || lpad(CAST(doc_id AS VARCHAR), 12, '0') AS id,
       CASE WHEN source IN ('src0', 'src1', 'src2', 'src3') THEN 'dataset'
            WHEN source IN ('src4', 'src5', 'src6') THEN 'code' ELSE 'doc' END AS kind,
       lang || ' document' AS title, source AS locator, text
FROM documents"""

CTES["md_docs"] = r"""
SELECT doc_id, 'Docs/' || doc_id || '.md' AS file, lang,
       CASE WHEN lang = 'en' THEN 'Kept as written.' END AS standing,
       regexp_replace(regexp_replace(regexp_replace('# ' || source || chr(10) || chr(10) || text,
         '\n(A[a-z]* )', chr(10) || chr(10) || '## \1' || chr(10) || chr(10), 'g'),
         '\n(E[a-z]* )', chr(10) || chr(10) || '### \1' || chr(10) || chr(10), 'g'),
         '\n(I[a-z]* )', chr(10) || '```' || chr(10) || '# \1' || chr(10) || '```' || chr(10) || ' ' || chr(10), 'g') AS text
FROM documents"""

CTES["md_lines"] = r"""
SELECT doc_id, i, line, regexp_matches(ltrim(line), '^```') AS fence,
       (sum(CAST(regexp_matches(ltrim(line), '^```') AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY i)) % 2 = 1 AS inside
FROM (SELECT doc_id, unnest(range(0, len(l))) AS i, unnest(l) AS line
      FROM (SELECT doc_id, regexp_split_to_array(text, '\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]') AS l FROM md_docs))"""

CTES["md_marked"] = r"""
SELECT *, NOT fence AND NOT inside AND regexp_matches(line, '^#{1,6}\s+') AS head,
       length(regexp_extract(line, '^(#{1,6})\s+', 1)) AS level, trim(regexp_extract(line, '^#{1,6}\s+(.*)$', 1)) AS title
FROM md_lines"""

CTES["md_sections"] = r"""
SELECT s.doc_id, s.sec, s.body, coalesce(t.trail, '') AS trail
FROM (SELECT doc_id, sec, trim(string_agg(line, chr(10) ORDER BY i) FILTER (NOT head), chr(10) || ' ' || chr(9) || chr(13)) AS body
      FROM (SELECT *, sum(CAST(head AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY i) AS sec FROM md_marked) GROUP BY 1, 2) s
LEFT JOIN (
  SELECT h.doc_id, h.sec, string_agg(g.title, ' > ' ORDER BY g.i) AS trail
  FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS sec FROM md_marked WHERE head) h
  JOIN md_marked g ON g.doc_id = h.doc_id AND g.head AND g.i <= h.i
  WHERE NOT EXISTS (SELECT 1 FROM md_marked x WHERE x.doc_id = g.doc_id AND x.head AND x.i > g.i AND x.i <= h.i AND x.level <= g.level)
  GROUP BY 1, 2) t ON t.doc_id = s.doc_id AND t.sec = s.sec
WHERE s.body <> ''"""

CTES["md_merged"] = r"""
SELECT doc_id, acc.out || CASE WHEN acc.body <> '' THEN [{'trail': acc.trail, 'body': acc.body, 'whole': true}] ELSE [] END AS secs
FROM (SELECT doc_id, list_reduce(list({'t': trail, 'b': body} ORDER BY sec), lambda a, s:
        CASE WHEN length(CASE WHEN a.body <> '' THEN a.body || chr(10) || chr(10) || s.b ELSE s.b END) < 200
        THEN {'trail': CASE WHEN a.body <> '' AND a.trail <> '' THEN a.trail ELSE s.t END,
              'body': CASE WHEN a.body <> '' THEN a.body || chr(10) || chr(10) || s.b ELSE s.b END, 'out': a.out}
        ELSE {'trail': '', 'body': '', 'out': list_append(a.out, {
              'trail': CASE WHEN a.body <> '' AND a.trail <> '' THEN a.trail ELSE s.t END,
              'body': CASE WHEN a.body <> '' THEN a.body || chr(10) || chr(10) || s.b ELSE s.b END, 'whole': false})} END,
        {'trail': '', 'body': '', 'out': CAST([] AS STRUCT(trail VARCHAR, body VARCHAR, whole BOOLEAN)[])}) AS acc
      FROM md_sections GROUP BY doc_id)"""

CTES["md_pieces"] = r"""
SELECT doc_id, sec, trail, unnest(range(0, len(ps))) AS part, unnest(ps) AS piece FROM (
  SELECT doc_id, sec, s.trail AS trail, CASE WHEN s.whole THEN [s.body] ELSE acc.out || CASE WHEN acc.cur <> '' THEN [acc.cur] ELSE [] END END AS ps
  FROM (SELECT doc_id, sec, s, list_reduce(
          list_filter(regexp_split_to_array(s.body, '\n\s*\n'), lambda p: trim(p, chr(10) || ' ' || chr(9)) <> ''), lambda a, p:
          CASE WHEN a.cur = '' THEN {'cur': p, 'out': a.out}
               WHEN length(a.cur) + 2 + length(p) <= 1400 THEN {'cur': a.cur || chr(10) || chr(10) || p, 'out': a.out}
               ELSE {'cur': right(a.cur, 160) || chr(10) || chr(10) || p, 'out': list_append(a.out, a.cur)} END,
          {'cur': '', 'out': CAST([] AS VARCHAR[])}) AS acc
        FROM (SELECT doc_id, unnest(range(0, len(secs))) AS sec, unnest(secs) AS s FROM md_merged)))"""

CTES["md_chunks"] = r"""
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY sec, part) - 1 AS position, trail,
       trim(CASE WHEN trail <> '' THEN '[' || trail || ']' || chr(10) ELSE '' END || piece, chr(10) || ' ' || chr(9) || chr(13)) AS piece
FROM md_pieces"""

CTES["questions"] = """
SELECT 'b' || item_id AS qid, text AS question FROM benchmark
UNION ALL
SELECT 'o' || item_id, reverse(text) FROM benchmark
UNION ALL
SELECT 'c' || conv_id || '.' || turn, text FROM conversations WHERE role = 'user'"""

CTES["points"] = """
SELECT vec_id AS id, label, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y FROM embeddings"""


def _needed(text: str, found: list[str]) -> list[str]:
    for name, body in CTES.items():
        if name not in found and re.search(rf"\b{name}\b", text):
            _needed(re.sub(rf"\b{name}\b", "", body), found)
            if name not in found:
                found.append(name)
    return found


def with_inputs(sql: str) -> str:
    """Put the derived inputs `sql` mentions in front of it.

    A statement may bring its own expressions by starting with ``WITH`` or
    ``WITH RECURSIVE``; the inputs then come first in the same list.
    """
    text = sql.strip()
    names = _needed(text, [])
    own = re.match(r"WITH\s+(RECURSIVE\s+)?", text, re.IGNORECASE)
    parts = ",\n".join(f"{n}{CTES[n].strip()}" if CTES[n].startswith("(") else f"{n} AS ({CTES[n].strip()})" for n in names)
    if own:
        rest = text[own.end():]
        return f"WITH RECURSIVE {parts}{',' if parts else ''}\n{rest}"
    return f"WITH RECURSIVE {parts}\n{text}" if parts else text
