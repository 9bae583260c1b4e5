"""Queries on networks: lines, neighbours, groups, paths."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.operators import components as cc
from gridloom.operators import network as nw
from gridloom.operators import paths as sp
from gridloom.operators import tours as tr
from gridloom.operators import stations as st
from gridloom.plans.registry import query
from gridloom.session import cut


@query("parallel_line_dedupe", """
SELECT a, b, distance_km, row_number, line_type, energy_loss_mw FROM (
  SELECT least(source, destination) AS a, greatest(source, destination) AS b, distance_km, row_number, line_type,
         energy_loss_mw, row_number() OVER (PARTITION BY least(source, destination), greatest(source, destination)
                                            ORDER BY distance_km, row_number) AS rn
  FROM survey_clean WHERE distance_km > 0 AND source <> destination) WHERE rn = 1""")
def parallel_line_dedupe(t):
    lines = t.survey_clean.select("row_number", "source", "destination", "distance_km", "line_type", "energy_loss_mw")
    return nw.parallel_line_dedupe(lines)


@query("adjacency", "SELECT * FROM grid_adj")
def adjacency(t):
    return nw.adjacency(t.grid)


@query("edge_lookup", """
SELECT s.row_number, s.source, s.destination, n.distance_km FROM survey_clean s
LEFT JOIN net n ON n.a = least(s.source, s.destination) AND n.b = greatest(s.source, s.destination)""")
def edge_lookup(t):
    pairs = t.survey_clean.select("row_number", "source", "destination")
    return nw.edge_lookup(pairs, t.net.select("a", "b", "distance_km"), "source", "destination")


@query("isolated_stations", """
SELECT name FROM grid_stations WHERE name NOT IN (SELECT src FROM feeder_adj)""")
def isolated_stations(t):
    return nw.isolated_stations(t.grid_stations, t.feeders)


@query("station_degree", """
SELECT name, count(src) AS degree FROM grid_stations LEFT JOIN grid_adj ON src = name GROUP BY name""")
def station_degree(t):
    return nw.station_degree(t.grid_stations, t.grid)


@query("busiest_station", """
SELECT src AS name, count(*) AS degree FROM grid_adj GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1""")
def busiest_station(t):
    return nw.busiest_station(t.grid_stations, t.grid)


@query("orphan_endpoints", """
SELECT source, destination FROM (SELECT DISTINCT source, destination FROM survey) s
WHERE NOT EXISTS (SELECT 1 FROM nation WHERE n_name = s.source)
   OR NOT EXISTS (SELECT 1 FROM nation WHERE n_name = s.destination)""")
def orphan_endpoints(t):
    return nw.orphan_endpoints(
        t.survey.select("source", "destination").distinct(), t.nation, "source", "destination", "n_name")


@query("neighbour_centroid", """
SELECT s.name,
       CASE WHEN f IS NOT NULL THEN CAST(f.lat AS DOUBLE) ELSE m.lat END AS latitude,
       CASE WHEN f IS NOT NULL THEN CAST(f.lon AS DOUBLE) ELSE m.lon END AS longitude,
       f IS NULL AND m.lat IS NOT NULL AS imputed
FROM stations s LEFT JOIN (
  SELECT src, avg(CAST(k.f.lat AS DOUBLE)) AS lat, avg(CAST(k.f.lon AS DOUBLE)) AS lon
  FROM net_adj JOIN stations k ON k.name = dst WHERE k.f IS NOT NULL GROUP BY src) m ON m.src = s.name""")
def neighbour_centroid(t):
    return nw.neighbour_centroid(st.station_dimension(t.survey_clean), t.net)


COMPONENTS = """
cc(node, label) USING KEY (node) AS (
  SELECT name, name FROM grid_stations
  UNION
  SELECT a.dst, min(c.label) FROM cc c JOIN feeder_adj a ON a.src = c.node JOIN recurring.cc r ON r.node = a.dst
  WHERE c.label < r.label GROUP BY a.dst),
sizes AS (SELECT label, count(*) AS size FROM cc GROUP BY 1),
ranked AS (SELECT label, size, row_number() OVER (ORDER BY size DESC, label) AS rank FROM sizes)"""


@query("connected_components", f"WITH RECURSIVE {COMPONENTS} SELECT node AS name, label AS component FROM cc")
def connected_components(t):
    return cc.connected_components(t.grid_stations, t.feeders)


@query("component_rank", f"WITH RECURSIVE {COMPONENTS} SELECT label AS component, size, rank FROM ranked")
def component_rank(t):
    return cc.component_rank(cc.connected_components(t.grid_stations, t.feeders))


@query("component_filter", f"""WITH RECURSIVE {COMPONENTS}
SELECT node AS name, size, rank FROM cc JOIN ranked ON ranked.label = cc.label WHERE rank = 1""")
def component_filter(t):
    return cc.component_members(cc.connected_components(t.grid_stations, t.feeders), 1)


@query("connectivity_gate", f"""WITH RECURSIVE {COMPONENTS}
SELECT rank, r.size, array_to_string(list_sort(list(node))[1:6], ', ') || CASE WHEN r.size > 6 THEN ' ...' ELSE '' END AS preview
FROM cc JOIN ranked r ON r.label = cc.label GROUP BY rank, r.size""")
def connectivity_gate(t):
    return cc.connectivity_report(cc.connected_components(t.grid_stations, t.feeders))


@query("network_summary", f"""WITH RECURSIVE {COMPONENTS}
SELECT (SELECT count(*) FROM grid_stations) AS stations, (SELECT count(*) FROM lineitem) AS rows_read,
       (SELECT count(*) FROM ranked) AS components,
       (SELECT count(*) FROM grid_stations WHERE name NOT IN (SELECT src FROM feeder_adj)) AS isolated,
       count(*) AS routable_lines, min(distance_km) AS shortest_line_km, max(distance_km) AS longest_line_km,
       CAST(sum(distance_km) AS DECIMAL(28,3)) AS total_line_km
FROM feeders""")
def network_summary(t):
    lines = cut(t.feeders)
    groups = cc.connected_components(t.grid_stations, lines)

    def one(df):
        return df.agg(F.count("*").alias("n")).scalar()

    return nw.line_extent(lines).select(
        one(t.grid_stations).alias("stations"), one(t.lineitem).alias("rows_read"),
        one(groups.select("component").distinct()).alias("components"),
        one(nw.isolated_stations(t.grid_stations, lines)).alias("isolated"), "*")


@query("shortest_paths", """
SELECT origin, node, km, hops, array_to_string(path, '>') AS path FROM net_closure""")
def shortest_paths(t):
    return t.net_closure.withColumn("path", F.array_join("path", ">"))


@query("closure_step", """
SELECT origin, dst AS node, CAST(c.km + a.km AS DECIMAL(18,3)) AS km, CAST(c.hops + 1 AS INTEGER) AS hops,
       array_to_string(list_append(c.path, dst), '>') AS path
FROM net_closure c JOIN net_adj a ON a.src = c.node""")
def closure_step(t):
    """One relaxation from every known way."""
    return sp.closure_step(t.net_closure, nw.adjacency(t.net_cut)).withColumn("path", F.array_join("path", ">"))


@query("direct_line_flag", """
SELECT c.origin, c.node AS destination, a.src IS NOT NULL AS is_direct
FROM net_closure c LEFT JOIN net_adj a ON a.src = c.origin AND a.dst = c.node""")
def direct_line_flag(t):
    return sp.direct_line_flag(t.net_closure.select("origin", F.col("node").alias("destination")), t.net_cut)


@query("nearest_stations", """
SELECT start AS origin, node, km, rank FROM grid_near""")
def nearest_stations(t):
    """The five stations nearest to every customer and supplier."""
    return sp.nearest_stations(t.grid_cut, t.grid_stations.select(F.col("name").alias("origin")), 5).select(
        "origin", "node", "km", "rank")


@query("reachability_check", f"""WITH RECURSIVE {COMPONENTS}
SELECT node AS start, cc.label AS component, size AS reachable, (SELECT count(*) FROM grid_stations) - size AS unreachable,
       CASE WHEN size < (SELECT count(*) FROM grid_stations) THEN 'some stations cannot be reached' ELSE 'ok' END AS status
FROM cc JOIN sizes ON sizes.label = cc.label""")
def reachability_check(t):
    """Every station as a start: how many it reaches and how many it cannot."""
    return sp.reachability_by_component(cc.connected_components(t.grid_stations, t.feeders))


@query("unreachable_pairs", """
SELECT instance_id, count(*) AS pairs, count(*) FILTER (km IS NULL) AS unreachable FROM inst_costs GROUP BY 1""")
def unreachable_pairs(t):
    """Pairs of each instance that no chain of lines joins."""
    return tr.unreachable_pairs(t.instance_costs)
