"""Queries on cleaning, stations and the findings of a load."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.functions import money, text
from gridloom.operators import stations as st
from gridloom.plans.registry import query
from gridloom.session import kept


@query("clean_name", """
SELECT row_number, trim(source, ' ' || chr(9)) AS source_len0,
       nullif(trim(source, ' ' || chr(9)), '') AS source, nullif(trim(destination), '') AS destination
FROM lines_raw""")
def clean_name(t):
    return t.lines_raw.select(
        "row_number", text.strip(F.col("source")).alias("source_len0"),
        text.clean_name(F.col("source")).alias("source"), text.clean_name(F.col("destination")).alias("destination"))


@query("safe_float", """
SELECT row_number, CASE WHEN distance_km <> 'n/a' THEN CAST(trim(distance_km) AS DOUBLE) END AS distance_km,
       CASE WHEN loss_percent NOT IN ('nan', '2d') THEN CAST(trim(loss_percent) AS DOUBLE) END AS loss_percent,
       CAST(src_lat AS DOUBLE) AS src_lat
FROM lines_raw""")
def safe_float(t):
    return t.lines_raw.select("row_number", *[
        text.safe_float(F.col(c)).alias(c) for c in ("distance_km", "loss_percent", "src_lat")])


@query("distance_nullify", """
SELECT row_number, CASE WHEN distance_km > 0 THEN distance_km END AS distance_km FROM survey""")
def distance_nullify(t):
    return st.nullify_distance(t.survey.select("row_number", "distance_km"))


@query("drop_blank_endpoints", "SELECT row_number, source, destination FROM survey WHERE trim(source) <> ''")
def drop_blank_endpoints(t):
    return st.drop_blank_endpoints(t.survey.select("row_number", "source", "destination"))


@query("routable_filter", "SELECT row_number, distance_km FROM survey_clean WHERE distance_km > 0")
def routable_filter(t):
    return st.routable(t.survey_clean.select("row_number", "distance_km"))


@query("self_loop_filter", "SELECT row_number, source, destination FROM survey_clean WHERE source <> destination")
def self_loop_filter(t):
    return st.without_self_loops(t.survey_clean.select("row_number", "source", "destination"))


@query("station_union", "SELECT source AS name FROM survey_clean UNION SELECT destination FROM survey_clean")
def station_union(t):
    return st.station_union(t.survey_clean)


@query("station_dimension", """
SELECT name, f.lat AS latitude, f.lon AS longitude, array_to_string(types, '/') AS types FROM stations""")
def station_dimension(t):
    return st.station_dimension(t.survey_clean).withColumn("types", F.array_join("types", "/"))


@query("station_flags", """
SELECT name, f.lat IS NOT NULL AND f.lon IS NOT NULL AS has_coordinates,
       CASE WHEN len(types) = 0 THEN 'unknown' ELSE array_to_string(types, '/') END AS type_label
FROM stations""")
def station_flags(t):
    return st.station_dimension(t.survey_clean).select(
        "name", st.has_coordinates().alias("has_coordinates"), text.type_label(F.col("types")).alias("type_label"))


@query("coordinate_conflicts", """
SELECT r.row_number, r.side, r.name, r.lat, r.lon, f.lat AS latitude, f.lon AS longitude
FROM readings r JOIN stations s ON s.name = r.name
WHERE r.lat IS NOT NULL AND r.lon IS NOT NULL AND (abs(r.lat - f.lat) > 0.0001 OR abs(r.lon - f.lon) > 0.0001)""")
def coordinate_conflicts(t):
    lines = t.survey_clean
    return st.coordinate_conflicts(lines, st.station_dimension(lines))


DUPLICATES = """
SELECT row_number, least(source, destination) AS a, greatest(source, destination) AS b,
       min(row_number) OVER (PARTITION BY least(source, destination), greatest(source, destination)) AS first_row
FROM survey_clean WHERE source <> destination"""


@query("duplicate_pairs", f"SELECT * FROM ({DUPLICATES}) WHERE row_number > first_row")
def duplicate_pairs(t):
    return st.duplicate_pairs(t.survey_clean)


@query("load_warnings", f"""
SELECT row_number AS row, 'blank_endpoint' AS code, 'row skipped' AS detail FROM survey WHERE trim(source) = ''
UNION ALL SELECT row_number, 'self_loop', source FROM survey WHERE trim(source) <> '' AND source = destination
UNION ALL SELECT row_number, 'missing_distance', source || ' -> ' || destination
          FROM survey WHERE trim(source) <> '' AND distance_km IS NULL
UNION ALL SELECT row_number, 'non_positive_distance', source || ' -> ' || destination
          FROM survey WHERE trim(source) <> '' AND distance_km <= 0
UNION ALL SELECT r.row_number, 'coordinate_conflict', r.name FROM readings r JOIN stations s ON s.name = r.name
          WHERE r.lat IS NOT NULL AND r.lon IS NOT NULL
            AND (abs(r.lat - f.lat) > 0.0001 OR abs(r.lon - f.lon) > 0.0001)
UNION ALL SELECT row_number, 'duplicate_pair', a || ' <-> ' || b FROM ({DUPLICATES}) WHERE row_number > first_row
UNION ALL SELECT NULL, 'no_coordinates', name FROM stations WHERE f IS NULL""")
def load_warnings(t):
    return st.load_warnings(kept(t.survey.select(
        "row_number", "source", "destination", "line_type", "src_lat", "src_lon", "dst_lat", "dst_lon", "distance_km"), "survey"))


@query("loss_cost", """
SELECT row_number, energy_loss_mw, CAST(energy_loss_mw * 1000 * 6.60 AS DECIMAL(30,4)) AS loss_cost_per_hour_inr,
       CAST(CAST(energy_loss_mw * 1000 * 6.60 AS DECIMAL(30,4)) * 8760 AS DECIMAL(34,4)) AS loss_cost_per_year_inr
FROM survey""")
def loss_cost(t):
    return t.survey.select("row_number", "energy_loss_mw").withColumns(money.loss_cost(F.col("energy_loss_mw")))


@query("sort_nulls_last", """
SELECT row_number, energy_loss_mw, row_number() OVER (ORDER BY energy_loss_mw DESC NULLS LAST, row_number) AS place
FROM survey_clean""")
def sort_nulls_last(t):
    """The whole lines table, most loss first, missing readings at the end."""
    from gridloom.operators.ranking import sorted_whole
    return sorted_whole(t.survey_clean.select("row_number", "energy_loss_mw"), "energy_loss_mw", "row_number", descending=True)
