"""Queries on stored tables: the relational mirror and the checks on it."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.functions import money
from gridloom.operators import network as nw
from gridloom.operators import quality as ql
from gridloom.operators import stations as st
from gridloom.operators.chunking import document_chunks
from gridloom.plans.registry import query

OPTIONAL = ["distance_km", "voltage_kv", "capacity_mw", "loss_percent", "energy_loss_mw"]


def mirror(t):
    """Lines with surrogate keys for both ends."""
    customers = t.customer.select("c_custkey", F.col("c_nationkey").alias("destination_id"))
    suppliers = t.supplier.select("s_suppkey", F.col("s_nationkey").alias("source_id"))
    orders = t.orders.select("o_orderkey", "o_custkey").join(customers, F.col("o_custkey") == F.col("c_custkey"))
    return (
        t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
        .join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
        .select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "source_id", "destination_id"))


@query("lines_expanded", """
SELECT l_orderkey, l_linenumber, l_partkey, s.n_name AS source, d.n_name AS destination
FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_suppkey = l_suppkey
JOIN nation s ON s.n_nationkey = s_nationkey JOIN nation d ON d.n_nationkey = c_nationkey""")
def lines_expanded(t):
    """Keys back to names: the same dimension joined once per end."""
    def ends(id_, name):
        return t.nation.select(F.col("n_nationkey").alias(id_), F.col("n_name").alias(name))

    return mirror(t).join(ends("source_id", "source"), "source_id").join(
        ends("destination_id", "destination"), "destination_id").select(
        "l_orderkey", "l_linenumber", "l_partkey", "source", "destination")


@query("endpoint_key_resolution", """
SELECT row_number, s.n_nationkey AS source_id, d.n_nationkey AS destination_id
FROM survey l JOIN nation s ON s.n_name = l.source JOIN nation d ON d.n_name = l.destination""")
def endpoint_key_resolution(t):
    def ends(name, id_):
        return t.nation.select(F.col("n_name").alias(name), F.col("n_nationkey").alias(id_))

    return t.survey.select("row_number", "source", "destination").join(ends("source", "source_id"), "source").join(
        ends("destination", "destination_id"), "destination").select("row_number", "source_id", "destination_id")


@query("attribute_coverage", "\nUNION ALL ".join(
    f"SELECT '{c}' AS attribute, count({c}) AS present, count(*) AS total FROM survey" for c in OPTIONAL))
def attribute_coverage(t):
    return ql.attribute_coverage(t.survey, OPTIONAL)


@query("row_count_check", """
SELECT 'nation' AS table_name, (SELECT count(*) FROM nation) AS rows, CAST(25 AS BIGINT) AS expected, (SELECT count(*) FROM nation) = 25 AS as_expected
UNION ALL SELECT 'lineitem', (SELECT count(*) FROM lineitem), (SELECT 4 * count(*) FROM orders), (SELECT count(*) FROM lineitem) = (SELECT 4 * count(*) FROM orders)
UNION ALL SELECT 'supplier', (SELECT count(*) FROM supplier), (SELECT count(*) FROM customer), (SELECT count(*) FROM supplier) = (SELECT count(*) FROM customer)""")
def row_count_check(t):
    """Expected counts follow other tables, so they hold at every size; one of them does not hold."""
    return ql.row_counts({
        "nation": (t.nation, 25), "lineitem": (t.lineitem, 4 * t.orders.count()), "supplier": (t.supplier, t.customer.count())})


@query("duplicate_key_check", """
SELECT l_orderkey, l_linenumber, count(*) AS copies FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1""")
def duplicate_key_check(t):
    return ql.duplicate_keys(t.lineitem, "l_orderkey", "l_linenumber")


@query("unordered_unique", """
SELECT least(source, destination) AS a, greatest(source, destination) AS b, count(*) AS copies
FROM survey_clean GROUP BY 1, 2 HAVING count(*) > 1""")
def unordered_unique(t):
    return ql.duplicate_keys(t.survey_clean, *st.pair_key())


@query("check_union", """
SELECT 'duplicate names' AS check_name, (SELECT count(*) FROM (SELECT n_name FROM nation GROUP BY 1 HAVING count(*) > 1)) AS violations
UNION ALL SELECT 'duplicate pairs', (SELECT count(*) FROM (
  SELECT 1 FROM survey_clean GROUP BY least(source, destination), greatest(source, destination) HAVING count(*) > 1))
UNION ALL SELECT 'unknown endpoint', (SELECT count(*) FROM survey s WHERE s.source NOT IN (SELECT n_name FROM nation)
  OR s.destination NOT IN (SELECT n_name FROM nation))""")
def check_union(t):
    return ql.check_union({
        "duplicate names": ql.duplicate_keys(t.nation, "n_name"),
        "duplicate pairs": ql.duplicate_keys(t.survey_clean, *st.pair_key()),
        "unknown endpoint": nw.orphan_endpoints(
            t.survey.select("row_number", "source", "destination"), t.nation, "source", "destination", "n_name")})


VIOLATIONS = """
SELECT row_number, unnest(list_filter([
  CASE WHEN NOT source <> destination THEN 'no_self_loop' END, CASE WHEN NOT distance_km > 0 THEN 'distance_positive' END,
  CASE WHEN NOT voltage_kv > 0 THEN 'voltage_positive' END, CASE WHEN NOT capacity_mw >= 0 THEN 'capacity_not_negative' END,
  CASE WHEN NOT energy_loss_mw >= 0 THEN 'energy_loss_not_negative' END,
  CASE WHEN NOT loss_percent BETWEEN 0 AND 100 THEN 'loss_percent_range' END,
  CASE WHEN NOT src_lat BETWEEN -90 AND 90 THEN 'latitude_range' END,
  CASE WHEN NOT src_lon BETWEEN -180 AND 180 THEN 'longitude_range' END,
  CASE WHEN line_type IS NULL THEN 'line_type_not_null' END, CASE WHEN distance_km IS NULL THEN 'distance_km_not_null' END,
  CASE WHEN voltage_kv IS NULL THEN 'voltage_kv_not_null' END, CASE WHEN capacity_mw IS NULL THEN 'capacity_mw_not_null' END,
  CASE WHEN loss_percent IS NULL THEN 'loss_percent_not_null' END,
  CASE WHEN energy_loss_mw IS NULL THEN 'energy_loss_mw_not_null' END], lambda v: v IS NOT NULL)) AS violation
FROM survey"""


@query("check_constraints", VIOLATIONS)
def check_constraints(t):
    return ql.check_constraints(t.survey, "row_number")


@query("violation_list", f"SELECT string_agg(DISTINCT violation, ', ' ORDER BY violation) AS violations FROM ({VIOLATIONS})")
def violation_list(t):
    return ql.violation_list(ql.check_constraints(t.survey, "row_number"))


def stored(t):
    """The survey with stored costs; readings at 500 kV were priced at an older rate, some never."""
    priced = t.survey.select("row_number", "voltage_kv", "line_type", "energy_loss_mw").withColumns(
        money.loss_cost(F.col("energy_loss_mw")))
    hour = F.when(F.col("voltage_kv") == 500, F.col("loss_cost_per_hour_inr") + 1).otherwise(F.col("loss_cost_per_hour_inr"))
    year = F.when(F.col("line_type") == "hydro", F.col("loss_cost_per_year_inr"))
    return priced.withColumn("loss_cost_per_hour_inr", hour.cast("decimal(30,4)")).withColumn(
        "loss_cost_per_year_inr", F.when(F.col("voltage_kv") == 490, year).otherwise(F.col("loss_cost_per_year_inr")))


@query("stale_columns", """
WITH fresh AS (
  SELECT row_number, voltage_kv, line_type, CAST(energy_loss_mw * 6600 AS DECIMAL(30,4)) AS fresh_hour,
         CAST(CAST(energy_loss_mw * 6600 AS DECIMAL(30,4)) * 8760 AS DECIMAL(34,4)) AS fresh_year FROM survey),
stored AS (
  SELECT *, CAST(CASE WHEN voltage_kv = 500 THEN fresh_hour + 1 ELSE fresh_hour END AS DECIMAL(30,4)) AS stored_hour,
         CASE WHEN voltage_kv = 490 AND line_type IS DISTINCT FROM 'hydro' THEN NULL ELSE fresh_year END AS stored_year FROM fresh)
SELECT row_number, stored_hour, fresh_hour, stored_year, fresh_year FROM stored
WHERE stored_hour IS DISTINCT FROM fresh_hour OR stored_year IS DISTINCT FROM fresh_year""")
def stale_columns(t):
    return ql.stale_columns(stored(t), "row_number")


@query("index_determinism", "SELECT unnest(['only_first', 'only_second']) AS check_name, CAST(0 AS BIGINT) AS violations")
def index_determinism(t):
    """Two builds of the same chunks share every row."""
    def build():
        return document_chunks(t.md_docs, "lang", "PROJECT DOCUMENTATION").drop("metadata")

    return ql.index_determinism(build(), build().repartition("id"))


@query("dataset_status", """
SELECT true AS found, CAST(len(list_distinct(list(DISTINCT source) FILTER (used) || list(DISTINCT destination) FILTER (used))) AS BIGINT) AS stations,
       count(*) FILTER (used) AS rows, count(*) FILTER (used AND distance_km > 0) AS routable_lines,
       count(*) FILTER (NOT used OR distance_km IS NULL OR distance_km <= 0) AS unusable_rows
FROM (SELECT source, destination, distance_km, trim(source) <> '' AS used FROM survey)""")
def dataset_status(t):
    lines = t.survey_clean
    stations = st.station_union(lines).agg(F.count("*")).scalar()
    unusable = t.survey.where("trim(source) = '' OR distance_km IS NULL OR distance_km <= 0").agg(F.count("*")).scalar()
    return lines.agg(F.count("*").alias("rows"), F.count_if(F.col("distance_km") > 0).alias("routable_lines")).select(
        (F.col("rows") > 0).alias("found"), stations.alias("stations"), "rows", "routable_lines",
        unusable.alias("unusable_rows"))


@query("chunk_counts", """
SELECT kind, count(*) AS chunks, count(DISTINCT locator) AS files FROM corpus GROUP BY 1""")
def chunk_counts(t):
    from gridloom.sources.index import chunk_counts

    return chunk_counts(t.corpus, "locator")


@query("chunk_union", """
SELECT id, kind, title, locator FROM corpus
UNION ALL SELECT 'page:' || page_id, 'doc', 'web page', url FROM pages""")
def chunk_union(t):
    from gridloom.sources.index import chunk_union

    pages = t.pages.selectExpr("'index' AS corpus_id", "html AS text", "concat('page:', page_id) AS id", "'doc' AS kind",
                               "'web page' AS title", "url AS locator")
    return chunk_union(t.corpus, pages).select("id", "kind", "title", "locator")
