"""Queries on records, run payloads, files and stored tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.functions import money
from gridloom.operators import compare as cp
from gridloom.operators import pricing as pr
from gridloom.operators import records as rc
from gridloom.operators import stations as st
from gridloom.operators import tours as tr
from gridloom.operators.network import line_extent
from gridloom.operators.ranking import legs_limit as first_legs
from gridloom.plans.registry import query
from gridloom.session import kept, scratch_path
from gridloom.sources import files, index, payload, sinks


@query("legs_limit", """
SELECT route_id, count(*) AS legs, greatest(count(*) - 30, 0) AS further,
       array_to_string(list(step || ': ' || origin || ' -> ' || destination ORDER BY step)[1:30], '; ') AS listed
FROM walk_legs GROUP BY 1""")
def legs_limit(t):
    return first_legs(t.walk_legs, "route_id", 30)


def _number(c: str, unit: str, places: int = 3) -> str:
    return (f"CASE WHEN {c} IS NULL THEN 'not recorded in the dataset' ELSE "
            f"regexp_replace(format('{{:,.{places}f}}', CAST({c} AS DOUBLE)), '\\.?0+$', '') || '{unit}' END")


STATION_RECORDS = f"""
SELECT 'station:' || trim(regexp_replace(lower(s.name), '[^a-z0-9]', '-', 'g'), '-') AS id, 'dataset' AS kind,
       'Station: ' || s.name AS title, 'survey (station record)' AS locator,
       concat_ws(chr(10), 'STATION (dataset record): ' || s.name,
         'Type: ' || CASE WHEN len(types) = 0 THEN 'unknown' ELSE array_to_string(types, '/') END,
         'Latitude: ' || {_number('f.lat', '', 4)}, 'Longitude: ' || {_number('f.lon', '', 4)},
         'Transmission lines meeting here: ' || coalesce(n.degree, 0),
         'Directly connected stations and the line distance to each:',
         coalesce(n.listed, '  - none; this station is isolated in the dataset')) AS text
FROM stations s LEFT JOIN (
  SELECT src, count(*) AS degree, string_agg('  - ' || src || ' <-> ' || dst || ': ' || {_number('km', ' km')}, chr(10) ORDER BY dst) AS listed
  FROM net_adj GROUP BY src) n ON n.src = s.name"""

_TARIFF = rc.tariff_text().replace("'", "''").replace("\n", "' || chr(10) || '")


@query("record_chunks", f"""WITH RECURSIVE
joined(node, label) USING KEY (node) AS (
  SELECT name, name FROM stations
  UNION
  SELECT a.dst, min(c.label) FROM joined c JOIN net_adj a ON a.src = c.node JOIN recurring.joined r ON r.node = a.dst
  WHERE c.label < r.label GROUP BY a.dst),
line_records AS (
SELECT 'line:' || trim(regexp_replace(lower(source), '[^a-z0-9]', '-', 'g'), '-') || '--'
       || trim(regexp_replace(lower(destination), '[^a-z0-9]', '-', 'g'), '-') || ':' || row_number AS id,
       'dataset' AS kind, 'Transmission line: ' || source || ' -> ' || destination AS title, 'survey row ' || row_number AS locator,
       concat_ws(chr(10), 'TRANSMISSION LINE (dataset record): ' || source || ' -> ' || destination,
         'CSV row ' || row_number || ' of survey.', 'Source station: ' || source, 'Destination station: ' || destination,
         'Type (facility type of the source station): ' || coalesce(line_type, 'not recorded in the dataset'),
         'Distance_km: ' || {_number('distance_km', ' km')}, 'Voltage_kV: ' || {_number('voltage_kv', ' kV')},
         'Capacity_MW: ' || {_number('capacity_mw', ' MW')}, 'Loss_Percent: ' || {_number('loss_percent', ' %')},
         'Energy_Loss_MW: ' || {_number('energy_loss_mw', ' MW')},
         'Loss_Cost_Per_Hour_INR: ' || {_number('energy_loss_mw * 6600', ' INR per hour', 2)},
         'Loss_Cost_Per_Year_INR: ' || {_number('energy_loss_mw * 6600 * 8760', ' INR per year', 2)}) AS text,
       concat_ws(';', 'source=' || source, 'destination=' || destination, 'csv_row=' || row_number, 'distance_km=' || CAST(distance_km AS VARCHAR),
         'energy_loss_mw=' || CAST(energy_loss_mw AS VARCHAR),
         'loss_cost_per_hour_inr=' || CAST(CAST(energy_loss_mw * 6600 AS DECIMAL(30,4)) AS VARCHAR),
         'loss_cost_per_year_inr=' || CAST(CAST(energy_loss_mw * 6600 * 8760 AS DECIMAL(34,4)) AS VARCHAR)) AS metadata
FROM survey_clean)
SELECT * FROM line_records
UNION ALL SELECT *, NULL FROM ({STATION_RECORDS})
UNION ALL SELECT 'network:summary', 'dataset', 'Network summary', 'survey (whole-file summary)', concat_ws(chr(10),
  'NETWORK SUMMARY (dataset record).', 'Dataset file: survey', 'Stations: ' || (SELECT count(*) FROM stations),
  'Rows in the CSV: ' || (SELECT count(*) FROM lineitem), 'Routable transmission lines (positive Distance_km): ' || count(*),
  'Connected components: ' || (SELECT count(DISTINCT label) FROM joined),
  'Isolated stations: ' || (SELECT count(*) FROM stations WHERE name NOT IN (SELECT src FROM net_adj)), 'Shortest line: ' || {_number('min(distance_km)', ' km')},
  'Longest line: ' || {_number('max(distance_km)', ' km')}, 'Total line length in the dataset: ' || {_number('sum(distance_km)', ' km')}), NULL
FROM net
UNION ALL SELECT 'tariff:basis', 'dataset', 'Tariff and monetary-loss basis', '{money.DEFAULT_TARIFF.source_location.replace("'", "''")}', '{_TARIFF}', NULL""")
def record_chunks(t):
    """One self-describing record per surveyed line, per station, of the network and of the tariff."""
    stations = kept(st.station_dimension(t.survey_clean), "stations")
    records = index.chunk_union(
        rc.line_records(t.survey_clean, "survey"), rc.station_records(stations, t.net_cut, "survey"),
        rc.summary_record(network_facts(stations.select("name"), t.net_cut, t.lineitem), "survey"), rc.tariff_record(t.spark))
    stated = F.transform(F.map_entries("metadata"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return records.withColumn("metadata", F.array_join(stated, ";"))


@query("station_records", STATION_RECORDS)
def station_records(t):
    return rc.station_records(st.station_dimension(t.survey_clean), t.net, "survey")


@query("network_record", f"""
SELECT 'network:summary' AS id, concat_ws(chr(10), 'NETWORK SUMMARY (dataset record).', 'Dataset file: grid', 'Stations: ' || (SELECT count(*) FROM grid_stations),
  'Rows in the CSV: ' || (SELECT count(*) FROM lineitem), 'Routable transmission lines (positive Distance_km): ' || count(*),
  'Connected components: 1', 'Isolated stations: 0', 'Shortest line: ' || {_number('min(distance_km)', ' km')},
  'Longest line: ' || {_number('max(distance_km)', ' km')}, 'Total line length in the dataset: ' || {_number('sum(distance_km)', ' km')}) AS text
FROM grid""")
def network_record(t):
    return rc.summary_record(network_facts(t.grid_stations, t.grid_cut, t.lineitem), "grid").select("id", "text")


def network_facts(stations, lines, rows):
    """One row on a network (name; a, b, distance_km) for its summary."""
    from gridloom.operators import components as cc
    from gridloom.operators import network as nw

    def one(df):
        return df.agg(F.count("*").alias("n")).scalar()

    groups = cc.connected_components(stations, lines)
    return line_extent(lines).select(
        one(stations).alias("stations"), one(rows).alias("rows_read"), one(groups.select("component").distinct()).alias("components"),
        one(nw.isolated_stations(stations, lines)).alias("isolated"), "*")


def instance_runs(t):
    """The whole compare workflow for the instance around every station: both tours, checks, prices, one payload each."""
    lines = t.grid_cut.select("a", "b", "distance_km", "energy_loss_mw")
    nn = kept(tr.nn_tours(t.instance_tables, t.instance_starts))
    better = kept(tr.window_reoptimize(nn, window=4, sweeps=3))

    walked = tr.tour_legs(nn.unionByName(better.select(nn.columns)).select(
        F.col("start").alias("tour_id"), tr.stop_names().alias("stops")))
    closure = t.leg_ways(walked.select("origin", "destination").distinct())

    def solved(tours, side, label):
        orders = tours.select(
            F.concat_ws("/", "start", F.lit(side)).alias("tour_id"), "start", tr.stop_names().alias("stops"), "total_km")
        legs = kept(tr.travelled_legs(tr.tour_legs(orders), closure, t.grid_cut))
        pool = tours.select(F.concat_ws("/", "start", F.lit(side)).alias("tour_id"), F.explode("names").alias("name"))
        checks = cp.tour_validation(orders, legs, pool, closure)
        counts = kept(pr.step_counts(legs.withColumnRenamed("tour_id", "route_id"), lines))
        losses = kept(pr.route_loss(counts))
        notes = pr.route_completeness(losses, counts).withColumn("caveats", pr.caveats())
        routes = orders.select(F.col("tour_id").alias("route_id"), F.lit(label).alias("label"), F.col("total_km").alias("total_distance_km"))
        return kept(payload.tour_payload(legs, orders, checks)), kept(payload.route_payload(losses, notes, routes)), losses

    (nn_tour, nn_route, nn_loss) = solved(nn, "classical", "Nearest neighbour")
    (qa_tour, qa_route, qa_loss) = solved(better, "hybrid", "Hybrid")

    def keyed(df, id_, name, value):
        return df.select(F.substring_index(id_, "/", 1).alias("start"), F.col(value).alias(name))

    compared = cp.tour_comparison(better.select(
        "start", F.col("start_km").alias("nn_km"), F.col("total_km").alias("hybrid_km"), F.struct(
            F.lit("exact").alias("mode"), F.lit(4).alias("window"), "sweeps_run", F.col("solved").alias("subproblems_solved"),
            F.col("skipped").alias("subproblems_skipped"), F.col("accepted").alias("improvements_accepted"),
            F.col("start_km").alias("start_distance_km")).alias("detail")))
    priced = pr.route_comparison(
        nn_loss.union(qa_loss).withColumn("start", F.substring_index("route_id", "/", 1)).withColumn(
            "label", F.substring_index("route_id", "/", -1)), "start", "label")
    tariff = money.DEFAULT_TARIFF
    both = (
        compared.join(priced, "start")
        .join(keyed(nn_tour, "tour_id", "nn_tour", "tour"), "start").join(keyed(qa_tour, "tour_id", "qa_tour", "tour"), "start")
        .join(keyed(nn_route, "route_id", "nn_route", "route"), "start")
        .join(keyed(qa_route, "route_id", "qa_route", "route"), "start"))
    return payload.response_sink(
        both, "start", F.col("start"),
        F.struct(F.lit("classical-nearest-neighbour").alias("algorithm"), "start", F.col("nn_tour").alias("tour")).alias("classical"),
        F.struct(F.lit("hybrid-window-reoptimization").alias("algorithm"), "start", F.col("qa_tour").alias("tour"), "detail").alias("hybrid"),
        F.struct(
            "start", F.col("nn_tour.stations_visited").alias("stations"), F.col("nn_km").alias("nn_distance_km"),
            F.col("nn_tour.valid").alias("nn_valid"), F.col("hybrid_km").alias("hybrid_distance_km"),
            F.col("qa_tour.valid").alias("hybrid_valid"), "improvement_km", "improvement_percent", "winner",
            F.array(*[F.struct(F.lit(label).alias("label"), passed.alias("passed")) for label, passed in (
                ("same stations", F.array_sort("nn_tour.order") == F.array_sort("qa_tour.order")),
                ("same starting station", F.col("nn_tour.start") == F.col("qa_tour.start")),
                ("both tours return to their start", (F.element_at("nn_tour.closed_route", -1) == F.col("nn_tour.start"))
                 & (F.element_at("qa_tour.closed_route", -1) == F.col("qa_tour.start"))))]).alias("same_problem_checks")
        ).alias("comparison"),
        F.struct(
            F.struct(money.rate(tariff).alias("inr_per_kwh"), F.lit(tariff.category).alias("category"),
                     F.lit(tariff.component).alias("component"), F.lit(tariff.authority).alias("authority")).alias("tariff"),
            F.col("nn_route").alias("classical"), F.col("qa_route").alias("hybrid"),
            F.col("improvement_km").alias("distance_difference_km"),
            F.col("total_energy_loss_mw_difference").alias("energy_loss_difference_mw"),
            F.col("loss_cost_per_hour_inr_difference").alias("hourly_cost_difference_inr"),
            F.col("loss_cost_per_year_inr_difference").alias("annual_cost_difference_inr"), "lower_loss_route",
            F.lit(money.HOURS_PER_YEAR).alias("hours_per_year")).alias("energy"))


INSTANCE_LEGS = """
legs AS (
  SELECT instance_id, i AS step, l.origin, l.destination, c.km, a.src IS NOT NULL AS is_direct
  FROM (SELECT instance_id, unnest(range(1, 7)) AS i, unnest(stops) AS origin, unnest(list_append(stops[2:], stops[1])) AS destination
        FROM inst_tours) l
  JOIN inst_costs c USING (instance_id) LEFT JOIN grid_adj a ON a.src = l.origin AND a.dst = l.destination
  WHERE c.origin = l.origin AND c.node = l.destination)"""


@query("response_sink", f"""WITH {INSTANCE_LEGS}
SELECT t.instance_id AS start, t.total_km AS nn_distance_km, CAST(direct AS VARCHAR) AS direct_legs, 'true' AS nn_valid, t.total_km AS route_km, 'Nearest neighbour' AS label, 'true' AS same_stations
FROM inst_tours t JOIN (SELECT instance_id, count(*) FILTER (is_direct) AS direct FROM legs GROUP BY 1) d ON d.instance_id = t.instance_id""")
def response_sink(t):
    """Fields of the payload text, read back by their path."""
    return instance_runs(t).select("start", *[
        F.get_json_object("payload", path).alias(name) for name, path in (
            ("nn_distance_km", "$.comparison.nn_distance_km"), ("direct_legs", "$.classical.tour.direct_legs"),
            ("nn_valid", "$.comparison.nn_valid"), ("route_km", "$.energy.classical.total_distance_km"),
            ("label", "$.energy.classical.label"), ("same_stations", "$.comparison.same_problem_checks[0].passed"))]).withColumns(
        {c: F.col(c).cast("decimal(18,3)") for c in ("nn_distance_km", "route_km")})


@query("json_payload_source", f"""WITH {INSTANCE_LEGS}
SELECT t.instance_id AS start, t.total_km AS nn_km, array_to_string(list_append(t.stops, t.instance_id), '>') AS closed_route,
       (SELECT string_agg(origin || '>' || destination || '>' || km || '>' || is_direct, ';' ORDER BY step) FROM legs l
        WHERE l.instance_id = t.instance_id) AS legs
FROM inst_tours t""")
def json_payload_source(t):
    tour = F.col("run.classical.tour")
    leg = F.transform(tour.legs, lambda x: F.concat_ws(
        ">", x.origin, x.destination, x.distance_km.cast("string"), x.is_direct.cast("string")))
    return payload.json_payload_source(instance_runs(t)).select(
        "start", tour.total_distance_km.alias("nn_km"), F.array_join(tour.closed_route, ">").alias("closed_route"),
        F.array_join(leg, ";").alias("legs"))


@query("run_chunks")
def run_chunks(t):
    """Up to ten records of every run. No SQL: the second tour comes out of a sequential loop."""
    return rc.run_records(payload.json_payload_source(instance_runs(t)), "start")


def survey_file(t):
    """The survey as a CSV folder with the columns of a line table; returns its path."""
    path = scratch_path(t.spark, "survey") + ".csv"
    names = {v: k for k, v in files.FIELDS.items()}
    t.lines_raw.select("row_number", *[F.col(c).alias(f" {n} ") for c, n in names.items()]).write.option(
        "header", True).option("compression", "lz4").option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return path


@query("csv_scan", """
SELECT row_number, trim(source, ' ' || chr(9)) AS source, trim(destination) AS destination, line_type, trim(distance_km) AS distance_km, src_lat
FROM lines_raw""")
def csv_scan(t):
    """The survey written to files and read back by its header."""
    rows = files.csv_scan(t.spark, survey_file(t))
    lines = files.as_connections(rows)
    return lines.select(
        "row_number", F.btrim("source", F.lit(" \t")).alias("source"), F.btrim("destination", F.lit(" ")).alias("destination"),
        "line_type", F.btrim("distance_km", F.lit(" ")).alias("distance_km"), "src_lat")


@query("clean_connections", """
SELECT row_number, trim(source, ' ' || chr(9)) AS source, trim(destination) AS destination, line_type,
       CASE WHEN distance_km NOT IN ('n/a', ' -1e3 ') THEN CAST(distance_km AS DOUBLE) END AS distance_km,
       CAST(voltage_kv AS DOUBLE) AS voltage_kv,
       CASE WHEN loss_percent NOT IN ('nan', '2d') THEN CAST(trim(loss_percent) AS DOUBLE) END AS loss_percent
FROM lines_raw WHERE trim(source, ' ' || chr(9)) <> ''""")
def clean_connections(t):
    """Files to typed connections, the whole load."""
    lines = files.as_connections(files.csv_scan(t.spark, survey_file(t)))
    return st.clean_connections(lines).select(
        "row_number", "source", "destination", "line_type", "distance_km", "voltage_kv", "loss_percent")


#: What is wrong with the folder of some nations; all others are as they should be.
_FAULTS = {"NATION_1": "header", "NATION_2": "rows", "NATION_3": "files", "NATION_4": "folder", "NATION_5": "stations"}
_FAULT = "CASE destination " + " ".join(f"WHEN '{n}' THEN '{f}'" for n, f in _FAULTS.items()) + " ELSE 'none' END"


def _status_sql(name: str) -> str:
    return f"""
WITH rows_of AS (SELECT destination AS folder, {_FAULT} AS fault, count(*) AS n, count(DISTINCT l_orderkey % 2) AS parts
                 FROM (SELECT destination, CAST(split_part(row_number, '-', 1) AS BIGINT) AS l_orderkey FROM survey) GROUP BY 1, 2),
told AS (
  SELECT n_name AS folder, CASE WHEN r.folder IS NULL OR fault = 'folder' THEN 0 WHEN fault = 'files' THEN parts ELSE 1 END AS files,
         CASE WHEN r.folder IS NULL OR fault IN ('folder', 'rows') THEN 0 ELSE n END AS rows, fault
  FROM nation LEFT JOIN rows_of r ON r.folder = n_name)
SELECT folder, files, CAST(rows AS BIGINT) AS rows,
       CASE WHEN files = 0 THEN 'no .csv file found' WHEN files > 1 THEN 'multiple CSV files'
            WHEN fault = 'header' THEN 'missing required column(s): Distance_km' WHEN rows = 0 THEN 'contains no data rows'
            WHEN fault = 'stations' THEN 'no usable station' ELSE 'ok' END AS status
FROM told {name}"""


def folders(t):
    """The survey written as one CSV folder per destination, some with a fault, and what a load of each would say."""
    path = scratch_path(t.spark, "folders")
    rows = kept(t.survey.selectExpr(
        "destination AS folder", f"{_FAULT} AS fault", "CAST(split_part(row_number, '-', 1) AS BIGINT) % 2 AS odd",
        "source AS Source", "destination AS Destination", "distance_km AS Distance_km"), "folder-rows")
    dealt = rows.withColumn("part", F.when(F.col("fault") == "files", F.col("odd")).otherwise(F.lit(0))).repartition("folder", "part")

    def written(df, header):
        df.write.mode("append").option("header", header).partitionBy("folder", "part").csv(path)

    blank = F.when(F.col("fault") != "stations", F.col("Source")), F.when(F.col("fault") != "stations", F.col("Destination"))
    written(dealt.where("fault IN ('files', 'stations', 'none')").select("folder", "part", blank[0].alias(" Source "), blank[1].alias("Destination"), "Distance_km"), True)
    written(dealt.where("fault = 'header'").select("folder", "part", "Source", "Destination"), True)
    written(dealt.where("fault = 'rows'").select("folder", "part").distinct().select(
        "folder", "part", F.lit("Source").alias("a"), F.lit("Destination").alias("b"), F.lit("Distance_km").alias("c")), False)
    scan = t.spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").text(path)
    return files.folder_status(scan, t.nation.select(F.col("n_name").alias("folder")), F.regexp_extract("file", "folder=([^/]+)", 1))


@query("single_file_source", _status_sql("WHERE files <> 1"))
def single_file_source(t):
    """The folders that have no file or several."""
    return folders(t).where("files <> 1")


@query("required_columns", _status_sql("WHERE files = 1 AND fault IN ('header', 'none')"))
def required_columns(t):
    """The folders whose one file lacks a column, and those that are in order."""
    return folders(t).where("files = 1 AND (status LIKE 'missing%' OR status = 'ok')")


@query("empty_input", _status_sql("WHERE files = 1 AND fault IN ('rows', 'stations')"))
def empty_input(t):
    """The folders whose file has no row, or no row that names a station."""
    return folders(t).where("status IN ('contains no data rows', 'no usable station')")


@query("row_provenance", "SELECT count(*) AS rows, 0 AS repeated, 0 AS gaps, true AS starts_at_two FROM survey")
def row_provenance(t):
    """Every row of every file has its own number, from two on without a gap."""
    path = scratch_path(t.spark, "survey")
    t.lines_raw.write.option("header", True).csv(path)
    rows = files.row_provenance(t.spark.read.option("header", True).csv(path), "line")
    per_file = rows.groupBy("file").agg(
        F.count("*").alias("n"), F.count_distinct("line").alias("d"), F.min("line").alias("lo"), F.max("line").alias("hi"))
    return per_file.agg(
        F.sum("n").alias("rows"), F.sum(F.col("n") - F.col("d")).cast("int").alias("repeated"),
        F.sum(F.col("hi") - F.col("lo") + 1 - F.col("n")).cast("int").alias("gaps"),
        F.bool_and(F.col("lo") == 2).alias("starts_at_two"))


@query("whole_file_scan", "SELECT page_id, CAST(length(html) AS INTEGER) AS size, md5(html) AS digest FROM pages")
def whole_file_scan(t):
    """Pages written as one file each, their id on the first line, and read back whole. A folder per page would be listed by itself."""
    path = scratch_path(t.spark, "pages")
    tasks = int(t.spark.conf.get("spark.sql.shuffle.partitions"))
    page = F.concat(F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit("\n"), F.coalesce("html", F.lit("")))
    t.pages.repartition(tasks, "page_id").select(page.alias("value")).write.option("maxRecordsPerFile", 1).option("lineSep", "\u0000").text(path)
    texts, _ = files.whole_file_scan(t.spark, [path])
    text = F.rtrim(F.col("text"), F.lit("\u0000"))
    first = F.locate("\n", text)
    parts = texts.select(F.substring(text, F.lit(1), first - 1).alias("page_id"), F.substring(text, first + 1, F.length(text)).alias("html"))
    return parts.select(F.expr("try_cast(page_id AS BIGINT)").alias("page_id"), F.length("html").alias("size"), F.md5("html").alias("digest"))


@query("derived_column_sink", """
SELECT row_number, coalesce(CAST(CAST(round(energy_loss_mw * 6600, 2) AS DECIMAL(34,2)) AS VARCHAR), '') AS hour,
       coalesce(CAST(CAST(round(energy_loss_mw * 6600 * 8760, 2) AS DECIMAL(34,2)) AS VARCHAR), '') AS year, true AS first_wrote, false AS second_wrote
FROM survey""")
def derived_column_sink(t):
    """Costs appended and written; a second run over the written table has nothing to write."""
    path, again = scratch_path(t.spark, "derived"), scratch_path(t.spark, "derived")
    rows = t.survey.select("row_number", F.col("energy_loss_mw").cast("string").alias("Energy_Loss_MW"))
    wrote = sinks.derived_column_sink(rows, path)
    stored = files.csv_scan(t.spark, path, ("Energy_Loss_MW",))
    second = sinks.derived_column_sink(stored, again)
    return stored.select(
        "row_number", F.coalesce(F.col("Loss_Cost_Per_Hour_INR"), F.lit("")).alias("hour"),
        F.coalesce(F.col("Loss_Cost_Per_Year_INR"), F.lit("")).alias("year"),
        F.lit(wrote).alias("first_wrote"), F.lit(second).alias("second_wrote"))


@query("keyed_upsert", """
SELECT coalesce(n.a, e.a) AS a, coalesce(n.b, e.b) AS b, CASE WHEN n.a IS NOT NULL THEN n.energy_loss_mw ELSE e.energy_loss_mw END AS energy_loss_mw
FROM (SELECT a, b, distance_km AS energy_loss_mw FROM grid) e
FULL JOIN (SELECT b AS a, a AS b, CAST(qty AS DECIMAL(18,3)) AS energy_loss_mw FROM grid_pairs WHERE qty >= 70) n ON n.a = e.b AND n.b = e.a""")
def keyed_upsert(t):
    """Strong pairs, named the other way round, replace the lines between the same stations."""
    existing = t.grid.select("a", "b", F.col("distance_km").alias("energy_loss_mw"))
    incoming = t.grid_pairs.where("qty >= 70").select(
        F.col("b").alias("a"), F.col("a").alias("b"), F.col("qty").cast("decimal(18,3)").alias("energy_loss_mw"))
    return sinks.keyed_upsert(existing, incoming, [F.least("a", "b"), F.greatest("a", "b")])


@query("index_sink", """
SELECT id, kind, title, locator, md5(text) AS digest FROM corpus""")
def index_sink(t):
    """The corpus saved as an index and loaded by its version."""
    path = scratch_path(t.spark, "index")
    index.save_index(t.corpus, path)
    return index.load_index(t.spark, path).select("id", "kind", "title", "locator", F.md5("text").alias("digest"))


@query("index_source", """
SELECT kind, count(*) AS chunks, CAST(sum(length(text)) AS BIGINT) AS characters FROM corpus GROUP BY 1""")
def index_source(t):
    """A stored index, loaded and counted per kind."""
    path = scratch_path(t.spark, "index")
    index.save_index(t.corpus, path)
    return index.load_index(t.spark, path).groupBy("kind").agg(
        F.count("*").alias("chunks"), F.sum(F.length("text")).alias("characters"))
