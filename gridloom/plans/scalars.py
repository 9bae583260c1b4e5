"""Queries on scalar functions: formats, chains, redaction, tariff facts."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.functions import money, readout, text
from gridloom.operators.ranking import preview
from gridloom.plans.registry import query


@query("tariff_facts", """
SELECT row_number, CAST(6.60 AS DECIMAL(9,2)) AS rate, 660 AS paise,
       'HT-2(a) - Industries including MSME energy charge, Rs. 6.60/kWh' AS label, 7 AS excluded,
       '2025-03-27' AS order_date, 'Energy Charges (per kWh) only' AS component,
       'Karnataka Electricity Regulatory Commission (KERC)' AS authority,
       'FY2025-26 and FY2026-27 (650 paise/kWh from FY2027-28)' AS effective_period,
       'Annexure-9, "TARIFF SCHEDULE HT-2(a)", order page 550' AS source_location,
       CAST(energy_loss_mw * 1000 AS DECIMAL(28,4)) AS kwh_per_hour
FROM survey""")
def tariff_facts(t):
    """The rate beside every loss it prices."""
    facts = money.tariff_columns()
    told = ("order_date", "component", "authority", "effective_period", "source_location")
    return t.survey.select(
        "row_number", facts["inr_per_kwh"].alias("rate"), facts["paise"].alias("paise"), facts["label"].alias("label"),
        F.size(facts["excludes"]).alias("excluded"), *[facts[c].alias(c) for c in told],
        money.kwh_per_hour(F.col("energy_loss_mw")).alias("kwh_per_hour"))


@query("number_text", """
SELECT row_number,
       CASE WHEN distance_km IS NULL THEN 'not recorded in the dataset'
            ELSE regexp_replace(format('{:,.3f}', CAST(distance_km AS DOUBLE)), '\\.?0+$', '') || ' km' END AS distance,
       CASE WHEN capacity_mw IS NULL THEN 'not recorded in the dataset'
            ELSE regexp_replace(format('{:,.1f}', CAST(capacity_mw AS DOUBLE)), '\\.?0+$', '') END AS capacity,
       format('{:,.0f}', CAST(voltage_kv AS DOUBLE)) || ' kV' AS voltage
FROM survey""")
def number_text(t):
    return t.survey.select(
        "row_number", text.number_text(F.col("distance_km"), "km").alias("distance"),
        text.number_text(F.col("capacity_mw").cast("double"), "", 1).alias("capacity"),
        text.number_text(F.col("voltage_kv"), "kV", 0).alias("voltage"))


@query("indian_scale", """
SELECT row_number, CASE WHEN v IS NULL THEN '' WHEN abs(v) >= 10000000 THEN ' (about Rs. ' || format('{:,.2f}', v / 10000000) || ' crore)'
       WHEN abs(v) >= 100000 THEN ' (about Rs. ' || format('{:,.2f}', v / 100000) || ' lakh)' ELSE '' END AS scale
FROM (SELECT row_number, CAST(energy_loss_mw AS DOUBLE) * 100 AS v FROM survey)""")
def indian_scale(t):
    return t.survey.select("row_number", text.indian_scale(F.col("energy_loss_mw").cast("double") * 100).alias("scale"))


@query("readout_text", """
SELECT event_id, format('{:,.3f}', v) || ' km' AS km, CASE WHEN d > 0 THEN '+' ELSE '' END || format('{:,.3f}', d) || ' MW' AS signed_mw,
       format('{:.2f}', v) || '%' AS percent, CASE WHEN d > 0 THEN '+' ELSE '' END || format('{:.2f}', d) || '%' AS signed_percent,
       CASE WHEN m < 0 THEN '-' ELSE '' END || '₹' || CASE WHEN abs(m) >= 1e7 THEN format('{:.2f}', abs(m) / 1e7) || ' Cr'
         WHEN abs(m) >= 1e5 THEN format('{:.2f}', abs(m) / 1e5) || ' L' WHEN abs(m) >= 1e3 THEN format('{:.2f}', abs(m) / 1e3) || ' K'
         ELSE format('{:.2f}', abs(m)) END AS rupees,
       CASE WHEN s < 0.001 THEN format('{:.0f}', s * 1e6) || ' µs' WHEN s < 1 THEN format('{:.3f}', s * 1000) || ' ms'
         WHEN s < 60 THEN format('{:.2f}', s) || ' s'
         ELSE CAST(floor(s / 60) AS BIGINT) || 'm ' || format('{:.0f}', s - floor(s / 60) * 60) || 's' END AS took
FROM (SELECT event_id, value AS v, value - 20 AS d, (value - 10) * value * value * value AS m, value * value * value * value / 1000000 AS s FROM events)""")
def readout_text(t):
    rows = t.events.selectExpr(
        "event_id", "value AS v", "value - 20 AS d", "(value - 10) * value * value * value AS m",
        "value * value * value * value / 1000000 AS s")
    return rows.select(
        "event_id", readout.quantity(F.col("v"), "km").alias("km"),
        readout.quantity(F.col("d"), "MW", signed=True).alias("signed_mw"), readout.share(F.col("v")).alias("percent"),
        readout.share(F.col("d"), signed=True).alias("signed_percent"), readout.rupees_short(F.col("m")).alias("rupees"),
        readout.duration(F.col("s")).alias("took"))


@query("slug", r"""
SELECT doc_id, trim(regexp_replace(lower(text), '[^\p{L}\p{N}]', '-', 'g'), '-') AS slug FROM documents""")
def slug(t):
    return t.documents.select("doc_id", text.slug(F.col("text")).alias("slug"))


@query("chain_text", "SELECT start, array_to_string(list_append(stops, start), ' -> ') AS chain FROM net_orders")
def chain_text(t):
    stops = F.array_append("stops", F.col("start"))
    return t.net_orders.select("start", text.chain_text(stops).alias("chain"))


@query("wrapped_chain", """
SELECT start, array_to_string(acc.lines || [acc.cur], chr(10)) AS lines FROM (
  SELECT start, list_reduce(list_append(stops, start), lambda a, n:
    CASE WHEN a.cur = '' THEN {'lines': a.lines, 'cur': n}
         WHEN length(a.cur) + length(n) + 4 <= 72 THEN {'lines': a.lines, 'cur': a.cur || ' -> ' || n}
         ELSE {'lines': list_append(a.lines, a.cur || ' ->'), 'cur': n} END,
    {'lines': CAST([] AS VARCHAR[]), 'cur': ''}) AS acc FROM net_orders)""")
def wrapped_chain(t):
    stops = F.array_append("stops", F.col("start"))
    return t.net_orders.select("start", F.array_join(text.wrapped_chain(stops), "\n").alias("lines"))


@query("redact", r"""
SELECT doc_id, regexp_replace(regexp_replace(text,
    '(?i)\b(token|secret|password|passwd|passphrase|credential|api[_-]?key|access[_-]?key|service[_-]?role[_-]?key|publishable[_-]?key|anon[_-]?key|bearer)(\s*["'']?\s*[:=]\s*)(["''][^"''\n]{6,}["''])',
    '\1\2"<redacted>"', 'g'),
    '(?i)\b([A-Z][A-Z0-9_]*(?:TOKEN|KEY|SECRET|PASSWORD))\s*=\s*(\S{6,})', '\1=<redacted>', 'g') AS text
FROM documents""")
def redact(t):
    return t.documents.select("doc_id", text.redact(F.col("text")).alias("text"))


@query("clip_text", r"""
SELECT doc_id, CASE WHEN length(text) > 1400 THEN regexp_replace(text[:1400], '\s+$', '') || chr(10) || '[... continues ...]' ELSE text END AS text
FROM documents""")
def clip_text(t):
    return t.documents.select("doc_id", text.clip_text(F.col("text"), 1400, "\n[... continues ...]").alias("text"))


def scripts(t):
    """Each part written up as a SQL and as a JavaScript text."""
    return t.part.selectExpr(
        "p_partkey",
        "concat('-- ', p_name, '\\n--   size ', p_size, '\\n\\n-- end\\ncreate table if not exists ', replace(p_name, ' ', '_'), ' (id int);\\n"
        "CREATE OR REPLACE VIEW ', replace(p_brand, '#', '_'), ' AS SELECT 1;\\n-- tail\\n') AS sql_text",
        "concat('/**\\n * ', p_name, '\\n *  made as ', p_type, '\\n */\\nexport default function ', replace(p_name, ' ', ''), '() {}\\n"
        "export const ', replace(p_brand, '#', ''), ' = 1\\nconst ', upper(p_type), '_SIZE = ', p_size, '\\n') AS js_text")


@query("declaration_extract", r"""
SELECT p_partkey, p_name || chr(10) || 'size ' || p_size || chr(10) || 'end' AS sql_header,
       'table ' || replace(p_name, ' ', '_') || ',VIEW ' || replace(p_brand, '#', '_') AS created,
       p_name || chr(10) || 'made as ' || p_type AS js_header,
       replace(p_name, ' ', '') || ',' || replace(p_brand, '#', '') AS exported, upper(p_type) || '_SIZE' AS constants
FROM part""")
def declaration_extract(t):
    created = F.zip_with(
        F.regexp_extract_all("sql_text", F.lit(text.SQL_OBJECT_PATTERN), 1),
        F.regexp_extract_all("sql_text", F.lit(text.SQL_OBJECT_PATTERN), 2), lambda k, n: F.concat_ws(" ", k, n))
    return scripts(t).select(
        "p_partkey", text.leading_dashes(F.col("sql_text")).alias("sql_header"), F.array_join(created, ",").alias("created"),
        text.header_comment(F.col("js_text")).alias("js_header"),
        F.array_join(F.regexp_extract_all("js_text", F.lit(text.JS_EXPORT_PATTERN), 1), ",").alias("exported"),
        F.array_join(F.regexp_extract_all("js_text", F.lit(text.JS_CONST_PATTERN), 1), ",").alias("constants"))


@query("preview_limit", """
SELECT s_nationkey, count(*) AS total, array_to_string(list_sort(list(s_name))[1:6], ', ') || CASE WHEN count(*) > 6 THEN ' ...' ELSE '' END AS preview
FROM supplier GROUP BY 1""")
def preview_limit(t):
    return preview(t.supplier, ["s_nationkey"], "s_name", 6)


@query("stable_order", "SELECT a, b, distance_km FROM grid ORDER BY a, b")
def stable_order(t):
    return t.grid.select("a", "b", "distance_km").orderBy("a", "b")
