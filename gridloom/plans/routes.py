"""Queries on routes: the lines they run over, the loss priced on them, two routes compared."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.functions import money
from gridloom.operators import compare as cp
from gridloom.operators import pricing as pr
from gridloom.plans.registry import query
from gridloom.session import cut

LOSS_COLUMNS = """route_id, line_count, traversal_count, revisited_lines, total_energy_loss_mw,
traversal_energy_loss_mw, lines_missing_loss, unmatched_steps, complete, energy_loss_kwh_per_hour,
loss_cost_per_hour_inr, loss_cost_per_year_inr"""


@query("route_to_lines", """
SELECT l.route_id, l.step, 0 AS hop, l.origin, l.destination, l.has_path, l.a, l.b,
       e.distance_km, e.energy_loss_mw, e.a IS NOT NULL AND l.has_path AS matched
FROM walk_legs l LEFT JOIN event_lines e ON e.a = l.a AND e.b = l.b""")
def route_to_lines(t):
    return pr.route_to_lines(t.walk_legs, t.event_lines)


@query("tour_to_lines", """
SELECT tour_id AS route_id, step, CAST(h - 1 AS INTEGER) AS hop, path[h] AS origin, path[h + 1] AS destination,
       n.distance_km, n.energy_loss_mw, n.a IS NOT NULL AS matched
FROM (SELECT *, unnest(range(1, len(path))) AS h FROM net_legs) l
LEFT JOIN (SELECT * FROM net WHERE b <> 'NATION_5') n ON n.a = least(path[h], path[h + 1]) AND n.b = greatest(path[h], path[h + 1])""")
def tour_to_lines(t):
    """Tours run through other stations, so a leg may cross several lines; hops over a line that is not surveyed are kept as unmatched."""
    legs = t.net_legs.withColumnRenamed("tour_id", "route_id")
    surveyed = t.net_cut.where("b <> 'NATION_5'").select("a", "b", "distance_km", "energy_loss_mw")
    return pr.route_to_lines(legs, surveyed).drop("a", "b", "has_path")


@query("unmatched_steps", f"""
SELECT l.route_id, l.step, 0 AS hop, l.origin, l.destination,
       CASE WHEN l.has_path THEN '{pr.NO_LINE}' ELSE '{pr.NO_PATH}' END AS reason
FROM walk_legs l LEFT JOIN event_lines e ON e.a = l.a AND e.b = l.b WHERE NOT l.has_path OR e.a IS NULL""")
def unmatched_steps(t):
    return pr.unmatched_steps(t.walk_legs, t.event_lines)


@query("route_line_usage", """
SELECT route_id, a, b, distance_km, energy_loss_mw, traversals,
       CAST(energy_loss_mw * 1000 * 6.60 AS DECIMAL(30,4)) AS loss_cost_per_hour_inr,
       CAST(CAST(energy_loss_mw * 1000 * 6.60 AS DECIMAL(30,4)) * 8760 AS DECIMAL(34,4)) AS loss_cost_per_year_inr
FROM walk_counts WHERE matched""")
def route_line_usage(t):
    return pr.route_line_usage(t.walk_counts)


@query("route_loss", f"SELECT {LOSS_COLUMNS} FROM walk_loss")
def route_loss(t):
    return pr.route_loss(t.walk_counts)


@query("route_completeness", """
SELECT route_id, complete, NOT complete AS lower_bound, lines_missing_loss, unmatched_steps, missing, total_energy_loss_mw
FROM walk_loss""")
def route_completeness(t):
    counts = t.walk_counts
    return pr.route_completeness(pr.route_loss(counts), counts)


def _caveat_sql(table: str) -> str:
    tariff = money.DEFAULT_TARIFF
    priced = (
        f"Priced at the {tariff.category} energy charge only (Rs. {tariff.inr_per_kwh:.2f}/kWh). Fixed charges, "
        "demand charges, FPPCA, taxes and other billing components are excluded.")
    return f"""
SELECT route_id, concat_ws(chr(10), '{pr.HOURS_NOTE}', '{priced}', '{pr.DISTINCT_NOTE}', '{pr.DISTANCE_NOTE}',
  CASE WHEN lines_missing_loss > 0 THEN lines_missing_loss ||
    ' line(s) used by this route carry no Energy_Loss_MW in the dataset and contribute nothing to the total: '
    || missing || '. The figure is a lower bound.' END,
  CASE WHEN unmatched_steps > 0 THEN unmatched_steps ||
    ' route step(s) could not be matched to a transmission line and were excluded.' END) AS caveats
FROM {table}"""


@query("route_caveats", _caveat_sql("walk_loss"))
def route_caveats(t):
    counts = t.walk_counts
    whole = pr.route_completeness(pr.route_loss(counts), counts)
    return whole.select("route_id", F.array_join(pr.caveats(), "\n").alias("caveats"))


HALF_LOSS = """
half_loss AS (
  SELECT user_id, label, CAST(coalesce(sum(energy_loss_mw) FILTER (matched), 0) AS DECIMAL(28,4)) AS loss,
    CAST(coalesce(sum(distance_km * traversals) FILTER (matched), 0) AS DECIMAL(28,3)) AS km
  FROM half_counts GROUP BY 1, 2),
both_halves AS (
  SELECT user_id, max(loss) FILTER (label = 'classical') AS c, max(loss) FILTER (label = 'hybrid') AS h,
    CAST(max(km) FILTER (label = 'classical') - max(km) FILTER (label = 'hybrid') AS DECIMAL(29,3)) AS km
  FROM half_loss GROUP BY 1)"""


def half_losses(t):
    return pr.route_loss(t.half_counts).withColumn("user_id", F.substring_index("route_id", "/", 1)).withColumn(
        "label", F.substring_index("route_id", "/", -1))


@query("route_comparison", f"""WITH {HALF_LOSS}
SELECT user_id, CAST(c - h AS DECIMAL(29,4)) AS total_energy_loss_mw_difference,
       CAST(CAST(c * 6600 AS DECIMAL(30,4)) - CAST(h * 6600 AS DECIMAL(30,4)) AS DECIMAL(31,4))
         AS loss_cost_per_hour_inr_difference,
       CAST(CAST(CAST(c * 6600 AS DECIMAL(30,4)) * 8760 AS DECIMAL(34,4))
          - CAST(CAST(h * 6600 AS DECIMAL(30,4)) * 8760 AS DECIMAL(34,4)) AS DECIMAL(35,4))
         AS loss_cost_per_year_inr_difference,
       km AS route_km_difference,
       CASE WHEN c = h THEN 'tie' WHEN c > h THEN 'hybrid' WHEN c < h THEN 'classical' END AS lower_loss_route
FROM both_halves""")
def route_comparison(t):
    """Each user's first half against the second, kilometres along the lines included."""
    priced = half_losses(t).join(pr.route_km(t.half_counts), "route_id")
    return pr.route_comparison(priced, "user_id", "label", measures=(*pr.MEASURES, "route_km"))


@query("route_membership", """
SELECT user_id, a, b, CASE WHEN bool_or(label = 'classical') AND bool_or(label = 'hybrid') THEN 'both'
                           WHEN bool_or(label = 'classical') THEN 'nn' ELSE 'qa' END AS route
FROM half_counts WHERE matched GROUP BY 1, 2, 3""")
def route_membership(t):
    return pr.route_membership(t.half_counts.where("matched"), "user_id", "label", "classical", "hybrid")


@query("network_total_loss", "SELECT CAST(sum(energy_loss_mw) AS DECIMAL(28,4)) AS network_loss_mw, count(*) AS lines FROM survey_clean")
def network_total_loss(t):
    return t.survey_clean.agg(F.sum("energy_loss_mw").alias("network_loss_mw"), F.count("*").alias("lines"))


@query("merged_caveats", """
SELECT user_id, c.missing AS first_missing, CASE WHEN c.n = 0 AND c.lost = 0 THEN 4 ELSE 4
       + CAST(c.n > 0 AS INTEGER) + CAST(c.lost > 0 AS INTEGER) END
       + CAST(h.n > 0 AND (h.n, h.missing) IS DISTINCT FROM (c.n, c.missing) AS INTEGER)
       + CAST(h.lost > 0 AND h.lost IS DISTINCT FROM c.lost AS INTEGER) AS notes
FROM (SELECT user_id, label, count(*) FILTER (matched AND energy_loss_mw IS NULL) AS n,
             coalesce(sum(traversals) FILTER (NOT matched), 0) AS lost,
             coalesce(string_agg(a || ' - ' || b, ', ' ORDER BY a || ' - ' || b)
                      FILTER (matched AND energy_loss_mw IS NULL), '') AS missing
      FROM half_counts GROUP BY 1, 2) c
JOIN (SELECT user_id, label, count(*) FILTER (matched AND energy_loss_mw IS NULL) AS n,
             coalesce(sum(traversals) FILTER (NOT matched), 0) AS lost,
             coalesce(string_agg(a || ' - ' || b, ', ' ORDER BY a || ' - ' || b)
                      FILTER (matched AND energy_loss_mw IS NULL), '') AS missing
      FROM half_counts GROUP BY 1, 2) h USING (user_id)
WHERE c.label = 'classical' AND h.label = 'hybrid'""")
def merged_caveats(t):
    """The notes of both halves of a walk, each said once."""
    counts = cut(t.half_counts)
    notes = pr.route_completeness(pr.route_loss(counts), counts).select(
        F.substring_index("route_id", "/", 1).alias("user_id"), F.substring_index("route_id", "/", -1).alias("label"),
        "missing", pr.caveats().alias("notes"))
    both = notes.groupBy("user_id").agg(
        *[F.max(F.when(F.col("label") == side, F.struct("notes", "missing"))).alias(side) for side in ("classical", "hybrid")])
    return both.where("classical IS NOT NULL AND hybrid IS NOT NULL").select(
        "user_id", F.col("classical.missing").alias("first_missing"),
        F.size(pr.merged_caveats(F.col("classical.notes"), F.col("hybrid.notes"))).alias("notes"))


@query("tail_mean", """
WITH samples AS (SELECT event_type, CAST(value AS DECIMAL(18,2)) AS value, count(*) AS weight FROM events GROUP BY 1, 2),
run AS (SELECT *, sum(weight) OVER (PARTITION BY event_type ORDER BY value) AS upto,
               sum(weight) OVER (PARTITION BY event_type) AS total FROM samples),
used AS (SELECT *, greatest(0, least(weight, greatest(1, CAST(round_even(0.25 * total, 0) AS BIGINT)) - (upto - weight))) AS u FROM run)
SELECT event_type, CAST(sum(u) AS BIGINT) AS taken, round(CAST(sum(value * u) AS DOUBLE) / CAST(sum(u) AS DOUBLE), 6) AS tail_mean
FROM used WHERE u > 0 GROUP BY 1""")
def tail_mean(t):
    samples = t.events.selectExpr(
        "event_type", "CAST(value AS DECIMAL(18,2)) AS value", "CAST(floor(value) AS BIGINT) AS slice",
        "1L AS weight", "CAST(0.25 AS DECIMAL(3,2)) AS alpha")
    return cp.tail_mean(samples, "event_type", "slice")
