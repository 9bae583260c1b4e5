"""Queries on tours: built, improved, measured and checked."""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import functions as F

from gridloom.operators import compare as cp
from gridloom.operators import tours as tr
from gridloom.operators.long_tours import window_scores_long as window_scores_of_long
from gridloom.operators.sequence import with_position
from gridloom.operators.paths import instances_checked
from gridloom.plans.registry import query
from gridloom.session import cut


def named(tours):
    """Tours with their stops as one text, so that two engines can compare them."""
    return tours.select("instance_id", F.array_join(tr.stop_names(), ">").alias("stops"), "total_km")


@query("nn_tours", "SELECT start, array_to_string(stops, '>') AS stops, total_km FROM net_orders")
def nn_tours(t):
    return t.net_tours.select("start", F.array_join(tr.stop_names(), ">").alias("stops"), "total_km")


@query("nn_on_instance", "SELECT instance_id, array_to_string(stops, '>') AS stops, total_km FROM inst_tours")
def nn_on_instance(t):
    """A nearest-neighbour tour inside the instance around every customer and supplier."""
    return named(tr.nn_tours(t.instance_tables, t.instance_starts))


@query("nn_tours_by_rounds", "SELECT instance_id AS tour_id, array_to_string(stops, '>') AS stops FROM inst_tours")
def nn_tours_by_rounds(t):
    """The same tours, built one join per step as for networks of any size."""
    closure = t.instance_costs.select("origin", "node", "km").distinct()
    pool = t.instances.select(F.col("instance_id").alias("tour_id"), "name")
    visits = tr.nn_tours_by_rounds(closure, pool.select("tour_id", F.col("tour_id").alias("start")).distinct(), pool)
    return visits.groupBy("tour_id").agg(F.array_sort(F.collect_list(F.struct("step", "name"))).alias("s")).select(
        "tour_id", F.array_join(F.transform("s", lambda x: x["name"]), ">").alias("stops"))


@query("exact_tours", "SELECT instance_id, array_to_string(stops, '>') AS stops, total_km FROM inst_exact")
def exact_tours(t):
    return named(tr.exact_tours(t.instance_tables, t.instance_starts))


@query("cost_matrix", "SELECT instance_id, origin, node, km FROM inst_costs")
def cost_matrix(t):
    return t.instance_costs


@query("instance_build", """
SELECT instance_id, count(DISTINCT origin) AS size, count(*) FILTER (km IS NULL) AS unreachable,
       CAST(sum(km) AS DECIMAL(28,3)) AS matrix_km, max(km) AS longest_km,
       string_agg(DISTINCT origin, '>' ORDER BY origin) AS names
FROM inst_costs GROUP BY 1""")
def instance_build(t):
    return t.instance_costs.groupBy("instance_id").agg(
        F.count_distinct("origin").alias("size"), F.count_if(F.col("km").isNull()).alias("unreachable"),
        F.sum("km").alias("matrix_km"), F.max("km").alias("longest_km"),
        F.array_join(F.array_sort(F.collect_set("origin")), ">").alias("names"))


@query("instance_facts", """
SELECT instance_id, size, size < total AS is_subset, (size - 1) * (size - 1) AS variables,
       (total - 1) * (total - 1) AS full_variables
FROM (SELECT instance_id, count(*) AS size, (SELECT count(*) FROM grid_stations) AS total FROM inst GROUP BY 1)""")
def instance_facts(t):
    total = t.grid_stations.agg(F.count("*").alias("n")).scalar()
    sizes = t.instances.groupBy("instance_id").agg(F.count("*").alias("size")).withColumn("total", total)
    return sizes.select(
        "instance_id", "size", (F.col("size") < F.col("total")).alias("is_subset"),
        ((F.col("size") - 1) * (F.col("size") - 1)).alias("variables"),
        ((F.col("total") - 1) * (F.col("total") - 1)).alias("full_variables"))


@query("tour_legs", """
SELECT tour_id, step, origin, destination, km, array_to_string(path, '>') AS path, is_direct FROM net_legs""")
def tour_legs(t):
    return t.net_legs.select(
        "tour_id", "step", "origin", "destination", "km", F.array_join("path", ">").alias("path"), "is_direct")


@query("nearest_pick", """
SELECT origin, node, km FROM (
  SELECT *, row_number() OVER (PARTITION BY origin ORDER BY km, node) AS rn FROM net_closure WHERE origin <> node)
WHERE rn = 1""")
def nearest_pick(t):
    """The nearest other station of every station, a tie going to the first name."""
    best = t.net_closure.where("origin <> node").groupBy("origin").agg(F.min(F.struct("km", "node")).alias("pick"))
    return best.select("origin", "pick.node", "pick.km")


@query("tour_length", """
SELECT tour_id, CAST(sum(km) AS DECIMAL(28,3)) AS closed_km,
       CAST(sum(km) FILTER (step < (SELECT count(*) FROM nation)) AS DECIMAL(28,3)) AS open_km
FROM net_legs GROUP BY 1""")
def tour_length(t):
    orders = t.net_orders
    closed = tr.tour_length(orders, t.net_closure).withColumnRenamed("km", "closed_km")
    return closed.join(tr.tour_length(orders, t.net_closure, closed=False).withColumnRenamed("km", "open_km"), "tour_id")


@query("segment_length", """
SELECT instance_id AS tour_id, CAST(sum(c.km) AS DECIMAL(28,3)) AS km
FROM (SELECT instance_id, unnest(stops[:5]) AS origin, unnest(stops[2:]) AS node FROM inst_tours) l
JOIN inst_costs c USING (instance_id, origin, node) GROUP BY 1""")
def segment_length(t):
    """Open length of the tour inside every instance."""
    orders = tr.nn_tours(t.instance_tables, t.instance_starts).select(
        F.col("instance_id").alias("tour_id"), tr.stop_names().alias("stops"))
    return tr.tour_length(orders, t.instance_distances, closed=False)


@query("tour_totals", """
SELECT tour_id, CAST(sum(km) AS DECIMAL(28,3)) AS total_km, count(*) AS stations_visited,
       count(*) FILTER (is_direct) AS direct_legs,
       string_agg(origin, '>' ORDER BY step) || '>' || max_by(destination, step) AS closed_route
FROM net_legs GROUP BY 1""")
def tour_totals(t):
    return tr.tour_totals(t.net_legs).withColumn("closed_route", F.array_join("closed_route", ">"))


@query("physical_path", """
SELECT tour_id, tour_id || '>' || string_agg(array_to_string(path[2:], '>'), '>' ORDER BY step) AS path
FROM net_legs GROUP BY 1""")
def physical_path(t):
    return tr.physical_path(t.net_legs).withColumn("path", F.array_join("path", ">"))


@query("via_slice", """
SELECT tour_id, step, array_to_string(path[2:len(path) - 1], '>') AS via FROM net_legs""")
def via_slice(t):
    return t.net_legs.select("tour_id", "step", F.array_join(tr.via_slice(F.col("path")), ">").alias("via"))


@query("visited_so_far", """
SELECT l.tour_id, l.step, count(DISTINCT e.destination) AS visited
FROM net_legs l LEFT JOIN net_legs e ON e.tour_id = l.tour_id AND e.step < l.step GROUP BY 1, 2""")
def visited_so_far(t):
    """How many stations a tour has reached before each leg."""
    firsts = t.net_legs.groupBy("tour_id", "destination").agg(F.min("step").alias("step"))
    from gridloom.operators.sequence import with_running_sum

    fresh = t.net_legs.select("tour_id", "step").join(
        firsts.select("tour_id", "step", F.lit(1).alias("fresh")), ["tour_id", "step"], "left"
    ).fillna(0, ["fresh"]).withColumn("slice", F.expr("step div 1000"))
    return with_running_sum(fresh, ["tour_id"], "slice", ["step"], "fresh", "upto").select(
        "tour_id", "step", (F.col("upto") - F.col("fresh")).alias("visited"))


#: Every tour also in versions that a check has to turn away: a stop missing, a stop twice, turned by one place, a wrong
#: total and a wrong leg, the way back missing, a leg without its chain.
_BROKEN = """
variants AS (
  SELECT tour_id || kind AS tour_id, kind, start, total_km + CASE WHEN kind = '-costly' THEN 1 ELSE 0 END AS total_km,
    CASE kind WHEN '-short' THEN stops[:len(stops) - 1] WHEN '-twice' THEN list_append(stops[:len(stops) - 1], stops[2])
      WHEN '-turned' THEN list_append(stops[2:], stops[1]) ELSE stops END AS stops
  FROM net_orders, (VALUES (''), ('-short'), ('-twice'), ('-turned'), ('-costly'), ('-open'), ('-cut')) v(kind)),
variant_legs AS (
  SELECT tour_id, step, l.origin, l.destination, c.km + CASE WHEN kind = '-costly' AND step = 1 THEN 1 ELSE 0 END AS km, c.km AS way,
    CASE WHEN kind = '-cut' AND step = 1 THEN [l.origin] ELSE path END AS path
  FROM (SELECT tour_id, kind, len(stops) AS n, unnest(range(1, len(stops) + 1)) AS step, unnest(stops) AS origin,
               unnest(list_append(stops[2:], stops[1])) AS destination FROM variants) l
  LEFT JOIN net_closure c ON c.origin = l.origin AND c.node = l.destination
  WHERE NOT (kind = '-open' AND step = n)),
leg_facts AS (
  SELECT tour_id, sum(way) AS way, max_by(destination, step) AS last, count(*) AS legs,
    bool_and(km IS NOT NULL AND len(path) >= 2 AND path[1] = origin AND path[len(path)] = destination) AS legs_real,
    bool_and(coalesce(km = way, false)) AS costs_agree
  FROM variant_legs GROUP BY 1),
everyone AS (SELECT list(n_name ORDER BY n_name) AS names FROM nation)"""


def broken_orders(t):
    """The nation tours and their broken versions: (tour_id, kind, start, stops, total_km)."""
    n, stops = F.size("stops"), F.col("stops")
    but_last = F.slice(stops, F.lit(1), n - 1)
    made = {
        "": stops, "-short": but_last, "-twice": F.array_append(but_last, F.get(stops, F.lit(1))),
        "-turned": F.array_append(F.slice(stops, F.lit(2), n - 1), F.get(stops, F.lit(0))), "-costly": stops, "-open": stops, "-cut": stops}
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), s.alias("stops")) for k, s in made.items()])
    return t.net_orders.select("tour_id", "start", "total_km", F.inline(kinds)).select(
        F.concat("tour_id", "kind").alias("tour_id"), "kind", "start", "stops",
        (F.col("total_km") + F.when(F.col("kind") == "-costly", 1).otherwise(0)).alias("total_km"))


def broken_legs(t, orders):
    """Their travelled legs."""
    legs = tr.travelled_legs(tr.tour_legs(orders), t.net_closure, t.net_cut).join(orders.select("tour_id", "kind", F.size("stops").alias("n")), "tour_id")
    first = F.col("step") == 1
    return legs.where("NOT (kind = '-open' AND step = n)").withColumn(
        "km", F.col("km") + F.when((F.col("kind") == "-costly") & first, 1).otherwise(0)).withColumn(
        "path", F.when((F.col("kind") == "-cut") & first, F.array("origin")).otherwise(F.col("path"))).drop("kind", "n")


@query("tour_validation", f"""WITH {_BROKEN}
SELECT *, same_stations AND none_repeated AND right_start AND closes AND legs_real AND total_matches AS valid
FROM (SELECT tour_id, list_sort(list_distinct(stops)) = names AS same_stations, len(stops) = len(list_distinct(stops)) AS none_repeated,
             stops[1] = start AS right_start, last = start AND legs = len(stops) AS closes, legs_real,
             abs(total_km - way) < 0.000001 AS total_matches
      FROM variants JOIN leg_facts USING (tour_id), everyone)""")
def tour_validation(t):
    """Every tour and every broken version of it."""
    orders = cut(broken_orders(t))
    pool = orders.select("tour_id", "start").join(
        t.net_tours.select("start", F.explode("names").alias("name")), "start").select("tour_id", "name")
    return cp.tour_validation(orders, broken_legs(t, orders), pool, t.net_closure)


@query("leg_cost_check", f"WITH {_BROKEN} SELECT tour_id, costs_agree FROM leg_facts")
def leg_cost_check(t):
    """The legs of every tour, also of one with a wrong leg, against the network."""
    return cp.leg_cost_check(broken_legs(t, broken_orders(t)), t.net_closure)


@query("circular_window", """
SELECT tour_id AS start, CAST(o AS INTEGER) AS offset_at,
       array_to_string([stops[1 + (o + k) % len(stops)] FOR k IN range(0, 6)], '>') AS seats
FROM (SELECT *, unnest(range(0, len(stops))) AS o FROM net_orders)""")
def circular_window(t):
    return tr.circular_windows(t.net_tours, 4).select(
        "start", F.col("offset").alias("offset_at"),
        F.array_join(F.transform("seats", lambda s: F.get(F.col("names"), s)), ">").alias("seats"))


_W = 3
_PERMS = ", ".join(str(tuple(p)) for p in permutations(range(1, _W + 1)))


@query("window_scores", f"""
WITH seats AS (
  SELECT instance_id, o, [stops[1 + (o + k) % 6] FOR k IN range(0, 5)] AS s
  FROM (SELECT *, unnest(range(0, 6)) AS o FROM inst_tours)),
perms AS (SELECT * FROM (VALUES {_PERMS}) AS v(p1, p2, p3)),
tried AS (
  SELECT instance_id, o, s, p1, p2, p3, [s[1], s[1 + p1], s[1 + p2], s[1 + p3], s[5]] AS walk FROM seats, perms),
scored AS (
  SELECT t.instance_id, o, s, p1, p2, p3, CAST(c1.km + c2.km + c3.km + c4.km AS DECIMAL(18,3)) AS km
  FROM tried t
  JOIN inst_costs c1 ON c1.instance_id = t.instance_id AND c1.origin = walk[1] AND c1.node = walk[2]
  JOIN inst_costs c2 ON c2.instance_id = t.instance_id AND c2.origin = walk[2] AND c2.node = walk[3]
  JOIN inst_costs c3 ON c3.instance_id = t.instance_id AND c3.origin = walk[3] AND c3.node = walk[4]
  JOIN inst_costs c4 ON c4.instance_id = t.instance_id AND c4.origin = walk[4] AND c4.node = walk[5])
SELECT instance_id, CAST(o AS INTEGER) AS offset_at, max(km) FILTER (p1 = 1 AND p2 = 2) AS current_km, min(km) AS best_km,
       first(s[1 + p1] || '>' || s[1 + p2] || '>' || s[1 + p3] ORDER BY km, p1, p2) AS ordering
FROM scored GROUP BY 1, 2""")
def window_scores(t):
    """Every window of every instance tour, three stations free."""
    tours = tr.nn_tours(t.instance_tables, t.instance_starts)
    return tr.window_scores(tours, _W).select(
        "instance_id", F.col("offset").alias("offset_at"), "current_km", "best_km",
        F.array_join("ordering", ">").alias("ordering"))


def _reoptimised(tours: str, costs: str, window: int, sweeps: int) -> str:
    """The improvement as recursive SQL: one row per tour and window looked at; `tours` has (id, stops, total_km), `costs` (id, origin, node, km)."""
    orders = "[" + ", ".join(str(list(p)) for p in permutations(range(1, window + 1))) + "]"
    seat = "(o + {k}) % n + 1"
    seats = "[" + ", ".join(f"stops[{seat.format(k=k)}]" for k in range(window + 2)) + "]"

    def metres(walk: list[str]) -> str:
        return " + ".join(f"m[{x}][{y}]" for x, y in zip(walk, walk[1:]))

    now = metres([f"seats[{k}]" for k in range(1, window + 3)])
    tried = metres(["seats[1]", *[f"seats[1 + p[{k}]]" for k in range(1, window + 1)], f"seats[{window + 2}]"])
    back = "(i - o - 2 + n) % n"
    return f"""
WITH tour_rows AS (SELECT id, origin, list(CAST(km * 1000 AS BIGINT) ORDER BY node) AS line FROM ({costs}) GROUP BY 1, 2),
tour_tables AS (SELECT id AS key, list(line ORDER BY origin) AS m, list(origin ORDER BY origin) AS names FROM tour_rows GROUP BY 1),
tour_starts AS (
  SELECT id, key, total_km AS start_km, len(stops) AS n, [CAST(list_position(names, s) AS BIGINT) FOR s IN stops] AS stops
  FROM ({tours}) JOIN tour_tables USING (key)),
improving(id, key, t, n, stops, dirty, improved, done, sweeps, solved, skipped, accepted) AS (
  SELECT id, key, 0, n, stops, stops, false, false, 0, 0, 0, 0 FROM tour_starts
  UNION ALL
  SELECT id, key, t + 1, n,
    CASE WHEN better THEN [CASE WHEN {back} < {window} THEN seats[1 + best.p[1 + {back}]] ELSE stops[i] END FOR i IN range(1, n + 1)] ELSE stops END,
    CASE WHEN skip THEN dirty WHEN better THEN list_distinct(list_concat(dirty, seats)) ELSE [d FOR d IN dirty IF d <> seats[1]] END,
    (o > 0 AND improved) OR better, o = n - 1 AND NOT ((o > 0 AND improved) OR better),
    sweeps + CASE WHEN o = 0 THEN 1 ELSE 0 END, solved + CASE WHEN skip THEN 0 ELSE 1 END,
    skipped + CASE WHEN skip THEN 1 ELSE 0 END, accepted + CASE WHEN better THEN 1 ELSE 0 END
  FROM (SELECT *, NOT skip AND best.m < {now} AS better
        FROM (SELECT *, list_sort([{{'m': {tried}, 'p': p}} FOR p IN {orders}])[1] AS best, NOT list_has_any(dirty, seats) AS skip
              FROM (SELECT r.*, t % n AS o, m, {seats.replace("(o +", "(t % n +")} AS seats
                    FROM improving r JOIN tour_tables USING (key) WHERE NOT done AND t < n * {sweeps})))),
last_rows AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY t DESC) AS rn FROM improving) WHERE rn = 1),
turned AS (
  SELECT l.*, s.start_km, names, m,
    list_concat(l.stops[list_position(l.stops, s.stops[1]):], l.stops[1:list_position(l.stops, s.stops[1]) - 1]) AS walk
  FROM last_rows l JOIN tour_starts s ON s.id = l.id JOIN tour_tables t ON t.key = l.key)
SELECT id AS {{id}}, array_to_string([names[w] FOR w IN walk], '>') AS stops, start_km,
  CAST(list_sum([m[walk[i]][walk[i % n + 1]] FOR i IN range(1, n + 1)]) AS DECIMAL(18,0)) * CAST(0.001 AS DECIMAL(4,3)) AS total_km,
  sweeps AS sweeps_run, solved, skipped, accepted
FROM turned"""


_NET = _reoptimised(
    "SELECT start AS id, 'net' AS key, stops, total_km FROM net_orders",
    "SELECT 'net' AS id, origin, node, km FROM net_closure", 4, 8).replace("{id}", "start")
_INSTANCES = _reoptimised(
    "SELECT instance_id AS id, instance_id AS key, stops, total_km FROM inst_tours",
    "SELECT instance_id AS id, origin, node, km FROM inst_costs", 4, 3).replace("{id}", "instance_id")


@query("window_reoptimize", _NET)
def window_reoptimize(t):
    """The nation tours after eight sweeps with four stations free."""
    better = tr.window_reoptimize(t.net_tours, window=4, sweeps=8)
    return better.select("start", F.array_join(tr.stop_names(), ">").alias("stops"), "start_km", "total_km",
                         "sweeps_run", "solved", "skipped", "accepted")


@query("window_reoptimize_instances", _INSTANCES)
def window_reoptimize_instances(t):
    """The same on the instance around every customer and supplier."""
    better = tr.window_reoptimize(tr.nn_tours(t.instance_tables, t.instance_starts), window=4, sweeps=3)
    return better.select("instance_id", F.array_join(tr.stop_names(), ">").alias("stops"), "start_km", "total_km",
                         "sweeps_run", "solved", "skipped", "accepted")


_WIDE = 6
_WIDE_ORDERS = "[" + ", ".join(str(list(p)) for p in permutations(range(1, _WIDE + 1))) + "]"
_STEP = "abs(xs[{a}] - xs[{b}]) + abs(ys[{a}] - ys[{b}])"


def _walked(places: list[str]) -> str:
    return " + ".join(_STEP.format(a=a, b=b) for a, b in zip(places, places[1:]))


@query("window_scores_long", f"""
WITH placed AS (
  SELECT label, vec_id, CAST(floor(CAST(embedding[1] AS DOUBLE) * 1000) AS BIGINT) AS x, CAST(floor(CAST(embedding[2] AS DOUBLE) * 1000) AS BIGINT) AS y
  FROM embeddings WHERE isfinite(embedding[1]) AND isfinite(embedding[2])),
routes AS (SELECT label, count(*) AS n, list(vec_id ORDER BY vec_id) AS ids, list(x ORDER BY vec_id) AS px, list(y ORDER BY vec_id) AS py FROM placed GROUP BY 1),
seats AS (
  SELECT label, o, [ids[1 + (o + k) % n] FOR k IN range(0, {_WIDE + 2})] AS s, [px[1 + (o + k) % n] FOR k IN range(0, {_WIDE + 2})] AS xs,
    [py[1 + (o + k) % n] FOR k IN range(0, {_WIDE + 2})] AS ys
  FROM (SELECT *, unnest(range(0, n)) AS o FROM routes WHERE n >= {_WIDE + 2})),
scored AS (
  SELECT label, o, s, {_walked([str(k) for k in range(1, _WIDE + 3)])} AS now,
    list_sort([{{'m': {_walked(["1", *[f"(1 + p[{k}])" for k in range(1, _WIDE + 1)], str(_WIDE + 2)])}, 'p': p}} FOR p IN {_WIDE_ORDERS}])[1] AS best
  FROM seats)
SELECT label AS tour_id, o AS offset_at, CAST(now AS DECIMAL(18,0)) * CAST(0.001 AS DECIMAL(4,3)) AS current_km,
  CAST(best.m AS DECIMAL(18,0)) * CAST(0.001 AS DECIMAL(4,3)) AS best_km, array_to_string([s[1 + k] FOR k IN best.p], '>') AS ordering
FROM scored""")
def window_scores_long(t):
    """Windows of six free stations on one long route per label, in the order of the ids; ways go along the axes."""
    places = t.embeddings.selectExpr(
        "label", "vec_id", "CAST(floor(CAST(embedding[0] AS DOUBLE) * 1000) AS BIGINT) AS x",
        "CAST(floor(CAST(embedding[1] AS DOUBLE) * 1000) AS BIGINT) AS y").where("x IS NOT NULL AND y IS NOT NULL")
    long = t.embeddings.where("embedding[0] = embedding[0] AND embedding[1] = embedding[1]").select("label", "vec_id")
    slices = long.withColumn("slice", F.expr("vec_id div 1000"))
    stops = with_position(slices, ["label"], "slice", ["vec_id"]).where(F.col("step_count") >= _WIDE + 2).select(
        F.col("label").alias("tour_id"), (F.col("step") - 1).alias("position"), F.col("vec_id").alias("name"))

    def distances(pairs):
        a = places.select(F.col("vec_id").alias("origin"), F.col("x").alias("ax"), F.col("y").alias("ay"))
        b = places.select(F.col("vec_id").alias("node"), F.col("x").alias("bx"), F.col("y").alias("by"))
        return pairs.join(a, "origin").join(b, "node").select(
            "origin", "node", tr.to_km(F.abs(F.col("ax") - F.col("bx")) + F.abs(F.col("ay") - F.col("by"))).alias("km"))

    return window_scores_of_long(stops, distances, _WIDE).select(
        "tour_id", F.col("offset").alias("offset_at"), "current_km", "best_km",
        F.array_join(F.transform("ordering", lambda x: x.cast("string")), ">").alias("ordering"))


@query("instance_status", """
SELECT start AS instance_id, count(*) AS stations, CASE WHEN count(*) < 6 THEN 'too few stations within reach' ELSE 'ok' END AS status
FROM grid_near GROUP BY 1""")
def instance_status(t):
    """Every start, also those that get no instance because too few stations can be reached."""
    return instances_checked(t.near, 6)


def both_tours(t):
    """The nearest-neighbour tour and the exact one of every instance, side by side."""
    nn = tr.nn_tours(t.instance_tables, t.instance_starts).select("instance_id", F.col("total_km").alias("nn_km"))
    best = tr.exact_tours(t.instance_tables, t.instance_starts).select(
        "instance_id", F.col("total_km").alias("hybrid_km"))
    return nn.join(best, "instance_id")


@query("tour_comparison", """
SELECT instance_id, n.total_km AS nn_km, e.total_km AS hybrid_km,
       CAST(n.total_km - e.total_km AS DECIMAL(18,3)) AS improvement_km,
       CAST(round(CAST(n.total_km - e.total_km AS DOUBLE) * 100 / CAST(n.total_km AS DOUBLE), 2) AS DECIMAL(9,2)) AS improvement_percent,
       CASE WHEN n.total_km = e.total_km THEN 'tie' WHEN n.total_km > e.total_km THEN 'hybrid' ELSE 'classical' END AS winner
FROM inst_tours n JOIN inst_exact e USING (instance_id)""")
def tour_comparison(t):
    return cp.tour_comparison(both_tours(t))


@query("optimality_gap", """
SELECT n.instance_id, solver, km, e.total_km AS optimum,
       round((CAST(km AS DOUBLE) / CAST(e.total_km AS DOUBLE) - 1) * 100, 6) AS gap_percent
FROM (SELECT instance_id, 'nn' AS solver, total_km AS km FROM inst_tours
      UNION ALL SELECT instance_id, 'exact', total_km FROM inst_exact) n
JOIN inst_exact e USING (instance_id)""")
def optimality_gap(t):
    lengths = both_tours(t).select("instance_id", F.inline(F.array(
        F.struct(F.lit("nn").alias("solver"), F.col("nn_km").alias("km")),
        F.struct(F.lit("exact").alias("solver"), F.col("hybrid_km").alias("km")))))
    return cp.optimality_gap(lengths)


@query("same_problem_checks", f"""WITH {_BROKEN}
SELECT tour_id, list_sort(stops) = names AS same_stations,
       CASE WHEN kind = '-turned' THEN stops[1] = start ELSE true END AS same_start, costs_agree AS same_costs,
       last = CASE WHEN kind = '-turned' THEN stops[1] ELSE start END AS both_close
FROM variants JOIN leg_facts USING (tour_id), everyone""")
def same_problem_checks(t):
    """The first tours and their broken versions, a turned one with a start of its own, against the improved ones, which keep station set and start."""
    orders = cut(broken_orders(t).withColumn("own_start", F.when(F.col("kind") == "-turned", F.get("stops", F.lit(0))).otherwise(F.col("start"))))
    first_legs = broken_legs(t, orders.drop("own_start"))
    better = tr.window_reoptimize(t.net_tours, window=3, sweeps=1).select("start", tr.stop_names().alias("stops"))
    second = cut(orders.select("tour_id", "start").join(better, "start"))
    legs = tr.travelled_legs(tr.tour_legs(second), t.net_closure, t.net_cut)

    def closing(orders, steps):
        last = steps.groupBy("tour_id").agg(F.max_by("destination", "step").alias("last"))
        return orders.join(last, "tour_id").withColumn("closes", F.col("last") == F.col("start"))

    first = orders.select("tour_id", F.col("own_start").alias("start"), "stops")
    return cp.same_problem_checks(
        closing(first, first_legs), closing(second, legs),
        cp.leg_cost_check(first_legs, t.net_closure), cp.leg_cost_check(legs, t.net_closure))


@query("set_equality", """
SELECT instance_id, list_sort(n.stops) = list_sort(e.stops) AS equal
FROM inst_tours n JOIN inst_exact e USING (instance_id)""")
def set_equality(t):
    def stops(tours):
        return tours.select("instance_id", F.explode(tr.stop_names()).alias("name"))

    return cp.set_equality(
        stops(tr.nn_tours(t.instance_tables, t.instance_starts)),
        stops(tr.exact_tours(t.instance_tables, t.instance_starts)), ["instance_id"], "name")
