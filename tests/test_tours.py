"""Paths and tours against plain Python on small networks."""

from __future__ import annotations

import itertools
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from gridloom.operators import compare as cp
from gridloom.operators import components as cc
from gridloom.operators import hubs
from gridloom.operators import long_tours as lt
from gridloom.operators import paths as sp
from gridloom.operators import tours as tr
from gridloom.session import shared_dir


def all_distances(edges):
    nodes = sorted({n for a, b, _ in edges for n in (a, b)})
    inf = float("inf")
    d = {(a, b): 0 if a == b else inf for a in nodes for b in nodes}
    for a, b, km in edges:
        d[a, b] = d[b, a] = min(d[a, b], km)
    for k, i, j in itertools.product(nodes, repeat=3):
        d[i, j] = min(d[i, j], d[i, k] + d[k, j])
    return nodes, d


def random_edges(seed, n=11):
    rng = random.Random(seed)
    names = [f"n{i:02d}" for i in range(n)]
    edges = [(names[i], names[rng.randrange(i)], rng.randrange(1, 30)) for i in range(1, n)]
    edges += [(*rng.sample(names, 2), rng.randrange(1, 30)) for _ in range(n)]
    best = {}
    for a, b, km in edges:
        key = (min(a, b), max(a, b))
        best[key] = min(km, best.get(key, km))
    return [(a, b, km) for (a, b), km in best.items()]


def frame(spark, edges):
    return spark.createDataFrame(edges, "a string, b string, km int").selectExpr(
        "a", "b", "CAST(km AS DECIMAL(18,3)) AS distance_km")


@pytest.mark.parametrize("seed", [1, 2])
def test_paths_and_tours_match_plain_python(spark, seed):
    edges = random_edges(seed)
    nodes, d = all_distances(edges)
    net = frame(spark, edges)
    origins = spark.createDataFrame([(n,) for n in nodes], "origin string")
    closure = sp.shortest_paths(net, origins)
    rows = closure.collect()
    assert {(r["origin"], r["node"]): int(r["km"]) for r in rows} == {k: v for k, v in d.items()}
    for r in rows:
        assert sum(d[a, b] for a, b in zip(r["path"], r["path"][1:])) == r["km"]

    near = sp.nearest_stations(net, origins, 3).collect()
    for o in nodes:
        want = sorted(nodes, key=lambda n: (d[o, n], n != o, n))[:4]
        assert [r["node"] for r in sorted((r for r in near if r["origin"] == o), key=lambda r: r["rank"])] == want

    members = origins.select(F.lit("i").alias("instance_id"), F.col("origin").alias("name"))
    tables = tr.matrices(tr.cost_pairs(members, closure))
    starts = origins.select(F.lit("i").alias("instance_id"), F.col("origin").alias("start"))
    nn = tr.nn_tours(tables, starts).cache()
    orders = {r["start"]: r["stops"] for r in nn.select("start", tr.stop_names().alias("stops")).collect()}
    for start, order in orders.items():
        left, walk = set(nodes) - {start}, [start]
        while left:
            walk.append(min(left, key=lambda n: (d[walk[-1], n], n)))
            left.remove(walk[-1])
        assert order == walk

    for window in (3, 4):
        pruned, full = (tr.window_reoptimize(nn, window, 50, p).cache() for p in (True, False))
        assert {(r["start"], r["total_km"]) for r in pruned.collect()} == {(r["start"], r["total_km"]) for r in full.collect()}
        assert all(r["current_km"] == r["best_km"] for r in tr.window_scores(pruned, window).collect())
        for r in pruned.withColumn("order", tr.stop_names()).collect():
            assert r["order"][0] == r["start"] and sorted(r["order"]) == nodes
            assert int(r["total_km"]) == sum(d[a, b] for a, b in zip(r["order"], r["order"][1:] + r["order"][:1]))
            assert r["total_km"] <= r["start_km"] and (r["accepted"] > 0) == (r["total_km"] < r["start_km"])
            assert r["solved"] + r["skipped"] == r["sweeps_run"] * len(nodes)
        assert all(r["skipped"] == 0 for r in full.collect())

    legs = tr.travelled_legs(
        tr.tour_legs(nn.select(F.col("start").alias("tour_id"), tr.stop_names().alias("stops"))), closure, net)
    checked = cp.tour_validation(
        nn.select(F.col("start").alias("tour_id"), "start", tr.stop_names().alias("stops"), "total_km"), legs,
        nn.select(F.col("start").alias("tour_id"), F.explode("names").alias("name")), closure)
    assert all(r["valid"] for r in checked.collect()) and checked.count() == len(nodes)


def test_exact_tours_match_enumeration(spark):
    edges = random_edges(5, 6)
    nodes, d = all_distances(edges)
    origins = spark.createDataFrame([(n,) for n in nodes], "origin string")
    closure = sp.shortest_paths(frame(spark, edges), origins, chains=False)
    tables = tr.matrices(tr.cost_pairs(origins.select(F.lit("i").alias("instance_id"), F.col("origin").alias("name")), closure))
    starts = origins.select(F.lit("i").alias("instance_id"), F.col("origin").alias("start"))
    for r in tr.exact_tours(tables, starts, 6).collect():
        rest = [n for n in nodes if n != r["start"]]
        best = min(sum(d[a, b] for a, b in zip([r["start"], *p], [*p, r["start"]])) for p in itertools.permutations(rest))
        assert int(r["total_km"]) == best


def subset_best(d, start, rest, last):
    """Length of the shortest way from start over all of rest to last, in plain Python."""
    best = {(frozenset([k]), k): d[start, k] for k in rest}
    for size in range(2, len(rest) + 1):
        for group in map(frozenset, itertools.combinations(rest, size)):
            for k in group:
                best[group, k] = min(best[group - {k}, j] + d[j, k] for j in group - {k})
    whole = frozenset(rest)
    return min(best[whole, k] + d[k, last] for k in rest)


def test_exact_tours_of_2_to_13_stations_in_one_call(spark):
    edges = random_edges(8, 13)
    nodes, d = all_distances(edges)
    closure = sp.shortest_paths(frame(spark, edges), spark.createDataFrame([(n,) for n in nodes], "origin string"), chains=False)
    members = spark.createDataFrame([(f"i{n}", name) for n in range(2, 14) for name in nodes[:n]], "instance_id string, name string")
    starts = spark.createDataFrame([(f"i{n}", nodes[n // 2]) for n in range(2, 14)], "instance_id string, start string")
    got = {r["instance_id"]: r for r in tr.exact_tours(tr.matrices(tr.cost_pairs(members, closure)), starts, 13).collect()}
    for n in range(2, 14):
        r, start = got[f"i{n}"], nodes[n // 2]
        walk = [r["names"][k] for k in r["stops"]]
        rest = [x for x in nodes[:n] if x != start]
        assert walk[0] == start and sorted(walk) == nodes[:n]
        assert int(r["total_km"]) == sum(d[a, b] for a, b in zip(walk, walk[1:] + walk[:1])) == subset_best(d, start, rest, start)
        if n <= 8:  # of equal tours the first in order
            orders = [(sum(d[a, b] for a, b in zip([start, *p], [*p, start])), list(p)) for p in itertools.permutations(rest)]
            assert walk[1:] == min(orders)[1]


def test_windows_of_more_than_five(spark):
    edges = random_edges(9, 12)
    nodes, d = all_distances(edges)
    origins = spark.createDataFrame([(n,) for n in nodes], "origin string")
    closure = sp.shortest_paths(frame(spark, edges), origins, chains=False)
    tables = tr.matrices(tr.cost_pairs(origins.select(F.lit("i").alias("instance_id"), F.col("origin").alias("name")), closure))
    tours = tr.nn_tours(tables, origins.limit(1).select(F.lit("i").alias("instance_id"), F.col("origin").alias("start"))).cache()
    order = tours.select(tr.stop_names().alias("s")).first()["s"]
    for r in tr.window_scores(tours, 7).collect():
        seats = [order[(r["offset"] + k) % 12] for k in range(9)]
        assert int(r["best_km"]) == subset_best(d, seats[0], seats[1:8], seats[8]) and sorted(r["ordering"]) == sorted(seats[1:8])
        assert int(r["current_km"]) == sum(d[a, b] for a, b in zip(seats, seats[1:]))
    better = tr.window_reoptimize(tours, 6, 20).cache()
    assert better.first()["total_km"] <= better.first()["start_km"]
    assert all(r["current_km"] == r["best_km"] for r in tr.window_scores(better, 6).collect())


def test_windows_of_a_tour_of_3000_stations(spark):
    """Stations on a ring of lines, visited with some neighbours swapped and some runs turned round."""
    n, rng = 3000, random.Random(12)
    order = list(range(n))
    for at in range(5, n - 10, 40):
        order[at:at + 4] = rng.sample(order[at:at + 4], 4)
    ring = lambda a, b: min((a - b) % n, (b - a) % n)

    def distances(pairs):
        return pairs.withColumn("d", F.pmod(F.substring("origin", 2, 9).cast("int") - F.substring("node", 2, 9).cast("int"), F.lit(n))).select(
            "origin", "node", F.least("d", n - F.col("d")).cast("decimal(18,3)").alias("km"))

    stops = spark.createDataFrame([("t", k, f"s{x}") for k, x in enumerate(order)] + [("u", k, f"s{k * 3}") for k in range(9)], "tour_id string, position int, name string")
    scores = {(r["tour_id"], r["offset"]): r for r in lt.window_scores_long(stops, distances, 7).collect()}
    assert len(scores) == n + 9
    for o in [*rng.sample(range(n), 25), n - 1, n - 5]:
        seats = [order[(o + k) % n] for k in range(9)]
        r, d = scores["t", o], {(a, b): ring(a, b) for a in seats for b in seats}
        assert int(r["current_km"]) == sum(ring(a, b) for a, b in zip(seats, seats[1:]))
        assert int(r["best_km"]) == subset_best(d, seats[0], seats[1:8], seats[8])
        walk = [seats[0], *[int(x[1:]) for x in r["ordering"]], seats[8]]
        assert sum(ring(a, b) for a, b in zip(walk, walk[1:])) == r["best_km"]
    better = lt.reoptimize_long(stops, distances, window=4, sweeps=2).cache()
    walk = [int(r["name"][1:]) for r in better.where("tour_id = 't'").orderBy("position").collect()]
    assert sorted(walk) == list(range(n)) and sum(ring(a, b) for a, b in zip(walk, walk[1:] + walk[:1])) == n
    assert better.where("tour_id = 'u'").count() == 9
    assert lt.window_scores_long(better, distances, 4).where("best_km < current_km").isEmpty()
    with pytest.raises(Exception, match="does not fit"):
        lt.window_scores_long(stops.where("tour_id = 'u'"), distances, 8).collect()


def test_distances_from_hub_labels(spark):
    """Random networks, and one whose hub has half of all lines; with limits and without."""
    star = [("hub", f"s{k:03d}", k % 7 + 1) for k in range(120)] + [(f"s{k:03d}", f"s{(k * 7 + 1) % 120:03d}", 9) for k in range(0, 120, 2)]
    for edges in (random_edges(4, 30), star):
        best = {}
        for a, b, km in edges:
            best[min(a, b), max(a, b)] = km
        edges = [(a, b, km) for (a, b), km in best.items() if a != b]
        net = frame(spark, [*edges, ("x", "y", 2)])
        nodes = sorted({n for a, b, _ in edges for n in (a, b)})[:25]
        want = {(r["origin"], r["node"]): r["km"] for r in sp.shortest_paths(
            net, spark.createDataFrame([(n,) for n in nodes], "origin string"), chains=False).collect() if r["node"] in nodes}
        pairs = spark.createDataFrame([(a, b) for a in [*nodes, "x"] for b in [*nodes, "y"]], "origin string, node string")
        labels = hubs.hub_labels(net)
        got = {(r["origin"], r["node"]): r["km"] for r in hubs.pair_distances(pairs, labels).collect()}
        assert {k: v for k, v in got.items() if "x" not in k and "y" not in k} == want and got["x", "y"] == 2 and ("x", nodes[0]) not in got
        limits = spark.createDataFrame([(n, 12) for n in nodes], "name string, km int").selectExpr("name", "CAST(km AS DECIMAL(18,3)) AS max_km")
        near = {(r["origin"], r["node"]): r["km"] for r in hubs.pair_distances(pairs, hubs.hub_labels(net, limits)).collect()}
        assert all(near[k] == v for k, v in want.items() if v <= 12)
        if edges[0][0] == "hub" or edges[0][1] == "hub":
            assert labels.groupBy("node").count().agg(F.max("count")).first()[0] < 10


def test_tours_by_rounds_equal_the_folds(spark):
    edges = random_edges(3, 7)
    nodes, d = all_distances(edges)
    origins = spark.createDataFrame([(n,) for n in nodes], "origin string")
    closure = sp.shortest_paths(frame(spark, edges), origins, chains=False)
    starts = origins.select(F.col("origin").alias("tour_id"), F.col("origin").alias("start"))
    pool = starts.select("tour_id", F.explode(F.array(*[F.lit(n) for n in nodes])).alias("name"))
    rounds = tr.nn_tours_by_rounds(closure, starts, pool).groupBy("tour_id").agg(
        F.array_sort(F.collect_list(F.struct("step", "name"))).alias("s")).collect()
    tables = tr.matrices(tr.cost_pairs(origins.select(F.lit("i").alias("instance_id"), F.col("origin").alias("name")), closure))
    folds = tr.nn_tours(tables, starts.select(F.lit("i").alias("instance_id"), "start")).select("start", tr.stop_names().alias("s"))
    assert {r["tour_id"]: [x["name"] for x in r["s"]] for r in rounds} == {r["start"]: r["s"] for r in folds.collect()}


def on_a_ring(spark, order):
    """A tour in the given order over stations on a ring of lines of one kilometre."""
    n = len(order)
    ring = frame(spark, [(f"n{i:02d}", f"n{(i + 1) % n:02d}", 1) for i in range(n)])
    members = spark.createDataFrame([("i", f"n{i:02d}") for i in range(n)], "instance_id string, name string")
    closure = sp.shortest_paths(ring, members.select(F.col("name").alias("origin")), chains=False)
    tables = tr.matrices(tr.cost_pairs(members, closure))
    return tables.select("*", F.lit(f"n{order[0]:02d}").alias("start"), F.array(*map(F.lit, order)).alias("stops"),
                         F.lit(0).cast("decimal(18,3)").alias("total_km"))


def test_a_swapped_pair_is_put_right_by_hand_worked_steps(spark):
    """Stops 2 and 3 are swapped on a ring of seven. Offset 0 sees 0 1 3 2 | 4 and puts it right, the only gain;
    the second sweep looks again at the windows that touch those stations, finds nothing and ends the run."""
    row = tr.window_reoptimize(on_a_ring(spark, [0, 1, 3, 2, 4, 5, 6]), window=3, sweeps=5).first()
    assert row["stops"] == [0, 1, 2, 3, 4, 5, 6] and row["total_km"] == 7
    assert (row["sweeps_run"], row["accepted"]) == (2, 1)


def test_an_optimal_tour_takes_one_sweep(spark):
    row = tr.window_reoptimize(on_a_ring(spark, [3, 4, 5, 6, 0, 1, 2]), window=4, sweeps=5).first()
    assert row["stops"] == [3, 4, 5, 6, 0, 1, 2]
    assert (row["sweeps_run"], row["solved"], row["skipped"], row["accepted"]) == (1, 7, 0, 0)


def test_no_tour_gets_lost(spark):
    """Instances of several sizes in one call; what does not fit raises."""
    rows = [(f"i{n}", f"s{k}") for n in (2, 3, 5, 7) for k in range(n)]
    members = spark.createDataFrame(rows, "instance_id string, name string")
    net = frame(spark, [(f"s{a}", f"s{b}", a + b) for b in range(9) for a in range(b)])
    closure = sp.shortest_paths(net, spark.createDataFrame([(f"s{k}",) for k in range(9)], "origin string"), chains=False)
    starts = spark.createDataFrame([(f"i{n}", "s0") for n in (2, 3, 5, 7)], "instance_id string, start string")
    tables = tr.matrices(tr.cost_pairs(members, closure)).cache()
    assert {(r["instance_id"], len(r["stops"])) for r in tr.exact_tours(tables, starts).collect()} == {(f"i{n}", n) for n in (2, 3, 5, 7)}
    with pytest.raises(Exception, match="2 to 6 stations"):
        tr.exact_tours(tables, starts, 6).collect()
    tours = tr.nn_tours(tables, starts)
    for short in (tr.window_scores(tours, 4), tr.circular_windows(tours, 4)):
        with pytest.raises(Exception, match="does not fit"):
            short.collect()


def test_limits_are_said(spark, lines):
    with pytest.raises(ValueError):
        tr.exact_tours(lines, lines, 14)
    with pytest.raises(ValueError):
        tr.window_scores(lines, window=11)
    with pytest.raises(ValueError):
        tr.window_reoptimize(lines, window=1)
    members = spark.createDataFrame([("i", "a"), ("i", "x")], "instance_id string, name string")
    closure = sp.shortest_paths(lines, members.select(F.col("name").alias("origin")))
    with pytest.raises(Exception, match="not connected"):
        tr.matrices(tr.cost_pairs(members, closure)).collect()


def test_components(spark, lines):
    stations = spark.createDataFrame([(n,) for n in "abcdexyz"], "name string")
    groups = cc.connected_components(stations, lines)
    assert {(r["name"], r["component"]) for r in groups.collect()} == {
        *[(n, "a") for n in "abcde"], ("x", "x"), ("y", "x"), ("z", "z")}
    assert [(r["rank"], r["component"]) for r in cc.component_rank(groups).orderBy("rank").collect()] == [
        (1, "a"), (2, "x"), (3, "z")]
    with pytest.raises(ValueError, match="3 separate groups"):
        cc.require_connected(groups)
    with pytest.raises(ValueError, match="out of range"):
        cc.component_members(groups, 4)


def test_long_chain_is_one_component(spark):
    edges = spark.createDataFrame([(f"n{i:03d}", f"n{i + 1:03d}") for i in range(60)], "a string, b string").withColumn(
        "distance_km", F.lit(1).cast("decimal(18,3)"))
    stations = spark.createDataFrame([(f"n{i:03d}",) for i in range(61)], "name string")
    assert cc.connected_components(stations, edges).select("component").distinct().count() == 1


def test_matrices_from_labels_equal_those_from_pairs(spark):
    """Instances that overlap, one with a station that no line reaches, one of a single station."""
    net = frame(spark, [*random_edges(6, 20), ("x", "y", 2)])
    names = sorted({r["a"] for r in net.collect()} | {r["b"] for r in net.collect()})
    members = spark.createDataFrame(
        [("i", n) for n in names[:5]] + [("j", n) for n in names[3:9]] + [("apart", n) for n in ("x", "y", "alone", names[0])] + [("one", "y")],
        "instance_id string, name string")
    labels = hubs.hub_labels(net)
    pairs = hubs.pair_distances(tr.member_pairs(members).select("origin", "node"), labels)
    want = {tuple(map(str, r)) for r in tr.cost_pairs(members, pairs).collect()}
    tables = hubs.label_matrices(tr.fitting_members(members), labels)
    assert {tuple(map(str, r)) for r in tr.table_costs(tables).collect()} == want
    whole = members.where("instance_id IN ('i', 'j', 'one')")
    assert {str(r) for r in tr.whole(hubs.label_matrices(whole, labels)).collect()} == {
        str(r) for r in tr.matrices(tr.cost_pairs(whole, pairs)).collect()}
    with pytest.raises(Exception, match="not connected"):
        tr.whole(tables).collect()


def test_a_search_of_many_rounds_stores_its_last_two(spark):
    """A chain takes a round per station; what earlier rounds wrote does not stay in the shared folder."""
    folder = Path(shared_dir(spark))
    net = frame(spark, [(f"n{k:02d}", f"n{k + 1:02d}", 1) for k in range(30)])
    origins = spark.createDataFrame([("n00",)], "origin string")
    for search in (lambda: sp.shortest_paths(net, origins), lambda: sp.nearest_stations(net, origins, 29), lambda: hubs.hub_labels(net)):
        before = set(folder.rglob("*")) | set(folder.glob("*"))
        assert search().count() > 0
        made = {p.parent for p in set(folder.rglob("part-*")) - before}
        assert 0 < len(made) <= 5
