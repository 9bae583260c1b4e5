"""Visiting tours. A tour is one row; every step of it is a fold inside that row.

The distances a tour may use travel with it as a small matrix, so thousands of
tours are built or improved side by side without a shuffle and without a job per
step. Distances are kept as whole metres, which makes sums and ties exact.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.operators.paths import direct_line_flag
from gridloom.session import Rounds, kept

METRES = 1000
# A matrix of n stations has n * n cells in one row; 1,000 stations are 8 MB.
MAX_STATIONS = 1000
#: Stations of an exact tour where the caller names no number, and the most they may name.
MAX_EXACT = 8
MOST_EXACT = 13
#: Free stations of a window at most; up to `LISTED_WINDOW` of them all orders are listed, beyond it sets are.
MAX_WINDOW = 10
LISTED_WINDOW = 5


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """Evaluate `value` once and use it under a name."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def cell(matrix: Column, i: Column, j: Column) -> Column:
    return F.get(F.get(matrix, i), j)


def fitting_members(members: DataFrame) -> DataFrame:
    """Members (instance_id, name) as they are, with any other columns; an instance of more than `MAX_STATIONS` raises."""
    others = [c for c in members.columns if c not in ("instance_id", "name")]
    members = members.where("instance_id IS NOT NULL")
    most = members.groupBy("instance_id").agg(F.count("*").alias("n")).agg(F.coalesce(F.max("n"), F.lit(0))).scalar()
    return members.select("instance_id", F.when(most <= MAX_STATIONS, F.col("name")).otherwise(
        F.raise_error(F.lit(f"an instance holds at most {MAX_STATIONS} stations"))).alias("name"), *others)


def member_pairs(members: DataFrame) -> DataFrame:
    """All ordered pairs of members of each instance: (instance_id, origin, node).

    The number of members is checked first, so this is at most that number squared;
    larger networks are toured by :func:`nn_tours_by_rounds` and improved by
    :func:`gridloom.operators.long_tours.reoptimize_long`.
    """
    fitting = fitting_members(members.select("instance_id", "name"))
    i, j = fitting.alias("i"), fitting.alias("j")
    return i.join(j, F.col("i.instance_id") == F.col("j.instance_id")).select(
        F.col("i.instance_id").alias("instance_id"), F.col("i.name").alias("origin"), F.col("j.name").alias("node"))


def cost_pairs(members: DataFrame, closure: DataFrame) -> DataFrame:
    """Distances between all members of each instance: (instance_id, origin, node, km).

    Two members with no way between them keep a row with a NULL distance.
    """
    return member_pairs(members).join(closure.select("origin", "node", "km"), ["origin", "node"], "left").select(
        "instance_id", "origin", "node", "km")


def unreachable_pairs(costs: DataFrame) -> DataFrame:
    return costs.groupBy("instance_id").agg(
        F.count("*").alias("pairs"), F.count_if(F.col("km").isNull()).alias("unreachable"))


def matrices(costs: DataFrame) -> DataFrame:
    """One row per instance: its sorted names and their distance matrix in metres.

    An instance with two stations that no line joins raises instead of losing one.
    """
    sizes = costs.groupBy("instance_id", "origin").agg(
        F.array_sort(F.collect_list(F.struct("node", (F.col("km") * METRES).cast("bigint").alias("m")))).alias("row"))
    table = sizes.groupBy("instance_id").agg(
        F.array_sort(F.collect_list(F.struct("origin", F.transform("row", lambda x: x.m).alias("row")))).alias("t"))
    return whole(table.select(
        "instance_id", F.transform("t", lambda x: x.origin).alias("names"), F.transform("t", lambda x: x.row).alias("matrix")))


def whole(tables: DataFrame) -> DataFrame:
    """Tables (instance_id, names, matrix) as they are; a distance that is missing raises."""
    gap = F.exists("matrix", lambda r: F.exists(r, lambda m: m.isNull()))
    return tables.select(
        "instance_id",
        F.when(gap, F.raise_error(F.lit("stations of one instance are not connected by any chain of lines")))
        .otherwise(F.col("names")).alias("names"), "matrix")


def table_costs(tables: DataFrame) -> DataFrame:
    """The cells of tables as rows, as :func:`cost_pairs` has them: (instance_id, origin, node, km)."""
    cells = F.flatten(F.zip_with("names", "matrix", lambda a, row: F.zip_with(F.col("names"), row, lambda b, m: F.struct(
        a.alias("origin"), b.alias("node"), to_km(m).alias("km")))))
    return tables.select("instance_id", F.inline_outer(cells))


def nearest_neighbour_order(matrix: Column, start: Column) -> Column:
    """Visit the nearest station not visited yet; a tie goes to the first name."""
    n = F.size(matrix)
    first = F.struct(
        F.array(start).alias("stops"),
        F.array_remove(F.sequence(F.lit(0), n - 1), start).alias("left"))

    def visit(acc: Column, _: Column) -> Column:
        here = F.element_at(acc.stops, -1)
        best = F.array_min(F.transform(acc.left, lambda j: F.struct(cell(matrix, here, j).alias("m"), j.alias("j"))))
        return let(best.j, lambda j: F.struct(
            F.array_append(acc.stops, j).alias("stops"), F.array_remove(acc.left, j).alias("left")))

    return F.aggregate(F.sequence(F.lit(1), n), first, lambda acc, step: F.when(
        F.size(acc.left) > 0, visit(acc, step)).otherwise(acc), lambda acc: acc.stops)


def closed_length(matrix: Column, stops: Column) -> Column:
    """Metres along the stops and back to the first."""
    n = F.size(stops)
    return F.aggregate(
        F.sequence(F.lit(0), n - 1), F.lit(0).cast("bigint"),
        lambda s, i: s + cell(matrix, F.get(stops, i), F.get(stops, (i + 1) % n)))


def to_km(metres: Column) -> Column:
    return (metres.cast("decimal(18,0)") * F.lit("0.001").cast("decimal(4,3)")).cast("decimal(18,3)")


def nn_tours(tables: DataFrame, starts: DataFrame) -> DataFrame:
    """Nearest-neighbour tours: one per (instance_id, start), with its distances kept beside it."""
    at = (F.array_position("names", F.col("start")) - 1).cast("int")
    located = starts.join(tables, "instance_id").withColumn(
        "_at", F.when(at >= 0, at).otherwise(F.raise_error(F.lit("the start is not part of the station set")))
    ).withColumn("_at", F.when(F.size("names") >= 2, F.col("_at")).otherwise(
        F.raise_error(F.lit("a tour needs at least 2 stations"))))
    return located.withColumn("stops", nearest_neighbour_order(F.col("matrix"), F.col("_at"))).drop("_at").withColumn(
        "total_km", to_km(closed_length(F.col("matrix"), F.col("stops"))))


def nn_tours_by_rounds(closure: DataFrame, starts: DataFrame, pool: DataFrame) -> DataFrame:
    """Nearest-neighbour tours of any size, one join per step: (tour_id, step, name, km).

    The way for networks whose matrix does not fit a row. `starts` has (tour_id,
    start), `pool` the stations of each tour as (tour_id, name). All tours take
    their step together; `km` is the distance from the stop before.
    """
    ways = kept(closure.select(F.col("origin").alias("here"), F.col("node").alias("name"), F.col("km").alias("way")), "ways")
    rounds = Rounds(pool.sparkSession, "visits")
    pool = kept(pool.select("tour_id", "name"), "pool")
    visits = rounds.keep(starts.select(
        "tour_id", F.lit(1).alias("step"), F.col("start").alias("name"), F.lit(0).cast("decimal(18,3)").alias("km")))
    step = 1
    while True:
        here = visits.where(F.col("step") == step).select("tour_id", F.col("name").alias("here"))
        left = pool.join(visits.select("tour_id", "name"), ["tour_id", "name"], "left_anti")
        options = left.join(here, "tour_id").join(ways, ["here", "name"])
        step += 1
        picked = options.groupBy("tour_id").agg(F.min(F.struct("way", "name")).alias("p")).select(
            "tour_id", F.lit(step).alias("step"), F.col("p.name").alias("name"), F.col("p.way").alias("km"))
        visits = rounds.keep(visits.union(picked))
        if visits.where(F.col("step") == step).isEmpty():
            return rounds.ended(visits)


def stop_names(names: str = "names", stops: str = "stops") -> Column:
    return F.transform(stops, lambda i: F.get(F.col(names), i))


def _orders(size: int) -> Column:
    """All orders of `size` positions as one constant; at most 120 of them."""
    table = [list(p) for p in permutations(range(size))]
    return F.from_json(F.lit(json.dumps(table)), "array<array<int>>")


def _subset_orders(n: int) -> tuple[list[list[int]], list[list[int]]]:
    """For every set of `n` places (a bit each): its places, ascending, and for each place the number of the set without it."""
    places = [[k for k in range(n) if mask >> k & 1] for mask in range(1 << n)]
    return places, [[mask & ~(1 << k) for k in held] for mask, held in enumerate(places)]


def _constant(table: list, kind: str) -> Column:
    return F.from_json(F.lit(json.dumps(table)), kind)


def shortest_order(matrix: Column, entry: Column, free: Column, last: Column, n: int) -> Column:
    """The shortest way from `entry` over all `n` stations of `free` to `last`: struct (m, p), p positions in `free` in order.

    A subset programme: for every set of free stations and every station it may end
    at, the best way so far, in the order of the sets' numbers, so that each set
    finds the sets with one station less done. 2^n * n^2 steps instead of n!. Of equal ways
    the one whose positions come first in order wins, as if all orders had been tried.
    The programme runs from the exit backwards: the rest of a way only depends on
    where it starts and what it has left, and the first station of the way is settled last.
    """
    places, without = _subset_orders(n)
    sets = _constant([{"places": p, "without": w} for p, w in zip(places, without)][1:], "array<struct<places:array<int>,without:array<int>>>")
    way = "struct<m:bigint,p:array<int>>"
    none = F.lit(None).cast(way)

    def onward(done: Column, start: Column, rest: Column) -> Column:
        """The best way from `start` over the set `rest` to `last`: `done` has, per set, the best by the place it begins at."""
        return F.when(rest == 0, F.struct(cell(matrix, start, last).alias("m"), F.expr("CAST(array() AS array<int>)").alias("p"))).otherwise(
            F.array_min(F.transform(F.filter(F.get(done, rest), lambda w: w.isNotNull()), lambda w: F.struct(
                (cell(matrix, start, F.get(free, F.get(w.p, F.lit(0)))) + w.m).alias("m"), w.p.alias("p")))))

    def settle(done: Column, s: Column) -> Column:
        best = F.transform(F.arrays_zip(s.places.alias("k"), s.without.alias("rest")), lambda x: let(
            onward(done, F.get(free, x.k), x.rest), lambda o: F.struct(o.m.alias("m"), F.concat(F.array(x.k), o.p).alias("p"))))
        return F.array_append(done, best)

    empty = F.array(F.array(none))
    return F.aggregate(sets, empty, settle, lambda done: onward(done, entry, F.lit((1 << n) - 1)))


def exact_tours(tables: DataFrame, starts: DataFrame, largest: int = MAX_EXACT) -> DataFrame:
    """The shortest closed tour of instances of any sizes up to `largest`, by a subset programme in each row.

    Time and room of a row grow with 2 to the power of its stations, so `largest` is at
    most `MOST_EXACT`; an instance beyond it, or of a single station, raises instead of
    getting lost. Of equal tours the first by its stations in order is taken.
    """
    if not 2 <= largest <= MOST_EXACT:
        raise ValueError(f"exact tours need 2 to {MOST_EXACT} stations")
    m, size = F.col("matrix"), F.size("names")
    at = (F.array_position("names", F.col("start")) - 1).cast("int")
    found = starts.join(tables, "instance_id").withColumn("_at", at).withColumn(
        "rest", F.array_remove(F.sequence(F.lit(0), size - 1), F.col("_at")))
    best = F.raise_error(F.lit(f"an exact tour needs 2 to {largest} stations")).cast("struct<m:bigint,p:array<int>>")
    for n in range(2, largest + 1):
        best = F.when(size == n, shortest_order(m, F.col("_at"), F.col("rest"), F.col("_at"), n - 1)).otherwise(best)
    return found.withColumn("_best", best).select(
        "instance_id", "start", "names", "matrix",
        F.concat(F.array("_at"), F.transform("_best.p", lambda k: F.get(F.col("rest"), k))).alias("stops"),
        to_km(F.col("_best.m")).alias("total_km"))


def _seat(stops: Column, offset: Column, k: int) -> Column:
    return F.get(stops, (offset + k) % F.size(stops))


def _window(stops: Column, offset: Column, window: int) -> Column:
    """The entry, the free stations and the exit at one place of a cyclic tour."""
    return F.array(*[_seat(stops, offset, k) for k in range(window + 2)])


def _inside(matrix: Column, seats: Column, order: list[Column]) -> Column:
    walk = [F.get(seats, F.lit(0)), *order, F.get(seats, F.lit(len(order) + 1))]
    return sum((cell(matrix, a, b) for a, b in zip(walk[1:], walk[2:])), cell(matrix, walk[0], walk[1]))


def _current(matrix: Column, seats: Column, window: int) -> Column:
    return _inside(matrix, seats, [F.get(seats, F.lit(k + 1)) for k in range(window)])


def _best(matrix: Column, seats: Column, window: int) -> Column:
    """The shortest order of the free stations; of equal ones the first in the list of all. Few orders are tried one by one."""
    if window > LISTED_WINDOW:
        return shortest_order(
            matrix, F.get(seats, F.lit(0)), F.slice(seats, 2, window), F.get(seats, F.lit(window + 1)), window)
    orders = _orders(window)
    return F.array_min(F.transform(orders, lambda p: F.struct(
        _inside(matrix, seats, [F.get(seats, F.get(p, F.lit(k)) + 1) for k in range(window)]).alias("m"),
        p.alias("p"))))


def _check_window(window: int) -> None:
    if not 2 <= window <= MAX_WINDOW:
        raise ValueError(f"a window holds 2 to {MAX_WINDOW} free stations")


def _fitting(window: int) -> Column:
    """The number of stations, if a window and its two ends fit among them; a tour visits all its names."""
    return F.when(F.size("names") >= window + 2, F.size("names")).otherwise(
        F.raise_error(F.lit(f"a window of {window} and its two fixed ends does not fit in the tour")))


def circular_windows(tours: DataFrame, window: int) -> DataFrame:
    """Every window of every tour: entry, free stations and exit at each offset. A tour too short for the window raises."""
    stops = F.col("stops")
    seats = F.transform(F.sequence(F.lit(0), _fitting(window) - 1), lambda o: F.struct(
        o.alias("offset"), _window(stops, o, window).alias("seats")))
    return tours.select("instance_id", "start", "names", F.inline_outer(seats))


def window_scores(tours: DataFrame, window: int) -> DataFrame:
    """For every tour and offset: the length now, the best length, and the order that gives it. A tour too short raises."""
    _check_window(window)
    stops, m = F.col("stops"), F.col("matrix")

    def score(offset: Column) -> Column:
        return let(_window(stops, offset, window), lambda seats: let(
            _best(m, seats, window), lambda best: F.struct(
                offset.alias("offset"), _current(m, seats, window).alias("now"), best.m.alias("best"),
                F.transform(best.p, lambda k: F.get(F.col("names"), F.get(seats, k + 1))).alias("ordering"))))

    scored = F.transform(F.sequence(F.lit(0), _fitting(window) - 1), score)
    # The outer unfolding keeps Spark from asking for a non-empty list first, which would compute the folds twice.
    return tours.select("instance_id", "start", F.inline_outer(scored)).select(
        "instance_id", "start", "offset", to_km(F.col("now")).alias("current_km"), to_km(F.col("best")).alias("best_km"),
        "ordering")


def window_reoptimize(tours: DataFrame, window: int = 4, sweeps: int = 3, prune: bool = True) -> DataFrame:
    """Improve tours window by window until a sweep changes nothing.

    Offsets are taken one after another; a window is reordered when that is
    strictly shorter. With `prune`, a window none of whose stations changed since
    it last failed is skipped. The start is rotated back to the front at the end.
    A tour too short for the window raises.
    """
    _check_window(window)
    m, n = F.col("matrix"), F.size("stops")
    state = F.struct(
        F.col("stops").alias("stops"), F.col("stops").alias("dirty"), F.lit(False).alias("improved"),
        F.lit(False).alias("done"), F.lit(0).alias("sweeps"), F.lit(0).alias("solved"),
        F.lit(0).alias("skipped"), F.lit(0).alias("accepted"))

    def with_(acc: Column, **changes: Column) -> Column:
        fields = ("stops", "dirty", "improved", "done", "sweeps", "solved", "skipped", "accepted")
        return F.struct(*[changes.get(f, acc[f]).alias(f) for f in fields])

    def tried(acc: Column, offset: Column, seats: Column) -> Column:
        def apply(best: Column) -> Column:
            def seat(stop: Column, at: Column) -> Column:
                k = (at - offset - 1 + n) % n
                return F.when(k < window, F.get(seats, F.get(best.p, k) + 1)).otherwise(stop)

            better = best.m < _current(m, seats, window)
            return F.when(better, with_(
                acc, stops=F.transform(acc.stops, seat), improved=F.lit(True), solved=acc.solved + 1,
                dirty=F.array_union(acc.dirty, seats), accepted=acc.accepted + 1,
            )).otherwise(with_(
                acc, dirty=F.array_remove(acc.dirty, F.get(seats, F.lit(0))), solved=acc.solved + 1))

        return let(_best(m, seats, window), apply)

    def step(acc: Column, t: Column) -> Column:
        offset = t % n
        opened = with_(acc, improved=F.when(offset == 0, F.lit(False)).otherwise(acc.improved),
                       sweeps=acc.sweeps + F.when(offset == 0, 1).otherwise(0))

        def visit(a: Column) -> Column:
            return let(_window(a.stops, offset, window), lambda seats: F.when(
                F.lit(prune) & ~F.arrays_overlap(a.dirty, seats), with_(a, skipped=a.skipped + 1)
            ).otherwise(tried(a, offset, seats)))

        def close(a: Column) -> Column:
            return with_(a, done=(offset == n - 1) & ~a.improved)

        return F.when(acc.done, acc).otherwise(let(let(opened, visit), close))

    fits = F.when(F.size("stops") >= window + 2, F.size("stops") * F.lit(max(1, sweeps))).otherwise(
        F.raise_error(F.lit(f"a window of {window} and its two fixed ends does not fit in the tour")))
    pivot = F.array_position("_s.stops", F.get("stops", F.lit(0))).cast("int")
    turned = F.concat(
        F.slice("_s.stops", pivot, F.size("stops")), F.slice("_s.stops", F.lit(1), pivot - 1))
    return (
        tours.withColumn("_s", F.aggregate(F.sequence(F.lit(0), fits - 1), state, step))
        .withColumn("_new", turned)
        .select(
            "instance_id", "start", "names", "matrix", F.col("_new").alias("stops"),
            F.col("total_km").alias("start_km"), to_km(closed_length(F.col("matrix"), F.col("_new"))).alias("total_km"),
            F.col("_s.sweeps").alias("sweeps_run"), F.col("_s.solved").alias("solved"),
            F.col("_s.skipped").alias("skipped"), F.col("_s.accepted").alias("accepted"))
    )


def tour_legs(tours: DataFrame) -> DataFrame:
    """Visiting orders as numbered legs; the last one returns to the start. Needs `stops` as names."""
    n = F.size("stops")
    legs = F.transform("stops", lambda stop, i: F.struct(
        (i + 1).alias("step"), stop.alias("origin"), F.get(F.col("stops"), (i + 1) % n).alias("destination")))
    return tours.select("tour_id", F.inline_outer(legs))


def travelled_legs(legs: DataFrame, closure: DataFrame, edges: DataFrame) -> DataFrame:
    """Legs with their distance, the chain of stations they cross and whether one line does it."""
    ways = closure.select("origin", F.col("node").alias("destination"), "km", "path")
    return direct_line_flag(legs.join(ways, ["origin", "destination"], "left"), edges)


def tour_length(orders: DataFrame, closure: DataFrame, closed: bool = True) -> DataFrame:
    """Length of visiting orders (tour_id, stops) over shortest paths, closed or open."""
    legs = tour_legs(orders)
    if not closed:
        last = orders.select("tour_id", F.size("stops").alias("n"))
        legs = legs.join(last, "tour_id").where("step < n").drop("n")
    ways = closure.select("origin", F.col("node").alias("destination"), "km")
    return legs.join(ways, ["origin", "destination"], "left").groupBy("tour_id").agg(F.sum("km").alias("km"))


def physical_path(legs: DataFrame) -> DataFrame:
    """Every station crossed by a tour, the joints between legs named once."""
    ordered = F.array_sort(F.collect_list(F.struct("step", "origin", "path")))
    tail = F.flatten(F.transform("_legs", lambda leg: F.slice(leg.path, F.lit(2), F.size(leg.path))))
    return (
        legs.groupBy("tour_id").agg(ordered.alias("_legs"))
        .select("tour_id", F.concat(F.array(F.get("_legs", F.lit(0)).origin), tail).alias("path")))


def via_slice(path: Column) -> Column:
    """A path without its two ends."""
    return F.when(F.size(path) > 2, F.slice(path, F.lit(2), F.size(path) - 2)).otherwise(
        F.array().cast("array<string>"))


def tour_totals(legs: DataFrame) -> DataFrame:
    """Per tour: length, stations visited, direct legs, and the closed route by name, back to its start."""
    ordered = F.array_sort(F.collect_list(F.struct("step", "origin", "destination")))
    return legs.groupBy("tour_id").agg(
        F.sum("km").alias("total_km"), F.count("*").alias("stations_visited"),
        F.count_if(F.col("is_direct")).alias("direct_legs"), ordered.alias("_legs")).select(
        "tour_id", "total_km", "stations_visited", "direct_legs", F.concat(
            F.transform("_legs", lambda leg: leg.origin), F.array(F.element_at("_legs", -1).destination)).alias("closed_route"))
