"""Windows of tours too long for one row: a tour is one row per stop, and a window only holds its own costs.

`stops` has (tour_id, position, name), positions from 0 without gaps. `distances`
is a function that takes pairs (origin, node) and gives (origin, node, km), such as a
look-up in hub labels, so no table of all pairs is ever made.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.operators.tours import METRES, MAX_WINDOW, shortest_order, to_km
from gridloom.session import cut

Distances = Callable[[DataFrame], DataFrame]


def _sized(stops: DataFrame, window: int) -> DataFrame:
    """`stops` with `n`, the stops of their tour. A tour in which a window and its two ends do not fit raises."""
    if not 2 <= window <= MAX_WINDOW:
        raise ValueError(f"a window holds 2 to {MAX_WINDOW} free stations")
    sizes = stops.groupBy("tour_id").agg(F.count("*").alias("n")).withColumn("n", F.when(F.col("n") >= window + 2, F.col("n")).otherwise(
        F.raise_error(F.lit(f"a window of {window} and its two fixed ends does not fit in the tour"))))
    return stops.join(sizes, "tour_id").select("tour_id", F.col("position").cast("bigint").alias("position"), "name", "n")


def _onward(stops: DataFrame, distances: Distances, window: int) -> DataFrame:
    """`stops` with `ways`: the metres from each to the `window` + 1 stops behind it, in order."""
    reach = stops.select("tour_id", "position", "name", "n", F.explode(F.sequence(F.lit(1), F.lit(window + 1))).alias("k"))
    there = stops.select("tour_id", F.col("position").alias("to"), F.col("name").alias("other"))
    pairs = cut(reach.withColumn("to", (F.col("position") + F.col("k")) % F.col("n")).join(there, ["tour_id", "to"]))
    km = distances(pairs.select(F.col("name").alias("origin"), F.col("other").alias("node")).distinct())
    priced = pairs.join(km.select(F.col("origin").alias("name"), F.col("node").alias("other"), "km"), ["name", "other"], "left").withColumn(
        "m", F.when(F.col("km").isNotNull(), (F.col("km") * METRES).cast("bigint")).otherwise(
            F.raise_error(F.lit("stations of one tour are not connected by any chain of lines"))))
    ways = F.transform(F.array_sort(F.collect_list(F.struct("k", "m"))), lambda x: x.m)
    return priced.groupBy("tour_id", "position", "name", "n").agg(ways.alias("ways"))


def _windows(onward: DataFrame, window: int, wanted: Column) -> DataFrame:
    """(tour_id, offset, n, seats, now, best) of the windows whose offset is `wanted`: seats are names, best is (m, p).

    Every stop goes to the windows that hold it, so a group is one window.
    """
    seats = onward.select("*", F.explode(F.sequence(F.lit(0), F.lit(window + 1))).alias("k")).withColumn(
        "offset", F.pmod(F.col("position") - F.col("k"), F.col("n"))).where(wanted)
    held = seats.groupBy("tour_id", "offset", "n").agg(F.array_sort(F.collect_list(F.struct("k", "name", "ways"))).alias("s"))
    size = window + 2
    rows = [F.array(*[F.lit(0).cast("bigint") if i == j else F.get(F.get("s", F.lit(min(i, j))).ways, F.lit(abs(i - j) - 1))
                      for j in range(size)]) for i in range(size)]
    now = sum((F.get(F.get("s", F.lit(i)).ways, F.lit(0)) for i in range(1, window + 1)), F.get(F.get("s", F.lit(0)).ways, F.lit(0)))
    return held.select("tour_id", "offset", "n", F.transform("s", lambda x: x["name"]).alias("seats"), now.alias("now"), F.array(*rows).alias("matrix")).withColumn(
        "best", shortest_order(F.col("matrix"), F.lit(0), F.array(*[F.lit(k + 1) for k in range(window)]), F.lit(window + 1), window)).drop("matrix")


def window_scores_long(stops: DataFrame, distances: Distances, window: int) -> DataFrame:
    """(tour_id, offset, current_km, best_km, ordering) of every window of every tour, however long."""
    scored = _windows(_onward(_sized(stops, window), distances, window), window, F.lit(True))
    return scored.select("tour_id", "offset", to_km(F.col("now")).alias("current_km"), to_km(F.col("best.m")).alias("best_km"),
                         F.transform("best.p", lambda k: F.get(F.col("seats"), k + 1)).alias("ordering"))


def reoptimize_long(stops: DataFrame, distances: Distances, window: int = 4, sweeps: int = 3) -> DataFrame:
    """(tour_id, position, name) after reordering windows until none gets shorter, or for `sweeps` rounds over all offsets.

    Windows whose offsets lie `window` + 1 apart have no free station in common and
    share only fixed ends, so they are settled at once; the few offsets that are left
    over at the end of a tour take a step each. A round is at most 2 * `window` + 1
    steps, whatever the length of the tours. Every change makes its tour strictly
    shorter; where a whole round changes nothing, every window is at its best.
    """
    at, stride = cut(_sized(stops, window)), window + 1
    offset, even = F.col("offset"), F.expr(f"n div {stride}") * stride
    steps = [(offset < even) & (offset % stride == c) for c in range(stride)] + [offset == even + c for c in range(stride - 1)]
    for _ in range(sweeps):
        changed = False
        for step in steps:
            better = cut(_windows(_onward(at, distances, window), window, step).where("best.m < now"))
            if better.isEmpty():
                continue
            changed = True
            order = F.transform("best.p", lambda k: F.get(F.col("seats"), k + 1))
            moved = better.select("tour_id", "offset", "n", F.posexplode(order).alias("k", "new")).select(
                "tour_id", F.pmod(F.col("offset") + F.col("k") + 1, F.col("n")).alias("position"), "new")
            at = cut(at.join(moved, ["tour_id", "position"], "left").select("tour_id", "position", F.coalesce("new", "name").alias("name"), "n"))
        if not changed:
            break
    return at.select("tour_id", "position", "name")
