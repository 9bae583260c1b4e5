"""Distances between given pairs of stations from two-hop hub labels.

Stations are ranked by their number of lines. A label (node, hub, km) says that a
chain of `km` joins the two over stations that all rank below the hub. On a shortest
chain between two stations the highest-ranked one is a hub of both, at its exact
distance; no label is shorter than the way it stands for. So the distance of a pair
is the smallest sum over the hubs that both have, one join on (pair, hub). A search
that may not pass what outranks its origin stays small where a plain one does not: a
hub with half of all lines is one label per station, and stations beside it do not
search through it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.operators.network import adjacency
from gridloom.operators.paths import KM
from gridloom.operators.ranking import sorted_whole
from gridloom.session import Rounds, kept, kept_in_parts

METRES = 1000
INT_MOST = (1 << 31) - 1
#: Members whose labels meet in the rows of their instances at a time.
PART_MEMBERS = 400_000


def ranks(lines: DataFrame) -> DataFrame:
    """(name, rank) of every station with a line: its place, more lines rank higher, then by a hash and the name."""
    order = F.struct(F.count("*").alias("lines"), F.xxhash64("name").alias("mix")).alias("order")
    counted = lines.select(F.col("src").alias("name")).groupBy("name").agg(order)
    return sorted_whole(counted, "order", "name").select("name", F.col("place").alias("rank"))


def rooms(lines: DataFrame, limits: DataFrame) -> DataFrame:
    """(node, room): how far from each station a search may still be of use to some (node, max_km) of `limits`.

    One number per station: the largest of its own limit and what its neighbours have left on the way to it.
    """
    rounds = Rounds(lines.sparkSession, "rooms")
    state = rounds.keep(limits.groupBy("node").agg(F.max("max_km").cast(KM).alias("room")).withColumn("changed", F.lit(True)))
    while not state.where("changed").isEmpty():
        passed = state.where("changed").join(lines, F.col("node") == F.col("src")).select(
            F.col("dst").alias("node"), (F.col("room") - F.col("km")).cast(KM).alias("room")).where("room >= 0")
        known = state.select("node", "room", F.lit(True).alias("known")).union(passed.select("node", "room", F.lit(False)))
        state = rounds.keep(known.groupBy("node").agg(F.max("room").alias("room"), F.max(F.when(F.col("known"), F.col("room"))).alias("old")).select(
            "node", "room", (F.col("old").isNull() | (F.col("room") > F.col("old"))).alias("changed")))
    return rounds.ended(state).drop("changed")


def hub_labels(edges: DataFrame, limits: DataFrame | None = None) -> DataFrame:
    """(node, hub, km) for every station with a line, itself among its hubs; hubs go by their rank.

    With `limits` (name, max_km), labels are those that a pair within `max_km` of one
    of the names may need. Stations are their ranks while labels are made, three
    numbers a row. A round is one join of the labels that got better with the lines,
    and one aggregate; only the last two rounds stay stored.
    """
    named = adjacency(edges)
    rank = kept(ranks(named), "ranks")
    ends = {end: rank.select(F.col("name").alias(end), F.col("rank").alias(f"{end}_rank")) for end in ("src", "dst")}
    lines = kept(named.join(ends["src"], "src").join(ends["dst"], "dst").select(
        F.col("src_rank").alias("src"), F.col("dst_rank").alias("dst"), "km"), "ranked-lines")
    first = rank.select(F.col("rank").alias("node"))
    if limits is not None:
        room = rooms(lines, limits.join(rank, "name").select(F.col("rank").alias("node"), "max_km"))
        first = first.join(room.select("node"), "node")
        lines = kept(lines.join(room.select(F.col("node").alias("dst"), "room"), "dst"), "ranked-lines")
    within = F.lit(True) if limits is None else F.col("km") + F.col("step") <= F.col("room")
    rounds = Rounds(edges.sparkSession, "labels")
    state = rounds.keep(first.select("node", F.col("node").alias("hub"), F.lit(0).cast(KM).alias("km"), F.lit(True).alias("changed")))
    while not state.where("changed").isEmpty():
        passed = state.where("changed").join(lines.withColumnRenamed("km", "step"), F.col("node") == F.col("src")).where(
            (F.col("dst") < F.col("hub")) & within).select(
            F.col("dst").alias("node"), "hub", (F.col("km") + F.col("step")).cast(KM).alias("km"))
        known = state.select("node", "hub", "km", F.lit(True).alias("known")).union(passed.withColumn("known", F.lit(False)))
        state = rounds.keep(known.groupBy("node", "hub").agg(F.min("km").alias("km"), F.min(F.when(F.col("known"), F.col("km"))).alias("old")).select(
            "node", "hub", "km", (F.col("old").isNull() | (F.col("km") < F.col("old"))).alias("changed")))
    return rounds.ended(state).join(rank.select("name", F.col("rank").alias("node")), "node").select(F.col("name").alias("node"), "hub", "km")


def label_lists(labels: DataFrame) -> DataFrame:
    """(name, hubs, metres): the labels of a station as one row of two lists. A station has few of them."""
    listed = F.collect_list(F.struct("hub", (F.col("km") * METRES).cast("bigint").alias("m")))
    return labels.groupBy(F.col("node").alias("name")).agg(listed.alias("l")).select(
        "name", F.col("l.hub").alias("hubs"), F.col("l.m").alias("metres"))


def label_matrices(members: DataFrame, labels: DataFrame, stored: bool = False) -> DataFrame:
    """(instance_id, names, matrix): the sorted names of each instance and the metres between them, NULL where no chain joins two.

    What :func:`tours.matrices` makes of pairs, without a row per pair: each member
    brings its labels into the row of its instance, and the smallest sum over the
    hubs of two members is found there. `members` (instance_id, name) are as many per
    instance as :func:`tours.fitting_members` lets through. Where they have a `max_km`,
    no other member is further, and labels beyond it are left behind. What is brought
    is shuffled, so its numbers are as short as they can be. With `stored`, instances
    are taken in parts of about `PART_MEMBERS` members, one stored after the other.
    """
    lists = kept(label_lists(labels), "label-lists")
    most = lists.agg(F.max(F.array_max("hubs")).alias("hub"), F.max(F.array_max("metres")).alias("m")).first()
    hub, metre = ("int" if (n or 0) <= INT_MOST else "bigint" for n in most)
    if not stored:
        return _matrices(members.join(lists, "name", "left"), hub, metre)
    parts = max(1, -(-members.count() // PART_MEMBERS))

    def part(i: int) -> DataFrame:
        some = members.where(F.pmod(F.xxhash64("instance_id"), F.lit(parts)) == i)
        return _matrices(some.join(lists, "name", "left"), hub, metre)

    return kept_in_parts(part, parts, "matrices")


def _matrices(brought: DataFrame, hub: str, metre: str) -> DataFrame:
    """:func:`label_matrices` of members with their labels (hubs, metres), as numbers of these types."""
    if "max_km" in brought.columns:
        limit = F.col("max_km") * METRES
        brought = brought.withColumn("hubs", F.filter("hubs", lambda _, i: F.get("metres", i) <= limit)).withColumn(
            "metres", F.filter("metres", lambda m: m <= limit))
    brought = brought.select("instance_id", "name", F.col("hubs").cast(f"array<{hub}>"), F.col("metres").cast(f"array<{metre}>"))
    rows = brought.groupBy("instance_id").agg(F.array_sort(F.collect_list(F.struct("name", "hubs", "metres"))).alias("t"))
    seen = F.transform("t", lambda x: F.map_from_arrays(x.hubs, x.metres))

    def metres(x, i, other, j):
        sums = F.zip_with(x.hubs, x.metres, lambda hub, m: m.cast("bigint") + F.try_element_at(other, hub))
        return F.when(i == j, F.lit(0).cast("bigint")).otherwise(F.array_min(sums))

    matrix = F.transform("t", lambda x, i: F.transform("seen", lambda other, j: metres(x, i, other, j)))
    return rows.withColumn("seen", seen).select("instance_id", F.col("t.name").alias("names"), matrix.alias("matrix"))


def pair_distances(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """(origin, node, km) for the pairs (origin, node) that some chain joins, either way round once.

    Pairs are looked up once for both directions.
    """
    one_way = pairs.select(F.least("origin", "node").alias("a"), F.greatest("origin", "node").alias("b")).where("a <> b").distinct()
    near = labels.select(F.col("node").alias("a"), "hub", F.col("km").alias("a_km"))
    far = labels.select(F.col("node").alias("b"), "hub", F.col("km").alias("b_km"))
    found = one_way.join(near, "a").join(far, ["b", "hub"]).groupBy("a", "b").agg(F.min(F.col("a_km") + F.col("b_km")).cast(KM).alias("km"))
    both = F.inline(F.array(F.struct(F.col("a").alias("origin"), F.col("b").alias("node"), "km"), F.struct(F.col("b").alias("origin"), F.col("a").alias("node"), "km")))
    same = pairs.where("origin = node").select("origin", "node", F.lit(0).cast(KM).alias("km")).distinct()
    return found.select(both).union(same)
