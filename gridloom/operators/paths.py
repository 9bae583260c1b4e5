"""Shortest paths over lines, as rounds of a relaxation join."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.operators.network import adjacency, nearest_lines
from gridloom.operators.skew import join_hot
from gridloom.session import Rounds, kept

KM = "decimal(18,3)"
#: As far as a distance can be.
FURTHEST = "999999999999999.999"


def closure_step(frontier: DataFrame, lines: DataFrame) -> DataFrame:
    """Every station one line beyond the frontier: distance, and hops and chain where the frontier has them."""
    f, e = frontier.alias("f"), lines.alias("e")
    chain = [(F.col("f.hops") + 1).alias("hops"), F.array_append("f.path", F.col("e.dst")).alias("path")]
    limit = [F.col("f.max_km").alias("max_km")]
    reached = f.join(e, F.col("f.node") == F.col("e.src")).select(
        F.col("f.origin").alias("origin"), F.col("e.dst").alias("node"),
        (F.col("f.km") + F.col("e.km")).cast(KM).alias("km"),
        *(chain if "path" in frontier.columns else []), *(limit if "max_km" in frontier.columns else []))
    return reached.where("km <= max_km").drop("max_km") if "max_km" in frontier.columns else reached


def _merge(state: DataFrame, reached: DataFrame, dealt_by: str | None = None) -> DataFrame:
    """The better of what is known and what was reached, flagged where it changed.

    Without chains the comparison is on the distance alone, a plain hash aggregate.
    Rows may be dealt by one column first, where the next step needs them by it.
    """
    chains = "path" in state.columns
    way = F.struct("km", "hops", "path") if chains else F.col("km")
    known = state.select("origin", "node", way.alias("way"), F.lit(True).alias("known"))
    new = reached.select("origin", "node", way.alias("way"), F.lit(False).alias("known"))
    both = known.union(new) if dealt_by is None else known.union(new).repartition(dealt_by)
    best = both.groupBy("origin", "node").agg(
        F.min("way").alias("way"), F.min(F.when(F.col("known"), F.col("way"))).alias("old"))
    changed = (F.col("old").isNull() | (F.col("way") < F.col("old"))).alias("changed")
    return best.select("origin", "node", *(["way.*"] if chains else [F.col("way").alias("km")]), changed)


def _seed(origins: DataFrame, chains: bool) -> DataFrame:
    return origins.select(
        "origin", F.col("origin").alias("node"), F.lit(0).cast(KM).alias("km"),
        *([F.lit(0).alias("hops"), F.array("origin").alias("path")] if chains else []), F.lit(True).alias("changed"))


def shortest_paths(edges: DataFrame, sources: DataFrame, max_hops: int | None = None, chains: bool = True) -> DataFrame:
    """Distance, hops and station chain from each source: (origin, node, km, hops, path).

    `sources` has `origin` and, if a search should stop at a distance, `max_km`.
    The result is as large as the sources times what they reach, so it is always
    asked for named sources or within a distance. Ways of equal length are told
    apart by fewer hops, then by the names on the way, which makes the result the
    same on every run. Only stations whose way improved are extended in a round.
    With `chains` off only distances are kept, which is several times cheaper.
    """
    lines = kept(adjacency(edges), "lines")
    limited = "max_km" in sources.columns
    limits = kept(sources.groupBy("origin").agg(F.max("max_km").alias("max_km")), "limits") if limited else None
    origins = limits.select("origin") if limited else sources.select("origin").distinct()
    stored = Rounds(edges.sparkSession, "paths")
    state = stored.keep(_seed(origins, chains))
    rounds = 0
    while (max_hops is None or rounds < max_hops) and not state.where("changed").isEmpty():
        frontier = state.where("changed").drop("changed")
        if limited:
            frontier = frontier.join(limits, "origin")
        state = stored.keep(_merge(state, closure_step(frontier, lines)))
        rounds += 1
    return stored.ended(state).drop("changed")


def nearest_stations(edges: DataFrame, origins: DataFrame, k: int, chains: bool = False) -> DataFrame:
    """The `k` stations nearest to each origin by (distance, name), and the origin at rank 0.

    A station among the k nearest is reached over stations that are nearer still,
    and over one of the k + 1 shortest lines of each of them. So the search keeps
    k + 1 stations per origin and k + 1 lines per station: the work stays linear
    in the number of origins, and a hub with very many lines adds k + 1 of them.
    An origin that has k + 1 stations takes none that is further than the last of
    them, and what it reaches is dealt by the origin once, to be merged and ranked.
    """
    lines = kept(nearest_lines(edges, k + 1), "nearest-lines")
    everything = Window.partitionBy("origin")
    order = everything.orderBy("km", "node")
    full = F.count("*").over(everything) > k
    stored = Rounds(edges.sparkSession, "nearest")
    state = stored.keep(_seed(origins.select("origin").distinct(), chains).withColumn("max_km", F.lit(FURTHEST).cast(KM)))
    while not state.where("changed").isEmpty():
        reached = closure_step(state.where("changed").drop("changed"), lines)
        merged = _merge(state, reached, "origin")
        best = merged.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= k + 1).drop("rn")
        state = stored.keep(best.withColumn("max_km", F.when(full, F.max("km").over(everything)).otherwise(F.lit(FURTHEST).cast(KM))))
    return stored.ended(state).drop("changed", "max_km").withColumn("rank", (F.row_number().over(order) - 1).cast("int"))


def reachability(pool: DataFrame, closure: DataFrame) -> DataFrame:
    """Members of a pool (start, name) that cannot be reached from its start."""
    return pool.join(closure, (F.col("start") == F.col("origin")) & (F.col("name") == F.col("node")), "left_anti")


def reachability_by_component(groups: DataFrame) -> DataFrame:
    """(start, component, reachable, unreachable, status) for every start, from (name, component).

    Members of one group reach the same stations, so one number per group says for
    each start how many are beyond reach, without a row per start and station.
    """
    sizes = groups.groupBy("component").agg(F.count("*").alias("reachable"))
    total = groups.agg(F.count("*").alias("n")).scalar()
    told = join_hot(groups.select(F.col("name").alias("start"), "component"), sizes, ["component"])
    return told.select("start", "component", "reachable", (total - F.col("reachable")).alias("unreachable"), F.when(
        F.col("reachable") < total, "some stations cannot be reached").otherwise("ok").alias("status"))


def direct_line_flag(pairs: DataFrame, edges: DataFrame, a: str = "origin", b: str = "destination") -> DataFrame:
    """Whether one line joins the two stations."""
    lines = adjacency(edges).select(F.col("src").alias("_s"), F.col("dst").alias("_d"), F.lit(True).alias("_line"))
    return (
        pairs.join(lines, (F.col(a) == F.col("_s")) & (F.col(b) == F.col("_d")), "left")
        .withColumn("is_direct", F.coalesce("_line", F.lit(False))).drop("_s", "_d", "_line"))


def instances_checked(near: DataFrame, size: int) -> DataFrame:
    """(instance_id, stations, status) of every origin of `nearest_stations`: whether `size` stations are within reach."""
    return near.groupBy(F.col("origin").alias("instance_id")).agg(F.count("*").alias("stations")).withColumn(
        "status", F.when(F.col("stations") < size, "too few stations within reach").otherwise("ok"))
