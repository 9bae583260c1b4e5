"""The undirected network: one line per pair, neighbours, lookups, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.operators.skew import join_hot

from gridloom.operators.stations import pair_key


def parallel_line_dedupe(lines: DataFrame) -> DataFrame:
    """The shortest routable line of every unordered pair, whole; a tie keeps the earlier row.

    A grouped minimum, so each task sends one candidate per pair into the shuffle
    however many parallel lines a pair has.
    """
    rest = [c for c in lines.columns if c not in ("source", "destination", "distance_km", "row_number")]
    best = F.min(F.struct("distance_km", "row_number", *rest)).alias("best")
    return (
        lines.where("distance_km > 0 AND source <> destination")
        .groupBy(*pair_key()).agg(best).select("a", "b", "best.*")
    )


def adjacency(edges: DataFrame) -> DataFrame:
    """Both directions of every line: (src, dst, km)."""
    both = F.array(F.struct(F.col("a").alias("src"), F.col("b").alias("dst"), F.col("distance_km").alias("km")),
                   F.struct(F.col("b").alias("src"), F.col("a").alias("dst"), F.col("distance_km").alias("km")))
    return edges.select(F.inline(both))


def edge_lookup(pairs: DataFrame, edges: DataFrame, a: str, b: str) -> DataFrame:
    """Attach the line between two stations, whichever way round they are named."""
    keyed = pairs.withColumn("_a", F.least(a, b)).withColumn("_b", F.greatest(a, b))
    line = edges.withColumnRenamed("a", "_a").withColumnRenamed("b", "_b")
    return join_hot(keyed, line, ["_a", "_b"], "left").drop("_a", "_b")


def isolated_stations(stations: DataFrame, edges: DataFrame) -> DataFrame:
    return stations.select("name").join(adjacency(edges), F.col("name") == F.col("src"), "left_anti")


def station_degree(stations: DataFrame, edges: DataFrame) -> DataFrame:
    """Lines meeting at each station; counted before the join, so a hub is one row in it."""
    degrees = adjacency(edges).groupBy(F.col("src").alias("name")).agg(F.count("*").alias("degree"))
    return stations.select("name").join(degrees, "name", "left").select(
        "name", F.coalesce("degree", F.lit(0)).cast("bigint").alias("degree"))


def orphan_endpoints(lines: DataFrame, stations: DataFrame, source: str, destination: str, key: str) -> DataFrame:
    """Lines where either end is unknown."""
    known = stations.select(F.col(key).alias("_known"))
    first = lines.join(known, F.col(source) == F.col("_known"), "left_anti")
    second = lines.join(known, F.col(destination) == F.col("_known"), "left_anti")
    return first.union(second).distinct()


def neighbour_centroid(stations: DataFrame, edges: DataFrame) -> DataFrame:
    """Fill missing coordinates with the mean of the known neighbours' coordinates."""
    known = stations.where("latitude IS NOT NULL AND longitude IS NOT NULL")
    missing = stations.where("latitude IS NULL OR longitude IS NULL").select("name")
    means = (
        adjacency(edges)
        .join(missing, F.col("src") == F.col("name"), "left_semi")
        .join(known.select("name", "latitude", "longitude"), F.col("dst") == F.col("name"))
        .groupBy(F.col("src").alias("name"))
        .agg(F.avg(F.col("latitude").cast("double")).alias("mean_lat"), F.avg(F.col("longitude").cast("double")).alias("mean_lon"))
    )
    placed = stations.join(means, "name", "left")
    has = F.col("latitude").isNotNull() & F.col("longitude").isNotNull()
    return placed.select(
        "name",
        F.when(has, F.col("latitude").cast("double")).otherwise(F.col("mean_lat")).alias("latitude"),
        F.when(has, F.col("longitude").cast("double")).otherwise(F.col("mean_lon")).alias("longitude"),
        (~has & F.col("mean_lat").isNotNull()).alias("imputed"))


def line_extent(edges: DataFrame) -> DataFrame:
    return edges.agg(
        F.count("*").alias("routable_lines"), F.min("distance_km").alias("shortest_line_km"),
        F.max("distance_km").alias("longest_line_km"), F.sum("distance_km").alias("total_line_km"))


def busiest_station(stations: DataFrame, edges: DataFrame) -> DataFrame:
    return station_degree(stations, edges).orderBy(F.desc("degree"), "name").limit(1)


def nearest_lines(edges: DataFrame, k: int) -> DataFrame:
    """Each station's k shortest lines. The ranking is trimmed before its shuffle, hubs included."""
    by = Window.partitionBy("src").orderBy("km", "dst")
    return adjacency(edges).withColumn("rn", F.row_number().over(by)).where(F.col("rn") <= k).drop("rn")
