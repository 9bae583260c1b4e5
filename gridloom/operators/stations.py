"""Stations and lines from raw connection rows: cleaning, dimension, findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.operators.skew import join_hot
from gridloom.functions.text import clean_name, safe_float, says_something

COORDINATE_TOLERANCE = 1e-4  # fixed value: readings further apart than this conflict


def clean_connections(raw: DataFrame) -> DataFrame:
    """Typed connections from a frame of text cells. Rows with a blank end are dropped."""
    typed = drop_blank_endpoints(raw).select(
        "row_number",
        clean_name(F.col("source")).alias("source"),
        clean_name(F.col("destination")).alias("destination"),
        clean_name(F.col("line_type")).alias("line_type"),
        *[safe_float(F.col(c)).alias(c) for c in (
            "src_lat", "src_lon", "dst_lat", "dst_lon", "distance_km", "voltage_kv",
            "capacity_mw", "loss_percent", "energy_loss_mw")],
    )
    return nullify_distance(typed)


def drop_blank_endpoints(lines: DataFrame) -> DataFrame:
    return lines.where(says_something(F.col("source")) & says_something(F.col("destination")))


def nullify_distance(lines: DataFrame) -> DataFrame:
    """A distance that is not positive is no distance; the row stays."""
    return lines.withColumn("distance_km", F.when(F.col("distance_km") > 0, F.col("distance_km")))


def routable(lines: DataFrame) -> DataFrame:
    return lines.where("distance_km > 0")


def without_self_loops(lines: DataFrame) -> DataFrame:
    return lines.where("source <> destination")


def endpoints(lines: DataFrame) -> DataFrame:
    """Both ends of every line as one column of readings; the type belongs to the source end."""
    ends = F.array(
        F.struct(F.lit(0).alias("side"), F.col("source").alias("name"), F.col("line_type").alias("type"),
                 F.col("src_lat").alias("lat"), F.col("src_lon").alias("lon")),
        F.struct(F.lit(1).alias("side"), F.col("destination").alias("name"), F.lit(None).cast("string").alias("type"),
                 F.col("dst_lat").alias("lat"), F.col("dst_lon").alias("lon")),
    )
    return lines.select("row_number", F.inline(ends))


def station_union(lines: DataFrame) -> DataFrame:
    return lines.select(F.col("source").alias("name")).union(lines.select("destination")).distinct()


def station_dimension(lines: DataFrame) -> DataFrame:
    """One row per name: the first full coordinate reading in row order, and its types."""
    usable = F.col("lat").isNotNull() & F.col("lon").isNotNull()
    first = F.min(F.when(usable, F.struct("row_number", "side", "lat", "lon")))
    return (
        endpoints(lines).groupBy("name")
        .agg(first.alias("first"), F.array_sort(F.collect_set("type")).alias("types"))
        .select("name", F.col("first.lat").alias("latitude"), F.col("first.lon").alias("longitude"), "types")
    )


def has_coordinates(lat: str = "latitude", lon: str = "longitude") -> Column:
    return F.col(lat).isNotNull() & F.col(lon).isNotNull()


def coordinate_conflicts(lines: DataFrame, stations: DataFrame) -> DataFrame:
    """Full readings further than the tolerance from the one that was kept."""
    limit = F.lit(str(COORDINATE_TOLERANCE)).cast("decimal(9,4)")
    readings = endpoints(lines).where("lat IS NOT NULL AND lon IS NOT NULL")
    return join_hot(readings, stations.select("name", "latitude", "longitude"), ["name"]).where(
        (F.abs(F.col("lat") - F.col("latitude")) > limit) | (F.abs(F.col("lon") - F.col("longitude")) > limit)
    ).select("row_number", "side", "name", "lat", "lon", "latitude", "longitude")


def pair_key(source: str = "source", destination: str = "destination") -> tuple[Column, Column]:
    return F.least(source, destination).alias("a"), F.greatest(source, destination).alias("b")


def first_rows(lines: DataFrame) -> DataFrame:
    """The first row of every unordered pair (an aggregate, so a hot pair combines early)."""
    return lines.groupBy(*pair_key()).agg(F.min("row_number").alias("first_row"))


def duplicate_pairs(lines: DataFrame) -> DataFrame:
    """Second and later rows of an unordered pair, with the row it was first seen on."""
    firsts = first_rows(without_self_loops(lines))
    rows = without_self_loops(lines).select("row_number", *pair_key())
    return join_hot(rows, firsts, ["a", "b"]).where(F.col("row_number") > F.col("first_row"))


def load_warnings(lines: DataFrame, absent_columns: list[str] = ()) -> DataFrame:
    """Every finding of a load as typed rows: (row, code, detail). `lines` is before cleaning."""
    spark = lines.sparkSession
    kept = drop_blank_endpoints(lines)
    stations = station_dimension(kept)
    pair = F.concat_ws(" -> ", "source", "destination")
    blank = ~(says_something(F.col("source")) & says_something(F.col("destination")))
    row_findings = F.array_compact(F.array(
        F.when(blank, F.struct(F.lit("blank_endpoint").alias("code"), F.lit("row skipped").alias("detail"))),
        F.when(~blank & (F.col("source") == F.col("destination")),
               F.struct(F.lit("self_loop").alias("code"), F.col("source").alias("detail"))),
        F.when(~blank & F.col("distance_km").isNull(),
               F.struct(F.lit("missing_distance").alias("code"), pair.alias("detail"))),
        F.when(~blank & (F.col("distance_km") <= 0),
               F.struct(F.lit("non_positive_distance").alias("code"), pair.alias("detail"))),
    ))
    found = lines.select(F.col("row_number").alias("row"), F.inline(row_findings))
    conflicts = coordinate_conflicts(kept, stations).select(
        F.col("row_number").alias("row"), F.lit("coordinate_conflict").alias("code"), F.col("name").alias("detail"))
    duplicates = duplicate_pairs(kept).select(
        F.col("row_number").alias("row"), F.lit("duplicate_pair").alias("code"),
        F.concat_ws(" <-> ", "a", "b").alias("detail"))
    bare = stations.where(~has_coordinates()).select(
        F.lit(None).cast("string").alias("row"), F.lit("no_coordinates").alias("code"), F.col("name").alias("detail"))
    result = found.unionByName(conflicts).unionByName(duplicates).unionByName(bare)
    if absent_columns:
        rows = [(None, "absent_column", c) for c in absent_columns]
        result = result.unionByName(spark.createDataFrame(rows, "row string, code string, detail string"))
    return result
