"""Points on the plane and on the map: projection, spans, lengths along a line, close pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.operators.sequence import with_previous, with_running_sum

STEP, LENGTH = "decimal(18,9)", "decimal(28,9)"


def project_xy(points: DataFrame, width: float, height: float, padding: float = 54.0) -> DataFrame:
    """Equirectangular projection with one scale for both axes, north at the top.

    The extent is one row; a point without coordinates stays, without a place.
    """
    def extent(expr):
        return points.where("latitude IS NOT NULL AND longitude IS NOT NULL").agg(expr.alias("v")).scalar()

    box = extent(F.struct(
        F.min("latitude").alias("s"), F.max("latitude").alias("n"),
        F.min("longitude").alias("w"), F.max("longitude").alias("e")))
    placed = points.withColumn("_box", box)
    lon_scale = F.cos(F.radians((F.col("_box.s") + F.col("_box.n")) / 2))
    span_x = F.greatest((F.col("_box.e") - F.col("_box.w")) * lon_scale, F.lit(1e-6))
    span_y = F.greatest(F.col("_box.n") - F.col("_box.s"), F.lit(1e-6))
    inner_w, inner_h = max(width - padding * 2, 1.0), max(height - padding * 2, 1.0)
    scale = F.least(inner_w / span_x, inner_h / span_y)
    x = F.lit(padding) + (inner_w - span_x * scale) / 2 + (F.col("longitude") - F.col("_box.w")) * lon_scale * scale
    y = F.lit(padding) + (inner_h - span_y * scale) / 2 + (F.col("_box.n") - F.col("latitude")) * scale
    known = F.col("latitude").isNotNull() & F.col("longitude").isNotNull()
    return placed.withColumn("px", F.when(known, x)).withColumn("py", F.when(known, y)).drop("_box")


def span_centroid(points: DataFrame, group: str) -> DataFrame:
    """Per group: the larger of the two spans and the mean point."""
    return points.groupBy(group).agg(
        F.greatest(F.max("x") - F.min("x"), F.max("y") - F.min("y")).alias("span"),
        F.avg("x").alias("cx"), F.avg("y").alias("cy"))


def arc_length(vertices: DataFrame, route: str, slice_: str, order: str) -> DataFrame:
    """Length walked up to each vertex of a route: adds seg, walked and walked_total."""
    seen = with_previous(vertices, [route], slice_, [order], ["x", "y"])
    step = F.hypot(F.col("x") - F.col("prev_x"), F.col("y") - F.col("prev_y"))
    return with_running_sum(
        seen.withColumn("seg", F.coalesce(step, F.lit(0.0)).cast(STEP)), [route], slice_, [order], "seg", "walked", LENGTH)


def arc_midpoint(vertices: DataFrame, route: str, slice_: str, order: str) -> DataFrame:
    """The point half way along each route; of a route without length, its first vertex.

    Exactly one segment of a route contains the half-way point, so one row per
    route passes the filter and nothing has to be gathered.
    """
    half = F.col("walked_total") / 2
    reached = (F.col("walked") >= half) & (F.col("walked") - F.col("seg") < half)
    still = (F.col("walked_total") == 0) & F.col("prev_x").isNull()
    t = ((half - (F.col("walked") - F.col("seg"))) / F.col("seg")).cast("double")
    return arc_length(vertices, route, slice_, order).where(reached | still).select(
        route,
        F.when(F.col("seg") > 0, F.col("prev_x") + (F.col("x") - F.col("prev_x")) * t).otherwise(F.col("x")).alias("mx"),
        F.when(F.col("seg") > 0, F.col("prev_y") + (F.col("y") - F.col("prev_y")) * t).otherwise(F.col("y")).alias("my"))


def close_pairs(points: DataFrame, separation: float) -> DataFrame:
    """Places nearer to each other than the separation, with how many pairs of points that is.

    Points at one place are counted, not paired: a place that holds many copies is
    one row with its number of pairs. Different places meet only within a grid
    cell as wide as the separation or in the cells next to it.
    """
    places = points.groupBy("x", "y").agg(F.count("*").alias("n"), F.min("id").alias("id"))
    cells = places.withColumn("cx", F.floor(F.col("x") / separation)).withColumn("cy", F.floor(F.col("y") / separation))
    # Each pair of cells is looked at from one side only.
    ahead = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy"))
                      for dx, dy in ((0, 0), (1, 0), (1, 1), (0, 1), (1, -1))])
    left = cells.select("*", F.inline(ahead)).select(
        (F.col("cx") + F.col("dx")).alias("cx"), (F.col("cy") + F.col("dy")).alias("cy"),
        ((F.col("dx") == 0) & (F.col("dy") == 0)).alias("same"), "x", "y", "n", "id").alias("l")
    right = cells.alias("r")
    gap = F.sqrt((F.col("l.x") - F.col("r.x")) * (F.col("l.x") - F.col("r.x"))
                 + (F.col("l.y") - F.col("r.y")) * (F.col("l.y") - F.col("r.y")))
    apart = left.join(right, (F.col("l.cx") == F.col("r.cx")) & (F.col("l.cy") == F.col("r.cy"))).where(
        (~F.col("l.same") | (F.col("l.id") < F.col("r.id"))) & (gap < separation)
    ).select(
        F.least("l.id", "r.id").alias("a"), F.greatest("l.id", "r.id").alias("b"), gap.alias("distance"),
        (F.col("l.n") * F.col("r.n")).alias("pairs"))
    coincident = places.where("n > 1").select(
        F.col("id").alias("a"), F.col("id").alias("b"), F.lit(0.0).alias("distance"),
        F.expr("n * (n - 1) div 2").alias("pairs"))
    return apart.unionByName(coincident)
