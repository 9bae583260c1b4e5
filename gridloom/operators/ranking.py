"""Orders, pages and previews."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.session import cut


def by_column(column: str, descending: bool = False) -> Column:
    """An order on one column with missing values last, either way."""
    return F.desc_nulls_last(column) if descending else F.asc_nulls_last(column)


def sorted_whole(df: DataFrame, column: str, tie: str, descending: bool = False) -> DataFrame:
    """The whole table with each row's place in the order, however large it is.

    Rows are dealt into ranges and sorted there; a row's place is its place within
    its range plus the rows of the ranges before it, one number per range.
    """
    order = [by_column(column, descending), F.asc(tie)]
    ranged = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).select(
        "*", F.spark_partition_id().alias("_range"), F.monotonically_increasing_id().alias("_at")))
    first = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = ranged.groupBy("_range").agg(F.count("*").alias("n")).select(
        "_range", F.coalesce(F.sum("n").over(first), F.lit(0)).alias("_before"))
    within = F.col("_at").bitwiseAND((1 << 33) - 1) + 1
    return ranged.join(before, "_range").withColumn("place", within + F.col("_before")).drop("_range", "_at", "_before")


def preview(df: DataFrame, keys: list[str], value: str, n: int) -> DataFrame:
    """Per group: how many distinct values there are and the first `n` of them in order.

    Values are ranked and trimmed before they are collected, so no group is ever
    gathered beyond the `n` that are shown.
    """
    distinct = df.select(*keys, value).distinct()
    by = Window.partitionBy(*keys).orderBy(value)
    shown = (
        distinct.withColumn("rn", F.row_number().over(by)).where(F.col("rn") <= n)
        .groupBy(*keys).agg(F.array_sort(F.collect_list(value)).alias("_first"))
    )
    counts = distinct.groupBy(*keys).agg(F.count("*").alias("total"))
    return counts.join(shown, keys).select(
        *keys, "total",
        F.concat(F.array_join("_first", ", "), F.when(F.col("total") > n, " ...").otherwise("")).alias("preview"))


def legs_limit(legs: DataFrame, route: str, n: int = 30) -> DataFrame:
    """The first `n` legs of each route as text and how many further there are.

    Legs beyond the first `n` are dropped from the listing before it is gathered
    and only counted, so a very long route costs a count.
    """
    by = Window.partitionBy(route).orderBy("step")
    line = F.concat(F.col("step").cast("string"), F.lit(": "), F.col("origin"), F.lit(" -> "), F.col("destination"))
    shown = (
        legs.withColumn("rn", F.row_number().over(by)).where(F.col("rn") <= n)
        .groupBy(route).agg(F.array_sort(F.collect_list(F.struct("step", line.alias("line")))).alias("l")))
    counts = legs.groupBy(route).agg(F.count("*").alias("legs"))
    return counts.join(shown, route).select(
        route, "legs", F.greatest(F.col("legs") - n, F.lit(0)).cast("bigint").alias("further"),
        F.array_join(F.transform("l", lambda x: x.line), "; ").alias("listed"))
