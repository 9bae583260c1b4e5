"""Row order within a key without putting a whole key into one task.

A key may hold a large part of all rows, so windows run over slices of a key
(an hour, a block of positions, a range of values) and a small table with one
row per slice carries what passes from one slice to the next.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _slices(df: DataFrame, keys: list[str], slice_: str, **aggregates: Column) -> DataFrame:
    return df.groupBy(*keys, slice_).agg(*[c.alias(n) for n, c in aggregates.items()])


def with_previous(df: DataFrame, keys: list[str], slice_: str, order: list[str], values: list[str]) -> DataFrame:
    """Add ``prev_<value>``: the values of the row before, within the key."""
    ends = _slices(df, keys, slice_, _last=F.max_by(F.struct(*values), F.struct(*order)))
    carried = ends.withColumn("_last", F.lag("_last").over(Window.partitionBy(*keys).orderBy(slice_)))
    inner = Window.partitionBy(*keys, slice_).orderBy(*order)
    here = df.withColumn("_at", F.row_number().over(inner)).withColumn("_lag", F.lag(F.struct(*values)).over(inner))
    joined = here.join(carried, [*keys, slice_])
    before = F.when(F.col("_at") == 1, F.col("_last")).otherwise(F.col("_lag"))
    return joined.withColumn("_before", before).select(
        *df.columns, *[F.col(f"_before.{v}").alias(f"prev_{v}") for v in values])


def with_position(df: DataFrame, keys: list[str], slice_: str, order: list[str], name: str = "step") -> DataFrame:
    """Add a one-based position within the key, and ``<name>_count``, the key's rows."""
    whole = Window.partitionBy(*keys)
    counts = _slices(df, keys, slice_, _n=F.count("*"))
    offsets = counts.withColumn("_skip", F.sum("_n").over(whole.orderBy(slice_)) - F.col("_n")).withColumn(
        "_all", F.sum("_n").over(whole)).drop("_n")
    inner = Window.partitionBy(*keys, slice_).orderBy(*order)
    return df.withColumn("_at", F.row_number().over(inner)).join(offsets, [*keys, slice_]).select(
        *df.columns, (F.col("_skip") + F.col("_at")).alias(name), F.col("_all").alias(f"{name}_count"))


def with_running_sum(df: DataFrame, keys: list[str], slice_: str, order: list[str], value: str, name: str,
                     as_type: str = "bigint") -> DataFrame:
    """Add the running sum of `value` up to and including the row, and ``<name>_total``.

    Sums are kept as `as_type`. Without that a decimal would lose places, since
    every sum of sums asks for ten more digits.
    """
    def kept(c: Column) -> Column:
        return F.coalesce(c, F.lit(0)).cast(as_type)

    whole = Window.partitionBy(*keys)
    sums = _slices(df, keys, slice_, _s=kept(F.sum(value)))
    offsets = sums.withColumn("_skip", kept(kept(F.sum("_s").over(whole.orderBy(slice_))) - F.col("_s"))).withColumn(
        "_all", kept(F.sum("_s").over(whole))).drop("_s")
    inner = Window.partitionBy(*keys, slice_).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    running = df.withColumn("_in", kept(F.sum(value).over(inner)))
    return running.join(offsets, [*keys, slice_]).select(
        *df.columns, kept(F.col("_skip") + F.col("_in")).alias(name), F.col("_all").alias(f"{name}_total"))


def collapse_repeats(df: DataFrame, keys: list[str], slice_: str, order: list[str], value: str) -> DataFrame:
    """Keep a row only where `value` differs from the row before it."""
    seen = with_previous(df, keys, slice_, order, [value])
    return seen.where(F.col(f"prev_{value}").isNull() | (F.col(f"prev_{value}") != F.col(value)))
