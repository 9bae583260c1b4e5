"""Checks on stored tables: constraints, keys, counts, derived columns gone stale."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions import money

LINE_CHECKS = {
    "no_self_loop": "source <> destination",
    "distance_positive": "distance_km > 0",
    "voltage_positive": "voltage_kv > 0",
    "capacity_not_negative": "capacity_mw >= 0",
    "energy_loss_not_negative": "energy_loss_mw >= 0",
    "loss_percent_range": "loss_percent BETWEEN 0 AND 100",
    "latitude_range": "src_lat BETWEEN -90 AND 90",
    "longitude_range": "src_lon BETWEEN -180 AND 180",
}
LINE_REQUIRED = ("line_type", "distance_km", "voltage_kv", "capacity_mw", "loss_percent", "energy_loss_mw")


def check_constraints(rows: DataFrame, key: str, checks: dict[str, str] = LINE_CHECKS,
                      required: tuple[str, ...] = LINE_REQUIRED) -> DataFrame:
    """(key, violation) for every broken rule, in one pass. A check on NULL holds, as in SQL."""
    broken = [F.when(~F.expr(rule), F.lit(name)) for name, rule in checks.items()]
    absent = [F.when(F.col(c).isNull(), F.lit(f"{c}_not_null")) for c in required]
    return rows.select(key, F.explode(F.array_compact(F.array(*broken, *absent))).alias("violation"))


def duplicate_keys(rows: DataFrame, *keys: Column | str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("copies")).where("copies > 1")


def row_counts(expected: dict[str, tuple[DataFrame, int]]) -> DataFrame:
    """Actual against expected rows of several tables."""
    parts = [
        df.agg(F.count("*").alias("rows")).select(
            F.lit(name).alias("table_name"), "rows", F.lit(n).cast("bigint").alias("expected"))
        for name, (df, n) in expected.items()]
    return reduce(DataFrame.unionAll, parts).withColumn("as_expected", F.col("rows") == F.col("expected"))


def check_union(checks: dict[str, DataFrame]) -> DataFrame:
    """Several lists of violations as one list of counts."""
    parts = [df.agg(F.count("*").alias("violations")).select(F.lit(name).alias("check_name"), "violations")
             for name, df in checks.items()]
    return reduce(DataFrame.unionAll, parts)


def violation_list(violations: DataFrame) -> DataFrame:
    """The names of the broken rules as one text; there are only as many as rules."""
    return violations.select("violation").distinct().agg(
        F.array_join(F.array_sort(F.collect_list("violation")), ", ").alias("violations"))


def stale_columns(rows: DataFrame, key: str, tariff: money.Tariff = money.DEFAULT_TARIFF) -> DataFrame:
    """Rows whose stored cost differs from the one their loss gives now."""
    fresh = money.loss_cost(F.col("energy_loss_mw"), tariff)
    hour, year = fresh["loss_cost_per_hour_inr"], fresh["loss_cost_per_year_inr"]
    same = F.col("loss_cost_per_hour_inr").eqNullSafe(hour) & F.col("loss_cost_per_year_inr").eqNullSafe(year)
    return rows.where(~same).select(
        key, F.col("loss_cost_per_hour_inr").alias("stored_hour"), hour.alias("fresh_hour"),
        F.col("loss_cost_per_year_inr").alias("stored_year"), year.alias("fresh_year"))


def attribute_coverage(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(column, present, total) for optional columns, counted in one pass."""
    counted = rows.agg(F.count("*").alias("total"), *[F.count(c).alias(c) for c in columns])
    return counted.unpivot(["total"], columns, "attribute", "present").select("attribute", "present", "total")


def index_determinism(first: DataFrame, second: DataFrame) -> DataFrame:
    """How many rows two builds do not share."""
    return check_union({"only_first": first.exceptAll(second), "only_second": second.exceptAll(first)})
