"""Writing derived columns and keyed tables. Targets are new folders, never the one being read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions import money
from gridloom.sources.files import DERIVED


def _two_places(c: Column) -> Column:
    return F.coalesce(F.round(c, 2).cast("decimal(34,2)").cast("string"), F.lit(""))


def with_derived_columns(rows: DataFrame, loss: str = "Energy_Loss_MW",
                         tariff: money.Tariff = money.DEFAULT_TARIFF) -> DataFrame:
    """Source columns as they were, then the two costs, as the text cells of a file."""
    costs = money.loss_cost(F.col(loss).try_cast("decimal(24,4)"), tariff)
    derived = dict(zip(DERIVED, (_two_places(c) for c in costs.values())))
    return rows.drop(*DERIVED).withColumns(derived)


def derived_column_sink(rows: DataFrame, path: str, loss: str = "Energy_Loss_MW",
                        tariff: money.Tariff = money.DEFAULT_TARIFF, write: bool = True) -> bool:
    """Write the table with fresh costs unless the stored ones already match; says whether it wrote."""
    fresh = with_derived_columns(rows, loss, tariff)
    if all(c in rows.columns for c in DERIVED):
        aligned = rows.select("*", *[fresh_cell(loss, i, tariff).alias(f"_fresh{i}") for i in range(len(DERIVED))])
        differs = [~F.coalesce(F.col(c), F.lit("")).eqNullSafe(F.col(f"_fresh{i}")) for i, c in enumerate(DERIVED)]
        if aligned.where(differs[0] | differs[1]).isEmpty():
            return False
    if write:
        fresh.write.mode("errorifexists").option("header", True).csv(path)
    return write


def fresh_cell(loss: str, i: int, tariff: money.Tariff) -> Column:
    return _two_places(list(money.loss_cost(F.col(loss).try_cast("decimal(24,4)"), tariff).values())[i])


def keyed_upsert(existing: DataFrame, incoming: DataFrame, keys: list[str | Column]) -> DataFrame:
    """Incoming rows, one for each key, and the existing rows whose key is not among them.

    Keys may be expressions, such as the two ends of a line put in order. Of
    several incoming rows with one key the largest stays, by the values of its
    columns from left to right.
    """
    def keyed(df: DataFrame) -> DataFrame:
        return df.select("*", *[(F.col(k) if isinstance(k, str) else k).alias(f"_k{i}") for i, k in enumerate(keys)])

    names = [f"_k{i}" for i in range(len(keys))]
    unique = keyed(incoming).groupBy(*names).agg(F.max(F.struct(*incoming.columns)).alias("row"))
    kept = keyed(existing).join(unique.select(*names), names, "left_anti")
    return unique.select("row.*").unionByName(kept.drop(*names))
