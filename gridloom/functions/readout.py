"""Readout strings for distances, shares, power, money and durations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NOTHING = "-"


def fixed(value: Column, decimals: int) -> Column:
    """Digits with `decimals` places and no grouping."""
    return F.regexp_replace(F.format_number(value, decimals), ",", "")


def _signed(value: Column, text: Column) -> Column:
    return F.when(value > 0, F.concat(F.lit("+"), text)).otherwise(text)


def quantity(value: Column, unit: str, decimals: int = 3, signed: bool = False) -> Column:
    """Grouped digits and a unit, such as ``1,234.500 km``."""
    text = F.concat(F.format_number(value, decimals), F.lit(f" {unit}"))
    return F.coalesce(_signed(value, text) if signed else text, F.lit(NOTHING))


def share(value: Column, decimals: int = 2, signed: bool = False) -> Column:
    text = F.concat(fixed(value, decimals), F.lit("%"))
    return F.coalesce(_signed(value, text) if signed else text, F.lit(NOTHING))


def rupees_short(value: Column, signed: bool = False) -> Column:
    """Rupees on the short scale: thousand, lakh, crore."""
    v = value.cast("double")
    size = F.abs(v)

    def scaled(unit: float, letter: str) -> Column:
        return F.concat(F.when(v < 0, "-").otherwise(""), F.lit("₹"), fixed(size / unit, 2), F.lit(letter))

    text = (
        F.when(size >= 1e7, scaled(1e7, " Cr")).when(size >= 1e5, scaled(1e5, " L"))
        .when(size >= 1e3, scaled(1e3, " K")).when(size >= 0, scaled(1.0, "")))
    return F.coalesce(_signed(v, text) if signed else text, F.lit(NOTHING))


def duration(seconds: Column) -> Column:
    """A running time in the unit that reads naturally."""
    s = seconds.cast("double")
    return (
        F.when(s.isNull(), NOTHING)
        .when(s < 0.001, F.concat(fixed(s * 1e6, 0), F.lit(" µs")))
        .when(s < 1, F.concat(fixed(s * 1000, 3), F.lit(" ms")))
        .when(s < 60, F.concat(fixed(s, 2), F.lit(" s")))
        .otherwise(F.concat(F.floor(s / 60).cast("string"), F.lit("m "),
                            fixed(s - F.floor(s / 60) * 60, 0), F.lit("s")))
    )
