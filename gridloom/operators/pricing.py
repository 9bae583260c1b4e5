"""Routes mapped to the physical lines they run over, and the loss priced on those lines.

Steps are counted per (route, line) before anything is joined, so the joins carry
one row per route and line however often a route crosses it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.operators.skew import join_hot
from gridloom.functions import money

# The reasons and notes users already know.
NO_PATH = "the leg records no traversed path, so it maps to no line"
NO_LINE = "no transmission line in the dataset joins these two stations"
HOURS_NOTE = (
    "Annualised cost is an ESTIMATE: it assumes the modeled loss is present for all 8,760 hours of the year. "
    "The dataset carries no load factor or operating profile, so this is not an actual yearly loss and not an "
    "electricity bill."
)
DISTINCT_NOTE = (
    "Energy loss is summed once per distinct transmission line used. Energy_Loss_MW is a steady-state property "
    "of a line, so a line crossed twice is still counted once."
)
DISTANCE_NOTE = (
    "Route distance and route loss are separate readings from the same lines. Distance does not determine loss."
)


def leg_hops(legs: DataFrame) -> DataFrame:
    """Every consecutive pair on every leg's path; a leg without a path keeps one row, marked so."""
    pairs = F.transform(F.sequence(F.lit(0), F.size("path") - 2), lambda i: F.struct(
        F.get("path", i).alias("origin"), F.get("path", i + 1).alias("destination"), F.lit(True).alias("has_path")))
    bare = F.array(F.struct("origin", "destination", F.lit(False).alias("has_path")))
    return legs.select(
        "route_id", "step", F.posexplode(F.when(F.size("path") >= 2, pairs).otherwise(bare)).alias("hop", "h")
    ).select("route_id", "step", "hop", "h.*")


def _keyed(hops: DataFrame) -> DataFrame:
    return hops.withColumn("a", F.least("origin", "destination")).withColumn("b", F.greatest("origin", "destination"))


def route_to_lines(legs: DataFrame, edges: DataFrame) -> DataFrame:
    """Each hop with the line it runs over, NULL where there is none."""
    lines = edges.withColumn("matched", F.lit(True))
    hops = _keyed(leg_hops(legs))
    return join_hot(hops, lines, ["a", "b"], "left").withColumn(
        "matched", F.coalesce("matched", F.lit(False)) & F.col("has_path"))


def unmatched_steps(legs: DataFrame, edges: DataFrame) -> DataFrame:
    """Hops that run over no line, and legs that record no path, each with its reason."""
    hops = _keyed(leg_hops(legs))
    bare = hops.where(~F.col("has_path")).withColumn("reason", F.lit(NO_PATH))
    lost = join_hot(hops.where("has_path"), edges.select("a", "b"), ["a", "b"], "left_anti").withColumn(
        "reason", F.lit(NO_LINE))
    return bare.unionByName(lost).select("route_id", "step", "hop", "origin", "destination", "reason")


def step_counts(legs: DataFrame, edges: DataFrame) -> DataFrame:
    """Steps counted per route and pair, with the line's readings where a line matches."""
    counted = _keyed(leg_hops(legs)).groupBy("route_id", "has_path", "a", "b").agg(F.count("*").alias("traversals"))
    return counted.join(edges.withColumn("matched", F.lit(True)), ["a", "b"], "left").withColumn(
        "matched", F.coalesce("matched", F.lit(False)) & F.col("has_path"))


def route_line_usage(counts: DataFrame, tariff: money.Tariff = money.DEFAULT_TARIFF) -> DataFrame:
    """Distinct lines per route with how often each is crossed and what its loss costs."""
    keep = [c for c in ("distance_km", "loss_percent", "energy_loss_mw") if c in counts.columns]
    return counts.where("matched").select("route_id", "a", "b", *keep, "traversals").withColumns(
        money.loss_cost(F.col("energy_loss_mw"), tariff))


def route_loss(counts: DataFrame, tariff: money.Tariff = money.DEFAULT_TARIFF) -> DataFrame:
    """Per route: loss over distinct lines (the headline), loss per traversal, and what is incomplete.

    A line without a reading adds nothing and marks the route; a step without a
    line is counted apart.
    """
    hit, loss = F.col("matched"), F.col("energy_loss_mw")
    zero = F.lit(0).cast("decimal(28,4)")
    totals = counts.groupBy("route_id").agg(
        F.count_if(hit).alias("line_count"),
        F.coalesce(F.sum(F.when(hit, F.col("traversals"))), F.lit(0)).alias("traversal_count"),
        F.count_if(hit & (F.col("traversals") > 1)).alias("revisited_lines"),
        F.coalesce(F.sum(F.when(hit, loss)).cast("decimal(28,4)"), zero).alias("total_energy_loss_mw"),
        F.coalesce(F.sum(F.when(hit, loss * F.col("traversals"))).cast("decimal(28,4)"), zero).alias(
            "traversal_energy_loss_mw"),
        F.count_if(hit & loss.isNull()).alias("lines_missing_loss"),
        F.coalesce(F.sum(F.when(~hit, F.col("traversals"))), F.lit(0)).alias("unmatched_steps"),
    )
    hourly = money.hourly_cost(F.col("total_energy_loss_mw"), tariff)
    return totals.select(
        "*", ((F.col("lines_missing_loss") == 0) & (F.col("unmatched_steps") == 0)).alias("complete"),
        money.kwh_per_hour(F.col("total_energy_loss_mw")).alias("energy_loss_kwh_per_hour"),
        hourly.alias("loss_cost_per_hour_inr"), money.yearly_cost(hourly).alias("loss_cost_per_year_inr"))


def lines_missing_loss(counts: DataFrame) -> DataFrame:
    """The lines of each route that carry no loss reading."""
    return counts.where(F.col("matched") & F.col("energy_loss_mw").isNull()).select("route_id", "a", "b", "traversals")


def route_completeness(losses: DataFrame, counts: DataFrame) -> DataFrame:
    """Per route: is the total whole, or a lower bound, and over which lines.

    Names are listed per distinct line of a route, never per step.
    """
    names = lines_missing_loss(counts).groupBy("route_id").agg(
        F.array_join(F.array_sort(F.collect_list(F.concat_ws(" - ", "a", "b"))), ", ").alias("missing"))
    return losses.join(names, "route_id", "left").select(
        "route_id", "complete", (~F.col("complete")).alias("lower_bound"), "lines_missing_loss", "unmatched_steps",
        F.coalesce("missing", F.lit("")).alias("missing"), "total_energy_loss_mw")


def caveats(tariff: money.Tariff = money.DEFAULT_TARIFF, missing: Column | None = None) -> Column:
    """The notes a reader of a route's cost needs; the last two only where they apply."""
    missing = F.col("missing") if missing is None else missing
    priced = (
        f"Priced at the {tariff.category} energy charge only (Rs. {tariff.inr_per_kwh:.2f}/kWh). Fixed charges, "
        "demand charges, FPPCA, taxes and other billing components are excluded.")
    lacking = F.concat(
        F.col("lines_missing_loss").cast("string"),
        F.lit(" line(s) used by this route carry no Energy_Loss_MW in the dataset and contribute nothing to the total: "),
        missing, F.lit(". The figure is a lower bound."))
    lost = F.concat(
        F.col("unmatched_steps").cast("string"),
        F.lit(" route step(s) could not be matched to a transmission line and were excluded."))
    return F.array_compact(F.array(
        F.lit(HOURS_NOTE), F.lit(priced), F.lit(DISTINCT_NOTE), F.lit(DISTANCE_NOTE),
        F.when(F.col("lines_missing_loss") > 0, lacking), F.when(F.col("unmatched_steps") > 0, lost)))


def merged_caveats(first: Column, second: Column) -> Column:
    """The notes of two routes, each said once."""
    return F.array_distinct(F.concat(first, second))


MEASURES = ("total_energy_loss_mw", "loss_cost_per_hour_inr", "loss_cost_per_year_inr")


def route_km(counts: DataFrame) -> DataFrame:
    """(route_id, route_km): kilometres along the matched lines, each as often as it is crossed."""
    km = F.sum(F.when(F.col("matched"), F.col("distance_km") * F.col("traversals")))
    return counts.groupBy("route_id").agg(F.coalesce(km, F.lit(0)).cast("decimal(28,3)").alias("route_km"))


def route_comparison(losses: DataFrame, group: str, label: str, first: str = "classical", second: str = "hybrid",
                     measures: tuple[str, ...] = MEASURES) -> DataFrame:
    """First minus second for each measure, and the route with the lower modelled loss.

    Both routes of a group meet in one grouped aggregate; there is no self-join.
    """
    def of(which: str, measure: str) -> Column:
        return F.max(F.when(F.col(label) == which, F.col(measure)))

    both = losses.groupBy(group).agg(
        *[(of(first, m) - of(second, m)).alias(f"{m}_difference") for m in measures])
    gap = F.col("total_energy_loss_mw_difference")
    return both.withColumn(
        "lower_loss_route",
        F.when(F.abs(gap) < 1e-9, "tie").when(gap > 0, second).when(gap < 0, first))


def route_membership(usage: DataFrame, group: str, label: str, first: str, second: str,
                     marks: tuple[str, str] = ("nn", "qa")) -> DataFrame:
    """Each line marked by the route that runs over it, or both."""
    on_first = F.bool_or(F.col(label) == first)
    on_second = F.bool_or(F.col(label) == second)
    return usage.where(F.col(label).isin(first, second)).groupBy(group, "a", "b").agg(
        F.when(on_first & on_second, "both").when(on_first, marks[0]).otherwise(marks[1]).alias("route"))
