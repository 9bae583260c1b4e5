"""Route pricing: what is counted once, what is missing, what is said about it."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import functions as F

from gridloom.functions.money import loss_cost
from gridloom.functions.text import indian_scale, number_text, tokenize, wrapped_chain
from gridloom.operators import compare as cp
from gridloom.operators import pricing as pr
from gridloom.operators.sequence import with_position, with_previous, with_running_sum

LEGS = "route_id string, step int, origin string, destination string, path array<string>"


def priced(spark, lines, *legs):
    counts = pr.step_counts(spark.createDataFrame(list(legs), LEGS), lines)
    losses = pr.route_loss(counts)
    return counts, losses, losses.first()


def test_there_and_back_counts_a_line_once(spark, lines):
    _, _, r = priced(spark, lines, ("r", 1, "a", "b", ["a", "b"]), ("r", 2, "b", "a", ["b", "a"]))
    assert (r["line_count"], r["traversal_count"], r["revisited_lines"]) == (1, 2, 1)
    assert r["total_energy_loss_mw"] == 1 and r["traversal_energy_loss_mw"] == 2 and r["complete"]
    assert r["loss_cost_per_hour_inr"] == 6600


def test_a_missing_loss_is_not_zero(spark, lines):
    counts, losses, r = priced(spark, lines, ("r", 1, "b", "c", ["b", "c"]))
    assert r["total_energy_loss_mw"] == 0 and not r["complete"] and r["lines_missing_loss"] == 1
    notes = pr.route_completeness(losses, counts).select(pr.caveats().alias("c")).first()["c"]
    assert len(notes) == 5 and "b - c. The figure is a lower bound." in notes[4]


def test_steps_on_no_line_have_a_reason(spark, lines):
    legs = [("r", 1, "b", "d", ["b", "d"]), ("r", 2, "d", "e", [])]
    _, _, r = priced(spark, lines, *legs)
    assert r["unmatched_steps"] == 2 and r["line_count"] == 0
    reasons = {x["step"]: x["reason"] for x in pr.unmatched_steps(spark.createDataFrame(legs, LEGS), lines).collect()}
    assert reasons == {1: pr.NO_LINE, 2: pr.NO_PATH}


def test_shown_distances_decide_the_comparison(spark):
    df = spark.createDataFrame([(2554.0154821, 2475.8767139), (5.0, 5.0)], "nn_km double, hybrid_km double")
    first, second = cp.tour_comparison(df).collect()
    assert first["improvement_km"] == Decimal("78.138") and first["improvement_percent"] == Decimal("3.06")
    assert (first["winner"], second["winner"]) == ("hybrid", "tie")


def test_cost_and_scale_texts(spark):
    df = spark.createDataFrame([(3232897.80,), (28320184728.0,), (4200.0,), (None,), (float("nan"),)], "v double")
    assert [r[0] for r in df.select(indian_scale(F.col("v"))).collect()] == [
        " (about Rs. 32.33 lakh)", " (about Rs. 2,832.02 crore)", "", "", ""]
    assert [r[0] for r in df.select(number_text(F.col("v"), "km", 2)).collect()] == [
        "3,232,897.8 km", "28,320,184,728 km", "4,200 km", *["not recorded in the dataset"] * 2]
    cost = spark.createDataFrame([(Decimal("10.0000"),), (None,)], "l decimal(24,4)").select(
        *[c.alias(n) for n, c in loss_cost(F.col("l")).items()]).collect()
    assert cost[0][0] == 66000 and cost[0][1] == 66000 * 8760 and cost[1][0] is None


def test_tokens_meet_on_their_stems(spark):
    def terms(text):
        return spark.range(1).select(tokenize(F.lit(text))).first()[0]

    for words in ("qubits qubit", "rupees rupee", "optimizing optimize optimizes", "policies policy"):
        assert len(set(terms(words))) == 1, words
    assert terms("loss") == ["loss"]
    assert terms("What is Energy_Loss_MW -> 6.60?") == ["energy", "loss", "mw", "6.60"]


def test_wrapped_chain_breaks_after_an_arrow(spark):
    df = spark.createDataFrame([(["aaaa", "bbbb", "cccc"],)], "s array<string>")
    assert df.select(wrapped_chain(F.col("s"), 12)).first()[0] == ["aaaa -> bbbb ->", "cccc"]


def test_slices_do_not_show_in_the_result(spark):
    rows = [("k" if i % 3 else "hot", i, i // 7, (i * 37) % 11) for i in range(60)]
    df = spark.createDataFrame(rows, "k string, i int, s int, v int")
    got = {r["i"]: r for r in with_running_sum(with_position(
        with_previous(df, ["k"], "s", ["i"], ["v"]), ["k"], "s", ["i"]), ["k"], "s", ["i"], "v", "upto").collect()}
    for key in ("k", "hot"):
        mine, total = [r for r in rows if r[0] == key], 0
        for n, row in enumerate(mine):
            total += row[3]
            assert got[row[1]]["prev_v"] == (mine[n - 1][3] if n else None)
            assert (got[row[1]]["step"], got[row[1]]["upto"]) == (n + 1, total)


def test_tail_mean(spark):
    rows = [("g", int(v), float(v), w, a) for v, w in ((1, 2), (2, 3), (9, 5)) for a in (0.3,)]
    df = spark.createDataFrame(rows, "g string, s int, value double, weight bigint, alpha double")
    assert cp.tail_mean(df, "g", "s").first()["tail_mean"] == round((1 * 2 + 2 * 1) / 3, 6)
    whole = df.withColumn("alpha", F.lit(1.0))
    assert cp.tail_mean(whole, "g", "s").first()["tail_mean"] == round((2 + 6 + 45) / 10, 6)
