"""Hot-key joins, whole sorted tables, keyed tables, and runs that share their ids."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from gridloom.operators import ranking, skew
from gridloom.operators import retrieval as rt
from gridloom.sources.sinks import keyed_upsert


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_dealt_and_sent_joins_agree(spark, monkeypatch, how):
    large = spark.range(400).select((F.col("id") % 5).alias("k"), F.col("id").alias("v"))
    other = spark.createDataFrame([(0, "a"), (1, "b"), (1, "c"), (9, "d")], "k long, w string")
    sent = sorted(map(str, skew.join_hot(large, other, ["k"], how).collect()))
    monkeypatch.setattr(skew, "SENT_BYTES", -1)
    assert sorted(map(str, skew.join_hot(large, other, ["k"], how).collect())) == sent


def test_every_row_has_its_place(spark):
    rows = [(f"r{k:03d}", None if k % 7 == 0 else k % 10) for k in range(300)]
    got = ranking.sorted_whole(spark.createDataFrame(rows, "id string, v long"), "v", "id", descending=True).collect()
    want = sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))
    assert [(r["id"], r["v"]) for r in sorted(got, key=lambda r: r["place"])] == want
    assert sorted(r["place"] for r in got) == list(range(1, 301))


def test_incoming_keys_are_unique_after_an_upsert(spark):
    kind = "a string, b string, v long"
    old = spark.createDataFrame([("x", "y", 1), ("p", "q", 2)], kind)
    new = spark.createDataFrame([("y", "x", 5), ("x", "y", 7), ("m", "n", 3)], kind)
    got = keyed_upsert(old, new, [F.least("a", "b"), F.greatest("a", "b")]).collect()
    assert sorted(map(tuple, got)) == [("m", "n", 3), ("p", "q", 2), ("y", "x", 5)]


def test_a_question_to_one_run_gets_no_text_of_another(spark):
    words = "the voltage of the northern substation line"
    chunks = spark.createDataFrame(
        [("index", "doc:1", "doc", "t", "l", "pumps and valves"), ("index", "run:energy", "doc", "t", "l", f"index {words}")]
        + [(f"run:{r}", i, "solver", "t", "l", f"run {r} says {i} {words}") for r in "AB" for i in ("run:energy", "run:routes")],
        "corpus_id string, id string, kind string, title string, locator string, text string")
    asked = spark.createDataFrame(
        [(f"q{r}", c, words) for r in "AB" for c in ("index", f"run:{r}")], "qid string, corpus_id string, question string")
    pieces = rt.budget_cut(rt.composite_search(asked, chunks), chunks).collect()
    for r, other in ("AB", "BA"):
        mine = [p for p in pieces if p["qid"] == f"q{r}"]
        assert {(p["corpus_id"], p["id"]) for p in mine} == {("index", "run:energy"), (f"run:{r}", "run:energy"), (f"run:{r}", "run:routes")}
        assert not any(f"run {other} says" in p["piece"] for p in mine)
