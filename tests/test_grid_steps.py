"""What the step that queries on instances share sends through shuffles."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from gridloom.operators import hubs
from gridloom.operators import paths as sp
from gridloom.operators import tours as tr
from gridloom.plans.inputs import Inputs
from gridloom.session import Rounds
from tests.test_tours import frame, random_edges

SF = "/root/testdata/sf0.1"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver tables are not here")
def test_pairs_of_the_grid_are_dealt_by_customer_once(spark):
    plan = plan_of(Inputs(spark, SF).grid)
    assert "hashpartitioning(a#" not in plan and "hashpartitioning(b#" not in plan
    assert "hashpartitioning(o_custkey" in plan and "C" in Inputs(spark, SF).grid.first()["a"]


def test_members_bring_short_numbers_and_labels_within_reach(spark):
    net = frame(spark, [*random_edges(6, 20), ("far", "further", 2_000_000), ("further", "furthest", 2_000_000)])
    origins = net.select(F.col("a").alias("origin")).union(net.select("b")).distinct()
    near = sp.nearest_stations(net, origins, 2).select(F.col("origin").alias("instance_id"), F.col("node").alias("name"), "km")
    far = near.groupBy("instance_id").agg(F.max("km").alias("far"))
    limits = near.join(far, "instance_id").select("instance_id", "name", (F.col("km") + F.col("far")).alias("max_km"))
    labels = hubs.hub_labels(net)
    plain = hubs.label_matrices(tr.fitting_members(near.select("instance_id", "name")), labels)
    within = hubs.label_matrices(tr.fitting_members(limits), labels)
    assert sorted(map(str, within.collect())) == sorted(map(str, plain.collect()))
    assert any(4_000_000_000 in row for r in within.collect() for row in r["matrix"])
    assert "array<int>" in plan_of(within)  # hubs are short, metres here are not
    assert sp.nearest_stations(net, origins, 2).columns == ["origin", "node", "km", "rank"]


def test_instances_are_taken_in_parts_and_old_states_go(spark, lines, monkeypatch):
    """All labels of all members met in one shuffle, beside both states of every loop before it."""
    edges = lines.select("a", "b", "distance_km")
    near = sp.nearest_stations(edges, spark.createDataFrame([(n,) for n in "abcde"], "origin string"), 3)
    members = tr.fitting_members(near.select(F.col("origin").alias("instance_id"), F.col("node").alias("name")))
    labels = hubs.hub_labels(edges)
    whole = sorted(map(str, hubs.label_matrices(members, labels).collect()))
    monkeypatch.setattr(hubs, "PART_MEMBERS", 3)
    parted = hubs.label_matrices(members, labels, stored=True)
    assert sorted(map(str, parted.collect())) == whole and len(whole) == 5
    assert "Exchange" not in plan_of(parted)
    rounds = Rounds(spark, "states")
    first, second = rounds.keep(spark.range(1)), rounds.keep(spark.range(2))
    assert rounds.ended(second).count() == 2 and first.columns == ["id"]
    assert sorted(os.path.exists(p) for p in rounds._paths) == [False, True]


def test_an_instance_beyond_the_limit_raises_and_one_without_a_name_goes(spark, monkeypatch):
    monkeypatch.setattr(tr, "MAX_STATIONS", 2)
    members = spark.createDataFrame([("i", "a", 1), ("i", "b", 2), (None, "c", 3)], "instance_id string, name string, max_km int")
    assert sorted(map(tuple, tr.fitting_members(members).collect())) == [("i", "a", 1), ("i", "b", 2)]
    with pytest.raises(Exception, match="at most 2 stations"):
        tr.fitting_members(members.union(members)).collect()
