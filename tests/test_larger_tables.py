"""What keeps work and memory in proportion to the input when tables grow."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from gridloom.functions.text import says_something, strip
from gridloom.operators import names as nm
from gridloom.operators import retrieval as rt
from gridloom.plans.inputs import Inputs
from gridloom.sources import files

SF = "/root/testdata/sf0.1"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver tables are not here")
def test_lines_of_the_survey_are_shuffled_for_their_orders_alone(spark):
    plan = plan_of(Inputs(spark, SF).survey)
    assert "Exchange hashpartitioning(l_suppkey" not in plan
    assert "Exchange hashpartitioning(l_orderkey" in plan


def test_white_space_of_any_kind_is_stripped(spark):
    space = r"[\s\x0b\x1c-\x1f\x85\p{Z}]+"
    points = [c for c in range(1, 0x3100)] + [0xFEFF, 0x1F600]
    rows = spark.createDataFrame([(f"{chr(c)}a{chr(c)}b{chr(c)}{chr(c)}", chr(c)) for c in points] + [("", " \t\u3000"), (None, None)], "t string, s string")
    for c in ("t", "s"):
        by_pattern = F.regexp_replace(c, f"^{space}|{space}$", "")
        assert rows.where(~strip(F.col(c)).eqNullSafe(by_pattern)).isEmpty()
        assert rows.where(says_something(F.col(c)) != F.coalesce(by_pattern != "", F.lit(False))).isEmpty()


def test_requests_with_one_text_are_looked_up_once(spark):
    stations = spark.createDataFrame([(f"Depot {i:04d}",) for i in range(40)] + [("Lone",)], "name string")
    requests = spark.createDataFrame([(f"q{i}", "depot") for i in range(50)] + [("one", " LON"), ("none", "xyz"), ("blank", " ")], "qid string, query string")
    texts = requests.select(F.lower(F.trim("query")).alias("low")).distinct()
    assert nm.text_matches(texts, stations).count() == 41
    got = {r["qid"]: r for r in nm.resolve_names(requests, stations).collect()}
    assert len(got) == 53 and {got[f"q{i}"]["matches"] for i in range(50)} == {40}
    assert got["q7"]["suggestions"] == ", ".join(f"Depot {i:04d}" for i in range(10))
    assert (got["one"]["status"], got["one"]["resolved"]) == ("part", "Lone")
    assert (got["none"]["status"], got["blank"]["status"]) == ("unknown", "blank")
    assert nm.substring_matches(requests, stations).count() == 50 * 40 + 1


def test_lengths_without_postings_are_those_with_them(spark):
    chunks = spark.createDataFrame(
        [("a", "1", "One", "x", "lines lines of words"), ("a", "2", "", "", ""), ("a", "2", "Two", "", "more words"), ("b", "1", "", "", "the of")],
        "corpus_id string, id string, title string, locator string, text string")
    alone = rt.corpus_stats(chunks)
    assert sorted(alone.collect()) == sorted(rt.corpus_stats(chunks, rt.postings(chunks)).collect())
    assert "explode" not in plan_of(alone)


def test_rows_of_files_are_numbered_without_a_shuffle(spark, tmp_path):
    spark.range(200).selectExpr("CAST(id AS STRING) AS value").repartition(3).write.text(str(tmp_path / "t"))
    rows = files.row_provenance(spark.read.text(str(tmp_path / "t")), "line")
    assert "Exchange hashpartitioning" not in plan_of(rows)
    per_file = rows.groupBy("file").agg(F.count("*").alias("n"), F.count_distinct("line").alias("d"), F.min("line").alias("lo"), F.max("line").alias("hi"))
    assert per_file.where("n <> d OR lo <> 2 OR hi <> n + 1").isEmpty()


def test_a_word_is_taken_once_per_text_for_frequencies(spark):
    chunks = spark.createDataFrame(
        [("a", "1", "One_two", "x->y", "Lines line lined one 2.5 2.5"), ("a", "1", "", "", "line again"), ("b", "1", "", "", "the of"), ("b", "2", None, "", "")],
        "corpus_id string, id string, title string, locator string, text string")
    held, posted = rt.holdings(chunks), rt.postings(chunks)
    assert sorted(held.collect()) == sorted(posted.select("corpus_id", "term", "id").collect())
    assert sorted(rt.document_frequency(held).collect()) == sorted(rt.document_frequency(posted).collect())
    assert {r["term"] for r in held.collect()} >= {"one", "two", "x", "y", "line", "2.5"}


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver tables are not here")
def test_pairs_of_the_grid_are_grouped_by_their_numbers(spark):
    plan = plan_of(Inputs(spark, SF).grid_pairs)
    assert "Exchange hashpartitioning(o_custkey" in plan
    assert "SortMergeJoin" not in plan
