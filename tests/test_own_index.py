"""The incremental index: what is posted again, what is taken over, and searching it beside runs."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from gridloom.operators import records, retrieval
from gridloom.plans import own_index
from gridloom.plans.inputs import Inputs
from gridloom.sources import index

COLUMNS = "corpus_id string, id string, kind string, title string, locator string, text string"
SF = "/root/testdata/sf0.001"


def chunks(spark, *rows):
    return spark.createDataFrame([("index", i, k, t, "somewhere", x) for i, k, t, x in rows], COLUMNS)


def rows_of(df):
    return sorted(tuple(map(str, r)) for r in df.collect())


FIRST = (("a", "doc", "Alpha", "turbines and dams"), ("b", "doc", None, "a long valley"), ("c", "code", "Gamma", None))


def test_refresh_tells_every_chunk_and_equals_a_build_from_nothing(spark, tmp_path):
    one, two, whole = (str(tmp_path / n) for n in "otw")
    assert {r["status"] for r in index.refresh_index(chunks(spark, *FIRST), one).collect()} == {"added"}
    later = chunks(spark, FIRST[0], ("b", "doc", "", "a long valley"), ("d", "doc", "Delta", "new words"))
    status = {r["id"]: r["status"] for r in index.refresh_index(later, two, one).collect()}
    assert status == {"a": "unchanged", "b": "changed", "c": "removed", "d": "added"}  # an empty title is not an absent one
    index.refresh_index(later, whole)
    names = ["corpus_id", "term", "id", "tf", "doc_len"]
    assert rows_of(index.load_postings(spark, two).select(names)) == rows_of(index.load_postings(spark, whole).select(names))
    manifest = index.load_manifest(spark, two).first()
    assert (manifest["chunks"], manifest["posted"], manifest["removed"], manifest["missing"]) == (3, 2, 1, 0)
    assert [tuple(k) for k in manifest["kinds"]] == [("doc", 3)]
    assert index.load_index(spark, one).count() == 3  # the earlier state is still there


def test_unchanged_postings_are_not_made_again(spark, tmp_path):
    """Postings altered in the earlier index come through for unchanged chunks, so their texts were not read."""
    one, two = str(tmp_path / "o"), str(tmp_path / "t")
    index.refresh_index(chunks(spark, *FIRST), one)
    index.load_postings(spark, one).withColumn("tf", F.col("tf") + 10).write.parquet(f"{one}/marked")
    spark.read.parquet(f"{one}/marked").write.mode("overwrite").parquet(f"{one}/postings")
    index.refresh_index(chunks(spark, FIRST[0], ("b", "doc", None, "another valley")), two, one)
    found = {(r["id"], r["tf"] > 10) for r in index.load_postings(spark, two).collect()}
    assert found == {("a", True), ("b", False)}


def test_missing_files_empty_builds_and_own_paths(spark, tmp_path):
    path = str(tmp_path / "i")
    index.refresh_index(chunks(spark, *FIRST), path, missing=spark.createDataFrame([("gone.md",)], "file string"))
    assert index.load_manifest(spark, path).first()["missing"] == 1
    with pytest.raises(ValueError, match="path of its own"):
        index.refresh_index(chunks(spark, *FIRST), path, path)
    empty = str(tmp_path / "e")
    assert {r["status"] for r in index.refresh_index(chunks(spark, *FIRST).where("false"), empty, path).collect()} == {"removed"}
    with pytest.raises(ValueError, match="empty"):
        index.load_index(spark, empty)


def test_stored_postings_score_as_fresh_ones_and_runs_join_in(spark, tmp_path):
    path = str(tmp_path / "i")
    text = chunks(spark, *[(str(n), "doc", f"Title {n}", f"valley dam turbine word{n}") for n in range(8)], ("z", "doc", "Far", "nothing alike"))
    index.refresh_index(text, path)
    run = spark.createDataFrame([("run:1", "0", "solver", "Run", "current run", "turbine valley of this run")], COLUMNS)
    asked = spark.createDataFrame([("q", c, "turbine valley") for c in ("index", "run:1")], "qid string, corpus_id string, question string")
    stored = index.load_index(spark, path)
    got = retrieval.search_index(asked, stored, index.load_postings(spark, path), run)
    want = retrieval.composite_search(asked, text.unionByName(run))
    keys = ["qid", "corpus_id", "id", "kind", "score", "rank"]
    assert rows_of(got.select(keys)) == rows_of(want.select(keys))
    assert ("run:1", "0") in {(r["corpus_id"], r["id"]) for r in got.collect()}  # its id is that of an index chunk as well


def test_best_chunks_are_those_of_all_scores(spark):
    """Many texts of few words, ties and copies among them, so that bounds are close and bits of marks are shared."""
    words = [f"word{n}" for n in range(40)]
    texts = [(f"{n:03}", "doc", None, " ".join(words[(n * n + 3 * i) % (5 + n % 36)] for i in range(n % 60))) for n in range(300)]
    text = chunks(spark, *texts, *[(f"copy{n}", "doc", None, texts[100][3]) for n in range(9)])
    asked = spark.createDataFrame(
        [(f"q{n}", "index", " ".join(words[n:n + 2 + n % 9])) for n in range(30)] + [("none", "index", "unheard"), ("empty", "index", "")],
        "qid string, corpus_id string, question string")
    for k in (1, 3, 6):
        got = rows_of(retrieval.best_chunks(asked, text, k))
        assert got and got == rows_of(retrieval.top_k_per_query(retrieval.bm25(asked, text), k))


def test_matches_are_not_shuffled(spark, monkeypatch):
    """Scores are whole in the task that made them; many small blocks of questions give what one gives. No whole text meets the hits."""
    text = chunks(spark, *[(f"{n:03}", "doc", "title", f"alpha word{n % 7} beta word{n % 5}") for n in range(60)])
    asked = spark.createDataFrame([(f"q{n}", "index", f"alpha word{n} beta") for n in range(9)], "qid string, corpus_id string, question string")
    scores = retrieval.bm25(asked, text)
    assert "hashpartitioning(qid" not in scores._jdf.queryExecution().toString()
    whole = rows_of(retrieval.best_chunks(asked, text))
    monkeypatch.setattr(retrieval, "SENT_TERMS", 5)
    assert rows_of(retrieval.best_chunks(asked, text)) == whole and rows_of(retrieval.bm25(asked, text).select("qid", "id", F.round("score", 6))) == rows_of(
        scores.select("qid", "id", F.round("score", 6)))


def test_counts_stay_with_their_chunk_and_sums_are_of_numbers(spark):
    """Texts are dealt by chunk before they are cut, rows that share an id included; scores are summed by numbers, not by names."""
    text = chunks(spark, *[(f"{n:03}", "doc", "title", f"alpha word{n % 7} beta") for n in range(40)], ("000", "doc", None, "alpha gamma"))
    posted = retrieval.postings(text)
    dealt = [line for line in posted._jdf.queryExecution().executedPlan().toString().splitlines() if "hashpartitioning(" in line]
    assert dealt and not any("term" in line for line in dealt)
    assert {r["term"]: r["tf"] for r in posted.where("id = '000'").collect()}["alpha"] == 2
    asked = spark.createDataFrame([("q", "index", "alpha beta word3"), ("r", "index", "gamma")], "qid string, corpus_id string, question string")
    scores = retrieval.bm25(asked, text)
    assert "keys=[asked" in scores._jdf.queryExecution().executedPlan().toString()
    assert scores.columns == ["qid", "corpus_id", "id", "needed", "score", "matched"]
    assert {(r["qid"], r["id"], r["matched"]) for r in scores.where("qid = 'r'").collect()} == {("r", "000", 1)}


def test_the_tariff_is_one_record(spark):
    row = records.tariff_record(spark).first()
    assert row["id"] == "tariff:basis" and row["text"] == records.tariff_text() and "6.60" in row["text"]


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver tables are not here")
def test_every_line_is_found_and_nothing_off_the_topic(spark):
    out = own_index.own_retrieval_eval(Inputs(spark, SF)).collect()
    lines = [r for r in out if r["qid"].startswith("line:")]
    others = [r for r in out if r["qid"].startswith("off:")]
    assert len(lines) > 100 and len(others) == 5
    assert all(r["passed"] for r in lines + others)


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver tables are not here")
def test_record_chunks_hold_stations_network_and_tariff_beside_lines(spark):
    from gridloom.plans.registry import QUERIES

    ids = QUERIES["record_chunks"](spark, SF).selectExpr("substring_index(id, ':', 1) AS family").distinct()
    families = {r["family"] for r in ids.collect()}
    assert families == {"line", "station", "network", "tariff"}
