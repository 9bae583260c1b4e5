"""Sums of scores in shards of chunks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gridloom.operators import retrieval as rt
from gridloom.operators import scoring


def test_plans_do_not_grow_with_the_questions_and_many_shards_give_what_one_gives(spark, monkeypatch):
    """Matches or terms beyond a bound made one more branch of the plan each; copies tie across shards."""
    text = spark.createDataFrame(
        [("index", f"{n:03}", "doc", "t", "l", f"alpha word{n % 7} beta word{n % 5}") for n in range(60)]
        + [("run:1", "000", "solver", "t", "l", "alpha word1 gamma")],
        "corpus_id string, id string, kind string, title string, locator string, text string")
    asked = spark.createDataFrame(
        [(f"q{n}", c, f"alpha word{n} beta") for n in range(9) for c in ("index", "run:1")], "qid string, corpus_id string, question string")

    def best():
        return rt.best_chunks(asked, text, 3)

    def size(df):
        return df._jdf.queryExecution().executedPlan().toString().count("Exchange")

    whole, rows, exchanges = best(), sorted(best().collect()), size(best())
    assert rows == sorted(rt.top_k_per_query(rt.bm25(asked, text), 3).collect()) and len(rows) == 9 * 3 + 1
    for name, value in (("SHARD_POSTINGS", 9), ("SENT_TERMS", 2), ("SPREAD_CHUNKS", 4), ("TASK_MATCHES", 10)):
        monkeypatch.setattr(rt, name, value, raising=False)
    assert sorted(best().collect()) == rows and size(best()) == exchanges
    assert sorted(rt.bm25(asked, text).select("qid", "corpus_id", "id", "matched").collect()) == sorted(
        (r["qid"], r["corpus_id"], r["id"], r["matched"]) for r in rt.bm25(asked, text.repartition(7)).collect())
    assert whole.columns == ["qid", "corpus_id", "id", "score", "place"]


def test_best_keeps_what_rounding_may_bring_up_and_few_of_many_copies():
    score = np.array([1.0] * 1000 + [2.0, 1.0 - 1e-10, 0.5] + [1.0] * 1000)
    assert sorted(scoring._best(score, 3)) == [0, 1, 2, 1000, 1001]
    assert sorted(scoring._best(score[:2], 3)) == [0, 1]


def test_a_question_without_a_chunk_in_reach_and_none_at_all(spark):
    text = spark.createDataFrame([("index", "1", "doc", "t", "l", "alpha")], "corpus_id string, id string, kind string, title string, locator string, text string")
    asked = spark.createDataFrame([("q", "index", "unheard"), ("r", "none", "alpha")], "qid string, corpus_id string, question string")
    assert rt.bm25(asked, text).isEmpty() and rt.best_chunks(asked, text).isEmpty()
    assert rt.best_chunks(asked.where(F.lit(False)), text).isEmpty()


def test_rows_for_the_sums_have_no_list_that_is_null(spark, monkeypatch):
    """Spark measures a batch after each of its rows, and goes over all NULLs at the end of a list column for it."""
    text = spark.createDataFrame([("index", "1", "doc", "t", "l", "alpha beta")], "corpus_id string, id string, kind string, title string, locator string, text string")
    asked = spark.createDataFrame([("q", "index", "alpha")], "qid string, corpus_id string, question string")
    seen, frame = [], type(text)
    monkeypatch.setattr(frame, "mapInArrow", lambda df, *a, f=frame.mapInArrow, **b: (seen.append(df), f(df, *a, **b))[1])
    assert rt.best_chunks(asked, text).count() == rt.bm25(asked, text).count() == 1
    assert [df.where("lists IS NULL").count() for df in seen] == [0, 0] and all(df.count() > 1 for df in seen)


def _shard(parts):
    shard = scoring.Shard(0)
    at, owner, part = zip(*parts, strict=True)
    shard.take(scoring.PART, pa.RecordBatch.from_pydict({"a": pa.array(owner), "b": pa.array(at), "x": pa.array(part)}))
    shard.ready()
    return shard


def test_the_best_of_a_rare_term_are_found_without_all_chunks_of_common_ones(monkeypatch):
    """Every line record has the words of a question on losses, few its station."""
    shard = _shard([(w, c, 0.1 + c % 7 / 100) for w in (0, 1) for c in range(200_000)] + [(2, c, 5.0 + c % 3) for c in range(0, 200_000, 20_000)])
    lists = np.array([0, 1, 2])
    place, score, _ = shard.scores(lists, 2)
    wanted = sorted(zip(score[best := scoring._best(score, 3)], place[best], strict=True))
    shard.best(lists, 2, 3)
    monkeypatch.setattr(scoring.Shard, "scores", lambda *_: pytest.fail("all chunks were summed"))
    place, score = shard.best(lists, 2, 3)
    best = scoring._best(score, 3)
    assert np.allclose(sorted(zip(score[best], place[best], strict=True)), wanted) and len(place) == 10


def test_the_best_equal_those_of_all_sums(monkeypatch):
    monkeypatch.setattr(scoring, "FEW", 0)
    some = np.random.default_rng(7)
    for begin in (1, 20, 400):
        monkeypatch.setattr(scoring, "BEGIN", begin)
        shard = _shard([(w, c, float(some.integers(1, 9)) / (w + 1)) for w in range(8) for c in some.choice(300, 300 // (w + 1), replace=False)])
        for needed, k in ((1, 1), (1, 6), (3, 6), (7, 4), (8, 300)):
            lists = some.permutation(8)
            place, score, _ = shard.scores(lists, needed)
            best = scoring._best(score, k)
            for _ in range(3):  # the long lists alone are remembered from the second time on
                near, sums = shard.best(lists, needed, k)
                found = scoring._best(sums, k)
                assert np.allclose(sorted(zip(place[best], score[best], strict=True)), sorted(zip(near[found], sums[found], strict=True)))


def test_questions_with_the_same_common_terms_sum_them_once(monkeypatch):
    """A shard without enough chunks on the rare term of a question summed all chunks on its common ones each time."""
    shard = _shard([(w, c, 0.1 + c % 7 / 100) for w in (0, 1) for c in range(20_000)] + [(w, w, 5.0) for w in range(2, 50)])
    wanted = []
    for w in range(2, 50):
        place, score, _ = shard.scores(np.array([w, 0, 1]), 2)
        best = scoring._best(score, 6)
        wanted.append(sorted(zip(score[best], place[best], strict=True)))
    calls, scores = [], scoring.Shard.scores
    monkeypatch.setattr(scoring.Shard, "scores", lambda *a: (calls.append(a), scores(*a))[1])
    for w, want in zip(range(2, 50), wanted, strict=True):
        place, score = shard.best(np.array([w, 0, 1]), 2, 6)
        best = scoring._best(score, 6)
        assert np.allclose(sorted(zip(score[best], place[best], strict=True)), want)
    assert len(calls) == 2 and np.all(np.diff(place) > 0)


def test_terms_of_many_small_corpora_do_not_make_the_large_one_meet_its_terms_in_a_shuffle(spark, monkeypatch):
    """Beyond `SENT_BYTES` of terms in all, every posting of the index was shuffled once more to meet them."""
    text = spark.createDataFrame(
        [("index", f"{n:03}", "doc", "t", "l", "alpha beta") for n in range(9)] + [(f"run:{n}", "0", "solver", "t", "l", f"word{n} beta") for n in range(9)],
        "corpus_id string, id string, kind string, title string, locator string, text string")
    asked = spark.createDataFrame(
        [("q", "index", "alpha beta")] + [(f"r{n}", f"run:{n}", f"word{n} beta") for n in range(9)], "qid string, corpus_id string, question string")
    wanted = sorted(rt.best_chunks(asked, text).collect())
    monkeypatch.setattr(rt, "SPREAD_CHUNKS", 5)
    joined, join = [], rt.join_hot
    monkeypatch.setattr(rt, "join_hot", lambda large, other, keys: (joined.append((large, other)), join(large, other, keys))[1])
    assert sorted(rt.best_chunks(asked, text).collect()) == wanted and len(wanted) == 6 + 9
    (large, other), = joined
    assert {r["corpus_id"] for r in large.collect()} == {r["corpus_id"] for r in other.collect()} == {"index"}
