"""Chunking, ranking, records and names on small texts."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from gridloom.functions.text import redact
from gridloom.operators import chunking as ck
from gridloom.operators import geometry as ge
from gridloom.operators import names as nm
from gridloom.operators import records as rc
from gridloom.operators import retrieval as rt
from gridloom.sources import payload
from gridloom.streaming import rowlocal


def one(spark, make, text):
    return spark.createDataFrame([(text,)], "t string").select(make(F.col("t"))).first()[0]


def test_sections_follow_headings_outside_fences(spark):
    text = "intro\n# A\none\n## B\n```\n# not a heading\n```\n### C\nthree\n## D\nfour\n"
    got = [(s["trail"], s["body"]) for s in one(spark, ck.markdown_sections, text)]
    assert got == [("", "intro"), ("A", "one"), ("A > B", "```\n# not a heading\n```"), ("A > B > C", "three"), ("A > D", "four")]


def test_long_sections_are_packed_with_overlap(spark):
    paragraphs = [f"{c * 600}" for c in "abcd"]
    pieces = one(spark, ck.pack_paragraphs, "\n\n".join(paragraphs))
    assert pieces[0] == "\n\n".join(paragraphs[:2])
    assert pieces[1] == "b" * 160 + "\n\n" + "\n\n".join(paragraphs[2:])


def test_small_sections_join_the_next(spark):
    text = f"# A\nshort\n# B\n{'x' * 300}\n# C\nrest"
    got = [(c["trail"], c["piece"]) for c in one(spark, ck.chunk_markdown, text)]
    assert got == [("A", "[A]\nshort\n\n" + "x" * 300), ("C", "[C]\nrest")]


CHUNKS = "corpus_id string, id string, kind string, title string, locator string, text string"


def corpus(spark):
    texts = ["alpha beta gamma", "alpha alpha delta", "beta epsilon zeta alpha", "", "omega"]
    return spark.createDataFrame([("index", f"d{i}", "doc", "", "", t) for i, t in enumerate(texts)], CHUNKS), texts


def test_scores_match_plain_python(spark):
    chunks, texts = corpus(spark)
    questions = ["alpha beta gamma delta", "omega", "nothing known", "alpha alpha unknown words here"]
    asked = spark.createDataFrame([(str(i), "index", q) for i, q in enumerate(questions)], "qid string, corpus_id string, question string")
    want = {}
    mean = sum(len(t.split()) for t in texts) / len(texts)
    for i, q in enumerate(questions):
        terms = set(q.split())
        for j, t in enumerate(texts):
            words, score, matched = t.split(), 0.0, 0
            for term in terms & set(words):
                df = sum(term in x.split() for x in texts)
                idf = max(math.log(1 + (len(texts) - df + 0.5) / (df + 0.5)), 1e-6)
                tf = words.count(term)
                score += idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(words) / mean))
                matched += 1
            # "here" and "words" stem to themselves up to the ending, which no text has
            if matched >= max(1, math.ceil(0.4 * len(terms))):
                want[str(i), f"d{j}"] = round(score, 6)
    got = rt.bm25(asked, chunks).collect()
    assert {(r["qid"], r["id"]): round(r["score"], 6) for r in got} == want


def test_context_keeps_the_first_and_stops_at_the_first_misfit(spark):
    chunks = spark.createDataFrame([("index", f"d{i}", "doc", "t", "l", "w" * n) for i, n in enumerate((900, 3000, 10))], CHUNKS)
    hits = spark.createDataFrame([("q", "index", f"d{i}", "doc", s, i + 1) for i, s in enumerate((3.0, 2.0, 1.0))],
                                 "qid string, corpus_id string, id string, kind string, score double, rank int")
    assert [r["id"] for r in rt.budget_cut(hits, chunks, budget=1500).orderBy("position").collect()] == ["d0"]
    assert rt.budget_cut(hits, chunks, budget=10).count() == 1
    whole = rt.budget_cut(hits, chunks)
    assert "[... this section continues ...]" in rt.context_block(whole).first()["context"]
    floor = hits.withColumn("score", F.lit(0.1))
    assert rt.budget_cut(floor, chunks).count() == 0


def test_names_resolve_in_order(spark):
    stations = spark.createDataFrame([("Alpha",), ("Beta North",), ("Beta South",)], "name string")
    asked = spark.createDataFrame([("1", " Alpha "), ("2", "ALPHA"), ("3", "south"), ("4", "beta"), ("5", "zz"), ("6", " "), ("7", "a")],
                                  "qid string, query string")
    got = {r["qid"]: (r["status"], r["resolved"], r["matches"]) for r in nm.resolve_names(asked, stations).collect()}
    assert got == {"1": ("exact", "Alpha", 1), "2": ("any_case", "Alpha", 1), "3": ("part", "Beta South", 1),
                   "4": ("ambiguous", None, 2), "5": ("unknown", None, 0), "6": ("blank", None, 0), "7": ("ambiguous", None, 3)}
    assert nm.name_or_type_search(stations.withColumn("type", F.lit("hydro")), " HYD ").count() == 3


def test_close_pairs_count_copies(spark):
    points = spark.createDataFrame([(i, 0.0, 0.0) for i in range(50)] + [(60, 0.5, 0.0), (61, -0.4, -0.4), (62, 5.0, 5.0)],
                                   "id bigint, x double, y double")
    got = {(r["a"], r["b"]): r["pairs"] for r in ge.close_pairs(points, 1.0).collect()}
    assert got == {(0, 0): 50 * 49 // 2, (0, 60): 50, (0, 61): 50, (60, 61): 1}


def test_midpoint_of_a_line_without_length_is_its_start(spark):
    df = spark.createDataFrame([("r", 0, 1, 0.0, 0.0), ("r", 0, 2, 4.0, 0.0), ("r", 1, 3, 4.0, 2.0), ("s", 0, 1, 7.0, 7.0), ("s", 0, 2, 7.0, 7.0)],
                               "route string, slice int, i int, x double, y double")
    got = {r["route"]: (r["mx"], r["my"]) for r in ge.arc_midpoint(df, "route", "slice", "i").collect()}
    assert got == {"r": (3.0, 0.0), "s": (7.0, 7.0)}


def test_secrets_are_blanked(spark):
    assert one(spark, redact, 'token = "abcdef123"; MY_KEY=abcdefgh x') == 'token = "<redacted>"; MY_KEY=<redacted> x'


def test_absent_sections_of_a_run_are_absent(spark):
    runs = payload.json_payload_source(spark.createDataFrame(
        [("r", '{"start": "A", "comparison": {"winner": "tie"}}')], "run_id string, payload string"))
    got = {r["id"]: r["text"] for r in rc.run_records(runs).collect()}
    assert set(got) == {"run:routes", "run:comparison"}
    assert payload.MISSING in got["run:routes"] and "Shorter route: tie" in got["run:comparison"]


def test_row_local_operators_run_on_a_stream(spark, tmp_path):
    cells = "row_number string, source string, destination string, line_type string, src_lat string, src_lon string, " \
            "dst_lat string, dst_lon string, distance_km string, voltage_kv string, capacity_mw string, loss_percent string, " \
            "energy_loss_mw string"
    spark.createDataFrame([("2", " A ", "B", None, "1", "2", None, None, "-5", "220", "x", "101", "3")], cells).write.parquet(
        str(tmp_path / "in"))
    stream = rowlocal.broken_rules(
        rowlocal.clean_lines(spark.readStream.schema(cells).parquet(str(tmp_path / "in"))), "row_number")
    running = stream.writeStream.format("memory").queryName("broken").option(
        "checkpointLocation", str(tmp_path / "ck")).start()
    running.processAllAvailable()
    running.stop()
    assert {r["violation"] for r in spark.table("broken").collect()} == {
        "line_type_not_null", "distance_km_not_null", "capacity_mw_not_null", "loss_percent_range"}


def test_number_texts_need_no_pattern(spark):
    """Trimming gives what the pattern gave: trailing zeros go, zeros before the point stay."""
    from gridloom.functions import text

    numbers = spark.createDataFrame([(v,) for v in (100.0, 1200.0, 0.0, 0.5, -10.0, 1234.56, 1e6, float("nan"), float("inf"), None)], "v double")
    made = numbers.select("v", text.number_text(F.col("v"), "km").alias("got"))
    assert "regexp_replace" not in made._jdf.queryExecution().optimizedPlan().toString().lower()
    shown = F.concat(F.regexp_replace(F.format_number("v", 3), r"\.?0+$", ""), F.lit(" km"))
    wanted = made.select("got", F.when(F.col("v").isNotNull() & ~F.isnan("v"), shown).otherwise(text.NOT_RECORDED).alias("want")).collect()
    assert all(r["got"] == r["want"] for r in wanted)


def test_a_line_record_has_its_ends_row_and_figures_as_metadata(spark):
    rows = spark.sql("""SELECT '7' AS row_number, 'Alpha' AS source, 'Beta' AS destination, 'hydro' AS line_type, CAST(1.5 AS DECIMAL(18,3)) AS distance_km,
      CAST(1 AS BIGINT) AS voltage_kv, CAST(NULL AS DECIMAL(18,3)) AS capacity_mw, CAST(NULL AS DECIMAL(9,3)) AS loss_percent, CAST(x AS DECIMAL(18,4)) AS energy_loss_mw
      FROM VALUES ('2'), (NULL) AS v(x)""")
    priced, plain = (r["metadata"] for r in rc.line_records(rows, "file").orderBy(F.col("metadata")["energy_loss_mw"].desc()).collect())
    assert priced == {"source": "Alpha", "destination": "Beta", "csv_row": "7", "distance_km": "1.500", "energy_loss_mw": "2.0000",
                      "loss_cost_per_hour_inr": "13200.0000", "loss_cost_per_year_inr": "115632000.0000"}
    assert plain["csv_row"] == "7" and plain["energy_loss_mw"] is plain["loss_cost_per_hour_inr"] is plain["loss_cost_per_year_inr"] is None
