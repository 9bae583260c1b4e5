"""Files in: headers, ragged rows, blanks, unreadable numbers, provenance."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from gridloom.functions.text import clean_name, safe_float
from gridloom.operators import stations as st
from gridloom.sources import files, index, sinks


def write(folder, name, text):
    path = folder / name
    path.write_text(text)
    return str(path)


def load(spark, path):
    return st.clean_connections(files.as_connections(files.row_provenance(spark.read.option("header", True).csv(path))))


def test_missing_column_is_named(spark, tmp_path):
    path = write(tmp_path, "x.csv", "Source,Destination\nA,B\n")
    with pytest.raises(files.DatasetError, match="Distance_km"):
        files.csv_scan(spark, path)


def test_sparse_rows_are_kept(spark, tmp_path):
    path = write(tmp_path, "x.csv", "Source,Destination,Distance_km,Capacity_MW\nA,B,10,\nB,C,,500\n")
    lines = load(spark, path)
    assert lines.count() == 2
    assert st.station_union(lines).count() == 3
    assert st.routable(lines).count() == 1
    codes = {r["code"] for r in st.load_warnings(
        lines, files.absent_coordinates(["Source", "Destination"])).collect()}
    assert codes == {"absent_column", "missing_distance", "no_coordinates"}


def test_header_names_are_trimmed_and_short_rows_padded(spark, tmp_path):
    path = write(tmp_path, "x.csv", " Source , Destination,Distance_km \nA,B\n\"C, north\",D,3\n")
    rows = {r["Source"]: r["Distance_km"] for r in files.csv_scan(spark, path).collect()}
    assert rows == {"A": None, "C, north": "3"}


def test_rows_with_too_many_cells_raise(spark, tmp_path):
    path = write(tmp_path, "x.csv", "Source,Destination,Distance_km\nA,B,1,2\n")
    with pytest.raises(Exception, match="too many cells"):
        files.csv_scan(spark, path).collect()


def test_one_file_is_found_and_two_raise(spark, tmp_path):
    with pytest.raises(files.DatasetError, match="no .csv"):
        files.single_file_source(spark, str(tmp_path))
    write(tmp_path, "one.csv", "Source\n")
    assert files.single_file_source(spark, str(tmp_path)).endswith("one.csv")
    write(tmp_path, "two.csv", "Source\n")
    with pytest.raises(files.DatasetError, match="one.csv, two.csv"):
        files.single_file_source(spark, str(tmp_path))


def test_empty_input_raises(spark, tmp_path):
    path = write(tmp_path, "x.csv", "Source,Destination,Distance_km\n")
    with pytest.raises(files.DatasetError, match="no data rows"):
        files.require_rows(files.csv_scan(spark, path))


def test_row_numbers_count_from_the_header(spark, tmp_path):
    path = write(tmp_path, "x.csv", "Source,Destination,Distance_km\n" + "".join(f"s{i},t,1\n" for i in range(50)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100")
    try:
        rows = files.row_provenance(spark.read.option("header", True).csv(path)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert {r["Source"]: r["row_number"] for r in rows} == {f"s{i}": i + 2 for i in range(50)}


def test_whole_files_and_the_missing_ones(spark, tmp_path):
    write(tmp_path, "a.md", "# A\n\ntext\n")
    texts, missing = files.whole_file_scan(spark, [str(tmp_path)], ["a.md", "b.md"])
    assert texts.first()["text"] == "# A\n\ntext\n"
    assert [r["file"] for r in missing.collect()] == ["b.md"]


def test_cells(spark):
    df = spark.createDataFrame([(" a ", "1_0"), ("  ", "nan"), (None, "2d"), ("b", "-1e3"), ("c", "inf")], "n string, v string")
    rows = df.select(clean_name(F.col("n")).alias("n"), safe_float(F.col("v")).alias("v")).collect()
    assert [r["n"] for r in rows] == ["a", None, None, "b", "c"]
    assert [r["v"] for r in rows] == [10.0, None, None, -1000.0, float("inf")]


def test_derived_cells_and_idempotence(spark, tmp_path):
    df = spark.createDataFrame([("A", "10.0"), ("B", None)], "Source string, Energy_Loss_MW string")
    assert sinks.derived_column_sink(df, str(tmp_path / "out"))
    stored = files.csv_scan(spark, str(tmp_path / "out"), ("Energy_Loss_MW",))
    got = {r["Source"]: (r["Loss_Cost_Per_Hour_INR"], r["Loss_Cost_Per_Year_INR"]) for r in stored.collect()}
    assert got == {"A": ("66000.00", "578160000.00"), "B": (None, None)}
    assert not sinks.derived_column_sink(stored, str(tmp_path / "again"))
    stale = stored.withColumn("Loss_Cost_Per_Hour_INR", F.lit("1.00"))
    assert sinks.derived_column_sink(stale, str(tmp_path / "fresh"))


def test_upsert_on_the_unordered_pair(spark):
    old = spark.createDataFrame([("a", "b", 1), ("b", "c", 2)], "a string, b string, v int")
    new = spark.createDataFrame([("b", "a", 9)], "a string, b string, v int")
    merged = sinks.keyed_upsert(old, new, [F.least("a", "b"), F.greatest("a", "b")])
    assert {tuple(r) for r in merged.collect()} == {("b", "a", 9), ("b", "c", 2)}


def test_index_version_and_emptiness(spark, tmp_path):
    chunks = spark.createDataFrame([("1", "doc", "t")], "id string, kind string, text string")
    index.save_index(chunks, str(tmp_path / "i"), missing=["gone.md"])
    assert index.load_index(spark, str(tmp_path / "i")).count() == 1
    with pytest.raises(ValueError, match="version"):
        index.load_index(spark, str(tmp_path / "i"), version=2)
    index.save_index(chunks.where("false"), str(tmp_path / "e"))
    with pytest.raises(ValueError, match="empty"):
        index.load_index(spark, str(tmp_path / "e"))


def test_status_of_many_folders_in_one_pass(spark, tmp_path):
    written = {
        "good/a.csv": "Source ,Destination,Distance_km\nx,y,1\n,z,2\n", "two/a.csv": "Source,Destination,Distance_km\nx,y,1\n",
        "two/b.csv": "Source,Destination,Distance_km\nx,y,1\n", "lacks/a.csv": "Source,Destination\nx,y\n",
        "norows/a.csv": "Destination,Source,Distance_km\n", "nobody/a.csv": "Type,Destination,Distance_km,Source\nq, ,1,\nq,,2\n", "other/a.txt": "Source"}
    for name, text in written.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    scan = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").text(str(tmp_path))
    expected = spark.createDataFrame([(f,) for f in ("good", "two", "lacks", "norows", "nobody", "other", "absent")], "folder string")
    got = {r["folder"]: (r["files"], r["rows"], r["status"]) for r in files.folder_status(
        scan, expected, F.regexp_extract("file", "/([^/]+)/[^/]+$", 1)).collect()}
    assert got == {
        "good": (1, 2, "ok"), "two": (2, 2, "multiple CSV files"), "lacks": (1, 1, "missing required column(s): Distance_km"),
        "norows": (1, 0, "contains no data rows"), "nobody": (1, 2, "no usable station"),
        "other": (0, 0, "no .csv file found"), "absent": (0, 0, "no .csv file found")}


def test_every_page_is_a_file_of_its_own(spark, tmp_path):
    """Pages that share an id, hold line breaks or are empty come back whole; no folder per page is listed."""
    from gridloom.plans.inputs import Inputs
    from gridloom.plans.payloads import whole_file_scan

    rows = [(1, "one\ntwo"), (1, "again"), (2, ""), (3, "7\n\n")]
    spark.createDataFrame(rows, "page_id long, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = whole_file_scan(Inputs(spark, str(tmp_path)))
    assert not any("page_id=" in f for f in got.inputFiles())
    assert sorted((r["page_id"], r["size"]) for r in got.collect()) == sorted((i, len(h)) for i, h in rows)
