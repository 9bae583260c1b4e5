"""Reading line tables and documents from files."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.operators.skew import join_hot

# The column names of a line table.
REQUIRED = ("Source", "Destination", "Distance_km")
COORDINATES = ("Source_Latitude", "Source_Longitude", "Destination_Latitude", "Destination_Longitude")
DERIVED = ("Loss_Cost_Per_Hour_INR", "Loss_Cost_Per_Year_INR")
FIELDS = {
    "Source": "source", "Destination": "destination", "Type": "line_type", "Source_Latitude": "src_lat",
    "Source_Longitude": "src_lon", "Destination_Latitude": "dst_lat", "Destination_Longitude": "dst_lon",
    "Distance_km": "distance_km", "Voltage_kV": "voltage_kv", "Capacity_MW": "capacity_mw",
    "Loss_Percent": "loss_percent", "Energy_Loss_MW": "energy_loss_mw",
}
_RAGGED = "_ragged"


class DatasetError(ValueError):
    """The input cannot be used, with the reason in words."""


def single_file_source(spark: SparkSession, folder: str) -> str:
    """The one ``*.csv`` in a folder; none or several raise. Only the listing is read."""
    try:
        found = sorted(spark.read.option("pathGlobFilter", "*.csv").text(folder).inputFiles())
    except AnalysisException as exc:
        if exc.getCondition() != "PATH_NOT_FOUND":
            raise
        raise DatasetError(f"no .csv file found in {folder!r}") from exc
    if not found:
        raise DatasetError(f"no .csv file found in {folder!r}")
    if len(found) > 1:
        raise DatasetError(f"multiple CSV files in {folder!r} ({', '.join(f.rsplit('/', 1)[-1] for f in found)})")
    return found[0]


def required_columns(columns: list[str], required: tuple[str, ...] = REQUIRED) -> None:
    missing = [c for c in required if c not in columns]
    if missing:
        raise DatasetError(f"missing required column(s): {', '.join(missing)}. Found: {', '.join(columns)}")


def _cells(line: Column) -> Column:
    """How many cells a line has; commas inside quotes are not separators."""
    return F.length(F.regexp_replace(F.regexp_replace(line, '"([^"]|"")*"', ""), "[^,]", "")) + 1


def csv_scan(spark: SparkSession, path: str, required: tuple[str, ...] = REQUIRED) -> DataFrame:
    """All columns as text, names trimmed. Short rows are padded with NULL, rows with too many cells raise.

    The header is read on its own for the names, so that a missing column is
    found before any data is read.
    """
    names = [c.strip() for c in spark.read.option("header", True).csv(path).columns]
    required_columns(names, required)
    schema = ", ".join(f"`{n}` STRING" for n in names) + f", `{_RAGGED}` STRING"
    rows = (
        spark.read.schema(schema).option("header", True).option("mode", "PERMISSIVE")
        .option("columnPruning", False).option("columnNameOfCorruptRecord", _RAGGED).csv(path))
    too_long = _cells(F.col(_RAGGED)) > len(names)
    first = F.when(too_long, F.raise_error(F.concat(F.lit("too many cells in: "), F.col(_RAGGED)))).otherwise(
        F.col(f"`{names[0]}`"))
    return rows.withColumn(names[0], first).drop(_RAGGED)


def require_rows(rows: DataFrame, what: str = "the dataset") -> DataFrame:
    if rows.isEmpty():
        raise DatasetError(f"{what} contains no data rows")
    return rows


def folder_status(files: DataFrame, expected: DataFrame, folder: Column, required: tuple[str, ...] = REQUIRED) -> DataFrame:
    """(folder, files, rows, status) of every folder: what a load of it would say, all folders in one pass.

    `files` is a scan of text lines (`spark.read.text`) over the ``*.csv`` of all
    folders, `expected` has (folder), also of folders without a file, and `folder`
    gives the folder of a line's column `file`. A folder needs one file, whose header
    has the required columns, with a row, and some row that names a station. Fields
    are taken by their place, so commas inside quotes are not looked at.
    """
    numbered = row_provenance(files.select("value"), "line")
    names = F.transform(F.split("value", ","), lambda n: F.trim(n))
    headers = numbered.where("line = 2").select("file", names.alias("names"))
    cells = F.split("value", ",", -1)
    ends = [F.trim(F.coalesce(F.get(cells, (F.array_position("names", end) - 1).cast("int")), F.lit(""))) for end in REQUIRED[:2]]
    body = join_hot(numbered.where("line > 2").select("file", "value"), headers, ["file"]).groupBy("file").agg(
        F.count("*").alias("rows"), F.count_if((ends[0] != "") | (ends[1] != "")).alias("named"))
    lacking = F.array_join(F.array_except(F.array(*map(F.lit, required)), F.col("names")), ", ")
    found = headers.join(body, "file", "left").select(
        folder.alias("folder"), F.coalesce("rows", F.lit(0)).alias("rows"), F.coalesce("named", F.lit(0)).alias("named"), lacking.alias("lacking"))
    told = expected.join(found.groupBy("folder").agg(
        F.count("*").alias("files"), F.sum("rows").alias("rows"), F.sum("named").alias("named"), F.max("lacking").alias("lacking")), "folder", "left")
    status = (
        F.when(F.col("files").isNull(), "no .csv file found").when(F.col("files") > 1, "multiple CSV files")
        .when(F.col("lacking") != "", F.concat(F.lit("missing required column(s): "), "lacking"))
        .when(F.col("rows") == 0, "contains no data rows").when(F.col("named") == 0, "no usable station").otherwise("ok"))
    return told.select("folder", F.coalesce("files", F.lit(0)).alias("files"), F.coalesce("rows", F.lit(0)).alias("rows"), status.alias("status"))


def row_provenance(rows: DataFrame, name: str = "row_number") -> DataFrame:
    """The number of each row's line in its file, the header being line one.

    `rows` comes straight from a file scan. Rows are counted per block of a file
    and numbered within their block, so nothing is sorted and no file has to pass
    through one task; only the counts, one row per block, are put in order.
    Blank lines and quoted line breaks are not counted.
    """
    placed = rows.select(
        "*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_id"))
    blocks = placed.groupBy("_file", "_block").agg(F.count("*").alias("_n"), F.min("_id").alias("_first"))
    before = F.sum("_n").over(Window.partitionBy("_file").orderBy("_block")) - F.col("_n")
    starts = blocks.select("_file", "_block", "_first", before.alias("_before"))
    return join_hot(placed, starts, ["_file", "_block"]).select(
        *rows.columns, F.col("_file").alias("file"), (F.col("_before") + F.col("_id") - F.col("_first") + 2).alias(name))


def as_connections(rows: DataFrame) -> DataFrame:
    """File columns under the names the operators use; absent ones are NULL, unknown ones are left out."""
    kept = [F.col(f"`{f}`").alias(n) if f in rows.columns else F.lit(None).cast("string").alias(n)
            for f, n in FIELDS.items()]
    own = [c for c in ("row_number", "file") if c in rows.columns]
    return rows.select(*own, *kept)


def absent_coordinates(columns: list[str]) -> list[str]:
    return [c for c in COORDINATES if c not in columns]


def whole_file_scan(spark: SparkSession, paths: list[str], expected: list[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(file, text) with one row per file, and the expected files that were not there."""
    texts = spark.read.option("recursiveFileLookup", True).text(paths, wholetext=True).select(
        F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))
    wanted = spark.createDataFrame([(e,) for e in expected], "file string")
    missing = wanted.join(texts.select(F.element_at(F.split("file", "/"), -1).alias("file")), "file", "left_anti")
    return texts, missing
