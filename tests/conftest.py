from __future__ import annotations

import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]").appName("tests")
        .config("spark.sql.shuffle.partitions", "4").config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared"))).getOrCreate())
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture
def lines(spark):
    """A small network: a square with one diagonal, a tail, and a pair of its own."""
    rows = [("a", "b", "2.000", "1.0000"), ("b", "c", "2.000", None), ("c", "d", "2.000", "3.0000"),
            ("a", "d", "2.500", "0.5000"), ("a", "c", "3.000", "2.0000"), ("d", "e", "1.000", "4.0000"),
            ("x", "y", "7.000", "9.0000")]
    return spark.createDataFrame(rows, "a string, b string, km string, loss string").selectExpr(
        "a", "b", "CAST(km AS DECIMAL(18,3)) AS distance_km", "CAST(loss AS DECIMAL(24,4)) AS energy_loss_mw")
