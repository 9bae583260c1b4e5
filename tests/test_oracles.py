"""A spread of registered queries, held against their SQL twins on the smallest folder; tools/check_oracle.py runs them all."""

from __future__ import annotations

import os

import duckdb
import pytest

import __spark_entry__ as entry
from gridloom.plans.inputs import TABLES

SF = "/root/testdata/sf0.001"
SPREAD = (
    "clean_name safe_float station_dimension load_warnings parallel_line_dedupe connected_components network_summary "
    "nearest_stations route_loss route_comparison tail_mean nn_tours nn_on_instance exact_tours window_scores "
    "tour_comparison bm25 context_block chunk_markdown resolve_name close_pairs arc_length check_constraints "
    "record_chunks csv_scan keyed_upsert index_source"
).split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver tables are not here")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    return connection


def test_every_oracle_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", SPREAD)
def test_query_equals_its_sql(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(tuple(str(r[c]) for c in cols) for r in df.collect())
    cursor = duck.execute(entry.oracle_sql()[name])
    heads = [d[0] for d in cursor.description]
    assert sorted(heads) == cols
    want = sorted(tuple(str(r[heads.index(c)]) for c in cols) for r in cursor.fetchall())
    assert got == want
