"""Where the ready-made queries register themselves, each beside its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gridloom.plans.inputs import Inputs
from gridloom.plans.inputs_sql import with_inputs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(inputs) -> DataFrame`` under `name`.

    `sql` may use the derived inputs of :mod:`gridloom.plans.inputs_sql` by name;
    the common table expressions it needs are put in front of it.
    """

    def register(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = lambda spark, sf_dir: fn(Inputs(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = with_inputs(sql)
        return fn

    return register
