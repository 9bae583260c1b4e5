"""Row-local operators on streams.

The results of this package are batch results; nothing in it keeps state between
rows of a stream. What works row by row is plain column code, though, so it runs
on a ``readStream`` frame unchanged. This module names the two such pipelines
users have: cleaning incoming line rows and listing the rules they break.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from gridloom.operators.quality import check_constraints
from gridloom.operators.stations import clean_connections


def clean_lines(rows: DataFrame) -> DataFrame:
    """Typed connections from text cells, batch or stream."""
    return clean_connections(rows)


def broken_rules(lines: DataFrame, key: str) -> DataFrame:
    """(key, violation) as rows arrive, batch or stream."""
    return check_constraints(lines, key)
