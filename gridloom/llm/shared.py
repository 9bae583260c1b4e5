"""Where intermediate tables of this subpackage go, and small schema helpers."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.session import scratch_path


def stored(df: DataFrame, name: str) -> DataFrame:
    """`df` written to the shared folder and read back: later steps start from files that every executor reaches."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(prefix: str, taken) -> str:
    """A column name that is not in `taken`, whatever the case of its letters."""
    names = {t.lower() for t in taken}
    while (name := f"{prefix}_{uuid.uuid4().hex[:8]}") in names:
        pass
    return name


def whole_row(df: DataFrame, keep=None) -> Column:
    """All columns of `df`, or those in `keep`, as one struct, out of the way of new names."""
    return F.struct(*[F.col(f"`{c}`") for c in keep or df.columns])
