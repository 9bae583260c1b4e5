"""Session helpers: where lineage is cut and where scratch tables go."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only a local-mode session without that setting (tests, a laptop) gets a
    folder of its own; on a cluster the setting is required, because a folder on
    one machine is lost with that machine.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    made = tempfile.mkdtemp(prefix="gridloom-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def cut(df: DataFrame) -> DataFrame:
    """Materialise `df` on reliable storage and forget how it was made."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unused path in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is executed in here go when it is done, not when the driver's memory is next cleared."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def _stored_at(df: DataFrame, path: str) -> DataFrame:
    with shuffles_freed(df.sparkSession):
        df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def kept(df: DataFrame, name: str = "kept") -> DataFrame:
    """`df` computed once and stored as packed columns; several times smaller than what :func:`cut` writes."""
    return _stored_at(df, scratch_path(df.sparkSession, name))


def kept_in_parts(part: Callable[[int], DataFrame], parts: int, name: str) -> DataFrame:
    """`part(0)`, `part(1)` and so on one after the other as one stored table, so that disk holds the shuffle files of one of them."""
    first = part(0)
    path = scratch_path(first.sparkSession, name)
    with shuffles_freed(first.sparkSession):
        for i in range(parts):
            (first if i == 0 else part(i)).write.mode("append").parquet(path)
    return first.sparkSession.read.schema(first.schema).parquet(path)


class Rounds:
    """The state of a loop. Two places take turns, so a loop holds its last two states however many rounds it has.

    A state may be made from the one before it and from nothing older.
    """

    def __init__(self, spark: SparkSession, name: str):
        self._spark = spark
        self._paths = scratch_path(spark, name), scratch_path(spark, name)
        self._made = 0

    def keep(self, state: DataFrame) -> DataFrame:
        self._made += 1
        return _stored_at(state, self._paths[self._made % 2])

    def ended(self, state: DataFrame) -> DataFrame:
        """`state`, which is the last one; the place of the one before it is cleared."""
        path = self._spark._jvm.org.apache.hadoop.fs.Path(self._paths[(self._made + 1) % 2])
        path.getFileSystem(self._spark._jsc.hadoopConfiguration()).delete(path, True)
        return state
