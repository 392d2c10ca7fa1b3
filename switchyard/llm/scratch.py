"""Intermediate tables in the shared checkpoint folder.

``spark.checkpoint.dir`` names a folder that driver and executors share; it is read from the session.  Only where it is
unset, and Spark runs on this machine alone (tests), a temporary folder is used; on a cluster that is an error.  A written
table cuts lineage, survives the loss of an executor and is read again with column pruning.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_LOCAL: list[str] = []


def root(spark: SparkSession) -> str:
    """The shared folder for intermediate tables."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not _LOCAL:
        _LOCAL.append("file://" + tempfile.mkdtemp(prefix="switchyard-"))
    return _LOCAL[0]


def fresh() -> str:
    """A name that no other table has."""
    return uuid.uuid4().hex


class Tables:
    """The tables of one run, which can be deleted together once no result that reads them is needed any more."""

    def __init__(self) -> None:
        self.paths: list[str] = []

    def clear(self, spark: SparkSession) -> None:
        while self.paths:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.paths.pop())
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


_RUN: ContextVar[Tables] = ContextVar("tables", default=Tables())  # noqa: B039


@contextmanager
def tables(made: Tables) -> Iterator[Tables]:
    """What is stored inside belongs to the handle ``made``."""
    token = _RUN.set(made)
    try:
        yield made
    finally:
        _RUN.reset(token)


def tracked(path: str) -> str:
    """``path``, to be deleted with the tables of the run."""
    _RUN.get().paths.append(path)
    return path


def stored(frame: DataFrame, name: str) -> DataFrame:
    """Write ``frame`` to a new table in the shared folder and read it back."""
    spark = frame.sparkSession
    path = tracked(f"{root(spark)}/switchyard-{fresh()}-{name}")
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)
