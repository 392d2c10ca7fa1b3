"""Tables written to the folder that driver and executors share (``spark.checkpoint.dir``).

A written table cuts a plan that would else compute the same rows once for each of its uses, and survives lost executors.
What is written inside ``with tables(made)`` belongs to the handle ``made`` and goes with ``made.clear(spark)``; all else
stays in the handle ``SESSION``.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_LOCAL: list[str] = []


class Written:
    """Paths of tables that are deleted together."""

    def __init__(self) -> None:
        self.paths: list[str] = []

    def clear(self, spark: SparkSession) -> None:
        while self.paths:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.paths.pop())
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


SESSION = Written()
_HANDLE: ContextVar[Written] = ContextVar("written", default=SESSION)  # noqa: B039


@contextmanager
def tables(made: Written) -> Iterator[Written]:
    """Tables written inside belong to ``made``; clear it once no result that reads them is needed."""
    token = _HANDLE.set(made)
    try:
        yield made
    finally:
        _HANDLE.reset(token)


def folder(spark: SparkSession) -> str:
    """The shared folder; a temporary one only where it is unset and Spark runs on this machine alone."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not _LOCAL:
        made = tempfile.mkdtemp(prefix="switchyard-")
        atexit.register(shutil.rmtree, made, ignore_errors=True)
        _LOCAL.append("file://" + made)
    return _LOCAL[0]


def written(frame: DataFrame, name: str) -> DataFrame:
    """``frame`` written to a new table and read back; small partitions are joined by Spark's adaptive plans."""
    spark = frame.sparkSession
    path = f"{folder(spark)}/switchyard-{uuid.uuid4().hex}-{name}"
    _HANDLE.get().paths.append(path)
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)
