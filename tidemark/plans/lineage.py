"""Cutting lineage with a table in the folder that all executors share."""

from __future__ import annotations

import math
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir.

    Only a local master, where driver and tasks share one machine, gets a
    temporary folder of its own when the setting is absent.
    """
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if found:
        return found.rstrip("/")
    if not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    own = tempfile.mkdtemp(prefix="tidemark-")
    sc.setCheckpointDir(own)
    return own


def cut(df: DataFrame) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back.

    The result has no lineage but those files, so lost executors cost nothing
    that was computed before, and its true size is known to the planner. The
    files go when the session ends.
    """
    spark = df.sparkSession
    path = scratch(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows that a task is to sort or group at most, about.
TASK_ROWS = 500_000


def pieces(df: DataFrame, rows: int | None = None) -> int:
    """Partitions for df (or so many rows) by its rows, TASK_ROWS each, at least the session's: tasks stay as large as they are when the table grows."""
    spark = df.sparkSession
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil((df.count() if rows is None else rows) / TASK_ROWS))


def scratch(spark: SparkSession) -> str:
    """A new path in the shared folder, which goes when the session ends or the innermost `spent` block does."""
    path = f"{shared_dir(spark)}/tidemark-{uuid.uuid4().hex}"
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    for paths in _BLOCKS[-1:]:
        paths.append(path)
    return path


@contextmanager
def spent(spark: SparkSession) -> Iterator[None]:
    """Delete, at the end of the block, the tables that were cut in it; what is to stay must have been written elsewhere by then."""
    _BLOCKS.append([])
    try:
        yield
    finally:
        for path in _BLOCKS.pop():
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


#: Paths of the tables cut in each open block, the innermost last.
_BLOCKS: list[list[str]] = []
