"""Shared folder for written intermediate tables.

Lineage is cut by writing Parquet to the folder that the cluster names in
``spark.checkpoint.dir``: every executor can read it, so a lost executor costs
only the tasks it was running.
"""

from __future__ import annotations

import contextlib
import gc
import tempfile
import threading
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a few numbers that a join may broadcast; more are shuffled.
ROWS_TO_BROADCAST = 500_000


def shared_dir(spark: SparkSession, kind: str) -> str:
    """A new folder URI below ``spark.checkpoint.dir``.

    Where the setting is absent and Spark runs in one process (tests), a
    temporary folder takes its place; on a cluster its absence is an error.
    """
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{kind}-{uuid.uuid4().hex}"


class _Scopes(threading.local):
    """Scratch scopes of the thread, the innermost last."""

    def __init__(self):
        self.stack: list[list[str]] = []


_own = _Scopes()


def materialize(df: DataFrame, kind: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back."""
    path = shared_dir(df.sparkSession, kind)
    if _own.stack:
        _own.stack[-1].append(path)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def discard(df: DataFrame) -> None:
    """Drop a table from ``materialize`` before its scope ends; nothing may read it any more."""
    drop(df.sparkSession, df._written_to)


def sweep(spark: SparkSession) -> None:
    """Let Spark's context cleaner remove the shuffle files of finished steps now.

    It learns of them when the driver collects garbage, which a driver with little to do
    puts off (by half an hour at most); a step that shuffles much is followed by this.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that are written inside go at the end; write what is to stay with ``keep``."""
    _own.stack.append([])
    try:
        yield
    finally:
        for path in _own.stack.pop():
            drop(spark, path)
        if not _own.stack:
            sweep(spark)


def keep(df: DataFrame, kind: str) -> DataFrame:
    """``materialize`` outside the innermost scratch scope."""
    held = _own.stack.pop() if _own.stack else None
    try:
        return materialize(df, kind)
    finally:
        if held is not None:
            _own.stack.append(held)


def drop(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def small_side(df: DataFrame, limit: int = ROWS_TO_BROADCAST) -> DataFrame:
    """``df``, a written table of narrow rows, marked for broadcast if it has at most ``limit`` rows."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def unused(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores behind it as it takes to differ from all columns of ``df``."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
