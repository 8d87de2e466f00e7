"""Snapshots of the catalog; and what reads and writes files besides."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from .schemas import CATALOG
from .shared import shared_folder, spread, written  # noqa: F401
from .walk import image_dimensions, read_text_files, scan_corpus  # noqa: F401

POINTER = "CURRENT"


def _hadoop(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def current_version(spark: SparkSession, folder: str) -> str | None:
    """Name of the published version, or None."""
    jvm, p, fs = _hadoop(spark, f"{folder}/{POINTER}")
    if not fs.exists(p):
        return None
    return spark.read.text(f"{folder}/{POINTER}").first()[0]


def publish_snapshot(tables: dict[str, DataFrame], folder: str) -> str:
    """Write a new version of the tables, then move the pointer to it.

    A failed run leaves the old version in place and nothing of its own.
    """
    spark = next(iter(tables.values())).sparkSession
    version = f"v={uuid.uuid4().hex}"
    jvm, temp, fs = _hadoop(spark, f"{folder}/{version}/pointer")
    try:
        for name, df in tables.items():
            df.write.parquet(f"{folder}/{version}/{name}")
        out = fs.create(temp, True)
        out.write(bytearray(version.encode()))
        out.close()
        # one atomic rename: readers see the old version or the new one
        options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
        context.rename(temp, jvm.org.apache.hadoop.fs.Path(f"{folder}/{POINTER}"), options)
    except BaseException:
        fs.delete(temp.getParent(), True)
        raise
    return version


def drop_versions(spark: SparkSession, folder: str, older_than_s: float = 7 * 24 * 3600) -> int:
    """Remove versions other than the published one that are older than so many seconds; returns how many."""
    _, p, fs = _hadoop(spark, folder)
    if not fs.exists(p):
        return 0
    now, limit, gone = current_version(spark, folder), (time.time() - older_than_s) * 1000, 0
    for s in fs.listStatus(p):
        name = s.getPath().getName()
        if name.startswith("v=") and name != now and s.getModificationTime() < limit:
            gone += fs.delete(s.getPath(), True)
    return gone


def load_catalog(spark: SparkSession, folder: str, schemas: dict[str, StructType] | None = None) -> dict[str, DataFrame]:
    """The published tables; empty ones of the same schema where nothing is published."""
    version, out = current_version(spark, folder), {}
    for name, schema in (schemas or CATALOG).items():
        jvm, p, fs = _hadoop(spark, f"{folder}/{version}/{name}")
        out[name] = spark.read.schema(schema).parquet(f"{folder}/{version}/{name}") if version and fs.exists(p) else spark.createDataFrame([], schema)
    return out
