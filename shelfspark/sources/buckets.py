"""Tables that take small batches: buckets by key hash, copied on write, listed in a manifest.

A table is cut into a fixed number of buckets by the hash of one key column. A commit
writes new files for the buckets that its batch touches and a manifest that names the
files of every bucket, old or new; so its work grows with the touched buckets, not with
the table. A manifest is put in place by one rename that fails if the version is taken:
readers see all of a commit or nothing of it, and of two writers one has to try again.
The manifest keeps the last batch of each source, so a batch that is run again after a
failure changes nothing. A commit that fails removes what it wrote; ``vacuum`` removes
what no kept version names.

Choose as many buckets as let one bucket fit a task; rows of one key stay together.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


@dataclass(frozen=True)
class Change:
    """What a commit does to a table.

    All rows whose ``key`` is among the keys of ``rows`` or of ``gone`` make way for
    ``rows``. With ``order``, the rows of a key compete and the least one stays.
    """

    table: str
    key: str
    rows: DataFrame
    gone: DataFrame | None = None
    order: tuple[str, ...] = ()


class VersionTaken(RuntimeError):
    """Another writer committed first; read again and retry."""


def bucket_of(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


class _Folder:
    """Driver-side access to the store, through Hadoop's file systems."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.root, self.jvm = spark, folder.rstrip("/"), spark.sparkContext._jvm
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.fs = self.path("").getFileSystem(self.conf)

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def list(self, name: str) -> list[tuple[str, float]]:
        """Names in a folder, each with the seconds since 1970 of its last change."""
        p = self.path(name)
        return sorted((s.getPath().getName(), s.getModificationTime() / 1000) for s in self.fs.listStatus(p)) if self.fs.exists(p) else []

    def read(self, name: str) -> str:
        stream = self.fs.open(self.path(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def put_new(self, name: str, text: str) -> None:
        """Write a file whole, or fail if there is one of this name."""
        temp = f"{name}.{uuid.uuid4().hex}.temp"
        out = self.fs.create(self.path(temp), True)
        out.write(bytearray(text.encode()))
        out.close()
        none = self.spark.sparkContext._gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 1)
        none[0] = self.jvm.org.apache.hadoop.fs.Options.Rename.NONE
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.conf)
        try:
            context.rename(self.path(temp), self.path(name), none)
        except Exception as e:
            self.drop(temp)
            if self.fs.exists(self.path(name)):
                raise VersionTaken(name) from e
            raise

    def drop(self, name: str) -> None:
        self.fs.delete(self.path(name), True)


def _manifest_name(version: int) -> str:
    return f"manifests/{version:012d}.json"


def manifest(spark: SparkSession, folder: str) -> dict:
    """The newest version: ``tables`` with key, number of buckets and the folder of each bucket that has rows; ``batches`` by source."""
    at = _Folder(spark, folder)
    versions = [name for name, _ in at.list("manifests") if name.endswith(".json")]
    return json.loads(at.read(f"manifests/{versions[-1]}")) if versions else {"version": 0, "tables": {}, "batches": {}}


def read_table(spark: SparkSession, folder: str, table: str, schema: StructType, only: Iterable[int] | None = None, at: dict | None = None) -> DataFrame:
    """The table's rows, or those of some buckets; no rows of this schema if nothing was committed."""
    files = (at or manifest(spark, folder))["tables"].get(table, {}).get("files", {})
    wanted = set(map(str, only)) if only is not None else files.keys()
    paths = [f"{folder.rstrip('/')}/{files[b]}" for b in sorted(files) if b in wanted]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def touched(keys: DataFrame, key: str, buckets: int) -> list[int]:
    """Buckets that hold the keys; at most ``buckets`` numbers come to the driver."""
    return sorted(r[0] for r in keys.select(bucket_of(F.col(key), buckets)).distinct().collect())


def read_keys(spark: SparkSession, folder: str, table: str, schema: StructType, keys: DataFrame, at: dict | None = None) -> DataFrame:
    """Rows whose key is among ``keys``; other buckets are not read."""
    at = at or manifest(spark, folder)
    held = at["tables"].get(table)
    if held is None:
        return spark.createDataFrame([], schema)
    rows = read_table(spark, folder, table, schema, touched(keys, held["key"], held["buckets"]), at)
    return rows.join(keys.select(held["key"]), held["key"], "left_semi")


def commit(spark: SparkSession, folder: str, changes: list[Change], batch: tuple[str, int] | None = None, buckets: int = 64, at: dict | None = None) -> int:
    """Apply the changes as one version and return its number.

    ``batch`` (source, number) makes reruns harmless: numbers up to the source's last
    one are taken as done. ``buckets`` holds for tables that are new. ``at`` is the
    manifest that the changes were worked out from, by default the newest; if there is
    a newer one by then, ``VersionTaken`` is raised.
    """
    store, now = _Folder(spark, folder), at or manifest(spark, folder)
    if batch and now["batches"].get(batch[0], -1) >= batch[1]:
        return now["version"]
    run = f"data/{uuid.uuid4().hex}"
    tables = dict(now["tables"])
    try:
        for change in changes:
            held = tables.get(change.table, {"key": change.key, "buckets": buckets, "files": {}})
            if held["key"] != change.key:
                raise ValueError(f"{change.table} is cut by {held['key']}")
            tables[change.table] = _rewrite(spark, folder, change, held, now, f"{run}/{change.table}", store)
        version = now["version"] + 1
        batches = now["batches"] | ({batch[0]: batch[1]} if batch else {})
        store.put_new(_manifest_name(version), json.dumps({"version": version, "tables": tables, "batches": batches}))
    except BaseException:
        store.drop(run)
        raise
    return version


def _rewrite(spark: SparkSession, folder: str, change: Change, held: dict, now: dict, to: str, store: _Folder) -> dict:
    key, rows = change.key, change.rows
    if change.order:  # the winners are found on key and order alone
        best = rows.groupBy(key).agg(F.min(F.struct(*change.order)).alias("best_"))
        rows = rows.join(best, (rows[key].eqNullSafe(best[key])) & F.struct(*(rows[c] for c in change.order)).eqNullSafe(best["best_"]), "left_semi").dropDuplicates([key])
    keys = rows.select(key)
    keys = keys.unionByName(change.gone.select(F.col(key))) if change.gone is not None else keys
    keys = keys.distinct()
    hit = touched(keys, key, held["buckets"])
    if not hit:
        return held
    old = read_table(spark, folder, change.table, rows.schema, hit, now)
    kept = old.join(keys, old[key].eqNullSafe(keys[key]), "left_anti")
    new = kept.unionByName(rows).withColumn("bucket_", bucket_of(F.col(key), held["buckets"]))
    # large buckets are written by several tasks, small ones share a task
    new.hint("rebalance", "bucket_").write.partitionBy("bucket_").parquet(f"{folder.rstrip('/')}/{to}")
    written = {name.removeprefix("bucket_=") for name, _ in store.list(to) if name.startswith("bucket_=")}
    files = {b: f for b, f in held["files"].items() if int(b) not in set(hit)} | {b: f"{to}/bucket_={b}" for b in written}
    return held | {"files": files}


def rebucket(spark: SparkSession, folder: str, table: str, schema: StructType, buckets: int) -> int:
    """Cut a table that has grown into another number of buckets, as a version of its own."""
    store, now = _Folder(spark, folder), manifest(spark, folder)
    held, run = now["tables"][table], f"data/{uuid.uuid4().hex}"
    try:
        rows = read_table(spark, folder, table, schema, at=now).withColumn("bucket_", bucket_of(F.col(held["key"]), buckets))
        rows.repartition(buckets, "bucket_").write.partitionBy("bucket_").parquet(f"{folder.rstrip('/')}/{run}/{table}")
        files = {b: f"{run}/{table}/{name}" for name, _ in store.list(f"{run}/{table}") if (b := name.removeprefix("bucket_=")) != name}
        tables = now["tables"] | {table: held | {"buckets": buckets, "files": files}}
        store.put_new(_manifest_name(now["version"] + 1), json.dumps(now | {"version": now["version"] + 1, "tables": tables}))
    except BaseException:
        store.drop(run)
        raise
    return now["version"] + 1


def vacuum(spark: SparkSession, folder: str, older_than_s: float = 7 * 24 * 3600) -> int:
    """Remove versions older than so many seconds, but for the newest, and files that no kept version names; returns how many folders of files went.

    Files that are younger stay, as a commit may be about to name them.
    """
    store, limit = _Folder(spark, folder), time.time() - older_than_s
    versions = store.list("manifests")
    named = [(name, t) for name, t in versions if name.endswith(".json")]
    for name, t in versions:
        if t < limit and (name, t) not in named[-1:]:
            store.drop(f"manifests/{name}")
    live = set()
    for name, t in named:
        if t >= limit or (name, t) in named[-1:]:
            live |= {f for table in json.loads(store.read(f"manifests/{name}"))["tables"].values() for f in table["files"].values()}
    gone = 0
    for run, _ in store.list("data"):
        left = 0
        for table, _ in store.list(f"data/{run}"):
            for name, t in store.list(f"data/{run}/{table}"):
                file = f"data/{run}/{table}/{name}"
                if name.startswith("bucket_=") and file not in live and t < limit:
                    store.drop(file)
                    gone += 1
                else:
                    left += name.startswith("bucket_=")
        if not left and all(t < limit for _, t in store.list(f"data/{run}")):
            store.drop(f"data/{run}")
    return gone
