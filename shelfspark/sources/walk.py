"""Walks of folder trees as Spark jobs, and what is read from the files they find.

A walk lists one level of folders at a time, each folder in the task that it falls to,
so a tree is spread over the cluster however it is shaped; at most ``max_depth`` + 1 jobs
run, and folders below the limit are never listed. Links are not followed; names that
begin with a dot are kept. Stores are those that pyarrow reads (local paths, hdfs, s3,
gs), and are read by the executors.
"""

from __future__ import annotations

import os
import stat
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .image_headers import image_size
from .schemas import MEDIA_EXTENSIONS
from .shared import written

_ENTRY = "rel_path string, is_dir boolean, size_bytes long, mtime long, ctime long"
#: Ranged reads come from blocks of this many bytes.
BLOCK = 4096


def store_of(root: str) -> tuple[pafs.FileSystem, str]:
    """The file system and path of a URI or a local path."""
    if "://" not in root and not root.startswith("file:"):
        return pafs.LocalFileSystem(), os.path.abspath(root)
    return pafs.FileSystem.from_uri(root)


def _listed(store: pafs.FileSystem, base: str, rel: str) -> Iterator[tuple]:
    """Entries of one folder: (rel_path, is_dir, size, mtime, ctime), times in milliseconds; ctime where the store has it."""
    path = f"{base}/{rel}" if rel else base
    under = f"{rel}/" if rel else ""
    if isinstance(store, pafs.LocalFileSystem):
        try:
            found = os.scandir(path)
        except (FileNotFoundError, PermissionError, NotADirectoryError):
            return
        with found:
            for e in found:
                s = e.stat(follow_symlinks=False)
                if stat.S_ISDIR(s.st_mode) or stat.S_ISREG(s.st_mode):
                    yield under + e.name, stat.S_ISDIR(s.st_mode), s.st_size, s.st_mtime_ns // 1_000_000, s.st_ctime_ns // 1_000_000
        return
    for e in store.get_file_info(pafs.FileSelector(path, allow_not_found=True)):
        if e.type in (pafs.FileType.Directory, pafs.FileType.File):
            yield under + e.base_name, e.type == pafs.FileType.Directory, e.size, e.mtime_ns // 1_000_000 if e.mtime_ns else None, None


def walk(spark: SparkSession, root: str, max_depth: int = 5, skip: str | None = None) -> DataFrame:
    """(rel_path, is_dir, size_bytes, mtime, ctime) of the files in folders at most ``max_depth`` below the root, and of all folders met.

    Entries whose name matches the pattern ``skip`` (the index's own files) are left
    out, folders with all that is below them. A missing root has no entries.
    """

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = store_of(root)
        for batch in batches:
            for rel in batch.column("rel_path").to_pylist():
                found = list(_listed(store, base.rstrip("/"), rel))
                for k in range(0, len(found), 10_000):
                    columns = zip(*found[k : k + 10_000], strict=True)
                    kinds = (pa.string(), pa.bool_(), pa.int64(), pa.int64(), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["rel_path", "is_dir", "size_bytes", "mtime", "ctime"])

    folders, levels = spark.createDataFrame([("",)], "rel_path string"), []
    for depth in range(max_depth + 1):
        level = folders.mapInArrow(entries, _ENTRY)
        if skip:
            level = level.where(~F.element_at(F.split("rel_path", "/"), -1).rlike(skip))
        levels.append(written(level, f"walk-{depth}"))
        folders = levels[-1].where("is_dir").select("rel_path")
        n = folders.count()
        if not n:
            break
        # single folders differ in size: deal them out evenly, some to a task
        folders = folders.repartition(min(n, 4 * spark.sparkContext.defaultParallelism + n // 1000))
    out = levels[0]
    for level in levels[1:]:
        out = out.unionByName(level)
    return out


def scan_corpus(spark: SparkSession, root: str, max_depth: int = 5, skip: str | None = None) -> DataFrame:
    """(rel_path, size_bytes, mtime, ctime) of files; contents aren't read."""
    return walk(spark, root, max_depth, skip).where("not is_dir").select("rel_path", "size_bytes", "mtime", "ctime")


def _each_file(files: DataFrame, root: str, look: Callable[[Callable[[int, int], bytes]], tuple], columns: str) -> DataFrame:
    """``look`` at each file of ``files`` (rel_path), given a function that reads a range; the file's URI and what it returns."""
    names = ["path", *(c.split()[0] for c in columns.split(", "))]
    schema = f"path string, {columns}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = store_of(root)
        for batch in batches:
            rows = []
            for rel in batch.column("rel_path").to_pylist():
                with store.open_input_file(f"{base.rstrip('/')}/{rel}" if rel else base) as f:
                    held: dict[int, bytes] = {}

                    def read(at: int, n: int, f=f, held=held) -> bytes:
                        out = b""
                        for k in range(at // BLOCK, (at + n - 1) // BLOCK + 1 if n > 0 else 0):
                            if k not in held:
                                f.seek(min(k * BLOCK, f.size()))
                                held[k] = f.read(BLOCK)
                            out += held[k]
                            if len(held[k]) < BLOCK:
                                break
                        return out[at % BLOCK : at % BLOCK + n]

                    rows.append((f"{root.rstrip('/')}/{rel}" if rel else root, *look(read)))
            kinds = [pa.int32() if "int" in c.split()[1] else pa.string() for c in schema.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names)

    return files.select("rel_path").mapInArrow(run, schema)


def _files(spark: SparkSession, root: str, max_depth: int) -> DataFrame:
    """Files below the root; the root itself if it is a file."""
    store, base = store_of(root)
    if store.get_file_info(base).type == pafs.FileType.File:
        return spark.createDataFrame([("",)], "rel_path string")
    found = scan_corpus(spark, root, max_depth).select("rel_path")
    return found.repartition(spark.sparkContext.defaultParallelism)  # a walk's rows lie where its folders were listed


def image_dimensions(spark: SparkSession, root: str, max_depth: int = 5) -> DataFrame:
    """(origin, width, height) of files with an image's extension; null sizes for what has no readable header. No pixels are decoded."""
    ext = F.lower(F.regexp_extract("rel_path", r"\.([^./]*)$", 1))
    files = _files(spark, root, max_depth)
    own = files.where(ext.isin(MEDIA_EXTENSIONS["image"]) | (F.col("rel_path") == ""))
    return _each_file(own, root, lambda read: image_size(read) or (None, None), "width int, height int").withColumnRenamed("path", "origin")


def read_text_files(spark: SparkSession, root: str, limit: int = 1000, max_depth: int = 5) -> DataFrame:
    """(path, text): the first characters of each file, of which no more bytes are read than these can have; broken UTF-8 is replaced."""
    return _each_file(_files(spark, root, max_depth), root, lambda read: (read(0, 4 * limit).decode("utf-8", "replace")[:limit],), "text string")
