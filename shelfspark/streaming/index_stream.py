"""Incremental indexing with Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import catalog
from ..sources import buckets


def catalogued(files: DataFrame) -> DataFrame:
    """Path parts, media type and flags of listed files, without what is not indexable."""
    return catalog.with_motion_flags(catalog.indexable(catalog.with_media_type(catalog.with_path_parts(files))))


def system_tags(files: DataFrame) -> DataFrame:
    """Folder, type and extension tags of files."""
    return catalog.derive_folder_tags(files).unionByName(catalog.derive_type_tags(files)).unionByName(catalog.derive_ext_tags(files))


def merge_batch(new: DataFrame, folder: str, batch: tuple[str, int] | None = None, n_buckets: int = 64, attempts: int = 5) -> int:
    """Merge catalogued files by path into the bucketed catalog: files, the folders above them, and their tags.

    Of several files of one path in a batch that with the least id stays. Only the
    buckets of the batch's paths, folders and file ids are read and written. If another
    writer commits meanwhile, the merge is made anew on what that one left.
    """
    least = new.groupBy("rel_path").agg(F.min("file_id").alias("file_id"))
    new = new.join(least, ["rel_path", "file_id"], "left_semi").dropDuplicates(["rel_path"]).persist()
    try:
        for left in reversed(range(attempts)):
            try:
                return _merged(new, folder, batch, n_buckets)
            except buckets.VersionTaken:
                if not left:
                    raise
        raise ValueError("no attempts")
    finally:
        new.unpersist()


def _merged(new: DataFrame, folder: str, batch: tuple[str, int] | None, n_buckets: int) -> int:
    spark = new.sparkSession
    now = buckets.manifest(spark, folder)
    before = buckets.read_keys(spark, folder, "files", new.schema, new.select("rel_path"), now)
    # the tags of a file that comes again, under whatever id, make way for its new ones
    again = before.select("file_id").unionByName(new.select("file_id")).distinct()
    above = catalog.derive_folders(new).persist()
    known = buckets.read_keys(spark, folder, "folders", above.schema, above, now)
    # each is read for its buckets, its keys and its rows
    fresh = above.join(known, "rel_path", "left_anti").persist()
    tags = catalog.unique_file_tags(system_tags(new)).persist()
    changes = [
        buckets.Change("files", "rel_path", new),
        buckets.Change("folders", "rel_path", fresh),
        buckets.Change("file_tags", "file_id", tags, gone=again),
    ]
    try:
        return buckets.commit(spark, folder, changes, batch, n_buckets, at=now)
    finally:
        for done in (tags, fresh, above):
            done.unpersist()


def index_stream(spark: SparkSession, source: str, schema, folder: str, checkpoint: str, derive: Callable[[DataFrame], DataFrame] = catalogued, n_buckets: int = 64) -> StreamingQuery:
    """Catalogue what arrives in a Parquet folder of listings (file_id, rel_path, ...), each file once.

    Every batch is one commit to the bucketed tables ``files``, ``folders`` and
    ``file_tags``; a batch that is run again after a failure is recognised by the
    stream's id and its number, and changes nothing.
    """

    def merge(batch: DataFrame, batch_id: int) -> None:
        stream = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId") or checkpoint
        merge_batch(derive(batch), folder, (stream, batch_id), n_buckets)

    stream = spark.readStream.schema(schema).parquet(source)
    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
