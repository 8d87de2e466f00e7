"""Registered query of incremental indexing."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import buckets, io
from ..streaming.index_stream import catalogued, index_stream, system_tags
from .fixtures import FILES, files
from .registry import query

_ROWS = "f AS (SELECT file_id, rel_path, ext, media_type FROM files WHERE media_type IN ('image', 'video', 'audio'))"


@query(
    "x01_index_stream",
    f"{FILES}, {_ROWS} SELECT file_id, media_type AS slug, 'type' AS kind, 'system' AS source FROM f UNION ALL SELECT file_id, '.' || ext, 'ext', 'system' FROM f UNION ALL SELECT file_id, 'folder:' || split_part(rel_path, '/', 1), 'folder', 'folder' FROM f WHERE contains(rel_path, '/') "
    "UNION ALL SELECT file_id, 'folder:' || split_part(rel_path, '/', 1) || '/' || split_part(rel_path, '/', 2), 'folder', 'folder' FROM f WHERE contains(rel_path, '/')",
)
def _(spark, sf_dir):
    """All files arrive in two runs of the stream; the tags in the snapshot come back."""
    base = io.shared_folder(spark, "index")
    listing = files(spark, sf_dir).select("file_id", "rel_path", "size_bytes", "mtime")
    for half in (0, 1):
        listing.where(F.col("file_id") % 2 == half).write.mode("append").parquet(f"{base}/listing")
        index_stream(spark, f"{base}/listing", listing.schema, f"{base}/catalog", f"{base}/checkpoint", n_buckets=8).awaitTermination()
    tags = buckets.read_table(spark, f"{base}/catalog", "file_tags", system_tags(catalogued(listing)).schema)
    return tags.select("file_id", "slug", "kind", "source")


@query(
    "x02_bucketed_upserts",
    f"{FILES}, {_ROWS} SELECT file_id, rel_path, size_bytes + CASE WHEN file_id % 5 = 0 THEN 1 ELSE 0 END AS size_bytes FROM files WHERE file_id % 3 <> 1 AND NOT (file_id % 7 = 2 AND file_id % 5 <> 0)",
)
def _(spark, sf_dir):
    """Files are committed to a bucketed table, some are deleted, some change (one batch of these twice); the table comes back."""
    folder = io.shared_folder(spark, "buckets")
    own = files(spark, sf_dir).where("file_id % 3 <> 1").select("file_id", "rel_path", "size_bytes")
    change = lambda rows, **k: [buckets.Change("files", "rel_path", rows, **k)]
    buckets.commit(spark, folder, change(own), buckets=8)
    buckets.commit(spark, folder, change(own.limit(0), gone=own.where("file_id % 7 = 2")))
    fresh = own.where("file_id % 5 = 0").withColumn("size_bytes", F.col("size_bytes") + 1)
    rivals = fresh.unionByName(fresh.withColumn("size_bytes", F.col("size_bytes") + 1))
    for _ in range(2):
        buckets.commit(spark, folder, change(rivals, order=("size_bytes",)), batch=("changes", 0))
    return buckets.read_table(spark, folder, "files", own.schema)
