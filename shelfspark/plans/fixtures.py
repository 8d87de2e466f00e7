"""Catalog tables derived from the given tables, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import text

EXTS = {0: "jpg", 1: "png", 2: "gif", 3: "mp4", 4: "webm", 5: "mp3", 6: "wav", 7: "txt", 9: "jpeg"}
VECTORS = {"clip_emb": (0, "doc_id % 13 <> 0"), "metadata_emb": (101, "true"), "ocr_emb": (202, "has_text = 1"), "transcript_emb": (303, "media_type in ('audio', 'video')"), "clap_emb": (404, "media_type in ('audio', 'video')")}
DIM = 64

_CASE_EXT = "CASE doc_id % 10 " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in EXTS.items()) + " END"
_COLUMNS = {
    "file_id": "doc_id",
    "ext": "ext",
    "rel_path": "(CASE WHEN doc_id % 11 = 0 THEN '' ELSE source || '/' || lang || '/' END) || 'doc_' || CAST(doc_id AS {text}) || COALESCE('.' || ext, '')",
    "media_type": "media_type",
    "size_bytes": "n_chars",
    "mtime": "1704067200000 + doc_id * 3600000",
    "width": "CASE WHEN media_type IN ('image', 'video') THEN CAST(64 * (1 + doc_id % 30) AS INT) END",
    "height": "CASE WHEN media_type IN ('image', 'video') THEN CAST(64 * (1 + doc_id % 17) AS INT) END",
    "duration_ms": "CASE WHEN media_type = 'audio' THEN 1000 * (1 + doc_id % 300) END",
    "fps": "CASE WHEN media_type = 'video' THEN CAST(12.0 * (2 + doc_id % 4) AS DOUBLE) END",
    "has_text": "has_text",
    "ocr_text": "CASE WHEN has_text = 1 THEN text END",
    "status": "CASE WHEN doc_id % 37 = 0 THEN 'embed_failed' ELSE 'indexed' END",
}
_MEDIA = "CASE WHEN ext IN ('jpg', 'png', 'gif', 'jpeg') THEN 'image' WHEN ext IN ('mp4', 'webm') THEN 'video' WHEN ext IN ('mp3', 'wav') THEN 'audio' WHEN ext = 'txt' THEN 'text' ELSE 'unknown' END"
_HAS_TEXT = "CAST(CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END AS INT)"

#: CTEs to start a query with: ``files``.
FILES = (
    f"WITH d0 AS (SELECT *, {_CASE_EXT} AS ext FROM documents), d1 AS (SELECT *, {_MEDIA} AS media_type, {_HAS_TEXT} AS has_text FROM d0), "
    "files AS (SELECT " + ", ".join(f"{v.format(text='VARCHAR')} AS {k}" for k, v in _COLUMNS.items()) + " FROM d1) "
)
#: The same with ``filesv``, which has the vectors too.
FILESV = FILES.rstrip() + ", filesv AS (SELECT f.*, " + ", ".join(f"{c}_.embedding AS {c}" for c in VECTORS) + " FROM files f " + " ".join(f"LEFT JOIN embeddings {c}_ ON {c}_.vec_id = (f.file_id + {k}) % (SELECT count(*) FROM embeddings) AND ({cond.replace('doc_id', 'f.file_id')})" for c, (k, cond) in VECTORS.items()) + ") "
TAGS = "user_tags AS (SELECT doc_id AS file_id, 'good' AS slug, 'user' AS source FROM labels WHERE quality = 1 UNION ALL SELECT doc_id, 'toxic', 'user' FROM labels WHERE toxic = 1) "
TEXTS = "turns AS (SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS transcript_text FROM conversations WHERE trim(text) <> '' GROUP BY conv_id), file_text AS (SELECT f.file_id, f.ocr_text, c.transcript_text FROM files f LEFT JOIN turns c ON c.conv_id = f.file_id) "


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files from documents."""
    d = table(spark, sf_dir, "documents").withColumn("ext", F.expr(_CASE_EXT)).withColumns({"media_type": F.expr(_MEDIA), "has_text": F.expr(_HAS_TEXT)})
    return d.select(*(F.expr(v.format(text="STRING")).alias(k) for k, v in _COLUMNS.items()))


def files_with_vectors(spark: SparkSession, sf_dir: str, *wanted: str) -> DataFrame:
    """Files with the wanted vector columns (all by default), dealt from the whole table of vectors."""
    out = files(spark, sf_dir)
    e = table(spark, sf_dir, "embeddings")
    n = e.count()
    for c in wanted or VECTORS:
        k, cond = VECTORS[c]
        key = F.when(F.expr(cond.replace("doc_id", "file_id")), (F.col("file_id") + k) % n)
        out = out.withColumn("k_", key).join(e.select(F.col("vec_id").alias("k_"), F.col("embedding").alias(c)), "k_", "left").drop("k_")
    return out


def user_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    marks = F.array_compact(F.array(F.when(F.col("quality") == 1, "good"), F.when(F.col("toxic") == 1, "toxic")))
    return table(spark, sf_dir, "labels").select(F.col("doc_id").alias("file_id"), F.explode(marks).alias("slug"), F.lit("user").alias("source"))


def file_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = text.join_regions(table(spark, sf_dir, "conversations"), "conv_id", "turn", "text").where("text <> ''").select(F.col("conv_id").alias("file_id"), F.col("text").alias("transcript_text"))
    return files(spark, sf_dir).select("file_id", "ocr_text").join(c, "file_id", "left")


def query_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stated queries of a batch search: every vector whose id is divisible by 20."""
    return table(spark, sf_dir, "embeddings").where(F.col("vec_id") % 20 == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qvec"))


def query_vector(spark: SparkSession, sf_dir: str, vec_id: int = 7) -> list[float]:
    """One query vector; a single row."""
    return table(spark, sf_dir, "embeddings").where(F.col("vec_id") == vec_id).select("embedding").first()[0]
