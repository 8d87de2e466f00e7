"""User tags and joins with them, a set at a time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars


def user_tags_of(files: DataFrame, file_tags: DataFrame, tags: DataFrame) -> DataFrame:
    return file_tags.where("source = 'user'").join(files.select("file_id", "rel_path"), "file_id").join(tags.select("slug", "display_name", "kind"), "slug").select("rel_path", "slug", "display_name", "kind").orderBy("display_name", "rel_path")


def with_raw_text(files: DataFrame, file_text: DataFrame) -> DataFrame:
    return files.drop("ocr_text").join(file_text.select("file_id", "ocr_text"), "file_id", "left")


def embedding_info(files: DataFrame, file_text: DataFrame, path: str) -> DataFrame:
    """One file's vectors and texts."""
    text = lambda c: F.when(F.coalesce(F.length(c), F.lit(0)) > 0, F.col(c)).otherwise("none")
    own = files.where(F.col("rel_path") == path).select("file_id", "rel_path", *(F.coalesce(F.size(c), F.lit(0)).cast("long").alias(f"{c}_floats") for c in files.columns if c.endswith("_emb")))
    return own.join(file_text.select("file_id", "ocr_text", "transcript_text"), "file_id", "left").select("rel_path", *(c for c in own.columns if c.endswith("_floats")), text("ocr_text").alias("ocr_text"), text("transcript_text").alias("transcript_text")).limit(1)


def hybrid(tag_hits: DataFrame, scored: DataFrame) -> DataFrame:
    """Scored rows that the tags hit too, best first."""
    return scored.join(tag_hits.select("rel_path"), "rel_path", "left_semi").orderBy(F.col("score").desc(), "rel_path")


def all_tag_names(custom: DataFrame, tags: DataFrame) -> DataFrame:
    return custom.select(F.col("slug").alias("name")).union(tags.where("kind = 'custom'").select("slug")).distinct().orderBy("name")


def files_with_tags(file_tags: DataFrame, slugs: list[str], mode: str = "any") -> DataFrame:
    """Files with any, or all, of the tags."""
    hits = file_tags.where(F.col("slug").isin(slugs))
    if mode == "any":
        return hits.select("file_id").distinct()
    return hits.groupBy("file_id").agg(F.count_distinct("slug").alias("n_")).where(F.col("n_") == len(set(slugs))).select("file_id")


def add_tags(file_tags: DataFrame, tags: DataFrame, new: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Attach (file_id, name); unknown files are ignored, missing tags created. Returns the new file_tags and tags."""
    wanted = new.select("file_id", scalars.tag_slug(F.col("name")).alias("slug")).where("slug <> ''").distinct().join(files.select("file_id"), "file_id", "left_semi")
    attach = wanted.withColumn("source", F.lit("user")).join(file_tags, ["file_id", "slug", "source"], "left_anti")
    create = wanted.select("slug").distinct().join(tags, "slug", "left_anti").select("slug", F.concat(F.lit("@"), "slug").alias("display_name"), F.lit("custom").alias("kind"))
    return file_tags.select("file_id", "slug", "source").unionByName(attach.select("file_id", "slug", "source")), tags.select("slug", "display_name", "kind").unionByName(create)


def remove_tags(file_tags: DataFrame, gone: DataFrame) -> DataFrame:
    """Detach (file_id, name) user tags."""
    keys = gone.select("file_id", scalars.tag_slug(F.col("name")).alias("slug"), F.lit("user").alias("source"))
    return file_tags.join(keys, ["file_id", "slug", "source"], "left_anti")


def status_overlay(listing: DataFrame, status: DataFrame, scored: DataFrame) -> DataFrame:
    """Each listed path with indexed, failed or none, and its score if it has one."""
    return listing.join(status, "rel_path", "left").join(scored.select("rel_path", "score"), "rel_path", "left").withColumn("index_status", F.coalesce("index_status", F.lit("none")))


def edit_custom_tags(custom: DataFrame, upserts: DataFrame, deletes: DataFrame) -> DataFrame:
    """The dictionary (slug, description) after overwriting and removing entries; names keep their case."""
    named = upserts.select(F.regexp_replace(F.trim("slug"), "^@", "").alias("slug"), F.trim("description").alias("description")).where("slug <> ''")
    return custom.join(named, "slug", "left_anti").unionByName(named).join(deletes.select("slug"), "slug", "left_anti")


def list_folder(df: DataFrame, path: str) -> DataFrame:
    """Direct children (rel_path, is_dir), without hidden ones, folders first."""
    own = df.where((scalars.dirname(F.col("rel_path")) == path) & (F.col("rel_path") != ""))
    name = scalars.basename(F.col("rel_path"))
    return own.where(~scalars.is_hidden(name)).orderBy(F.col("is_dir").desc(), F.lower(name))
