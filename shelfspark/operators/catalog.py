"""Deriving and maintaining the catalog."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars
from ..sources import schemas


def by_extension(table: dict[str, list[str]], ext: Column, default: str) -> Column:
    """The group of ``table`` that lists the extension."""
    groups = [ext.isin(v) for v in table.values()]
    return reduce(lambda c, k: c.when(k[0], k[1]), zip(groups[1:], list(table)[1:], strict=True), F.when(groups[0], next(iter(table)))).otherwise(default)


def count_visible_files(df: DataFrame, name: str = "name") -> DataFrame:
    return df.where(~scalars.is_hidden(F.col(name))).agg(F.count("*").alias("n"))


def unprocessed(files: DataFrame, catalog: DataFrame) -> DataFrame:
    """Files that the old catalog doesn't hold as well-embedded media."""
    done = catalog.where(F.col("media_type").isin("image", "video", "audio") & (F.col("status") != "embed_failed")).select("rel_path")
    return files.join(done, "rel_path", "left_anti")


def parse_audio_probe(df: DataFrame, json_col: str) -> DataFrame:
    f = F.col("p_.format")
    ms = F.round(scalars.try_double(f["duration"]) * 1000).cast("bigint")
    kbps = F.round(scalars.try_double(f["bit_rate"]) / 1000).cast("bigint")
    tags = {t: f["tags"][t] for t in ("artist", "album", "genre", "comment", "track")}
    return df.withColumn("p_", F.from_json(json_col, schemas.AUDIO_PROBE)).withColumns(tags | {"year": f["tags"]["date"].try_cast("int"), "duration_ms": ms, "bit_rate_kbps": kbps}).drop("p_")


def parse_video_probe(df: DataFrame, json_col: str) -> DataFrame:
    """Size and rate of the last video stream; whether any stream is audio."""
    v = F.try_element_at(F.filter("p_.streams", lambda s: s["codec_type"] == "video"), F.lit(-1))
    num, den = (F.try_element_at(F.split("rate_", "/"), F.lit(i)).try_cast("double") for i in (1, 2))
    out = df.withColumn("p_", F.from_json(json_col, schemas.VIDEO_PROBE)).withColumns({"width": v["width"], "height": v["height"], "rate_": v["r_frame_rate"]})
    has_audio = F.coalesce(F.exists("p_.streams", lambda s: s["codec_type"] == "audio"), F.lit(False)).cast("int")
    return out.withColumns({"fps": F.when(den > 0, num / den), "has_audio": has_audio}).drop("p_", "rate_")


def load_custom_tags(df: DataFrame, json_col: str) -> DataFrame:
    """(slug, description) of JSON objects; bad JSON gives nothing."""
    return df.select(F.explode(F.from_json(json_col, "map<string,string>")).alias("slug", "description"))


def first_chars(df: DataFrame, col: str, limit: int = 1000, out: str = "head") -> DataFrame:
    return df.withColumn(out, F.substring(col, 1, limit))


def with_path_parts(df: DataFrame) -> DataFrame:
    """name, stem, ext, parent and depth of rel_path; files in the root have depth 0."""
    name = scalars.basename(F.col("rel_path"))
    return df.withColumns({"name": name, "stem": scalars.stem(name), "ext": scalars.extension(name), "parent_rel_path": scalars.dirname(F.col("rel_path")), "depth": F.size(F.split("rel_path", "/")) - 1})


def with_media_type(df: DataFrame) -> DataFrame:
    return df.withColumn("media_type", by_extension(schemas.MEDIA_EXTENSIONS, F.lower("ext"), "unknown"))


def with_mime_category(df: DataFrame) -> DataFrame:
    return df.withColumn("category", by_extension(schemas.CATEGORY_EXTENSIONS, F.lower("ext"), "File"))


def preview_kind(df: DataFrame) -> DataFrame:
    """image, gif, video or file."""
    return df.withColumn("preview", F.when(F.lower("ext") == "gif", "gif").when(F.col("media_type").isin("image", "video"), F.col("media_type")).otherwise("file"))


def indexable(df: DataFrame) -> DataFrame:
    return df.where(F.col("media_type").isin("image", "video", "audio"))


def with_motion_flags(df: DataFrame) -> DataFrame:
    has_audio = F.coalesce("has_audio", F.lit(0)) if "has_audio" in df.columns else F.lit(0)
    return df.withColumns({"has_motion": ((F.col("media_type") == "video") | F.coalesce(F.col("ext") == "gif", F.lit(False))).cast("int"), "has_audio": has_audio})


def derive_folders(files: DataFrame) -> DataFrame:
    """One row for each folder above a file, and the root ''."""
    paths = files.select(F.explode(F.concat(F.array(F.lit("")), scalars.path_prefixes(F.col("rel_path")))).alias("rel_path")).distinct()
    path = F.col("rel_path")
    return paths.select("rel_path", scalars.basename(path).alias("name"), F.when(path == "", 0).otherwise(F.size(F.split(path, "/"))).alias("depth"), F.when(path != "", scalars.dirname(path)).alias("parent_rel_path"))


def folder_rollups(folders: DataFrame, files: DataFrame) -> DataFrame:
    """Direct files and direct sub-folders of each folder."""
    n_files = files.groupBy(scalars.dirname(F.col("rel_path")).alias("rel_path")).agg(F.count("*").alias("file_count"))
    n_folders = folders.where("parent_rel_path is not null").groupBy(F.col("parent_rel_path").alias("rel_path")).agg(F.count("*").alias("folder_count"))
    return folders.join(n_files, "rel_path", "left").join(n_folders, "rel_path", "left").fillna(0, ["file_count", "folder_count"])


def derive_folder_tags(files: DataFrame, levels: int = 5) -> DataFrame:
    """A tag for each of the first folders above a file; none for files in the root."""
    return files.select("file_id", F.explode(F.slice(scalars.path_prefixes(F.col("rel_path")), 1, levels)).alias("p_")).select("file_id", F.concat(F.lit("folder:"), "p_").alias("slug"), F.concat(F.lit("@"), "p_").alias("display_name"), F.lit("folder").alias("kind"), F.lit("folder").alias("source"))


def derive_type_tags(files: DataFrame) -> DataFrame:
    return files.select("file_id", F.col("media_type").alias("slug"), F.concat(F.lit("@"), "media_type").alias("display_name"), F.lit("type").alias("kind"), F.lit("system").alias("source"))


def derive_ext_tags(files: DataFrame) -> DataFrame:
    return files.where("ext is not null").select("file_id", F.concat(F.lit("."), F.lower("ext")).alias("slug"), F.concat(F.lit("@."), "ext").alias("display_name"), F.lit("ext").alias("kind"), F.lit("system").alias("source"))


def build_tag_dimension(file_tags: DataFrame) -> DataFrame:
    """(slug, display_name, kind): the seeds, and the tags in use that are no seeds."""
    seeds = file_tags.sparkSession.createDataFrame([(s, f"@{s}", k, 0) for s, k in schemas.SEED_TAGS], "slug string, display_name string, kind string, p_ int")
    rows = file_tags.select("slug", "display_name", "kind", F.lit(1).alias("p_")).unionByName(seeds)
    pick = F.min_by(F.struct("display_name", "kind"), F.struct("p_", "display_name", "kind"))
    return rows.groupBy("slug").agg(pick.alias("t_")).select("slug", "t_.display_name", "t_.kind")


def unique_file_tags(file_tags: DataFrame) -> DataFrame:
    return file_tags.dropDuplicates(["file_id", "slug", "source"])


def tag_usage_counts(tags: DataFrame, file_tags: DataFrame) -> DataFrame:
    used = file_tags.groupBy("slug").agg(F.count("*").alias("usage_count"))
    return tags.join(used, "slug", "left").fillna(0, ["usage_count"])


def build_metadata_text(files: DataFrame, custom_tags: DataFrame | None = None, max_tags: int = 10_000) -> DataFrame:
    """What is embedded for a file: its stem, audio metadata, and the custom dictionary.

    The dictionary stands in the text of every file; it is read when the plan is built,
    and one of more than ``max_tags`` entries is refused.
    """
    audio = F.col("media_type") == "audio"
    has = set(files.columns)
    field = lambda n: F.when(audio & (F.coalesce(F.col(n).cast("string"), F.lit("")) != ""), F.concat(F.lit(f"{n}: "), F.col(n).cast("string")))
    parts = [F.concat(F.lit("file: "), "stem"), *(field(n) for n in ("artist", "album", "genre", "year", "track", "comment") if n in has)]
    parts.append(F.when(audio & F.col("duration_ms").isNotNull(), F.format_string("duration: %.1fs", F.col("duration_ms") / 1000.0)))
    if custom_tags is not None:
        one = F.concat(F.lit("@"), "slug", F.when(F.coalesce("description", F.lit("")) != "", F.concat(F.lit(": "), "description")).otherwise(F.lit("")))
        held = custom_tags.select("slug", one.alias("t")).limit(max_tags + 1).collect()
        if len(held) > max_tags:
            raise ValueError(f"more than {max_tags} custom tags")
        words = ", ".join(r.t for r in sorted(held, key=lambda r: ((r.slug or "").encode(), (r.t or "").encode())) if r.t is not None)
        if words:
            parts.append(F.lit(f"tags: {{{words}}}"))
    return files.withColumn("metadata_text", F.concat_ws(", ", *parts))


def plan_stages(files: DataFrame, tier: str = "lite", clip: bool = True, clap: bool = True, metadata: bool = True, ocr: bool = True, whisper: bool = True) -> DataFrame:
    """(file_id, stage): what is to be derived for each file under a tier and five switches."""
    tier = {"low": "lite", "high": "full"}.get(tier, tier)
    if tier not in ("lite", "mid", "full"):
        raise ValueError(f"unknown tier {tier!r}")
    kind, more = F.col("media_type"), tier in ("mid", "full")
    plan = {"clip": (clip, kind.isin("image", "video")), "clap": (clap and tier == "full", kind.isin("audio", "video")), "metadata": (metadata, kind.isin("image", "video", "audio")), "ocr": (ocr and more, kind.isin("image", "video")), "whisper": (whisper and more, kind.isin("audio", "video"))}
    stages = F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, (on, c) in plan.items() if on), F.lit(None).cast("string")))
    return files.select("file_id", F.explode(stages).alias("stage"))


def with_text_flags(files: DataFrame, file_text: DataFrame) -> DataFrame:
    text = file_text.select("file_id", "ocr_text", "transcript_text")
    flag = lambda c: F.when(F.length(c) > 0, 1).otherwise(0)
    return files.drop("has_text", "has_speech", "ocr_text", "transcript_text").join(text, "file_id", "left").withColumns({"has_text": flag("ocr_text"), "has_speech": flag("transcript_text")})


def index_summary(files: DataFrame) -> DataFrame:
    ok = F.count_if((F.col("status") == "indexed") & F.col("media_type").isin("image", "video", "audio"))
    failed = F.count_if((F.col("status") == "embed_failed") & F.col("media_type").isin("image", "video", "audio"))
    return files.agg(F.count("*").alias("total"), ok.alias("ok"), failed.alias("failed"), (F.count("*") - ok - failed).alias("skipped"))


def index_status(files: DataFrame) -> DataFrame:
    return files.select("rel_path", F.when(F.coalesce("status", F.lit("indexed")) == "embed_failed", "failed").otherwise("indexed").alias("index_status"))


def upsert_files(old: DataFrame, new: DataFrame) -> DataFrame:
    """Insert or replace by rel_path; of several rows of a path the new ones win, then the least file_id.

    The winners are found on path and id alone, so map-side sums and narrow rows move
    before whole rows do. For batches into a kept table see ``sources.buckets``.
    """
    both = old.withColumn("o_", F.lit(1)).unionByName(new.withColumn("o_", F.lit(0)), allowMissingColumns=True)
    best = both.groupBy("rel_path").agg(F.min(F.struct("o_", "file_id")).alias("b_"))
    same = both["rel_path"].eqNullSafe(best["rel_path"]) & F.struct(both["o_"], both["file_id"]).eqNullSafe(best["b_"])
    return both.join(best, same, "left_semi").dropDuplicates(["rel_path"]).drop("o_")


def upsert_file_text(old: DataFrame, new: DataFrame) -> DataFrame:
    """Column by column; null never replaces a text."""
    n = new.select("file_id", F.col("ocr_text").alias("n_ocr_"), F.col("transcript_text").alias("n_tr_"))
    return old.join(n, "file_id", "full_outer").select("file_id", F.coalesce("n_ocr_", "ocr_text").alias("ocr_text"), F.coalesce("n_tr_", "transcript_text").alias("transcript_text"))


def dedupe_keep_first(df: DataFrame, key: str = "rel_path", id_col: str = "file_id") -> DataFrame:
    first = df.groupBy(key).agg(F.min(id_col).alias(id_col))
    return df.join(first, [key, id_col], "left_semi")


#: Columns that name a row of their table, by check.
_UNIQUE = {"files.rel_path unique": ("files", "rel_path"), "files.file_id unique": ("files", "file_id"), "folders.rel_path unique": ("folders", "rel_path"), "tags.slug unique": ("tags", "slug"), "file_tags unique": ("file_tags", "file_id", "slug", "source")}
_ROW_RULES = {"files not null": ("files", "rel_path is null or media_type is null"), "folders.depth range": ("folders", "depth < 0 or depth > 5")}
_REFERENCES = {"folders.parent exists": ("folders", "parent_rel_path", "folders", "rel_path"), "file_tags.file exists": ("file_tags", "file_id", "files", "file_id"), "file_tags.tag exists": ("file_tags", "slug", "tags", "slug")}


def validate_catalog(tables: dict[str, DataFrame]) -> DataFrame:
    """(check, violations) for the declared constraints on files, folders, tags and file_tags.

    Each table is read once. A row gives a tagged key for every check that it takes part
    in: a unique key, either end of a reference (nulls are no orphans), or a broken rule
    on the row itself; one grouped pass over the keys of all tables settles all checks.
    Keys are summed before they are shuffled, so a value in very many rows is no burden.
    """
    text = lambda *cols: F.array(*(F.col(c).cast("string") for c in cols))
    mark = lambda check, key, there=None: F.struct(F.lit(check).alias("check"), key.alias("key"), F.lit(there).cast("boolean").alias("there"))

    def keys(t: str) -> DataFrame:
        marks = [mark(c, text(*cols)) for c, (of, *cols) in _UNIQUE.items() if of == t]
        marks += [F.when(F.expr(rule), mark(c, F.lit(None).cast("array<string>"))) for c, (of, rule) in _ROW_RULES.items() if of == t]
        for c, (child, own, parent, key) in _REFERENCES.items():
            marks += [F.when(F.col(own).isNotNull(), mark(c, text(own), False))] if child == t else []
            marks += [mark(c, text(key), True)] if parent == t else []
        return tables[t].select(F.inline(F.array_compact(F.array(*marks))))

    sums = reduce(DataFrame.unionByName, map(keys, ("files", "folders", "tags", "file_tags"))).groupBy("check", "key").agg(F.count("*").alias("n"), F.max("there").alias("there"))
    total = lambda c, n: F.coalesce(F.sum(F.when(F.col("check") == c, n)), F.lit(0)).alias(c)
    broken = [total(c, (F.col("n") > 1).cast("long")) for c in _UNIQUE] + [total(c, F.col("n")) for c in _ROW_RULES] + [total(c, F.when(~F.col("there"), F.col("n"))) for c in _REFERENCES]
    rows = F.array(*(F.struct(F.lit(c).alias("check"), F.col(f"`{c}`").alias("violations")) for c in (*_UNIQUE, *_ROW_RULES, *_REFERENCES)))
    return sums.agg(*broken).select(F.inline(rows))


EMBEDDINGS = ("clip_emb", "clap_emb", "metadata_emb", "ocr_emb", "transcript_emb", "search_emb")


def carry_over(old: DataFrame, new: DataFrame) -> DataFrame:
    """Bring vectors and status of unchanged files (same path and mtime) into the new snapshot."""
    cols = [c for c in (*EMBEDDINGS, "status") if c in old.columns]
    kept = old.select("rel_path", "mtime", *(F.col(c).alias(f"{c}_old") for c in cols))
    merged = {c: F.coalesce(c, f"{c}_old") if c in new.columns else F.col(f"{c}_old") for c in cols}
    return new.join(kept, ["rel_path", "mtime"], "left").withColumns(merged).drop(*(f"{c}_old" for c in cols))


def carry_over_tags(file_tags: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """User tags of paths that survive, under the new file ids."""
    paths = old.select("file_id", "rel_path").join(new.select("rel_path", F.col("file_id").alias("new_id_")), "rel_path")
    return file_tags.where("source = 'user'").join(paths, "file_id").select(F.col("new_id_").alias("file_id"), "slug", "source")
