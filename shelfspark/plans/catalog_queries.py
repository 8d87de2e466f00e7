"""Registered queries of sources, catalog derivation and tags."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..functions import scalars, vectors
from ..operators import catalog, tags
from ..sources import io, schemas, walk
from .fixtures import FILES, FILESV, TAGS, TEXTS, file_text, files, files_with_vectors, table, user_tags
from .registry import query

_list = lambda xs: ", ".join(f"'{x}'" for x in xs)
_media = "CASE " + " ".join(f"WHEN lower(ext) IN ({_list(v)}) THEN '{k}'" for k, v in schemas.MEDIA_EXTENSIONS.items()) + " ELSE 'unknown' END"
_category = "CASE " + " ".join(f"WHEN lower(ext) IN ({_list(v)}) THEN '{k}'" for k, v in schemas.CATEGORY_EXTENSIONS.items()) + " ELSE 'File' END"
_NAME = "regexp_extract(rel_path, '[^/]*$')"
_DIR = "CASE WHEN contains(rel_path, '/') THEN regexp_extract(rel_path, '^(.*)/[^/]*$', 1) ELSE '' END"
#: A deep hierarchy: file paths under the host and path of each page's URL.
_WEB = "web AS (SELECT page_id AS file_id, regexp_replace(regexp_replace(url, '^https?://', ''), '[?#].*$', '') || '/a/b/c/d/p' || CAST(page_id AS VARCHAR) || '.html' AS rel_path FROM pages)"
_PREFIX = "string_split(rel_path, '/')"
_PREFIXES = "(SELECT file_id, array_to_string(list_slice(parts, 1, i), '/') AS p, i FROM (SELECT file_id, string_split(rel_path, '/') AS parts, unnest(range(1, len(string_split(rel_path, '/')))) AS i FROM web))"


def web_files(spark, sf_dir):
    path = F.regexp_replace(F.regexp_replace("url", "^https?://", ""), "[?#].*$", "")
    return table(spark, sf_dir, "pages").select(F.col("page_id").alias("file_id"), F.concat(path, F.lit("/a/b/c/d/p"), F.col("page_id").cast("string"), F.lit(".html")).alias("rel_path"))


# --- sources and sinks


#: A tree of files, one for each supplier: folders down to eight levels, dot-files and dot-folders.
_TREE = (
    "parts AS (SELECT s_suppkey AS k, CASE s_suppkey % 5 WHEN 0 THEN 'png' WHEN 1 THEN 'gif' WHEN 2 THEN 'bmp' WHEN 3 THEN 'jpg' ELSE 'txt' END AS ext, list_transform(range(1, CAST(s_suppkey % 9 AS INT) + 1), lambda i: CASE WHEN (s_suppkey + i) % 4 = 0 THEN '.d' ELSE 'd' END || CAST((s_suppkey + i) % 3 AS VARCHAR)) AS dirs, s_name FROM supplier), "
    "tree AS (SELECT k, ext, len(dirs) AS depth, array_to_string(list_append(dirs, CASE WHEN k % 7 = 0 THEN '.' ELSE '' END || 'f' || CAST(k AS VARCHAR) || '.' || ext), '/') AS rel_path, s_name FROM parts)"
)


def tree(spark, sf_dir):
    """The tree's files: (k, rel_path, ext, body); images have the sizes 1 + k and 2 + k % 1000 and no pixels, one in eleven is broken."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("long").alias("k"), "s_name")
    ext = F.element_at(F.array(*map(F.lit, ("png", "gif", "bmp", "jpg", "txt"))), (F.col("k") % 5 + 1).cast("int"))
    name = lambda i: F.concat(F.when((F.col("k") + i) % 4 == 0, ".d").otherwise("d"), ((F.col("k") + i) % 3).cast("string"))
    dirs = F.transform(F.filter(F.sequence(F.lit(1), F.lit(8)), lambda i: i <= F.col("k") % 9), name)
    file = F.concat(F.when(F.col("k") % 7 == 0, ".").otherwise(""), F.lit("f"), F.col("k").cast("string"), F.lit("."), F.col("ext"))
    hexed = lambda c, n: F.lpad(F.hex(c), 2 * n, "0")
    turned = lambda c, n: F.concat(*(F.substring(hexed(c, n), 2 * i + 1, 2) for i in reversed(range(n))))
    w, h = F.col("k") + 1, F.col("k") % 1000 + 2
    images = {
        "png": F.concat(F.lit("89504e470d0a1a0a0000000d49484452"), hexed(w, 4), hexed(h, 4), F.lit("0802000000")), "gif": F.concat(F.lit("474946383961"), turned(w % 65536, 2), turned(h, 2), F.lit("000000")),
        "bmp": F.concat(F.lit("424d00000000000000003600000028000000"), turned(w, 4), turned(h, 4), F.lit("01001800")), "jpg": F.concat(F.lit("ffd8ffe000104a46494600010100000100010000ffc0001108"), hexed(h, 2), hexed(w % 65536, 2), F.lit("03011100")),
    }
    picture = reduce(lambda c, e: c.when(F.col("ext") == e[0], e[1]), images.items(), F.when(F.col("k") % 11 == 0, F.lit("00")))
    body = F.when(F.col("ext") == "txt", F.encode(F.repeat("s_name", 100), "UTF-8")).otherwise(F.unhex(picture))
    return s.withColumn("ext", ext).select("k", "ext", F.array_join(F.array_append(dirs, file), "/").alias("rel_path"), body.alias("body"))


def written_tree(spark, sf_dir):
    """Write the tree's files from the tasks; returns their folder."""
    root = io.shared_folder(spark, "tree")

    def write(batches):
        store, base = walk.store_of(root)
        for batch in batches:
            for rel, body in zip(batch.column("rel_path").to_pylist(), batch.column("body").to_pylist(), strict=True):
                store.create_dir(f"{base}/{rel}".rpartition("/")[0], recursive=True)
                with store.open_output_stream(f"{base}/{rel}") as out:
                    out.write(body)
            yield batch.select(["k"])

    tree(spark, sf_dir).mapInArrow(write, "k long").write.format("noop").mode("overwrite").save()
    return root


@query("s01_scan_corpus", f"WITH {_TREE} SELECT rel_path, true AS has_ctime FROM tree WHERE depth <= 5")
def _(spark, sf_dir):
    found = io.scan_corpus(spark, written_tree(spark, sf_dir))
    return found.select("rel_path", F.col("ctime").isNotNull().alias("has_ctime"))


@query("s06_image_dimensions", f"WITH {_TREE} SELECT rel_path, CASE WHEN k % 11 <> 0 THEN CAST(k + 1 AS INT) END AS width, CASE WHEN k % 11 <> 0 THEN CAST(k % 1000 + 2 AS INT) END AS height FROM tree WHERE depth <= 5 AND ext <> 'txt'")
def _(spark, sf_dir):
    root = written_tree(spark, sf_dir)
    return io.image_dimensions(spark, root).select(F.substring("origin", len(root) + 2, 1 << 20).alias("rel_path"), "width", "height")


@query("s11_read_text_files", f"WITH {_TREE} SELECT rel_path, substr(repeat(s_name, 100), 1, 1000) AS head FROM tree WHERE depth <= 5 AND ext = 'txt'")
def _(spark, sf_dir):
    root = written_tree(spark, sf_dir)
    found = io.read_text_files(spark, root).where(F.col("path").endswith(".txt"))
    return found.select(F.substring("path", len(root) + 2, 1 << 20).alias("rel_path"), F.col("text").alias("head"))


@query("s02_count_visible_files", f"{FILES}, h AS (SELECT CASE WHEN file_id % 7 = 0 THEN regexp_replace(rel_path, '([^/]+)$', '.\\1') ELSE rel_path END AS rel_path FROM files) SELECT count(*) AS n FROM h WHERE NOT starts_with({_NAME}, '.')")
def _(spark, sf_dir):
    hidden = F.when(F.col("file_id") % 7 == 0, F.regexp_replace("rel_path", "([^/]+)$", ".$1")).otherwise(F.col("rel_path"))
    return catalog.count_visible_files(catalog.with_path_parts(files(spark, sf_dir).withColumn("rel_path", hidden)))


@query("s03_unprocessed", f"{FILES} SELECT file_id, rel_path FROM files WHERE rel_path NOT IN (SELECT rel_path FROM files WHERE file_id % 4 <> 0 AND media_type IN ('image', 'video', 'audio') AND status <> 'embed_failed')")
def _(spark, sf_dir):
    f = files(spark, sf_dir)
    return catalog.unprocessed(f, f.where("file_id % 4 <> 0")).select("file_id", "rel_path")


@query(
    "s04_audio_probe",
    "SELECT p_partkey, p_name AS artist, p_brand AS album, CAST(NULL AS VARCHAR) AS genre, CAST(1990 + p_size AS INT) AS year, CAST(p_size AS VARCHAR) AS track, CAST(round(p_retailprice * 1000) AS BIGINT) AS duration_ms, CAST(round(CAST(p_size * 1000 AS DOUBLE) / 1000) AS BIGINT) AS bit_rate_kbps FROM part",
)
def _(spark, sf_dir):
    tag = F.struct(F.col("p_name").alias("artist"), F.col("p_brand").alias("album"), (1990 + F.col("p_size")).cast("string").alias("date"), F.col("p_size").cast("string").alias("track"))
    fmt = F.struct(F.col("p_retailprice").cast("string").alias("duration"), (F.col("p_size") * 1000).cast("string").alias("bit_rate"), tag.alias("tags"))
    probed = table(spark, sf_dir, "part").select("p_partkey", F.to_json(F.struct(fmt.alias("format"))).alias("j"))
    return catalog.parse_audio_probe(probed, "j").select("p_partkey", "artist", "album", "genre", "year", "track", "duration_ms", "bit_rate_kbps")


@query(
    "s05_video_probe",
    "SELECT p_partkey, CAST(p_size * 16 AS INT) AS width, CAST(p_size * 9 AS INT) AS height, CASE WHEN p_size % 7 > 0 THEN CAST(p_size * 1000 AS DOUBLE) / (p_size % 7) END AS fps, CAST(CASE WHEN p_size % 2 = 0 THEN 1 ELSE 0 END AS INT) AS has_audio FROM part",
)
def _(spark, sf_dir):
    j = F.format_string('{"streams":[{"codec_type":"video","width":1,"height":1,"r_frame_rate":"1/1"},{"codec_type":"%s"},{"codec_type":"video","width":%d,"height":%d,"r_frame_rate":"%d/%d"}]}', F.when(F.col("p_size") % 2 == 0, "audio").otherwise("data"), F.col("p_size") * 16, F.col("p_size") * 9, F.col("p_size") * 1000, F.col("p_size") % 7)
    return catalog.parse_video_probe(table(spark, sf_dir, "part").select("p_partkey", j.alias("j")), "j").select("p_partkey", "width", "height", "fps", "has_audio")


@query("s07_s08_snapshot_round_trip", f"{FILES} SELECT file_id, rel_path, media_type, size_bytes FROM files")
def _(spark, sf_dir):
    folder = io.shared_folder(spark, "snapshots")
    own = files(spark, sf_dir).select("file_id", "rel_path", "media_type", "size_bytes")
    io.publish_snapshot({"files": own}, folder)
    return io.load_catalog(spark, folder, {"files": own.schema})["files"]


@query("s09_vector_codec", "SELECT vec_id, CAST(len(embedding) AS BIGINT) AS n, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 4) AS total FROM embeddings")
def _(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", vectors.encode_vectors(F.col("embedding")).alias("b"))
    back = e.select("vec_id", vectors.decode_vectors(F.col("b"), 64).alias("v"))
    return back.select("vec_id", F.size("v").cast("long").alias("n"), F.round(vectors.vec_sum(F.transform("v", lambda x: x.cast("double"))), 4).alias("total"))


@query("s10_custom_tags", "SELECT key AS slug, CAST(json_extract_string(props, '$.' || key) AS VARCHAR) AS description FROM (SELECT event_id, props, unnest(json_keys(props)) AS key FROM events)")
def _(spark, sf_dir):
    return catalog.load_custom_tags(table(spark, sf_dir, "events"), "props")


@query("s11_text_head", "SELECT doc_id, substr(text, 1, 1000) AS head FROM documents")
def _(spark, sf_dir):
    return catalog.first_chars(table(spark, sf_dir, "documents"), "text").select("doc_id", "head")


# --- derivation


@query("c01_path_parts", f"{FILES} SELECT file_id, {_NAME} AS name, regexp_replace({_NAME}, '\\.[^.]*$', '') AS stem, lower(ext) AS ext, {_DIR} AS parent_rel_path, CAST(len({_PREFIX}) - 1 AS INT) AS depth FROM files")
def _(spark, sf_dir):
    return catalog.with_path_parts(files(spark, sf_dir).drop("ext")).select("file_id", "name", "stem", "ext", "parent_rel_path", "depth")


@query("c02_media_type", f"{FILES} SELECT file_id, {_media} AS media_type FROM files")
def _(spark, sf_dir):
    return catalog.with_media_type(files(spark, sf_dir).drop("media_type")).select("file_id", "media_type")


@query("c03_indexable", f"{FILES} SELECT file_id, media_type FROM files WHERE media_type NOT IN ('unknown', 'text')")
def _(spark, sf_dir):
    return catalog.indexable(files(spark, sf_dir)).select("file_id", "media_type")


@query("c04_motion_flags", f"{FILES} SELECT file_id, CAST(CASE WHEN media_type = 'video' OR ext = 'gif' THEN 1 ELSE 0 END AS INT) AS has_motion, CAST(CASE WHEN file_id % 4 = 0 THEN 1 ELSE 0 END AS INT) AS has_audio FROM files")
def _(spark, sf_dir):
    heard = F.when(F.col("file_id") % 4 == 0, 1)  # unknown for the others
    return catalog.with_motion_flags(files(spark, sf_dir).withColumn("has_audio", heard)).select("file_id", "has_motion", "has_audio")


_FOLDERS = f"folders AS (SELECT DISTINCT p AS rel_path FROM {_PREFIXES} UNION SELECT '' AS rel_path)"


@query("c05_folders", f"WITH {_WEB}, {_FOLDERS} SELECT rel_path, regexp_extract(rel_path, '[^/]*$') AS name, CAST(CASE WHEN rel_path = '' THEN 0 ELSE len({_PREFIX}) END AS INT) AS depth, CASE WHEN rel_path <> '' THEN {_DIR} END AS parent_rel_path FROM folders")
def _(spark, sf_dir):
    return catalog.derive_folders(web_files(spark, sf_dir))


@query(
    "c06_folder_rollups",
    f"WITH {_WEB}, {_FOLDERS} SELECT rel_path, (SELECT count(*) FROM web w WHERE regexp_extract(w.rel_path, '^(.*)/[^/]*$', 1) = f.rel_path) AS file_count, (SELECT count(*) FROM folders g WHERE g.rel_path <> '' AND CASE WHEN contains(g.rel_path, '/') THEN regexp_extract(g.rel_path, '^(.*)/[^/]*$', 1) ELSE '' END = f.rel_path) AS folder_count FROM folders f",
)
def _(spark, sf_dir):
    w = web_files(spark, sf_dir)
    return catalog.folder_rollups(catalog.derive_folders(w), w).select("rel_path", "file_count", "folder_count")


@query("c07_folder_tags", f"WITH {_WEB} SELECT file_id, 'folder:' || p AS slug, '@' || p AS display_name, 'folder' AS kind, 'folder' AS source FROM {_PREFIXES} WHERE i <= 5")
def _(spark, sf_dir):
    return catalog.derive_folder_tags(web_files(spark, sf_dir))


_SYSTEM_TAGS = "system_tags AS (SELECT file_id, media_type AS slug, '@' || media_type AS display_name, 'type' AS kind, 'system' AS source FROM files UNION ALL SELECT file_id, '.' || lower(ext), '@.' || ext, 'ext', 'system' FROM files WHERE ext IS NOT NULL)"
_SEEDS = "seeds AS (SELECT * FROM (VALUES " + ", ".join(f"('{s}', '@{s}', '{k}')" for s, k in schemas.SEED_TAGS) + ") AS v(slug, display_name, kind))"
_DIMENSION = f"dimension AS (SELECT * FROM seeds UNION ALL SELECT DISTINCT slug, display_name, kind FROM system_tags WHERE slug NOT IN (SELECT slug FROM seeds))"


def system_tags(f):
    return catalog.derive_type_tags(f).unionByName(catalog.derive_ext_tags(f))


@query("c08_type_tags", f"{FILES}, {_SYSTEM_TAGS} SELECT * FROM system_tags WHERE kind = 'type'")
def _(spark, sf_dir):
    return catalog.derive_type_tags(files(spark, sf_dir))


@query("c09_ext_tags", f"{FILES}, {_SYSTEM_TAGS} SELECT * FROM system_tags WHERE kind = 'ext'")
def _(spark, sf_dir):
    return catalog.derive_ext_tags(files(spark, sf_dir))


@query("c10_tag_dimension", f"{FILES}, {_SYSTEM_TAGS}, {_SEEDS}, {_DIMENSION} SELECT * FROM dimension")
def _(spark, sf_dir):
    return catalog.build_tag_dimension(system_tags(files(spark, sf_dir)))


@query("c11_unique_file_tags", f"{FILES}, {TAGS} SELECT DISTINCT file_id, slug, source FROM user_tags")
def _(spark, sf_dir):
    u = user_tags(spark, sf_dir)
    return catalog.unique_file_tags(u.unionByName(u.where("file_id % 3 = 0")))


@query("c12_tag_usage", f"{FILES}, {_SYSTEM_TAGS}, {_SEEDS}, {_DIMENSION} SELECT slug, kind, (SELECT count(*) FROM system_tags t WHERE t.slug = d.slug) AS usage_count FROM dimension d")
def _(spark, sf_dir):
    t = system_tags(files(spark, sf_dir))
    return catalog.tag_usage_counts(catalog.build_tag_dimension(t), t).select("slug", "kind", "usage_count")


@query(
    "c13_metadata_text",
    f"{FILES} SELECT file_id, 'file: doc_' || CAST(file_id AS VARCHAR) || CASE WHEN media_type = 'audio' THEN ', artist: ' || 'a' || CAST(file_id % 7 AS VARCHAR) || ', year: ' || CAST(1990 + file_id % 30 AS VARCHAR) || ', duration: ' || CAST(duration_ms // 1000 AS VARCHAR) || '.0s' ELSE '' END || ', tags: {{@cat: a small animal, @dog}}' AS metadata_text FROM files",
)
def _(spark, sf_dir):
    f = catalog.with_path_parts(files(spark, sf_dir)).withColumns({"artist": F.concat(F.lit("a"), (F.col("file_id") % 7).cast("string")), "year": (1990 + F.col("file_id") % 30).cast("int"), "album": F.lit("")})
    custom = spark.createDataFrame([("dog", ""), ("cat", "a small animal")], "slug string, description string")
    return catalog.build_metadata_text(f, custom).select("file_id", "metadata_text")


@query(
    "c14_plan_stages",
    f"{FILES} SELECT file_id, 'clip' AS stage FROM files WHERE media_type IN ('image', 'video') UNION ALL SELECT file_id, 'clap' FROM files WHERE media_type IN ('audio', 'video') UNION ALL SELECT file_id, 'metadata' FROM files WHERE media_type IN ('image', 'video', 'audio') UNION ALL SELECT file_id, 'ocr' FROM files WHERE media_type IN ('image', 'video')",
)
def _(spark, sf_dir):
    return catalog.plan_stages(files(spark, sf_dir), "high", whisper=False)


@query("c15_text_flags", f"{FILES}, {TEXTS} SELECT file_id, CAST(CASE WHEN length(ocr_text) > 0 THEN 1 ELSE 0 END AS INT) AS has_text, CAST(CASE WHEN length(transcript_text) > 0 THEN 1 ELSE 0 END AS INT) AS has_speech FROM file_text")
def _(spark, sf_dir):
    return catalog.with_text_flags(files(spark, sf_dir), file_text(spark, sf_dir)).select("file_id", "has_text", "has_speech")


_OK = "media_type IN ('image', 'video', 'audio')"


@query("c16_index_summary", f"{FILES} SELECT count(*) AS total, count(*) FILTER (WHERE status = 'indexed' AND {_OK}) AS ok, count(*) FILTER (WHERE status = 'embed_failed' AND {_OK}) AS failed, count(*) FILTER (WHERE NOT ({_OK})) AS skipped FROM files")
def _(spark, sf_dir):
    return catalog.index_summary(files(spark, sf_dir))


@query("c17_index_status", f"{FILES} SELECT rel_path, CASE WHEN status = 'embed_failed' THEN 'failed' ELSE 'indexed' END AS index_status FROM files")
def _(spark, sf_dir):
    return catalog.index_status(files(spark, sf_dir).withColumn("status", F.expr("nullif(status, 'indexed')")))


@query("c18_upsert_files", f"{FILES} SELECT file_id, rel_path, CASE WHEN file_id % 4 = 0 THEN size_bytes ELSE size_bytes + 1 END AS size_bytes FROM files")
def _(spark, sf_dir):
    f = files(spark, sf_dir).select("file_id", "rel_path", "size_bytes")
    return catalog.upsert_files(f, f.where("file_id % 4 <> 0").withColumn("size_bytes", F.col("size_bytes") + 1))


@query("c19_upsert_file_text", f"{FILES}, {TEXTS} SELECT file_id, CASE WHEN file_id % 5 = 0 THEN 'new' ELSE ocr_text END AS ocr_text, transcript_text FROM file_text")
def _(spark, sf_dir):
    t = file_text(spark, sf_dir)
    return catalog.upsert_file_text(t, t.where("file_id % 5 = 0").select("file_id", F.lit("new").alias("ocr_text"), F.lit(None).cast("string").alias("transcript_text")))


def doubled(f):
    return f.unionByName(f.where("file_id % 5 = 0").withColumn("file_id", F.col("file_id") + 1_000_000))


@query("c20_dedupe_keep_first", f"{FILES} SELECT rel_path, min(file_id) AS file_id FROM files GROUP BY rel_path")
def _(spark, sf_dir):
    return catalog.dedupe_keep_first(doubled(files(spark, sf_dir).select("rel_path", "file_id")))


@query(
    "c21_validate_catalog",
    f"{FILES}, {TAGS} SELECT c.name AS \"check\", CASE c.name WHEN 'files.rel_path unique' THEN (SELECT count(*) FROM files WHERE file_id % 5 = 0) WHEN 'file_tags.tag exists' THEN (SELECT count(*) FROM user_tags WHERE slug = 'toxic') ELSE 0 END AS violations FROM (VALUES ('files.rel_path unique'), ('files.file_id unique'), ('files not null'), ('folders.rel_path unique'), ('folders.depth range'), ('folders.parent exists'), ('tags.slug unique'), ('file_tags unique'), ('file_tags.file exists'), ('file_tags.tag exists')) AS c(name)",
)
def _(spark, sf_dir):
    f = doubled(files(spark, sf_dir).select("file_id", "rel_path", "media_type"))
    known = spark.createDataFrame([("good",)], "slug string")
    return catalog.validate_catalog({"files": f, "folders": catalog.derive_folders(f), "tags": known, "file_tags": user_tags(spark, sf_dir)})


@query("c22_mime_category", f"{FILES} SELECT file_id, {_category} AS category, CASE WHEN lower(ext) = 'gif' THEN 'gif' WHEN media_type IN ('image', 'video') THEN media_type ELSE 'file' END AS preview FROM files")
def _(spark, sf_dir):
    return catalog.preview_kind(catalog.with_mime_category(files(spark, sf_dir))).select("file_id", "category", "preview")


# --- joins and tags

_JTAGS = "jtags AS (SELECT * FROM (VALUES ('good', '@good', 'custom'), ('toxic', '@toxic', 'custom'), ('image', '@image', 'type')) AS v(slug, display_name, kind))"


def known_tags(spark):
    return spark.createDataFrame([("good", "@good", "custom"), ("toxic", "@toxic", "custom"), ("image", "@image", "type")], "slug string, display_name string, kind string")


@query("j01_user_tags", f"{FILES}, {TAGS}, {_JTAGS} SELECT f.rel_path, t.slug, t.display_name, t.kind FROM user_tags u JOIN files f USING (file_id) JOIN jtags t USING (slug)")
def _(spark, sf_dir):
    return tags.user_tags_of(files(spark, sf_dir), user_tags(spark, sf_dir), known_tags(spark))


@query("j02_raw_text", f"{FILES}, {TEXTS} SELECT f.file_id, t.ocr_text FROM files f LEFT JOIN file_text t ON t.file_id = f.file_id AND t.file_id % 2 = 0")
def _(spark, sf_dir):
    return tags.with_raw_text(files(spark, sf_dir), file_text(spark, sf_dir).where("file_id % 2 = 0")).select("file_id", "ocr_text")


@query("j03_embedding_info", f"{FILESV}, {TEXTS} SELECT f.rel_path, CAST(COALESCE(len(clip_emb), 0) AS BIGINT) AS clip_emb_floats, CAST(COALESCE(len(clap_emb), 0) AS BIGINT) AS clap_emb_floats, CASE WHEN length(t.ocr_text) > 0 THEN t.ocr_text ELSE 'none' END AS ocr_text, CASE WHEN length(t.transcript_text) > 0 THEN t.transcript_text ELSE 'none' END AS transcript_text FROM filesv f LEFT JOIN file_text t USING (file_id) WHERE f.file_id = 33")
def _(spark, sf_dir):
    path = files(spark, sf_dir).where("file_id = 33").select("rel_path").first()[0]
    return tags.embedding_info(files_with_vectors(spark, sf_dir, "clip_emb", "clap_emb"), file_text(spark, sf_dir), path)


@query("j05_all_tag_names", f"WITH {_JTAGS} SELECT DISTINCT name FROM (SELECT slug AS name FROM jtags WHERE kind = 'custom' UNION ALL SELECT lang FROM documents)")
def _(spark, sf_dir):
    return tags.all_tag_names(table(spark, sf_dir, "documents").select(F.col("lang").alias("slug")), known_tags(spark))


@query("j06_files_with_any", f"WITH {TAGS} SELECT DISTINCT file_id FROM user_tags WHERE slug IN ('good', 'toxic')")
def _(spark, sf_dir):
    return tags.files_with_tags(user_tags(spark, sf_dir), ["good", "toxic"], "any")


@query("j06_files_with_all", f"WITH {TAGS} SELECT file_id FROM user_tags WHERE slug IN ('good', 'toxic') GROUP BY file_id HAVING count(DISTINCT slug) = 2")
def _(spark, sf_dir):
    return tags.files_with_tags(user_tags(spark, sf_dir), ["good", "toxic"], "all")


@query("j07_add_tags", f"WITH {TAGS} SELECT file_id, slug, source FROM user_tags UNION SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'good' ELSE 'new ' || lang END, 'user' FROM documents WHERE doc_id % 3 = 0")
def _(spark, sf_dir):
    name = F.when(F.col("doc_id") % 2 == 0, "@Good ").otherwise(F.concat(F.lit("@NEW "), F.upper("lang")))
    new = table(spark, sf_dir, "documents").where("doc_id % 3 = 0").select(F.col("doc_id").alias("file_id"), name.alias("name"))
    new = new.unionByName(new.withColumn("file_id", F.col("file_id") + 10**9))
    return tags.add_tags(user_tags(spark, sf_dir), known_tags(spark), new, files(spark, sf_dir))[0]


@query("j07_tags_created", f"WITH {_JTAGS} SELECT * FROM jtags UNION SELECT 'new ' || lang, '@new ' || lang, 'custom' FROM documents")
def _(spark, sf_dir):
    new = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file_id"), F.concat(F.lit("@NEW "), F.upper("lang")).alias("name"))
    return tags.add_tags(user_tags(spark, sf_dir), known_tags(spark), new, files(spark, sf_dir))[1]


@query("j08_remove_tags", f"WITH {TAGS} SELECT file_id, slug, source FROM user_tags WHERE NOT (slug = 'good' AND file_id % 2 = 0)")
def _(spark, sf_dir):
    gone = table(spark, sf_dir, "documents").where("doc_id % 2 = 0").select(F.col("doc_id").alias("file_id"), F.lit("@GOOD").alias("name"))
    return tags.remove_tags(user_tags(spark, sf_dir), gone)


@query("j09_status_overlay", f"{FILES} SELECT rel_path, CASE WHEN file_id % 4 = 0 THEN 'none' WHEN status = 'embed_failed' THEN 'failed' ELSE 'indexed' END AS index_status, CASE WHEN file_id % 3 = 0 THEN CAST(file_id AS DOUBLE) END AS score FROM files")
def _(spark, sf_dir):
    f = files(spark, sf_dir)
    return tags.status_overlay(f.select("rel_path"), catalog.index_status(f.where("file_id % 4 <> 0")), f.where("file_id % 3 = 0").select("rel_path", F.col("file_id").cast("double").alias("score")))


@query("j10_dedupe_paths", f"{FILES} SELECT rel_path, min(file_id) AS file_id FROM files GROUP BY rel_path")
def _(spark, sf_dir):
    return catalog.dedupe_keep_first(doubled(files(spark, sf_dir).select("rel_path", "file_id")), "rel_path", "file_id").dropDuplicates(["rel_path"])


@query("j11_carry_over", f"{FILESV} SELECT file_id, CASE WHEN file_id % 4 <> 0 AND file_id % 6 <> 0 THEN status ELSE 'new' END AS status, CAST(CASE WHEN file_id % 4 <> 0 AND file_id % 6 <> 0 THEN COALESCE(len(clip_emb), 0) ELSE 0 END AS BIGINT) AS n FROM filesv")
def _(spark, sf_dir):
    old = files_with_vectors(spark, sf_dir, "clip_emb").where("file_id % 4 <> 0").select("rel_path", "mtime", "status", "clip_emb")
    new = files(spark, sf_dir).select("file_id", "rel_path", F.when(F.col("file_id") % 6 == 0, F.col("mtime") + 1).otherwise(F.col("mtime")).alias("mtime"))
    out = catalog.carry_over(old, new)
    return out.select("file_id", F.coalesce("status", F.lit("new")).alias("status"), F.coalesce(F.size("clip_emb"), F.lit(0)).cast("long").alias("n"))


@query("j11_carry_over_tags", f"WITH {TAGS} SELECT file_id + 5000000 AS file_id, slug, source FROM user_tags WHERE file_id % 4 <> 0 AND file_id IN (SELECT doc_id FROM documents)")
def _(spark, sf_dir):
    f = files(spark, sf_dir)
    return catalog.carry_over_tags(user_tags(spark, sf_dir), f.where("file_id % 4 <> 0"), f.withColumn("file_id", F.col("file_id") + 5_000_000))


@query("j12_edit_custom_tags", "SELECT lang AS slug, CASE WHEN lang = 'de' THEN 'changed' ELSE 'old' END AS description FROM (SELECT DISTINCT lang FROM documents WHERE lang <> 'fr') UNION ALL SELECT 'Mixed', 'new'")
def _(spark, sf_dir):
    custom = table(spark, sf_dir, "documents").select(F.col("lang").alias("slug")).distinct().withColumn("description", F.lit("old"))
    edits = spark.createDataFrame([("@de", " changed"), (" @Mixed ", "new"), ("@", "nothing")], "slug string, description string")
    return tags.edit_custom_tags(custom, edits, spark.createDataFrame([("fr",)], "slug string"))


@query("l01_list_folder", f"{FILES} SELECT rel_path, false AS is_dir FROM files WHERE NOT contains(rel_path, '/') UNION ALL SELECT DISTINCT source, true FROM documents WHERE doc_id % 11 <> 0")
def _(spark, sf_dir):
    f = files(spark, sf_dir)
    both = f.select("rel_path", F.lit(False).alias("is_dir")).unionByName(catalog.derive_folders(f).select("rel_path", F.lit(True).alias("is_dir")))
    return tags.list_folder(both, "")


# --- scalar functions


@query("f01_format_size", "SELECT l_orderkey, l_linenumber, n, CASE WHEN n <= 0 THEN '0 B' WHEN n < 1024 THEN CAST(n AS VARCHAR) || ' B' WHEN n < 1048576 THEN printf('%.1f KB', floor(n * 10 / 1024.0 + 0.5) / 10) WHEN n < 1073741824 THEN printf('%.1f MB', floor(n * 10 / 1048576.0 + 0.5) / 10) ELSE printf('%.2f GB', floor(n * 100 / 1073741824.0 + 0.5) / 100) END AS size_text FROM (SELECT l_orderkey, l_linenumber, CAST(l_orderkey * (l_linenumber - 1) * 977 + l_partkey * 3 AS BIGINT) AS n FROM lineitem)")
def _(spark, sf_dir):
    n = (F.col("l_orderkey") * (F.col("l_linenumber") - 1) * 977 + F.col("l_partkey") * 3).cast("long")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", n.alias("n")).withColumn("size_text", scalars.format_size(F.col("n")))


@query("f03_format_duration", "SELECT event_id, CASE WHEN s >= 3600 THEN CAST(s // 3600 AS VARCHAR) || ':' || lpad(CAST(s // 60 % 60 AS VARCHAR), 2, '0') ELSE CAST(s // 60 AS VARCHAR) END || ':' || lpad(CAST(s % 60 AS VARCHAR), 2, '0') AS duration_text FROM (SELECT event_id, event_id * 1357 // 1000 AS s FROM events)")
def _(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", scalars.format_duration(F.col("event_id") * 1357).alias("duration_text"))


@query("f04_format_date", "SELECT event_id, strftime(ts, '%b %-d, %Y %-I:%M %p') AS date_text FROM events")
def _(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", scalars.format_date(F.col("ts")).alias("date_text"))


@query("f05_tag_slug", "SELECT doc_id, trim(lower(regexp_replace(source || ' ', '^@', ''))) || '|' || '@' || lang AS slug FROM documents")
def _(spark, sf_dir):
    plain, double = scalars.tag_slug(F.concat(F.lit("@"), F.upper("source"), F.lit(" "))), scalars.tag_slug(F.concat(F.lit("@@"), F.upper("lang")))
    return table(spark, sf_dir, "documents").select("doc_id", F.concat(plain, F.lit("|"), double).alias("slug"))


@query("f06_paths", f"{FILES} SELECT file_id, {_NAME} AS base, {_DIR} AS dir, CASE WHEN {_DIR} = '' THEN {_NAME} ELSE {_DIR} || '/' || {_NAME} END AS joined FROM files")
def _(spark, sf_dir):
    base, folder = scalars.basename(F.col("rel_path")), scalars.dirname(F.col("rel_path"))
    return files(spark, sf_dir).select("file_id", base.alias("base"), folder.alias("dir"), scalars.join_path(folder, base).alias("joined"))


@query("f07_try_parse", "SELECT p_partkey, TRY_CAST(CASE WHEN p_size % 2 = 0 THEN CAST(p_size AS VARCHAR) ELSE p_name END AS BIGINT) AS i, TRY_CAST(CASE WHEN p_size % 3 = 0 THEN p_name ELSE CAST(p_retailprice AS VARCHAR) END AS DOUBLE) AS d FROM part")
def _(spark, sf_dir):
    i = F.when(F.col("p_size") % 2 == 0, F.col("p_size").cast("string")).otherwise(F.col("p_name"))
    d = F.when(F.col("p_size") % 3 == 0, F.col("p_name")).otherwise(F.col("p_retailprice").cast("string"))
    return table(spark, sf_dir, "part").select("p_partkey", scalars.try_int(i).alias("i"), scalars.try_double(d).alias("d"))


@query("f08_parse_date", "SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN epoch_ms(date_trunc('day', o_orderdate)) WHEN 1 THEN o_orderkey * 1000 ELSE 1700000000000 + o_orderkey END AS ms FROM orders")
def _(spark, sf_dir):
    k = F.col("o_orderkey")
    text = F.when(k % 3 == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).when(k % 3 == 1, k.cast("string")).otherwise((k + 1700000000000).cast("string"))
    return table(spark, sf_dir, "orders").select("o_orderkey", scalars.parse_epoch_ms(text).alias("ms"))


@query("f09_epoch_ms", "SELECT event_id, epoch_us(ts) // 1000 AS ms FROM events")
def _(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", scalars.epoch_ms(F.col("ts")).alias("ms"))


@query("f10_arithmetic", "SELECT event_id, CAST(round(value) AS BIGINT) AS r, CAST(ceil(value) AS BIGINT) AS c, CAST(floor(value) AS BIGINT) AS f, greatest(least(value, 50.0), 5.0) AS k, round(log10(abs(value) + 1), 6) AS l, round(sqrt(abs(value)), 6) AS s, round(pow(abs(value), 1.5), 4) AS p FROM events")
def _(spark, sf_dir):
    v = F.col("value")
    return table(spark, sf_dir, "events").select("event_id", F.round(v).cast("long").alias("r"), F.ceil(v).cast("long").alias("c"), F.floor(v).cast("long").alias("f"), scalars.clamp(v, 5.0, 50.0).alias("k"), F.round(F.log10(F.abs(v) + 1), 6).alias("l"), F.round(F.sqrt(F.abs(v)), 6).alias("s"), F.round(F.pow(F.abs(v), F.lit(1.5)), 4).alias("p"))


@query("f11_json_get", "SELECT event_id, COALESCE(json_extract_string(props, '$.k'), '-') AS k, COALESCE(json_extract_string(props, '$.zz'), '-') AS zz FROM events")
def _(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", scalars.json_get(F.col("props"), "$.k", "-").alias("k"), scalars.json_get(F.col("props"), "$.zz", "-").alias("zz"))


@query("f12_map_text", "SELECT doc_id, '@' || CASE WHEN lang < 'k' THEN lang || ': ' || source || ', @k' ELSE 'k, @' || lang || ': ' || source END AS t FROM documents")
def _(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", scalars.map_text(F.create_map(F.lit("k"), F.lit(""), "lang", "source")).alias("t"))


@query("f13_path_prefixes", f"WITH {_WEB} SELECT file_id, string_agg(p, '|' ORDER BY i) AS prefixes FROM {_PREFIXES} GROUP BY file_id")
def _(spark, sf_dir):
    return web_files(spark, sf_dir).select("file_id", F.array_join(scalars.path_prefixes(F.col("rel_path")), "|").alias("prefixes"))


@query("f14_hidden", "SELECT doc_id, doc_id % 4 = 0 AS hidden FROM documents")
def _(spark, sf_dir):
    name = F.concat(F.when(F.col("doc_id") % 4 == 0, ".").otherwise("x."), F.col("lang"))
    return table(spark, sf_dir, "documents").select("doc_id", scalars.is_hidden(name).alias("hidden"))
