"""Table schemas of the catalog, and the extension tables."""

from __future__ import annotations

from pyspark.sql.types import ArrayType, DoubleType, FloatType, IntegerType, LongType, StringType, StructField, StructType

_S, _I, _L, _D, _V = StringType(), IntegerType(), LongType(), DoubleType(), ArrayType(FloatType())


def _table(**fields) -> StructType:
    """Fields by name; a pair (type, False) is not null."""
    return StructType([StructField(k, *(v if isinstance(v, tuple) else (v, True))) for k, v in fields.items()])


ROOTS = _table(id=_I, root_path=(_S, False), root_name=(_S, False), created_at=(_L, False), indexed_at=_L, model_tier=_S, model_name=_S, text_model=_S, app_version=_S, schema_version=_I)
FOLDERS = _table(id=_L, rel_path=_S, name=_S, depth=_I, parent_id=_L, file_count=_I, folder_count=_I, mtime=_L, indexed_at=_L)
FILES = _table(
    id=_L, folder_id=_L, rel_path=_S, name=_S, stem=_S, ext=_S, media_type=_S, size_bytes=_L, mtime=_L, ctime=_L, sha256=_S, width=_I, height=_I, duration_ms=_L, fps=_D,
    has_audio=_I, has_text=_I, has_speech=_I, has_motion=_I, artist=_S, album=_S, genre=_S, year=_I, comment=_S, track=_S, indexed_at=_L, status=_S,
    clip_emb=_V, clap_emb=_V, metadata_emb=_V, ocr_emb=_V, transcript_emb=_V, search_emb=_V, metadata_text=_S,
)
TAGS = _table(id=_L, slug=_S, display_name=_S, kind=_S, color=_S, description=_S, created_at=_L, usage_count=_I)
FILE_TAGS = _table(file_id=_L, tag_id=_L, source=_S, confidence=_D)
FILE_TEXT = _table(file_id=_L, ocr_text=_S, transcription=_S, transcript_text=_S, ai_description=_S, filename_hint=_S, combined_text=_S)
FILE_SEGMENTS = _table(id=_L, file_id=_L, segment_index=_I, start_ms=_L, end_ms=_L, transcript_text=_S, ocr_text=_S, ai_description=_S)
CATALOG = {"roots": ROOTS, "folders": FOLDERS, "files": FILES, "tags": TAGS, "file_tags": FILE_TAGS, "file_text": FILE_TEXT, "file_segments": FILE_SEGMENTS}

AUDIO_PROBE = "format struct<duration:string,bit_rate:string,tags:struct<artist:string,album:string,genre:string,date:string,comment:string,track:string>>"
VIDEO_PROBE = "streams array<struct<codec_type:string,width:int,height:int,r_frame_rate:string>>"

# Extensions by media type.
MEDIA_EXTENSIONS = {
    "image": ["jpg", "jpeg", "png", "gif", "webp", "avif", "heic", "heif", "bmp", "tiff", "tif", "ico", "apng"],
    "video": ["mp4", "webm", "mkv", "avi", "mov", "flv", "wmv", "ogv", "3gp", "3g2", "m4v", "ts", "mts", "m2ts", "vob"],
    "audio": ["mp3", "ogg", "wav", "flac", "aac", "m4a", "opus", "wma", "aiff", "aif", "alac"],
    "text": ["txt", "srt", "sub", "vtt", "ass", "ssa", "md"],
}
# Extensions by display category.
CATEGORY_EXTENSIONS = {
    "Image": ["jpg", "jpeg", "png", "webp", "bmp", "gif", "heic", "heif", "tiff", "tif", "svg", "ico", "avif"],
    "Video": ["mp4", "m4v", "mov", "webm", "mkv", "avi", "wmv", "flv", "mpeg", "mpg", "3gp", "ogv"],
    "Audio": ["mp3", "ogg", "wav", "flac", "aac", "m4a", "opus", "wma", "mid", "midi", "amr"],
    "Document": ["pdf", "doc", "docx", "xls", "xlsx", "ppt", "pptx", "odt", "ods", "odp", "txt", "rtf", "csv"],
    "Archive": ["zip", "tar", "gz", "bz2", "xz", "7z", "rar", "tgz", "deb", "rpm"],
    "Code": ["dart", "js", "ts", "jsx", "tsx", "py", "rs", "go", "java", "c", "cpp", "h", "hpp", "cs", "rb", "php", "swift", "kt", "sh", "bash", "zsh", "yaml", "yml", "toml", "json", "xml", "html", "css", "scss", "sql", "md", "markdown"],
}
# Tags that every catalog starts with (slug, kind).
SEED_TAGS = [("image", "type"), ("picture", "type"), ("photo", "type"), ("video", "type"), ("audio", "type"), ("sound", "type"), ("has:audio", "modality"), ("has:speech", "modality"), ("has:text", "modality"), ("has:motion", "modality")]
