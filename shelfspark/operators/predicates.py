"""Tag predicates as Column builders; combine them with ``&``, ``|`` and ``~``."""

from __future__ import annotations

import re
from datetime import date, datetime, time, timedelta
from zoneinfo import ZoneInfo

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MEDIA = ("image", "video", "audio")
# Names of the types.
TYPE_NAMES = {"image": "image", "picture": "image", "photo": "image", "video": "video", "audio": "audio", "sound": "audio", "text": "text"}
FIELDS = {"size": "size_bytes", "length": "duration_ms", "duration": "duration_ms", "width": "width", "height": "height", "fps": "fps"}
COMPARE = {">": Column.__gt__, "<": Column.__lt__, ">=": Column.__ge__, "<=": Column.__le__, "=": Column.__eq__, "==": Column.__eq__}


def is_type(name: str) -> Column:
    return is_gif() if name == "gif" else F.col("media_type") == TYPE_NAMES[name.lower()]


def is_gif() -> Column:
    return F.col("ext") == "gif"


def has_ext(ext: str) -> Column:
    # fixed value: the pattern of an extension
    if not re.fullmatch(r"[A-Za-z0-9]{2,4}", ext):
        raise ValueError(f"not an extension: {ext!r}")
    return F.col("ext") == ext.lower()


def in_folder(path: str) -> Column:
    """Below the folder, ignoring case; ``_`` stands for any character."""
    # fixed value: the pattern of a folder path
    if not re.fullmatch(r"[A-Za-z0-9_\- ]+(/[A-Za-z0-9_\- ]+){0,4}", path):
        raise ValueError(f"not a folder path: {path!r}")
    return F.col("rel_path").ilike(path + "/%")


def cmp(field: str, op: str, value) -> Column:
    try:
        return COMPARE[op](F.col(FIELDS[field]), float(value))
    except (TypeError, ValueError):
        raise ValueError(f"not a number: {value!r}") from None


def session_zone() -> ZoneInfo:
    """Time zone of the active session; UTC without one."""
    spark = SparkSession.getActiveSession()
    return ZoneInfo(spark.conf.get("spark.sql.session.timeZone") if spark else "UTC")


def date_ms(value: str | int, now: datetime | None = None) -> int:
    """today, yesterday, epoch seconds or milliseconds, or an ISO date, as epoch milliseconds; days begin at midnight of the session's time zone."""
    zone = session_zone()
    day: date = (now or datetime.now(zone)).astimezone(zone).date()
    if value in ("today", "yesterday"):
        return int(datetime.combine(day - timedelta(days=value == "yesterday"), time(), zone).timestamp() * 1000)
    if re.fullmatch(r"-?\d+", str(value)):
        n = int(value)
        return n * 1000 if abs(n) < 10**12 else n
    at = datetime.fromisoformat(str(value))
    return int((at if at.tzinfo else at.replace(tzinfo=zone)).timestamp() * 1000)


def date_cmp(op: str, value, now: datetime | None = None) -> Column:
    return COMPARE[op](F.col("mtime"), date_ms(value, now))


def has(modality: str) -> Column:
    if modality not in ("audio", "speech", "text", "motion"):
        raise ValueError(f"unknown modality {modality!r}")
    return F.col(f"has_{modality}") == 1


def base_media() -> Column:
    return F.col("media_type").isin(*MEDIA)


def filter_files(files: DataFrame, pred: Column) -> DataFrame:
    """Paths of the media files that match."""
    return files.where(pred & base_media()).select("rel_path").distinct()


def score_between(scored: DataFrame, lo: float | None = None, hi: float | None = None) -> DataFrame:
    """Both bounds are inclusive."""
    out = scored if lo is None else scored.where(F.col("score") >= lo)
    return out if hi is None else out.where(F.col("score") <= hi)


def visible(df: DataFrame, path: str = "rel_path") -> DataFrame:
    return df.where(~F.substring_index(path, "/", -1).startswith("."))
