"""Scalar helpers as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def format_size(n: Column) -> Column:
    """Bytes as B, KB, MB (one decimal) or GB (two); '0 B' for nothing."""
    kb, mb, gb = 1024.0, 1024.0**2, 1024.0**3
    return (
        F.when(n <= 0, "0 B").when(n < kb, F.concat(n.cast("string"), F.lit(" B"))).when(n < mb, F.format_string("%.1f KB", n / kb)).when(n < gb, F.format_string("%.1f MB", n / mb)).otherwise(F.format_string("%.2f GB", n / gb))
    )


def format_duration(ms: Column) -> Column:
    """m:ss, or h:mm:ss from an hour on."""
    s = F.floor(ms / 1000)
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    h, m = F.floor(s / 3600), F.floor(s / 60) % 60
    return F.when(h > 0, F.concat(h.cast("string"), F.lit(":"), two(m), F.lit(":"), two(s % 60))).otherwise(F.concat(m.cast("string"), F.lit(":"), two(s % 60)))


def format_date(ts: Column) -> Column:
    return F.date_format(ts, "MMM d, yyyy h:mm a")


def tag_slug(name: Column) -> Column:
    """Strip the first '@' in front, lower-case, trim."""
    return F.trim(F.lower(F.regexp_replace(name, "^@", "")))


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def dirname(path: Column) -> Column:
    return F.when(F.instr(path, "/") > 0, F.regexp_extract(path, "^(.*)/[^/]*$", 1)).otherwise(F.lit(""))


def join_path(*parts: Column) -> Column:
    return F.concat_ws("/", *(F.when(p != "", p) for p in parts))


def stem(name: Column) -> Column:
    """The name without its last extension; a leading dot starts no extension."""
    return F.regexp_replace(name, r"(?<=[^.])\.[^.]*$", "")


def extension(name: Column) -> Column:
    """Lower-case extension without the dot; null if there is none."""
    e = F.lower(F.regexp_extract(name, r"[^.]\.([^.]*)$", 1))
    return F.when(e != "", e)


def is_hidden(name: Column) -> Column:
    return name.startswith(".")


def try_int(c: Column) -> Column:
    return c.try_cast("bigint")


def try_double(c: Column) -> Column:
    return c.try_cast("double")


def parse_epoch_ms(c: Column) -> Column:
    """An ISO date or time, epoch seconds (below 1e12) or epoch milliseconds, as epoch milliseconds."""
    n = c.try_cast("bigint")
    return F.when(n.isNotNull(), F.when(F.abs(n) < 10**12, n * 1000).otherwise(n)).otherwise(F.unix_millis(F.try_to_timestamp(c)))


def epoch_ms(ts: Column) -> Column:
    return F.unix_millis(ts.cast("timestamp"))


def clamp(c: Column, lo, hi) -> Column:
    return F.greatest(F.least(c, F.lit(hi)), F.lit(lo))


def json_get(json: Column, path: str, default) -> Column:
    return F.coalesce(F.get_json_object(json, path), F.lit(default))


def map_text(entries: Column) -> Column:
    """'@key: value' for each entry by key, or '@key' where the value is empty."""
    ordered = F.array_sort(F.map_entries(entries))
    one = lambda e: F.concat(F.lit("@"), e["key"], F.when(F.coalesce(e["value"], F.lit("")) != "", F.concat(F.lit(": "), e["value"])).otherwise(F.lit("")))
    return F.array_join(F.transform(ordered, one), ", ")


def path_prefixes(path: Column) -> Column:
    """All folders above a path, shortest first, without the root."""
    parts = F.slice(F.split(path, "/"), 1, F.size(F.split(path, "/")) - 1)
    return F.when(F.instr(path, "/") == 0, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/")))
