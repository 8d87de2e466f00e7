"""Operators over ordered rows of a key, for keys of any length.

Rows are range-sorted by key and order and written once; a long key so lies in many
ranges. Within a range they are cut into segments of a key, and what a row needs of the
rows before it is put together from its segment and from a carry: an aggregate of the
key's earlier segments. Only carries, a row for each key and segment, meet in one task.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written

SEGMENT_BITS = 16


def _earlier():
    """A key's segments before this one."""
    return Window.partitionBy("key_").orderBy("seg_").rowsBetween(Window.unboundedPreceding, -1)


def segmented(df: DataFrame, key: str, order: list[str], **columns: Column) -> DataFrame:
    """(key_, seq_, seg_, i_, n_ and the columns), written: ``i_`` is the row's place in its key, ``n_`` the key's rows.

    ``seq_`` rises with the order of a key's rows, and by one within a segment.
    """
    rows = df.select(F.col(key).alias("key_"), *(F.col(c).alias(f"o{k}_") for k, c in enumerate(order)), *(c.alias(n) for n, c in columns.items()))
    by = ["key_", *(f"o{k}_" for k in range(len(order)))]
    ranges = rows.withColumn("tie_", F.xxhash64(F.monotonically_increasing_id())).repartitionByRange(*by, "tie_").sortWithinPartitions(*by)
    seq = F.monotonically_increasing_id()
    placed = written(ranges.select("key_", *columns, seq.alias("seq_")), "segments").withColumn("seg_", F.shiftright("seq_", SEGMENT_BITS))
    carry = placed.groupBy("key_", "seg_").agg(F.min("seq_").alias("first_"), F.count("*").alias("rows_"))
    carry = carry.withColumns({"before_": F.coalesce(F.sum("rows_").over(_earlier()), F.lit(0)), "n_": F.sum("rows_").over(Window.partitionBy("key_"))})
    return _with(placed, carry).withColumn("i_", F.col("before_") + F.col("seq_") - F.col("first_")).drop("before_", "first_", "rows_")


def _with(rows: DataFrame, carry: DataFrame) -> DataFrame:
    """Each row with its segment's carry; null keys have segments too."""
    here = rows["key_"].eqNullSafe(carry["key_"]) & (rows["seg_"] == carry["seg_"])
    return rows.join(carry, here).drop(carry["key_"], carry["seg_"])


def running(rows: DataFrame, value: Column, name: str, both: Callable[[Column, Column], Column], fold: Callable[[Column], Column], here: bool = True) -> DataFrame:
    """``rows`` with ``fold`` (an aggregate) of the value over the key's rows so far, with or without the row itself.

    ``both`` joins the carry's and the segment's value, either of which may be null.
    """
    rows = rows.withColumn("v_", value)
    window = Window.partitionBy("key_", "seg_").orderBy("seq_").rowsBetween(Window.unboundedPreceding, 0 if here else -1)
    carry = rows.groupBy("key_", "seg_").agg(fold(F.col("v_")).alias("own_")).withColumn("carry_", fold(F.col("own_")).over(_earlier())).drop("own_")
    rows = _with(rows.withColumn("own_", fold(F.col("v_")).over(window)), carry)
    return rows.withColumn(name, both(F.col("carry_"), F.col("own_"))).drop("v_", "own_", "carry_")


def latest(rows: DataFrame, value: Column, name: str, here: bool = True) -> DataFrame:
    """``rows`` with the greatest value so far; null before there is one."""
    return running(rows, value, name, F.greatest, F.max, here)


def previous(rows: DataFrame, value: Column, name: str) -> DataFrame:
    """``rows`` with the value of the row before, as a struct of its place and the value; null for a key's first row."""
    return latest(rows, F.struct(F.col("i_"), value.alias("value")), name, here=False)


def peak_envelope(df: DataFrame, key: str, order: list[str], value: str, segments: int = 20) -> DataFrame:
    """(key, segment, peak): loudest decibel of each of ``segments`` equal chunks as amplitude in [0.05, 1].

    A key without any value gets 0.5 throughout.
    """
    rows = segmented(df.where(F.col(value).isNotNull()), key, order, value_=F.col(value))
    chunk = F.greatest(F.lit(1), F.ceil(F.col("n_") / segments))
    loud = rows.groupBy("key_", F.floor(F.col("i_") / chunk).cast("int").alias("segment")).agg(F.greatest(F.max("value_"), F.lit(-100.0)).alias("db_"))
    grid = df.groupBy(F.col(key).alias("own_")).agg(F.count(value).alias("n_")).select("own_", "n_", F.explode(F.sequence(F.lit(0), F.lit(segments - 1))).alias("place_"))
    linear = F.when(F.col("db_") > -100, F.pow(F.lit(10.0), F.col("db_") / 20)).otherwise(F.lit(0.0))
    peak = F.when(F.col("n_") == 0, 0.5).when(F.col("db_").isNull(), 0.05).otherwise(F.greatest(F.lit(0.05), F.least(F.lit(1.0), linear)))
    both = grid.join(loud, F.col("own_").eqNullSafe(F.col("key_")) & (F.col("place_") == F.col("segment")), "left")
    return both.select(F.col("own_").alias(key), F.col("place_").alias("segment"), peak.alias("peak"))


def collapse_repeats(df: DataFrame, key: str, order: list[str], symbol: str, blank: str, max_streak: int = 30) -> DataFrame:
    """(key, decoded): blanks and repeats of the previous symbol go; stops after more than ``max_streak`` in a row, once something was kept.

    A null symbol goes like a blank; what follows it is no repeat.
    """
    rows = previous(segmented(df, key, order, s_=F.col(symbol)), F.col("s_"), "p_")
    drop = F.col("s_").isNull() | (F.col("s_") == blank) | F.col("s_").eqNullSafe(F.col("p_.value"))
    rows = latest(rows.withColumn("drop_", drop), F.when(~drop, F.col("i_")), "last_")
    rows = rows.withColumn("over_", F.col("i_") - F.col("last_") > max_streak)
    stop = rows.groupBy("key_").agg(F.min(F.when(F.col("over_"), F.col("i_"))).alias("stop_")).where("stop_ is not null").withColumnRenamed("key_", "own_")
    kept = rows.where(~F.col("drop_")).join(stop, F.col("key_").eqNullSafe(F.col("own_")), "left").where("stop_ is null or i_ < stop_")
    # a segment's text first, then the key's
    spelt = lambda at: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(at, "s_"))), lambda x: x["s_"]), "")
    texts = kept.groupBy("key_", "seg_").agg(spelt("i_").alias("s_")).groupBy("key_").agg(spelt("seg_").alias("s_"))
    keys = df.select(F.col(key).alias("own_")).distinct()
    return keys.join(texts, F.col("own_").eqNullSafe(F.col("key_")), "left").select(F.col("own_").alias(key), F.coalesce("s_", F.lit("")).alias("decoded"))


def threshold_runs(df: DataFrame, key: str, order: list[str], value: str, threshold: float, gap: int = 2, min_len: int = 5, pad: int = 5) -> DataFrame:
    """(key, start, end): runs above the threshold over gaps of at most ``gap``; short ones go, the rest is padded within the key."""
    rows = segmented(df, key, order, v0_=F.col(value)).where(F.col("v0_") > threshold)
    rows = latest(rows, F.col("i_"), "p_", here=False)
    rows = latest(rows, F.when(F.col("p_").isNull() | (F.col("i_") - F.col("p_") - 1 > gap), F.col("i_")), "run_")
    runs = rows.groupBy("key_", "run_").agg(F.max("i_").alias("z_"), F.max("n_").alias("n_")).where(F.col("z_") - F.col("run_") + 1 >= min_len)
    return runs.select(F.col("key_").alias(key), F.greatest(F.lit(0), F.col("run_") - pad).cast("long").alias("start"), F.least(F.col("n_"), F.col("z_") + 1 + pad).cast("long").alias("end"))


def fit_length(v: Column, n: int, pad, mode: str = "constant") -> Column:
    """Cut to n; pad with a constant, or with whole copies and then the constant."""
    if mode == "repeat":
        copies = F.flatten(F.array_repeat(v, F.greatest(F.lit(1), F.floor(n / F.greatest(F.size(v), F.lit(1))).cast("int"))))
        return F.slice(F.concat(copies, F.array_repeat(F.lit(pad), n)), 1, n)
    return F.slice(F.concat(v, F.array_repeat(F.lit(pad), n)), 1, n)


def log_scale_clamp(df: DataFrame, key: str, value: str, out: str = "scaled") -> DataFrame:
    """log10 with a floor, at most 8 below the key's maximum, then (x + 4) / 4.

    Maxima are found map-side and joined back; a long key's rows may be split by the join.
    """
    log = F.log10(F.greatest(F.col(value), F.lit(1e-10)))
    top = df.groupBy(F.col(key).alias("own_")).agg(F.max(log).alias("top_"))
    return df.join(top, F.col(key).eqNullSafe(F.col("own_"))).withColumn(out, (F.greatest(log, F.col("top_") - 8) + 4) / 4).drop("own_", "top_")
