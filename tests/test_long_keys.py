"""Ordered-row operators with a key that holds nine tenths of the rows, cut into small segments."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from shelfspark.operators import sequences

N = 4000


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    out, level = [], 0.0
    for i in range(N):
        level = max(-5.0, min(30.0, level + rng.uniform(-3, 3)))
        key = None if i % 37 == 0 else 7 if i % 10 else i % 50
        symbol = rng.choice("aab-") if rng.random() < 0.3 or 2000 < i < 2100 else "-" if i % 600 < 200 else "c"
        out.append((key, i // 3, i, level if rng.random() < 0.95 else None, symbol if rng.random() < 0.98 else None))
    return out + [(99, 0, N + i, None, "-") for i in range(3)]


@pytest.fixture(scope="module")
def df(spark, rows):
    return spark.createDataFrame(rows, "k long, t long, id long, v double, s string").repartition(6)


@pytest.fixture(autouse=True, params=[16, 4, 0])
def segment_bits(request, monkeypatch):
    monkeypatch.setattr(sequences, "SEGMENT_BITS", request.param)


def by_key(rows):
    out: dict = {}
    for r in sorted(rows, key=lambda r: (r[1], r[2])):
        out.setdefault(r[0], []).append(r)
    return out


def test_places(df, rows):
    got = sequences.segmented(df, "k", ["t", "id"], id_=F.col("id")).collect()
    assert {(r.key_, r.id_): (r.i_, r.n_) for r in got} == {(k, r[2]): (i, len(own)) for k, own in by_key(rows).items() for i, r in enumerate(own)}


def test_peak_envelope(df, rows):
    want = {}
    for k, own in by_key(rows).items():
        v = [r[3] for r in own if r[3] is not None]
        chunk = max(1, math.ceil(len(v) / 20))
        for s in range(20):
            part = v[s * chunk : (s + 1) * chunk]
            db = max([*part, -100.0]) if part else None
            want[k, s] = 0.5 if not v else 0.05 if db is None else max(0.05, min(1.0, 10 ** (db / 20) if db > -100 else 0.0))
    got = {(r.k, r.segment): r.peak for r in sequences.peak_envelope(df, "k", ["t", "id"], "v").collect()}
    assert got.keys() == want.keys() and all(abs(got[x] - want[x]) < 1e-12 for x in want)


@pytest.mark.parametrize("most", [2, 30, 10_000])
def test_collapse_repeats(df, rows, most):
    want = {}
    for k, own in by_key(rows).items():
        text, last, streak = "", "-", 0
        kept = False
        for r in own:
            drop = r[4] in (None, "-", last)
            last = r[4]
            if not drop:
                text, kept, streak = text + r[4], True, 0
            elif kept:
                streak += 1
                if streak > most:
                    break
        want[k] = text
    got = {r.k: r.decoded for r in sequences.collapse_repeats(df, "k", ["t", "id"], "s", "-", most).collect()}
    assert got == want


def test_threshold_runs(df, rows):
    want = []
    for k, own in by_key(rows).items():
        runs: list[list[int]] = []
        for i, r in enumerate(own):
            if r[3] is not None and r[3] > 10:
                if runs and i - runs[-1][1] - 1 <= 2:
                    runs[-1][1] = i
                else:
                    runs.append([i, i])
        want += [(k, max(0, a - 5), min(len(own), z + 6)) for a, z in runs if z - a + 1 >= 5]
    got = [tuple(r) for r in sequences.threshold_runs(df, "k", ["t", "id"], "v", 10.0).collect()]
    assert sorted(got, key=str) == sorted(want, key=str) and len(want) > 20


def test_log_scale_clamp(df, rows):
    log = lambda v: -10.0 if v is None else math.log10(max(v, 1e-10))  # noqa: E731  null is the floor
    top = {k: max(log(r[3]) for r in own) for k, own in by_key(rows).items()}
    for r in sequences.log_scale_clamp(df, "k", "v").collect():
        assert abs(r.scaled - (max(log(r.v), top[r.k] - 8) + 4) / 4) < 1e-9


def test_tasks_of_a_long_key_are_even(spark, df):
    """Nine tenths of the rows have one key; the written ranges still have about as many rows each."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # the ranges here are small
    try:
        placed = sequences.segmented(df.withColumn("k", F.when(F.col("id") % 10 > 0, 7).otherwise(F.col("k"))), "k", ["t", "id"], v_=F.col("v"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    sizes = [r["count"] for r in placed.groupBy(F.shiftright("seq_", 33)).count().collect()]
    assert len(sizes) == 4 and max(sizes) < 1.5 * sum(sizes) / len(sizes)
