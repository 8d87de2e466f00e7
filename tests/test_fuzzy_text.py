"""Bit-parallel LCS against a plain table, and the bounds on it."""

from __future__ import annotations

import random
import time

import pytest
from pyspark.sql import functions as F

from shelfspark.operators import search


def plain(a: str, b: str) -> int:
    row = [0] * (len(a) + 1)
    for c in b:
        last = 0
        for j, x in enumerate(a, 1):
            last, row[j] = row[j], last + 1 if x == c else max(row[j], row[j - 1])
    return row[-1]


def made(n: int, longest: int, seed: int = 2) -> list[str]:
    rng = random.Random(seed)
    return ["".join(rng.choice("abcdé 日\U0001f600\x00") for _ in range(rng.randrange(longest))) for _ in range(n)]


@pytest.mark.parametrize("query", ["a", "abc", "ab" * 32, "abcd" * 16 + "é", "日é\U0001f600ab " * 40, "a" * 129])
def test_lengths_equal_a_plain_table(query):
    texts = made(60, 150) + ["", query, query[::-1], query * 2] + ["abcd" * 30] * 20
    assert search.lcs_lengths(query, texts).tolist() == [plain(query, t) for t in texts]


def test_many_symbols():
    query = "".join(chr(0x4E00 + i) for i in range(400))
    texts = [query[i::3] + query[::-1][:40] for i in range(30)]
    assert search.lcs_lengths(query, texts).tolist() == [plain(query, t) for t in texts]


def test_texts_go_abreast_much_faster():
    query, texts = "the and entier", made(1200, 1500)
    began = time.perf_counter()
    search.lcs_lengths(query, texts)
    fast = time.perf_counter() - began
    began = time.perf_counter()
    for t in texts[:200]:
        search.lcs_lengths(query, [t])
    assert fast < (time.perf_counter() - began) * 6 / 3


@pytest.fixture(scope="module")
def files(spark):
    texts = made(300, 40) + ["Abc dé", None, ""]
    rows = [(f"p{i:03d}", "image" if i % 7 else "text", "embed_failed" if i % 11 == 0 else "indexed", t) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "rel_path string, media_type string, status string, ocr_text string").repartition(3)


@pytest.mark.parametrize("query", ["abc dé", "ABCABCABC", "zz", ""])
def test_bounds_lose_nothing(files, query):
    everything = search.fuzzy_text_scores(files, query)
    held = sorted(((r.rel_path, r.score) for r in everything.collect()), key=lambda x: (-x[1], x[0]))
    for least in (0.0, 0.4, 0.75, 1.0):
        got = {(r.rel_path, r.score) for r in search.fuzzy_text_scores(files, query, at_least=least).collect()}
        assert got == {x for x in held if x[1] >= least}
    for k in (1, 10, 1000):
        got = [(r.rel_path, r.score) for r in search.fuzzy_text_best(files, query, k).collect()]
        assert got == [x for x in held if x[1] >= 0][:k]


def test_bound_is_native_and_above(files):
    rows = search._texts(files, "abc dé", "ocr_text").where("t_ is not null").select(search.lcs_bound(F.col("t_"), "abc dé").alias("b"), search.lcs_ratio("abc dé")("t_").alias("s")).collect()
    assert all(r.b >= r.s - 1e-12 for r in rows) and any(r.b > r.s for r in rows)
    plan = search._texts(files, "abc", "ocr_text").where(search.lcs_bound(F.col("t_"), "abc") > 0.5)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan


def test_vectors_are_read_once_for_normalised_scores(spark, files, tmp_path):
    rows = files.withColumn("clip_emb", F.array(F.lit(1.0), F.rand(1)).cast("array<float>"))
    rows.write.parquet(f"{tmp_path}/f")
    held = spark.read.parquet(f"{tmp_path}/f")
    out = search.minmax_0_100(search.semantic_scores(held, [1.0, 0.5], "imagecontent"))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "clip_emb" not in plan and plan.count("FileScan") == 1
    scores = [r.score for r in out.collect() if r.score >= 0]
    assert min(scores) == 0 and max(scores) == 100


def test_score_ranges_of_few_rows(spark):
    rows = spark.createDataFrame([("a", 1.0), ("b", -1.0), ("c", 3.0)], "rel_path string, score double")
    got = lambda df: {r.rel_path: r.score for r in search.minmax_0_100(df).collect()}
    assert got(rows) == {"a": 0.0, "b": -1.0, "c": 100.0}
    assert got(rows.where("score < 0")) == {"b": -1.0} and got(rows.where("score = 1")) == {"a": 100.0}
    assert got(rows.where("false")) == got(rows.limit(0)) == {}
