"""Plug-in embedders that fail, and fusing in batches."""

from __future__ import annotations

import hashlib
import math
import random
import re
import time
from collections import Counter

import pytest

from shelfspark.functions import vectors


def test_failing_rows_cost_few_set_ups(spark, tmp_path):
    log = str(tmp_path / "set-ups")

    def embed(batches):
        with open(log, "a") as f:
            f.write("x")
        for batch in batches:
            for t in batch:
                if t.startswith("bad"):
                    raise ValueError(t)
                yield [float(len(t))]

    rows = [(i, f"bad {i}" if i in (100, 700) else None if i % 9 == 0 else "y" * (i % 7) if i != 50 else "") for i in range(1000)]
    df = spark.createDataFrame(rows, "i long, t string").coalesce(1)
    got = {r.i: (r.v, r.e) for r in vectors.embed_column(df, "t", embed, 1, "v", "e").collect()}
    assert got == {i: (None, None) if t is None else (None, f"ValueError: {t}") if t.startswith("bad") else ([float(len(t))], None) for i, t in rows}
    with open(log) as f:
        assert len(f.read()) < 50


def test_a_plug_in_gets_few_texts_at_once(spark):
    """Batches were of up to 10,000 rows, however long their texts."""
    df = spark.range(0, 3000, 1, 1).selectExpr("id", "if(id % 10 = 0, null, repeat('word ', 4000)) as t")
    got = [r.v for r in vectors.embed_column(df, "t", lambda bs: ([float(len(b))] for b in bs for _ in b), 1, "v").select("v").collect()]
    assert [v is None for v in got] == [i % 10 == 0 for i in range(3000)]
    assert max(v[0] for v in got if v) * 20_000 <= 2 * vectors._TEXT_AT_ONCE


def test_hash_embedding_counts_words_in_one_pass(spark):
    """Before, every bucket passed over all words: 50,000 x 16,384 steps here."""
    words = [f"w{i * i % 9973}" for i in range(50_000)]
    texts = ["", None, "--", "a A b", " ".join(words)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    for dim in (1, 64, 16_384):
        began = time.perf_counter()
        got = {r.i: r.embedding for r in vectors.embed_column(df, "t", dim=dim).collect()}
        assert time.perf_counter() - began < 20
        for i, t in enumerate(texts):
            if t is None:
                assert got[i] is None
                continue
            n = Counter(int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % dim for w in re.findall("[a-z0-9]+", t.lower()))
            norm = math.sqrt(sum(v * v for v in n.values())) or 1.0
            assert all(math.isclose(x, n[b] / norm, abs_tol=1e-9) for b, x in enumerate(got[i])) and len(got[i]) == dim


def test_short_vectors_are_no_errors(spark):
    df = spark.createDataFrame([("ab",), ("abc",)], "t string")
    got = vectors.embed_column(df, "t", lambda bs: ([1.0] * len(t) for b in bs for t in b), 3, "v", "e").collect()
    assert [(r.v, r.e) for r in got] == [(None, None), ([1.0] * 3, None)]
    assert vectors.embed_column(df, "t", dim=4, errors="e").first().e is None


def test_fusing_in_batches_equals_expressions(spark):
    rng, rows = random.Random(2), []
    for i in range(120):
        dim = rng.choice([3, 5])
        rows.append((i, *(None if rng.random() < 0.4 else [0.0] * dim if rng.random() < 0.1 else [rng.uniform(-1, 1) for _ in range(dim)] for _ in range(4))))
    rows.append((500, [], None, None, None))
    df = spark.createDataFrame(rows, "i long, " + ", ".join(f"{c} array<float>" for c in ("clip_emb", "metadata_emb", "ocr_emb", "transcript_emb"))).repartition(3)
    fast = {r.i: r.search_emb for r in vectors.fuse_embeddings(df).collect()}
    slow = {r.i: r.search_emb for r in vectors.fuse_embeddings(df, arrow=False).where("i < 500").collect()}
    assert sum(v is None for v in slow.values()) > 1
    assert fast.pop(500) == []
    for i, v in slow.items():
        assert fast[i] is v or all(math.isclose(a, b, abs_tol=1e-9) for a, b in zip(fast[i], v, strict=True))


def test_fusing_other_lengths_is_refused(spark):
    df = spark.createDataFrame([([1.0], [1.0, 2.0], None, None)], "clip_emb array<float>, metadata_emb array<float>, ocr_emb array<float>, transcript_emb array<float>")
    with pytest.raises(Exception, match="different lengths"):
        vectors.fuse_embeddings(df).collect()
