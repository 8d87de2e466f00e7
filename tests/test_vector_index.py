"""The vector index against scoring all rows."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfspark.operators import search, vector_index
from shelfspark.operators.topk import TopK

DIM = 24


def vectors_of(kind: str, n: int, seed: int = 3) -> np.ndarray:
    rng = np.random.default_rng(seed)
    if kind == "random":
        return rng.normal(size=(n, DIM)).astype(np.float32)
    centres = rng.normal(size=(25, DIM))
    return (centres[rng.integers(0, 25, n)] + 0.1 * rng.normal(size=(n, DIM))).astype(np.float32)


def by_hand(paths, m, q, k):
    norm = np.linalg.norm(m, axis=1)
    s = np.divide(m @ (q / max(np.linalg.norm(q), 1e-300)), norm, out=np.zeros(len(m)), where=norm > 0)
    return [(paths[i], s[i]) for i in np.lexsort((np.array(paths), -s))[:k]]


@pytest.mark.parametrize("kind,cells,k", [("clusters", 40, 5), ("random", 16, 5), ("clusters", 1, 3), ("random", 500, 400)])
def test_index_equals_all_rows(spark, tmp_path, kind, cells, k):
    m = vectors_of(kind, 3000).astype(np.float64)
    m[5], m[6], m[7:12] = 0, 0, m[12]  # zero vectors and copies
    rows = [(f"p{i:05d}", "indexed" if i % 50 else "embed_failed", m[i].tolist()) for i in range(len(m))]
    rows += [("null", "indexed", None), ("short", "indexed", [1.0]), ("nostatus", None, m[12].tolist())]
    files = spark.createDataFrame(rows, "rel_path string, status string, clip_emb array<float>").repartition(5)
    folder = str(tmp_path / "index")
    vector_index.build(files, folder, DIM, "imagecontent", cells)
    assert spark.read.parquet(f"{folder}/rows").count() == 3000 - 60 + 1
    stated = [(i, m[i * 37].tolist()) for i in range(30)] + [(99, [0.0] * DIM)]
    counts = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)
    got: dict = {}
    for r in vector_index.nearest(spark, folder, spark.createDataFrame(stated, "query_id long, qvec array<double>"), k, counts=counts).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.rel_path, r.score))
    paths = [r[0] for r in rows[:3000] if r[1] != "embed_failed"] + ["nostatus"]
    held = np.concatenate([m[[i for i in range(3000) if i % 50]], m[12:13]]).astype(np.float32).astype(np.float64)
    for i, q in stated:
        want = by_hand(paths, held, np.array(q), k)
        assert np.allclose([s for _, s in got[i]], [s for _, s in want], atol=1e-9)
        clear = [p for p, s in want if sum(abs(s - t) < 1e-9 for _, t in want) == 1]
        assert [p for p, _ in got[i] if p in set(clear)] == clear
    if kind == "clusters" and cells > 1:  # the query of all zeros is served by every ring
        scored, skipped = counts[0].value, counts[1].value
        assert skipped > 5 * scored


def test_index_of_nothing(spark, tmp_path):
    files = spark.createDataFrame([("a", "indexed", None)], "rel_path string, status string, clip_emb array<float>")
    queries = spark.createDataFrame([(1, [1.0] * DIM)], "query_id long, qvec array<double>")
    vector_index.build(files, str(tmp_path / "i"), DIM, "imagecontent")
    assert vector_index.nearest(spark, str(tmp_path / "i"), queries, 3).collect() == []
    assert vector_index.nearest(spark, str(tmp_path / "i"), queries.limit(0), 3).collect() == []
    with pytest.raises(ValueError, match="in parts"):
        vector_index.nearest(spark, str(tmp_path / "i"), queries.union(queries), 3, max_queries=1)


def test_top_k_with_ties():
    rng = np.random.default_rng(1)
    for k in (1, 3, 7):
        top, seen = TopK(4, k), [[] for _ in range(4)]
        for b in range(12):
            n = int(rng.integers(0, 9))
            scores, names = rng.integers(-1, 4, (4, n)).astype(float), np.array([f"{b}-{i}" for i in rng.permutation(n)], object)
            which = rng.permutation(4)
            top.add(which, scores, lambda at, names=names: names[at])
            for row, i in enumerate(which):
                seen[i] += [(-s, p) for s, p in zip(scores[row], names, strict=True)]
        q, paths, values = top.rows()
        for i in range(4):
            assert [(-s, p) for s, p in zip(values[q == i], paths[q == i], strict=True)] == sorted(seen[i])[:k]


def test_batch_search_equals_single_searches(spark):
    m = vectors_of("random", 400)
    rows = [(f"p{i}", "image", "indexed" if i % 20 else "embed_failed", m[i].tolist()) for i in range(400)]
    files = spark.createDataFrame(rows, "rel_path string, media_type string, status string, clip_emb array<float>").repartition(3)
    queries = spark.createDataFrame([(i, m[i].astype(float).tolist()) for i in range(8)], "query_id long, qvec array<double>")
    got = {(r.query_id, r["rank"]): (r.rel_path, round(r.score, 6)) for r in search.search_batch(files, queries, 6, "imagecontent").collect()}
    for i in range(8):
        single = search.minmax_0_100(search.semantic_scores(files, m[i].astype(float).tolist(), "imagecontent")).orderBy(F.col("score").desc(), "rel_path").limit(6).collect()
        assert [got[i, n + 1] for n in range(6)] == [(r.rel_path, round(r.score, 6)) for r in single]
