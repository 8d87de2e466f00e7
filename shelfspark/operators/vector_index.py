"""An exact index of vectors by cells around sampled centres.

Every vector lies in the cell of the centre that its angle is least to, and the table is
sorted by cell and angle; so a run of rows is a ring around a centre. By the triangle
inequality on the sphere a row of the ring [lo, hi] is at least ``t - hi`` and ``lo - t``
away from a query at angle t from the centre: the cosine of that bounds all scores of
the ring from above. A first pass scores each query against the cells next to it, which
gives a bound on its k-th best score; the second pass reads the cells and angles that
can still hold something better, and skips the queries that a ring can't serve. Bounds
only leave out what can't be among the results, so these are those of scoring all rows.

Centres are a bounded sample (``cells``); all rows are indexed. Cells of any size are
spread over tasks by ranges of angle. The results don't depend on the sample.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import vectors
from .topk import TopK

#: Angles from float vectors are taken as exact to this much.
MARGIN = 1e-6
RING = 1024


def _unit(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    norm = np.sqrt((rows * rows).sum(axis=1, keepdims=True))
    return np.divide(rows, norm, out=np.zeros_like(rows), where=norm > 0), norm[:, 0] > 0


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(-1, dim)


def build(files: DataFrame, folder: str, dim: int, space: str = "default", cells: int = 256) -> None:
    """Write the index of the files' vectors of one space and length; files without one, or that failed, are left out."""
    col = F.col(vectors.choose_space(space))
    rows = files.where(F.coalesce(F.col("status") != "embed_failed", F.lit(True))).select("rel_path", vectors.of_dim(col, dim).alias("v")).where("v is not null")
    sample = [r.v for r in rows.orderBy(F.xxhash64("rel_path"), "rel_path").limit(cells).collect()]
    centres, real = _unit(np.array(sample, np.float64).reshape(-1, dim))
    centres = np.unique(centres[real], axis=0)
    spread = files.sparkSession.sparkContext.broadcast(centres)  # at most ``cells`` rows

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m, real = _unit(_matrix(batch.column("v"), dim))
            cell, angle = np.full(len(m), -1, np.int32), np.zeros(len(m))  # -1: zero vectors, and all if there is no centre
            if len(spread.value):
                likeness = m @ spread.value.T
                cell[real] = likeness.argmax(axis=1)[real]
                angle[real] = np.arccos(np.clip(likeness.max(axis=1), -1, 1))[real]
            yield pa.RecordBatch.from_arrays([batch.column("rel_path"), pa.array(cell), pa.array(angle), batch.column("v")], ["rel_path", "cell", "angle", "v"])

    placed = rows.mapInArrow(assign, "rel_path string, cell int, angle double, v array<float>")
    placed.repartitionByRange("cell", "angle", "rel_path").sortWithinPartitions("cell", "angle").write.parquet(f"{folder}/rows")
    held = [(i, c.tolist()) for i, c in enumerate(centres)]
    files.sparkSession.createDataFrame(held, "cell int, v array<double>").coalesce(1).write.parquet(f"{folder}/centres")


def _stated(queries: DataFrame, limit: int, max_bytes: int) -> tuple[list[int], np.ndarray]:
    found = queries.select("query_id", "qvec").limit(limit + 1).collect()
    matrix = np.array([r["qvec"] for r in found], np.float64)
    if len(found) > limit or matrix.nbytes > max_bytes:
        raise ValueError(f"more than {limit} queries or {max_bytes} bytes of them; give them in parts")
    return [r["query_id"] for r in found], matrix


def nearest(spark: SparkSession, folder: str, queries: DataFrame, k: int, max_queries: int = 100_000, max_bytes: int = 256 << 20, counts=None) -> DataFrame:
    """(query_id, rank, rel_path, score): the k indexed files of the highest cosine for each of a stated set of queries (query_id, qvec).

    Equal scores go by path. ``counts``, two accumulators, get the pairs of query and row
    that tasks scored, and those that bounds left out.
    """
    ids, matrix = _stated(queries, max_queries, max_bytes)
    if not ids:
        return spark.createDataFrame([], "query_id long, rank int, rel_path string, score double")
    dim = matrix.shape[1]
    q, _ = _unit(matrix)
    centres = np.array([r.v for r in spark.read.parquet(f"{folder}/centres").orderBy("cell").collect()], np.float64).reshape(-1, dim)
    angles = np.arccos(np.clip(q @ centres.T, -1, 1))  # queries x cells, both bounded
    rows = spark.read.parquet(f"{folder}/rows")
    shared = spark.sparkContext.broadcast((q, angles, ids))
    near = np.argsort(angles, axis=1)[:, :2] if len(centres) else np.zeros((len(ids), 0), int)
    first = rows.where(F.col("cell").isin(np.unique(near).tolist()))
    own = np.zeros((len(centres) + 1, len(ids)), bool)
    own[near.T, np.arange(len(ids))] = True
    bound = _best(first, shared, dim, k, np.full(len(ids), -np.inf), own, None).groupBy("query_id").agg(F.collect_list("score").alias("s"))
    found = {r.query_id: np.sort(r.s)[-k] if len(r.s) >= k else -np.inf for r in bound.collect()} if len(centres) else {}
    least = np.array([found.get(i, -np.inf) for i in ids])
    # rings that can hold something as good, over all queries
    reach = np.arccos(np.clip(least - MARGIN, -1, 1))[:, None] + MARGIN
    lo, hi = (angles - reach).min(axis=0), (angles + reach).max(axis=0)
    inside = F.col("cell") == -1
    if len(centres):
        bounds = [F.element_at(F.lit(x.tolist()), F.col("cell") + 1) for x in (lo, hi)]
        inside = inside | F.col("angle").between(*bounds)
    open_cells = [-1, *np.flatnonzero(hi >= 0).tolist()]
    got = _best(rows.where(F.col("cell").isin(open_cells)).where(inside), shared, dim, k, least, np.ones((len(centres) + 1, len(ids)), bool), counts)
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "rel_path")
    return got.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "rel_path", "score")


def _best(rows: DataFrame, shared, dim: int, k: int, least: np.ndarray, open_: np.ndarray, counts) -> DataFrame:
    """(query_id, rel_path, score): of each task the k best rows of each query, over rings that can reach ``least`` and cells that are open to the query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, angles, ids = shared.value
        top = TopK(len(ids), k)
        for batch in batches:
            cells = batch.column("cell").to_numpy()
            turn = np.flatnonzero(np.diff(cells)) + 1
            edges = sorted({0, *turn.tolist(), *range(RING, len(cells), RING), len(cells)})
            for a, z in zip(edges[:-1], edges[1:], strict=True):
                cell, ring = int(cells[a]), batch.column("angle").slice(a, z - a).to_numpy()
                bar = np.maximum(least, top.least())
                if cell < 0:
                    which = np.flatnonzero(open_[cell])
                else:
                    t = angles[:, cell]
                    away = np.maximum(0, np.maximum(t - ring.max(), ring.min() - t) - MARGIN)
                    which = np.flatnonzero(open_[cell] & (np.cos(away) >= bar - MARGIN))
                if counts:
                    counts[0].add(len(which) * (z - a))
                    counts[1].add((len(ids) - len(which)) * (z - a))
                if not len(which):
                    continue
                paths = batch.column("rel_path").slice(a, z - a)
                m, _ = _unit(_matrix(batch.column("v").slice(a, z - a), dim))
                for part in np.split(which, range(512, len(which), 512)):
                    top.add(part, q[part] @ m.T, lambda at, p=paths: p.take(pa.array(at)).to_numpy(zero_copy_only=False))
        at, paths, scores = top.rows()
        yield pa.record_batch({"query_id": pa.array(np.array(ids, np.int64)[at]), "rel_path": pa.array(paths.tolist(), pa.string()), "score": pa.array(scores)})

    return rows.mapInArrow(run, "query_id long, rel_path string, score double")
