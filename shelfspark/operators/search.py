"""Scoring, normalising and ranking."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..functions import vectors
from ..sources.shared import written
from . import predicates, tags
from .topk import TopK

MAX_SIZES = 200  # lengths of prefixes
# Badge of each space.
BADGES = {"default": "", "imagecontent": "img", "ocr": "txt", "transcript": "cc", "audiocontent": "aud"}


def _cosines(qvec: list[float]):
    """An Arrow UDF: cosine of each vector with the query, 0 for a zero vector."""
    q = np.asarray(qvec, np.float64)
    norm = float(np.sqrt(q @ q))

    def run(col: pa.Array) -> pa.Array:
        m = np.asarray(col.flatten(), np.float64).reshape(-1, len(q))  # without the nulls
        own = np.sqrt((m * m).sum(axis=1)) * norm
        found = np.divide(m @ q, own, out=np.zeros(len(m)), where=own > 0)
        at = np.cumsum(col.is_valid().to_numpy(zero_copy_only=False)) - 1
        return pa.array(found).take(pc.if_else(col.is_valid(), pa.array(at), None))

    return F.arrow_udf(run, "double")


def semantic_scores(files: DataFrame, qvec: list[float], space: str = "default", arrow: bool = True) -> DataFrame:
    """(rel_path, score): cosine with the query; failed files -1, files without a vector of the query's length left out."""
    media = ["audio", "video"] if space == "audiocontent" else list(predicates.MEDIA)
    col = F.col(vectors.choose_space(space))
    failed = F.coalesce(F.col("status") == "embed_failed", F.lit(False))
    rows = files.where(F.col("media_type").isin(media)).select("rel_path", failed.alias("f_"), vectors.of_dim(col, len(qvec)).alias("v_"))
    rows = rows.where("f_ or v_ is not null").withColumn("v_", F.when(~F.col("f_"), F.col("v_")))
    likeness = _cosines(qvec)("v_") if arrow else vectors.cosine(F.col("v_"), F.array(*(F.lit(float(x)) for x in qvec)))
    return rows.select("rel_path", F.when(F.col("f_"), -1.0).otherwise(likeness).alias("score"))


def audio_scores(files: DataFrame, qvec: list[float]) -> DataFrame:
    return semantic_scores(files, qvec, "audiocontent")


def space_with_fallback(files: DataFrame, space: str) -> str:
    """The default space where audio vectors are asked for and there are none."""
    return "default" if space == "audiocontent" and files.where("clap_emb is not null").isEmpty() else space


def lcs_lengths(query: str, texts: list[str]) -> np.ndarray:
    """Length of the longest common subsequence of the query with each text.

    Bit-parallel: a row of bits for the query's characters, in words of 64, is updated
    for one character of all texts at once; texts of like length go together, few of
    them one by one.
    """
    symbols = {c: i + 1 for i, c in enumerate(dict.fromkeys(query))}
    n_words, out = -(-len(query) // 64), np.zeros(len(texts), np.int64)
    whole = {c: sum(1 << i for i, x in enumerate(query) if x == c) for c in symbols}
    full = (1 << len(query)) - 1
    masks = np.array([[0] * n_words] + [[m >> 64 * w & (1 << 64) - 1 for w in range(n_words)] for m in whole.values()], np.uint64)
    table = np.zeros(0x110000, np.uint8 if len(symbols) < 256 else np.uint32)
    for c, i in symbols.items():
        table[ord(c)] = i
    order = sorted(range(len(texts)), key=lambda i: len(texts[i]))
    at = 0
    while at < len(order):
        to = at + 1
        while to < len(order) and len(texts[order[to]]) <= 1.25 * len(texts[order[at]]) + 16 and (to - at) * len(texts[order[to]]) < 1 << 22:
            to += 1
        group = order[at:to]
        if len(group) < 16:
            for i in group:
                v = full
                for c in texts[i]:
                    u = v & whole.get(c, 0)
                    v = ((v + u) | (v - u)) & full
                out[i] = len(query) - v.bit_count()
        else:
            longest = len(texts[group[-1]])
            steps = np.zeros((len(group), longest), table.dtype)  # what is past a text's end changes nothing
            for row, i in enumerate(group):
                steps[row, : len(texts[i])] = table[np.frombuffer(texts[i].encode("utf-32-le", "surrogatepass"), np.uint32)]
            v = [np.full(len(group), (1 << 64) - 1, np.uint64) for _ in range(n_words)]
            for symbol in np.ascontiguousarray(steps.T):
                carry = None
                for w in range(n_words):
                    u = v[w] & masks[symbol, w]
                    total = v[w] + u
                    over = total < u
                    if carry is not None:
                        total += carry
                        over |= total < carry
                    carry = over.astype(np.uint64) if w + 1 < n_words else None
                    v[w] = total | (v[w] & ~u)
            for w in range(n_words):
                left = np.uint64((full >> 64 * w) & ((1 << 64) - 1))
                out[group] += np.bitwise_count(~v[w] & left)
        at = to
    return out


def lcs_ratio(query: str):
    """An Arrow UDF: longest common subsequence with the query over the shorter length."""

    @F.pandas_udf("double")
    def run(texts: pd.Series) -> pd.Series:
        have = texts.dropna()
        place = {t: i for i, t in enumerate(dict.fromkeys(have))}  # pandas' own factors take texts with a NUL for equal
        codes = np.array([place[t] for t in have], np.int64)
        sizes = np.array([min(len(query), len(t)) for t in place], np.float64)
        ratios = lcs_lengths(query, list(place)) / sizes if len(place) else np.zeros(0)
        out = pd.Series(np.full(len(texts), np.nan), index=texts.index)
        out[have.index] = ratios[codes]
        return out

    return run


def lcs_bound(text: Column, query: str) -> Column:
    """No LCS ratio is above this: characters that text and query share, over the shorter length; native."""
    length = F.char_length(text)
    own = lambda c: length - F.char_length(F.translate(text, c, ""))
    shared = reduce(Column.__add__, (F.least(own(c), F.lit(query.count(c))) for c in dict.fromkeys(query)))
    return shared / F.least(length, F.lit(len(query)))


def _texts(files: DataFrame, query: str, text_col: str) -> DataFrame:
    """(rel_path, t_): lower-case text, null where the file failed or has none."""
    rows = predicates_base(files).select("rel_path", F.lower(F.col(text_col)).alias("t_"), F.coalesce(F.col("status") == "embed_failed", F.lit(False)).alias("f_"))
    usable = ~F.col("f_") & (F.coalesce(F.length("t_"), F.lit(0)) > 0) & F.lit(len(query) > 0)
    return rows.select("rel_path", F.when(usable, F.col("t_")).alias("t_"))


def fuzzy_text_scores(files: DataFrame, query: str, text_col: str = "ocr_text", at_least: float | None = None) -> DataFrame:
    """(rel_path, score): likeness of the text and the query; -1 for failed files and empty texts.

    With ``at_least`` only files of such a score; what shared character counts rule out
    is not aligned.
    """
    query = query.lower()
    rows = _texts(files, query, text_col)
    if at_least is not None and at_least > 0:
        rows = rows.where(lcs_bound(F.col("t_"), query) >= at_least - 1e-12) if query else rows.limit(0)
    scored = rows.select("rel_path", F.coalesce(lcs_ratio(query)("t_"), F.lit(-1.0)).alias("score"))
    return scored if at_least is None else scored.where(F.col("score") >= at_least)


def fuzzy_text_best(files: DataFrame, query: str, k: int, text_col: str = "ocr_text") -> DataFrame:
    """(rel_path, score): the k best, ties by path. The k files of the highest bounds are scored first; their least score rules out others."""
    query = query.lower()
    rows = _texts(files, query, text_col).where("t_ is not null")
    if not query:
        return rows.select("rel_path", F.lit(-1.0).alias("score")).limit(0)
    score = lambda df: df.select("rel_path", lcs_ratio(query)("t_").alias("score"))
    first = score(rows.orderBy(lcs_bound(F.col("t_"), query).desc(), "rel_path").limit(k)).agg(F.count("*"), F.min("score")).first()
    if first[0] == k:
        rows = rows.where(lcs_bound(F.col("t_"), query) >= first[1] - 1e-12)
    return score(rows).orderBy(F.col("score").desc(), "rel_path").limit(k)


def predicates_base(files: DataFrame) -> DataFrame:
    return files.where(predicates.base_media())


def scale(score: Column, lo: Column, hi: Column) -> Column:
    """0 to 100 for what isn't negative; 100 if all are equal."""
    return F.when(score < 0, score).when(hi == lo, 100.0).otherwise((score - lo) / (hi - lo) * 100)


def minmax_0_100(scored: DataFrame) -> DataFrame:
    """Scores scaled by the least and greatest that isn't negative.

    The scores are computed once: they are written, path and score only, while their ends are observed.
    """
    ends = Observation()
    good = F.when(F.col("score") >= 0, F.col("score"))
    held = written(scored.observe(ends, F.min(good).alias("lo"), F.max(good).alias("hi")), "scores")
    lo, hi = (F.lit(ends.get[k]).cast("double") for k in ("lo", "hi"))
    return held.withColumn("score", scale(F.col("score"), lo, hi))


def rank(scored: DataFrame) -> DataFrame:
    return scored.orderBy(F.col("score").desc(), "rel_path")


def placed(scored: DataFrame) -> DataFrame:
    """``rank`` with a column ``place`` from 1: ranges of the order are sorted by many tasks and written once, and each adds the rows of the ranges before it."""
    parts = scored.repartitionByRange(F.col("score").desc(), F.col("rel_path")).sortWithinPartitions(F.col("score").desc(), "rel_path")
    numbered = written(parts.withColumn("at_", F.monotonically_increasing_id()), "placed").withColumn("part_", F.shiftright("at_", 33))
    sizes = numbered.groupBy("part_").agg(F.count("*").alias("n_"))  # a row a task
    before = sizes.select("part_", (F.sum("n_").over(Window.orderBy("part_")) - F.col("n_")).alias("before_"))
    place = (F.col("before_") + F.col("at_").bitwiseAND(F.lit((1 << 33) - 1)) + 1).cast("long")
    return numbered.join(F.broadcast(before), "part_").withColumn("place", place).drop("at_", "part_", "before_")


def search(files: DataFrame, pred: Column | None = None, qvec: list[float] | None = None, space: str = "default", lo: float | None = None, hi: float | None = None) -> DataFrame:
    """Tag filter, scores over the whole space, normalising, bounds, intersection, ranking."""
    hits = predicates.filter_files(files, pred) if pred is not None else None
    if qvec is None:
        if hits is None:
            raise ValueError("give a predicate, a query vector, or both")
        return hits.withColumn("score", F.lit(None).cast("double"))
    scored = predicates.score_between(minmax_0_100(semantic_scores(files, qvec, space)), lo, hi)
    return rank(scored) if hits is None else tags.hybrid(hits, scored)


def search_batch(files: DataFrame, queries: DataFrame, k: int, space: str = "default", max_queries: int = 100_000, max_bytes: int = 256 << 20) -> DataFrame:
    """(query_id, rank, rel_path, score): the k best files of each of a stated set of queries (query_id, qvec).

    A task scores its rows against all queries in blocks and keeps k rows and the ends of
    the score range for each, so only tasks x queries x k rows are shuffled.
    """
    stated = queries.limit(max_queries + 1).collect()
    if len(stated) > max_queries:
        raise ValueError(f"more than {max_queries} queries; give them in parts")
    ids, matrix = [r["query_id"] for r in stated], np.array([r["qvec"] for r in stated], np.float64)
    if matrix.nbytes > max_bytes:
        raise ValueError(f"queries of more than {max_bytes} bytes; give them in parts")
    matrix = matrix / np.maximum(np.sqrt((matrix**2).sum(axis=1, keepdims=True)), 1e-300)
    media = ["audio", "video"] if space == "audiocontent" else list(predicates.MEDIA)
    rows = files.where(F.col("media_type").isin(media)).select("rel_path", F.coalesce(F.col("status") == "embed_failed", F.lit(False)).alias("failed"), vectors.of_dim(F.col(vectors.choose_space(space)), matrix.shape[1]).alias("v"))
    rows = rows.where("failed or v is not null")
    width, spread = matrix.shape[1] if matrix.ndim == 2 else 0, files.sparkSession.sparkContext.broadcast(matrix)

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrix, top = spread.value, TopK(len(ids), k)
        lo, hi = np.full(len(ids), np.inf), np.full(len(ids), -np.inf)
        for batch in batches:
            paths, failed = batch.column("rel_path"), batch.column("failed").to_numpy(zero_copy_only=False)
            m = np.zeros((batch.num_rows, width))
            m[~failed] = np.asarray(batch.column("v").filter(pa.array(~failed)).flatten(), np.float64).reshape(-1, width)
            norm = np.sqrt((m**2).sum(axis=1))
            m /= np.where(norm > 0, norm, 1)[:, None]
            for q0 in range(0, len(ids), 256):
                which = np.arange(q0, min(q0 + 256, len(ids)))
                scores = matrix[which] @ m.T
                scores[:, failed] = -1.0
                good = scores >= 0
                lo[which] = np.minimum(lo[which], np.where(good, scores, np.inf).min(axis=1, initial=np.inf))
                hi[which] = np.maximum(hi[which], np.where(good, scores, -np.inf).max(axis=1, initial=-np.inf))
                top.add(which, scores, lambda at, p=paths: p.take(pa.array(at)).to_numpy(zero_copy_only=False))
        at, paths, scores = top.rows()
        yield pa.record_batch({"query_id": pa.array(np.array(ids, np.int64)[at]), "rel_path": pa.array(paths.tolist(), pa.string()), "score": pa.array(scores), "lo": pa.array(lo[at]), "hi": pa.array(hi[at])})

    w = Window.partitionBy("query_id")
    cand = rows.mapInArrow(best, "query_id long, rel_path string, score double, lo double, hi double")
    scored = cand.withColumns({"lo": F.min("lo").over(w), "hi": F.max("hi").over(w), "rank": F.row_number().over(w.orderBy(F.col("score").desc(), "rel_path"))}).where(F.col("rank") <= k)
    return scored.select("query_id", "rank", "rel_path", scale(F.col("score"), F.col("lo"), F.col("hi")).alias("score"))


def score_badge(scored: DataFrame, space: str) -> DataFrame:
    """Label of the space and the rounded percent."""
    return scored.withColumn("badge", F.trim(F.concat(F.lit(BADGES[space] + " "), F.round("score").cast("int").cast("string"), F.lit("%"))))


def suggest(names: DataFrame, prefixes: DataFrame, k: int = 8) -> DataFrame:
    """(prefix, rank, tag): first k tags (tag, category) that begin with each prefix, by category and name.

    The lengths of the prefixes are read when the plan is built; more than ``MAX_SIZES`` are refused.
    """
    size = F.char_length(F.lower("prefix"))
    sizes = [r[0] for r in prefixes.where("prefix is not null").select(size).distinct().limit(MAX_SIZES + 1).collect()]
    if len(sizes) > MAX_SIZES:
        raise ValueError(f"prefixes of more than {MAX_SIZES} lengths")
    # tags and prefixes meet on the first characters, for each length that a prefix has
    heads = names.select("*", F.explode(F.array(*(F.lit(n) for n in sizes)).cast("array<int>")).alias("size_")).where(F.char_length(F.lower("tag")) >= F.col("size_"))
    heads = heads.withColumn("head_", F.left(F.lower("tag"), F.col("size_")))
    rows = heads.join(prefixes.select("prefix", F.lower("prefix").alias("head_")), "head_").drop("size_", "head_")
    w = Window.partitionBy("prefix").orderBy("category", "tag")
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("prefix", "rank", "tag")
