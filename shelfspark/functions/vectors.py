"""Vector expressions over array columns, in double precision."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACES = {"default": "search_emb", "imagecontent": "clip_emb", "ocr": "ocr_emb", "transcript": "transcript_emb", "audiocontent": "clap_emb"}


def choose_space(space: str) -> str:
    """Vector column of a search space."""
    if space not in SPACES:
        raise ValueError(f"unknown search space {space!r}; one of {', '.join(SPACES)}")
    return SPACES[space]


def vec_sum(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return vec_sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """0 where a norm is 0."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms == 0, F.lit(0.0)).otherwise(dot(a, b) / norms)


def of_dim(v: Column, dim: int) -> Column:
    """Null for a vector of another length."""
    return F.when(F.size(v) == dim, v)


def _at(vs: Column, i: Column) -> Column:
    return F.transform(vs, lambda v: v[i].cast("double"))


def vec_mean(vs: Column) -> Column:
    """Elementwise mean of an array of vectors; null if there are none."""
    vs = F.array_compact(vs)
    return F.when(F.size(vs) > 0, F.transform(F.sequence(F.lit(0), F.size(vs[0]) - 1), lambda i: vec_sum(_at(vs, i)) / F.size(vs)))


def vec_max(vs: Column) -> Column:
    vs = F.array_compact(vs)
    return F.when(F.size(vs) > 0, F.transform(F.sequence(F.lit(0), F.size(vs[0]) - 1), lambda i: F.array_max(_at(vs, i))))


def l2_normalize(v: Column) -> Column:
    """A zero vector stays."""
    return F.transform(F.array(F.sqrt(dot(v, v))), lambda n: F.transform(v, lambda x: F.when(n == 0, x.cast("double")).otherwise(x / n)))[0]


def fused(*vectors: Column) -> Column:
    """L2-normalised 0.4 mean + 0.6 max of the vectors that are not null."""

    def mix(vs: Column) -> Column:
        place = lambda i: F.transform(F.array(_at(vs, i)), lambda x: 0.4 * vec_sum(x) / F.size(x) + 0.6 * F.array_max(x))[0]
        return F.transform(F.sequence(F.lit(0), F.size(vs[0]) - 1), place)

    bound = F.transform(F.array(F.array_compact(F.array(*vectors))), lambda vs: F.when(F.size(vs) > 0, F.transform(F.array(mix(vs)), l2_normalize)[0]))
    return bound[0]


def text_override(text_emb: Column, clip_emb: Column) -> Column:
    """The text vector where a file has one, else the image vector."""
    return F.coalesce(text_emb, clip_emb)


def _fused_batch(*columns: pa.Array) -> pa.Array:
    """``fused`` for a batch: sums, counts and maxima over the vectors that are there."""
    n, values, offsets = len(columns[0]), [], [0]
    sizes = [pc.fill_null(pc.list_value_length(c), -1).to_numpy(zero_copy_only=False) for c in columns]
    longest = np.max(sizes, axis=0)
    uneven = [i for i in range(n) if any(0 <= s[i] != longest[i] for s in sizes)]
    if uneven:
        raise ValueError("vectors of different lengths can't be fused")
    for dim in np.unique(longest[longest > 0]):
        at = np.flatnonzero(longest == dim)
        total, top, count = np.zeros((len(at), dim)), np.full((len(at), dim), -np.inf), np.zeros(len(at))
        for c, s in zip(columns, sizes, strict=True):
            have = s[at] == dim
            m = np.asarray(c.take(pa.array(at[have])).flatten(), np.float64).reshape(-1, dim)
            total[have] += m
            top[have] = np.maximum(top[have], m)
            count[have] += 1
        out = 0.4 * total / count[:, None] + 0.6 * top
        norm = np.sqrt((out * out).sum(axis=1, keepdims=True))
        values.append((at, np.divide(out, norm, out=out, where=norm > 0)))
    flat = np.zeros(int(np.maximum(longest, 0).sum()))
    offsets = np.append(0, np.cumsum(np.maximum(longest, 0)))
    for at, out in values:
        flat[offsets[at][:, None] + np.arange(out.shape[1])] = out
    mask = pa.array(np.append(longest < 0, False))
    return pa.ListArray.from_arrays(pc.if_else(mask, None, pa.array(offsets, pa.int32())), pa.array(flat))


def fuse_embeddings(files: DataFrame, out: str = "search_emb", arrow: bool = True) -> DataFrame:
    """Fuse image, metadata, OCR and transcript vectors; audio lies in another space.

    Batches are fused in Arrow; without ``arrow`` by expressions, which are evaluated element by element.
    """
    columns = [F.col(c) for c in ("clip_emb", "metadata_emb", "ocr_emb", "transcript_emb")]
    return files.withColumn(out, F.arrow_udf(_fused_batch, "array<double>")(*columns) if arrow else fused(*columns))


def scale_channels(v: Column, mean: list[float], std: list[float], scale: float = 255.0) -> Column:
    """(x / scale - mean) / std, channel by channel."""
    m, s, n = F.array(*map(F.lit, mean)), F.array(*map(F.lit, std)), len(mean)
    return F.transform(v, lambda x, i: (x.cast("double") / scale - m[i % n]) / s[i % n])


def argmax(v: Column) -> Column:
    return (F.array_position(v, F.array_max(v)) - 1).cast("long")


def top_class(df: DataFrame, key: str, cls: str, score: str) -> DataFrame:
    """Best class of each key; of equal scores the least class, whatever its type. Null scores take no part."""
    least = F.min(F.struct((-F.col(score)).alias("s"), F.col(cls).alias("c")))
    return df.where(F.col(score).isNotNull()).groupBy(key).agg(least.alias("b_")).select(key, F.col("b_.c").alias(cls), (-F.col("b_.s")).alias(score))


def array_stats(v: Column) -> Column:
    return F.struct(F.array_min(v).cast("double").alias("lo"), F.array_max(v).cast("double").alias("hi"), (vec_sum(F.transform(v, lambda x: x.cast("double"))) / F.size(v)).alias("mean"))


def compare_vectors(a: Column, b: Column) -> Column:
    """Largest error and root mean square error."""
    d = F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double")))
    return F.transform(F.array(d), lambda e: F.struct(F.array_max(e).alias("max_error"), F.sqrt(dot(e, e) / F.size(e)).alias("rmse")))[0]


def hash_embedding(text: Column, dim: int = 64) -> Column:
    """Native embedder: words hashed into buckets, counted, normalised."""
    bucket = lambda w: F.conv(F.substring(F.md5(w.cast("binary")), 1, 8), 16, 10).cast("bigint") % dim
    buckets = F.transform(F.regexp_extract_all(F.lower(text), F.lit(r"([a-z0-9]+)"), 1), bucket)

    def counts(bs: Column) -> Column:
        """Of sorted buckets: where each one's run ends, less where the run before ends; a pass over the words, however many buckets."""
        ends = F.array_compact(F.transform(bs, lambda b, i: F.when(F.coalesce(b != F.get(bs, i + 1), F.lit(True)), F.struct(b.alias("b"), (i + 1).alias("n")))))
        runs = F.transform(F.array(ends), lambda e: F.map_from_entries(F.transform(e, lambda x, i: F.struct(x["b"], x["n"] - F.coalesce(F.get(e, i - 1)["n"], F.lit(0))))))
        return F.transform(runs, lambda n: F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.coalesce(n[i.cast("bigint")], F.lit(0)).cast("double")))[0]

    return F.transform(F.array(F.sort_array(buckets)), lambda bs: F.transform(F.array(counts(bs)), l2_normalize)[0])[0]


#: Bytes of texts, about, that a plug-in is given at once; a batch of long texts has far more.
_TEXT_AT_ONCE = 1 << 22


def embed_column(df: DataFrame, col: str, embedder: Callable[[Iterator[pd.Series]], Iterator[list]] | None = None, dim: int = 64, out: str = "embedding", errors: str | None = None) -> DataFrame:
    """Text column to vector; null stays null.

    A plug-in takes an iterator of batches and yields a vector for each row, in order. It
    is set up once for a task's batches. Where it fails it is set up anew and given half
    of the batch at a time, down to the rows that fail; these have a null vector, and
    their error in the column ``errors`` if one is named. Null texts, and vectors of
    another length, give null without an error.
    """
    if embedder is None:
        found = df.withColumn(out, F.when(F.col(col).isNotNull(), hash_embedding(F.col(col), dim)))
        return found.withColumn(errors, F.lit(None).cast("string")) if errors else found

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        waiting: list[pd.Series] = []
        answers: Iterator | None = None

        def given() -> Iterator[pd.Series]:
            while waiting:
                yield waiting.pop()

        def solved(rows: pd.Series) -> list[tuple]:
            nonlocal answers
            try:
                waiting[:] = [rows]
                answers = iter(embedder(given())) if answers is None else answers
                return [(checked(next(answers)), None) for _ in rows]
            except Exception as e:  # noqa: BLE001  a bad row must not end the job
                answers = None
                if len(rows) == 1:
                    return [(None, f"{type(e).__name__}: {e}")]
                half = len(rows) // 2
                return solved(rows.iloc[:half]) + solved(rows.iloc[half:])

        def checked(v) -> np.ndarray | None:
            v = np.asarray(v, dtype=np.float32).ravel()
            return v if len(v) == dim else None

        def given_back(texts: pd.Series) -> pa.Array:
            found: list[tuple] = [(None, None)] * len(texts)
            have = np.flatnonzero(texts.notna())
            for i, row in zip(have, solved(texts.iloc[have]) if len(have) else [], strict=True):
                found[i] = row
            return pa.StructArray.from_arrays([pa.array([v for v, _ in found], pa.list_(pa.float32())), pa.array([e for _, e in found], pa.string())], ["vector", "error"])

        for batch in batches:
            step = min(1024, max(1, len(batch) * _TEXT_AT_ONCE // max(1, batch.nbytes)))
            parts = [given_back(batch.slice(lo, step).to_pandas()) for lo in range(0, len(batch), step)]
            yield pa.concat_arrays(parts) if parts else given_back(batch.to_pandas())

    both = df.withColumn("found_", F.arrow_udf(run, "struct<vector:array<float>,error:string>")(F.col(col)))
    names = {out: F.col("found_.vector")} | ({errors: F.col("found_.error")} if errors else {})
    return both.withColumns(names).drop("found_")


def status_of(fatal: list[str]) -> Column:
    """Status of a file from its error columns: embedding its image, sound, text or metadata may fail without harm; of the others, named here, any error counts."""
    return F.when(F.coalesce(*(F.col(c) for c in fatal)).isNotNull(), "embed_failed").otherwise("indexed")


def decode_vectors(col: Column, dim: int) -> Column:
    """Little-endian float32 bytes to vector; another length gives null."""

    @F.pandas_udf("array<float>")
    def run(blobs: pd.Series) -> pd.Series:
        return blobs.map(lambda b: np.frombuffer(b, "<f4") if b is not None else None)

    return run(F.when(F.octet_length(col) == 4 * dim, col))


def encode_vectors(col: Column) -> Column:
    @F.pandas_udf("binary")
    def run(vectors: pd.Series) -> pd.Series:
        return vectors.map(lambda v: np.asarray(v, "<f4").tobytes() if v is not None else None)

    return run(col)
