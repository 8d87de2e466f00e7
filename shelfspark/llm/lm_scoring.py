"""Interpolated modified Kneser-Ney language model, counted in Spark.

The model has order two. All bigrams and words of the training rows are counted:
tasks combine equal ones per slice of text, pack the sorted keys of each hash
range into a block, and a shuffle by range brings the blocks together. Each range
is stored as sorted hash arrays with counts; workers map them into memory, look
up the sorted keys of a slice of text by bisection, and never hold the model.

A bigram's key is the upper halves of its words' 64-bit hashes, so bigrams of a
context lie in a row; word counts use the whole hash. Discounts are those of Chen
and Goodman, from the counts of counts; the lower order uses continuation counts
and is interpolated with the uniform distribution over vocabulary and unknown.

Defined results: null text counts as empty and scores its end token; rows with a
null id are scored but never learned from, and count as held out; repeated rows
are learned and scored one by one; other columns are ignored; without training
rows the model score is that of a uniform distribution.
"""

from __future__ import annotations

import io
import os
import tempfile
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .language_id import held_out
from .storage import materialize, shared_dir
from .textscan import Words, released, scan, slices, small_batches

BEGIN, END = np.uint64(0x0123456789ABCDEF), np.uint64(0xFEDCBA9876543210)
MAX_OPEN = 2048  # mapped ranges of a table in a worker
_CODEC = pa.Codec("zstd", compression_level=1)
_HIGH, _32 = np.uint64(0xFFFFFFFF00000000), np.uint64(32)


def pack_block(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted keys as byte planes of their differences, then counts as byte planes, compressed."""
    steps = np.diff(keys, prepend=np.uint64(0))
    planes = [np.ascontiguousarray(a.view(np.uint8).reshape(-1, 8).T).tobytes() for a in (steps, counts.astype(np.uint64))]
    return len(keys).to_bytes(8, "little") + _CODEC.compress(b"".join(planes), asbytes=True)


def unpack_block(block: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = int.from_bytes(block[:8], "little")
    raw = np.frombuffer(_CODEC.decompress(block[8:], decompressed_size=16 * n, asbytes=True), np.uint8)
    steps, counts = (np.ascontiguousarray(raw[k * 8 * n : (k + 1) * 8 * n].reshape(8, n).T).view(np.uint64).ravel() for k in (0, 1))
    return np.cumsum(steps, dtype=np.uint64), counts


def tally(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, with the sums of their counts."""
    order = np.argsort(keys, kind="stable") if counts is not None else None
    s = keys[order] if counts is not None else np.sort(keys)
    first = np.flatnonzero(np.diff(s, prepend=s[:1] ^ np.uint64(1))) if len(s) else np.zeros(0, np.int64)
    n = np.diff(np.append(first, len(s))).astype(np.uint64) if counts is None else np.add.reduceat(counts[order], first) if len(s) else counts
    return s[first], n


def sequence(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's begin mark, words and end token in a row, and where each text starts."""
    n = words.counts()
    at = words.offsets[:-1] + 2 * np.arange(len(n))
    out = np.empty(len(words) + 2 * len(n), np.uint64)
    place = np.ones(len(out), bool)
    place[at] = place[at + n + 1] = False
    out[place] = words.hashes()
    out[at], out[at + n + 1] = BEGIN, END
    return out, np.append(at, len(out))


def bigram_keys(h: np.ndarray) -> np.ndarray:
    return (h[:-1] & _HIGH) | (h[1:] >> _32)


def save(uri: str, **arrays: np.ndarray) -> None:
    fs, path = pafs.FileSystem.from_uri(uri)
    fs.create_dir(path, recursive=True)
    for name, array in arrays.items():
        data = io.BytesIO()
        np.save(data, array)
        with fs.open_output_stream(f"{path}/{name}.npy.part") as out:
            out.write(data.getbuffer())
        fs.move(f"{path}/{name}.npy.part", f"{path}/{name}.npy")


def load(uri: str, name: str) -> np.ndarray:
    """Map an array into memory; from a store without local paths it is copied to the worker's own disk first."""
    fs, path = pafs.FileSystem.from_uri(uri)
    path = f"{path}/{name}.npy"
    if not isinstance(fs, pafs.LocalFileSystem):
        own = os.path.join(tempfile.gettempdir(), "shelfspark-lm" + path.replace("/", "-"))
        if not os.path.exists(own):
            with fs.open_input_stream(path) as src, open(f"{own}.{os.getpid()}", "wb") as out:
                while data := src.read(1 << 20):
                    out.write(data)
            os.replace(f"{own}.{os.getpid()}", own)
        path = own
    return np.load(path, mmap_mode="r")


@dataclass
class HashArrays:
    """Sorted keys in 2**bits ranges by their upper bits, each with arrays of values."""

    uri: str
    bits: int
    parts: frozenset[int]
    names: tuple[str, ...]
    opened: dict = field(default_factory=dict)  # the ranges used last

    def __getstate__(self):
        return self.__dict__ | {"opened": {}}

    def lookup(self, keys: np.ndarray) -> list[np.ndarray]:
        """Values of sorted distinct keys; 0 where a key is absent."""
        out = [np.zeros(len(keys), np.float64) for _ in self.names]
        part = (keys >> np.uint64(64 - self.bits)).astype(np.int64)
        cuts = np.flatnonzero(np.diff(part, prepend=-1))
        for a, b in zip(cuts, [*cuts[1:], len(keys)], strict=True):
            p = int(part[a])
            if p not in self.parts:
                continue
            self.opened[p] = self.opened.pop(p, None) or [load(f"{self.uri}/{p}", n) for n in ("keys", *self.names)]
            if len(self.opened) > MAX_OPEN:  # a process may map so many files only
                del self.opened[next(iter(self.opened))]
            have, *values = self.opened[p]
            at = np.minimum(np.searchsorted(have, keys[a:b]), len(have) - 1)
            hit = have[at] == keys[a:b]
            for o, v in zip(out, values, strict=True):
                o[a:b] = np.where(hit, v[at], 0)
        return out


def discounts(n: list[int]) -> np.ndarray:
    """D1, D2, D3+ of Chen and Goodman from the numbers of keys counted once to four times; index 0 is 0."""
    n1, n2, n3, n4 = (max(1, x) for x in n)
    y = n1 / (n1 + 2 * n2)
    return np.array([0.0, *(float(np.clip(d, 0.01, k - 0.01)) for k, d in ((1, 1 - 2 * y * n2 / n1), (2, 2 - 3 * y * n3 / n2), (3, 3 - 4 * y * n4 / n3)))])


@dataclass
class KneserNey:
    """Arrays of the model and its few totals."""

    words: HashArrays  # whole hash -> count
    bigrams: HashArrays  # key -> count
    contexts: HashArrays  # upper half -> total, n1, n2, n3
    follows: HashArrays  # upper half -> number of distinct words before
    tokens: int
    vocabulary: int
    types: int  # distinct bigrams
    d2: np.ndarray
    d1: np.ndarray
    spread: float  # mass of the lower order left to the uniform distribution

    def score(self, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per text: known tokens, base score, model score (log10)."""
        h, at = sequence(words)
        inner = np.ones(len(h), bool)
        inner[at[:-1]] = False  # begin marks are no tokens
        token, token_of = np.unique(h[inner], return_inverse=True)
        count = self.words.lookup(token)[0]
        half, half_of = np.unique(token & _HIGH, return_inverse=True)
        before = self.follows.lookup(half)[0][half_of]
        low = (np.maximum(before - self.d1[np.minimum(before, 3).astype(int)], 0) / max(self.types, 1)) + self.spread / (self.vocabulary + 1)
        key, key_of = np.unique(bigram_keys(h)[inner[1:]], return_inverse=True)
        c = self.bigrams.lookup(key)[0]
        context, context_of = np.unique(key & _HIGH, return_inverse=True)
        total, n1, n2, n3 = self.contexts.lookup(context)
        seen = total > 0
        back = np.where(seen, (self.d2[1] * n1 + self.d2[2] * n2 + self.d2[3] * n3) / np.maximum(total, 1), 1.0)
        high = np.maximum(c - self.d2[np.minimum(c, 3).astype(int)], 0) / np.maximum(total, 1)[context_of]
        p = high[key_of] + back[context_of][key_of] * low[token_of]
        base = np.log10((count + 0.1) / (self.tokens + 0.1 * (self.vocabulary + 1)))[token_of]
        starts = at[:-1] - np.arange(len(at) - 1)  # without the begin marks
        return (np.add.reduceat(a, starts) for a in ((count > 0)[token_of].astype(np.int64), base, np.log10(p)))


def blocks(batches: Iterator[pa.RecordBatch], keys_of, bits: int) -> Iterator[pa.RecordBatch]:
    """One row per range for each slice of text: its keys and counts, packed."""
    for batch in released(batches):
        for part in slices(batch, "text", min(32, 4 << max(0, bits - 10)) << 20):  # more ranges, larger slices: blocks stay worth packing
            keys, counts = tally(keys_of(scan(part.column("text"), True)))
            cuts = np.searchsorted(keys, np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits))
            rows = [(p, pack_block(keys[a:b], counts[a:b])) for p, (a, b) in enumerate(zip(cuts, [*cuts[1:], len(keys)], strict=True)) if b > a]
            yield pa.record_batch({"part": pa.array([r[0] for r in rows], pa.int32()), "block": pa.array([r[1] for r in rows], pa.binary())})


def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Ranges of a task, which come sorted by range: (range, keys, counts)."""
    part, held, size = None, [], 0

    def fold() -> tuple[np.ndarray, np.ndarray]:
        return tally(np.concatenate([k for k, _ in held]), np.concatenate([c for _, c in held]))

    for batch in released(batches):
        for p, block in zip(batch.column("part").to_pylist(), batch.column("block"), strict=True):
            if p != part and held:
                yield part, *fold()
                held, size = [], 0
            part = p
            held.append(unpack_block(block.as_py()))
            size += len(held[-1][0])
            if size > 4_000_000 and len(held) > 1:  # equal keys meet early
                held = [fold()]
                size = 0
    if held:
        yield part, *fold()


def count_words(train: DataFrame, uri: str, bits: int) -> DataFrame:
    """Store word counts by range; returns (part, tokens, words)."""

    def keys(words: Words) -> np.ndarray:
        return np.append(words.hashes(), np.full(len(words.offsets) - 1, END, np.uint64))

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p, k, c in merged(batches):
            save(f"{uri}/{p}", keys=k, count=c.astype(np.uint32 if c.max() < 1 << 32 else np.uint64))
            yield pa.record_batch({"part": pa.array([p], pa.int32()), "tokens": pa.array([int(c.sum())]), "words": pa.array([len(k)])})

    packed = train.mapInArrow(lambda b: blocks(b, keys, bits), "part int, block binary")
    return packed.repartition("part").sortWithinPartitions("part").mapInArrow(store, "part int, tokens long, words long")


def count_bigrams(train: DataFrame, uri: str, bits: int) -> DataFrame:
    """Store bigram counts and context totals by range; returns (part, c1..c4, types) and rows (part, word, before)."""

    def keys(words: Words) -> np.ndarray:
        h, at = sequence(words)
        within = np.ones(max(0, len(h) - 1), bool)
        within[at[1:-1] - 1] = False  # an end and the next text's begin are no bigram
        return bigram_keys(h)[within]

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p, k, c in merged(batches):
            save(f"{uri}/bigrams/{p}", keys=k, count=c.astype(np.uint16 if c.max() < 1 << 16 else np.uint32 if c.max() < 1 << 32 else np.uint64))
            context = k & _HIGH
            first = np.flatnonzero(np.diff(context, prepend=context[:1] ^ np.uint64(1 << 32)))
            sums = {"total": np.add.reduceat(c, first)} | {f"n{i}": np.add.reduceat((c == i if i < 3 else c > 2).astype(np.uint32), first) for i in (1, 2, 3)}
            save(f"{uri}/contexts/{p}", keys=context[first], **sums)
            word, before = tally(k << _32)
            of_counts = [int((c == i).sum()) for i in (1, 2, 3, 4)]
            cuts = np.searchsorted(word, np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits))
            rows = [(q, pack_block(word[a:b], before[a:b])) for q, (a, b) in enumerate(zip(cuts, [*cuts[1:], len(word)], strict=True)) if b > a]
            n = len(rows)
            out = {"part": pa.array([r[0] for r in rows], pa.int32()), "block": pa.array([r[1] for r in rows], pa.binary()), "own": pa.array([p] * n, pa.int32())}
            yield pa.record_batch(out | {f"c{i}": pa.array([v if j == 0 else 0 for j in range(n)], pa.int64()) for i, v in enumerate([*of_counts, len(k)])})

    packed = train.mapInArrow(lambda b: blocks(b, keys, bits), "part int, block binary")
    return packed.repartition("part").sortWithinPartitions("part").mapInArrow(store, "part int, block binary, own int, c0 long, c1 long, c2 long, c3 long, c4 long")


def count_follows(rows: DataFrame, uri: str) -> DataFrame:
    """Store, per word, the number of distinct words before it; returns (part, counts of counts)."""

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p, k, c in merged(batches):
            save(f"{uri}/{p}", keys=k, count=c.astype(np.uint32))
            spare = [int((c == i).sum()) for i in (1, 2, 3, 4)] + [int((c > 2).sum())]
            yield pa.record_batch({"part": pa.array([p], pa.int32())} | {f"c{i}": pa.array([v]) for i, v in enumerate(spare)})

    return rows.select("part", "block").repartition("part").sortWithinPartitions("part").mapInArrow(store, "part int, c0 long, c1 long, c2 long, c3 long, c4 long")


def range_bits(n_bytes: int) -> int:
    """Bits for about 32 MB of text to a hash range, from 7 to 17 (4 TB; beyond that give ``bits``)."""
    return max(7, min(17, (n_bytes >> 25).bit_length()))


def train_model(train: DataFrame, bits: int | None = None, uri: str | None = None) -> KneserNey:
    """Count the rows' texts (column ``text``) and store the arrays below ``uri``.

    ``bits`` sets 2**bits hash ranges; a task holds one range at a time, so by
    default it grows with the input.
    """
    if bits is None:
        bits = range_bits(train.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    uri = uri or shared_dir(train.sparkSession, "kneser-ney")
    words = count_words(train, f"{uri}/words", bits).collect()  # a row a range
    bigrams = materialize(count_bigrams(train, uri, bits), "follows")
    totals = bigrams.agg(*(F.sum(f"c{i}") for i in range(5))).first()
    own = [r[0] for r in bigrams.select("own").distinct().collect()]
    low = count_follows(bigrams, f"{uri}/follows").collect()
    c2, types = [x or 0 for x in totals[:4]], totals[4] or 0
    c1 = [sum(r[f"c{i}"] for r in low) for i in range(5)]
    d1, d2 = discounts(c1[:4]), discounts(c2)
    spread = (d1[1] * c1[0] + d1[2] * c1[1] + d1[3] * c1[4]) / types if types else 1.0
    arrays = lambda name, parts, *names: HashArrays(f"{uri}/{name}", bits, frozenset(parts), names)
    return KneserNey(
        arrays("words", [r["part"] for r in words], "count"), arrays("bigrams", own, "count"), arrays("contexts", own, "total", "n1", "n2", "n3"), arrays("follows", [r["part"] for r in low], "count"),
        sum(r["tokens"] for r in words), sum(r["words"] for r in words), types, d2, d1, spread,
    )


def score(docs: DataFrame, model: KneserNey) -> DataFrame:
    """(doc_id, n_tokens, n_known, base_score, score) for rows of (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in released(batches):
            for part in slices(batch, "text"):
                words = scan(part.column("text"), True)
                known, base, own = model.score(words)
                yield pa.record_batch({"doc_id": part.column("doc_id"), "n_tokens": pa.array(words.counts() + 1), "n_known": pa.array(known), "base_score": pa.array(base), "score": pa.array(own)})

    return docs.mapInArrow(run, "doc_id long, n_tokens long, n_known long, base_score double, score double")


def lm_scores(docs: DataFrame, folds: int = 10, bits: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Learn from the rows that are not held out, score all, and add perplexity."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    model = train_model(rows.where(~held_out("doc_id", folds)).select("text"), bits)
    return score(rows, model).select(
        "doc_id", held_out("doc_id", folds).alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score",
        F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"),
    )
