"""Benchmark decontamination: n-gram seeds, then Smith-Waterman alignment.

Word n-grams of the test items are seeds. However frequent a seed is, each place in
a document where it matches is a window to align with the item (how often a seed
occurs doesn't tell whether the passage around it leaked into many copies): matches
count 2, mismatches and gaps -1, and the score is the share of the best possible.

Seeds are compared in the tasks that scan the text if they number at most
``max_local_seeds``; beyond that, n-grams and seeds meet in a shuffled join.

Defined results: null and empty texts, and texts or items of fewer than n words,
match nothing (an item of fewer words is one seed of its own length only if it has
n words); rows with a null id are left out; repeated rows give repeated findings
once per (doc_id, item_id); other columns are ignored; empty tables give an empty
result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import keep, materialize, scratch, small_side
from .textscan import ngrams, released, scan, slices, small_batches


@dataclass(frozen=True)
class LeakSpec:
    n: int = 3
    min_score: float = 0.5
    bucket: int = 32  # windows start at multiples of this many words
    pad: int = 12
    max_local_seeds: int = 2_000_000
    max_local_words: int = 5_000_000  # words of all items up to which they are sent to the tasks once, not with each window


MATCH, MISS, GAP = 2, -1, -1


def smith_waterman(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Local alignment of each row of ``a`` with the same row of ``b``; 0 is padding.

    Returns the best score and the ends (exclusive) in a and b of the first best cell.
    """
    rows, width = b.shape
    h = np.zeros((rows, width + 1), np.int32)
    best, end_a, end_b = np.zeros(rows, np.int32), np.zeros(rows, np.int32), np.zeros(rows, np.int32)
    ramp = np.arange(width + 1, dtype=np.int32) * -GAP
    for i in range(a.shape[1]):
        w = a[:, i : i + 1]
        step = h[:, :-1] + np.where((b == w) & (w != 0), MATCH, MISS)
        t = np.zeros_like(h)
        t[:, 1:] = np.maximum(np.maximum(step, h[:, 1:] + GAP), 0)
        h = np.maximum.accumulate(t + ramp, axis=1) - ramp  # gaps along the row
        at = h.argmax(axis=1)
        top = h[np.arange(rows), at]
        better = top > best
        best[better], end_a[better], end_b[better] = top[better], i + 1, at[better]
    return best, end_a, end_b


def padded(parts: list[np.ndarray]) -> np.ndarray:
    out = np.zeros((len(parts), max(map(len, parts))), np.uint64)
    for i, p in enumerate(parts):
        out[i, : len(p)] = p
    return out


def align(items: list[np.ndarray], windows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Share of the best possible score, and start and end of the match in the window."""
    best, end_a, end_b = smith_waterman(padded(items), padded(windows))
    # the same alignment read backwards from its end gives its start
    back = smith_waterman(padded([x[:e][::-1] for x, e in zip(items, end_a, strict=True)]), padded([x[:e][::-1] for x, e in zip(windows, end_b, strict=True)]))
    return best / (MATCH * np.array([len(x) for x in items])), end_b - back[2], end_b


def seeds_of(items: DataFrame, n: int) -> DataFrame:
    """(item_id, seed, item_pos, words) of (item_id, text); words are the item's word hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in released(batches):
            for part in slices(batch, "text"):
                words = scan(part.column("text"), True)
                h = words.hashes()
                grams, first = ngrams(words, h, n)
                owner = words.owner()[first] if len(first) else np.zeros(0, np.int64)
                whole = pa.LargeListArray.from_arrays(pa.array(words.offsets[:-1].tolist() + [len(h)], pa.int64()), pa.array(h.view(np.int64)))
                yield pa.record_batch({"item_id": part.column("item_id").take(pa.array(owner)), "seed": pa.array(grams.view(np.int64)), "item_pos": pa.array(first - words.offsets[owner], pa.int64()), "words": whole.take(pa.array(owner)).cast(pa.list_(pa.int64()))})

    return items.mapInArrow(run, "item_id long, seed long, item_pos long, words array<long>")


def hits_of(docs: DataFrame, seeds: DataFrame, spec: LeakSpec) -> DataFrame:
    """(doc_id, seed, pos): the places of documents (doc_id, text) where a seed starts."""
    distinct = seeds.select("seed").distinct()
    local = distinct.count() <= spec.max_local_seeds
    wanted = docs.sparkSession.sparkContext.broadcast(np.sort(np.array(distinct.toPandas()["seed"], np.int64).view(np.uint64)) if local else None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have = wanted.value
        for batch in released(batches):
            for part in slices(batch, "text"):
                words = scan(part.column("text"), True)
                grams, first = ngrams(words, words.hashes(), spec.n)
                if have is not None:
                    found = have[np.minimum(np.searchsorted(have, grams), len(have) - 1)] == grams if len(have) else np.zeros(len(grams), bool)
                    grams, first = grams[found], first[found]
                owner = np.searchsorted(words.offsets, first, "right") - 1
                yield pa.record_batch({"doc_id": part.column("doc_id").take(pa.array(owner)), "seed": pa.array(grams.view(np.int64)), "pos": pa.array(first - words.offsets[owner], pa.int64())})

    hits = docs.mapInArrow(run, "doc_id long, seed long, pos long")
    return hits if local else hits.join(distinct, "seed", "left_semi")


def find_leaks(docs: DataFrame, items: DataFrame, spec: LeakSpec = LeakSpec(), id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, score, start_word, end_word): the best alignment of each leaked item in each document, as a written table."""
    small_batches(docs.sparkSession)
    with scratch(docs.sparkSession):
        return keep(_found(docs, items, spec, id_col, text_col, item_id_col, item_text_col), "leaks")


def _found(docs: DataFrame, items: DataFrame, spec: LeakSpec, id_col: str, text_col: str, item_id_col: str, item_text_col: str) -> DataFrame:
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    own = items.where(F.col(item_id_col).isNotNull()).select(F.col(item_id_col).cast("long").alias("item_id"), F.coalesce(F.col(item_text_col), F.lit("")).alias("text")).dropDuplicates()
    seeds = materialize(seeds_of(own, spec.n), "seeds")
    hits = materialize(hits_of(rows, seeds, spec), "seed-hits")

    places = seeds.select("item_id", "seed", "item_pos")
    windows = hits.join(places, "seed").select("doc_id", "item_id", F.floor((F.col("pos") - F.col("item_pos")) / spec.bucket).alias("bucket")).distinct()
    item_words = seeds.groupBy("item_id").agg(F.first("words").alias("words"))
    item_words = materialize(item_words, "item-words")
    known = None
    if (item_words.agg(F.sum(F.size("words"))).first()[0] or 0) <= spec.max_local_words:
        known = {r["item_id"]: np.array(r["words"], np.int64).view(np.uint64) for r in item_words.collect()}
        windows = windows.withColumn("words", F.lit(None).cast("array<long>"))
    else:
        windows = windows.join(item_words, "item_id")
    items_of = docs.sparkSession.sparkContext.broadcast(known)
    # a row per document: its text travels once, and only where there is something to align
    by_doc = windows.groupBy("doc_id").agg(F.collect_list(F.struct("item_id", "bucket", "words")).alias("todo"))
    by_doc = materialize(by_doc, "windows")
    todo = rows.join(small_side(by_doc.select("doc_id")), "doc_id", "left_semi").join(by_doc, "doc_id").select("doc_id", "text", "todo")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_items = items_of.value
        for batch in released(batches):
            for part in slices(batch, "text", 1 << 20):
                words = scan(part.column("text"), True)
                h = words.hashes()
                parts, spans, first, places = [], [], [], []
                for i, todo_list in enumerate(part.column("todo").to_pylist()):
                    for t in todo_list:
                        item = np.array(t["words"], np.int64).view(np.uint64) if own_items is None else own_items[t["item_id"]]
                        a = max(0, t["bucket"] * spec.bucket - spec.pad)
                        z = (t["bucket"] + 1) * spec.bucket + len(item) + spec.pad
                        parts.append(item)
                        first.append(a)
                        places.append((i, t["item_id"]))
                        spans.append(h[words.offsets[i] + a : min(words.offsets[i] + z, words.offsets[i + 1])])
                order, out = np.argsort([len(p) for p in parts], kind="stable"), []
                for k in range(0, len(order), 256):  # rows of like length share a block
                    own = order[k : k + 256]
                    score, start, end = align([parts[i] for i in own], [spans[i] for i in own])
                    out += [(i, s, first[i] + x, first[i] + y) for i, s, x, y in zip(own, score, start, end, strict=True) if s >= spec.min_score]
                ids = part.column("doc_id").to_pylist()
                cols = [ids[places[o[0]][0]] for o in out], [places[o[0]][1] for o in out], [float(o[1]) for o in out], [int(o[2]) for o in out], [int(o[3]) for o in out]
                kinds = pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()
                names = ["doc_id", "item_id", "score", "start_word", "end_word"]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)

    aligned = todo.mapInArrow(run, "doc_id long, item_id long, score double, start_word long, end_word long")
    best = F.max(F.struct("score", (-F.col("start_word")).alias("s"), "start_word", "end_word"))
    return aligned.groupBy("doc_id", "item_id").agg(best.alias("b")).select("doc_id", "item_id", "b.score", "b.start_word", "b.end_word")


def decontaminate(docs: DataFrame, items: DataFrame, spec: LeakSpec = LeakSpec(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without those that hold a leaked item; rows with a null id stay."""
    leaks = find_leaks(docs, items, spec, id_col, text_col).select(F.col("doc_id").alias(id_col)).distinct()
    return docs.join(small_side(materialize(leaks, "leaks")), id_col, "left_anti")
