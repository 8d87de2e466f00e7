"""Best-fit packing of token sequences.

Bulk-synchronous best-fit over size classes: pieces and gaps are ordered by
size, and the supersteps run from the longest class to the shortest. In each,
all pieces of one length are matched at once by a sweep over the gaps that can
hold them, smallest first; pieces that want the same gap are told apart by their
rank within the class; the gaps shrink, and the next class follows. Pieces of
equal length are interchangeable, so the sweep needs only the number of pieces
of each length, which is at most ``capacity`` rows whatever the corpus holds.
Ranks and the join of pieces with their places run on all executors.

Defined results: null text counts as empty and packs its end id alone; rows with
the same document id are packed one by one; other columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import materialize
from .textscan import released, scan, slices, small_batches
from .tokenization import tokenizer

SALT = 32


def cut_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Tokenise and cut: one row per piece of at most ``capacity`` ids; only longer documents are cut."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(tokenizer_path)
        for batch in released(batches):
            for part in slices(batch, "text", 1 << 20):
                flat, at = tok.encode(scan(part.column("text"), False))
                flat = np.insert(flat, at[1:], end_id).astype("<u4")
                at = at + np.arange(len(at))
                n = -(-np.diff(at) // capacity)
                doc = np.repeat(np.arange(len(n)), n)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
                start = piece * capacity
                first = at[doc] + start
                last = np.minimum(first + capacity, at[doc + 1])
                crc = [zlib.crc32(flat[a:b].tobytes()) for a, b in zip(first, last, strict=True)]
                out = {"doc_id": part.column("doc_id").take(pa.array(doc)), "piece": pa.array(piece, pa.int32()), "start": pa.array(start, pa.int64()), "length": pa.array(last - first, pa.int64()), "ids_crc32": pa.array(crc, pa.int64())}
                if with_ids:
                    out["ids"] = pa.array([flat[a:b].astype(np.int32) for a, b in zip(first, last, strict=True)], pa.list_(pa.int32()))
                yield pa.record_batch(out)

    return rows.mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids)


def plan_places(classes: list[tuple[int, int]], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit over (length, number of pieces), longest first.

    Gaps are runs of sequences with the same room: room -> [(first sequence, how
    many)]. Returns (length, first rank, number, first sequence, pieces a sequence,
    offset): ranks in a row fill sequences in a row.
    """
    gaps: dict[int, list[tuple[int, int]]] = {}
    rooms: list[int] = []
    places, opened = [], 0

    def leave(room: int, first: int, n: int) -> None:
        if room and n:
            if room not in gaps:
                bisect.insort(rooms, room)
            gaps.setdefault(room, []).append((first, n))

    for length, left in sorted(classes, reverse=True):
        rank, at = 0, bisect.bisect_left(rooms, length)
        sweep = rooms[at:]
        while left:
            if sweep:
                room = sweep.pop(0)
                runs = gaps.pop(room)
                rooms.remove(room)
            else:
                room, each = capacity, capacity // length
                runs = [(opened, -(-left // each))]
                opened += runs[0][1]
            each = room // length
            for first, n in runs:
                full = min(n, left // each)
                if full:
                    places.append((length, rank, full * each, first, each, capacity - room))
                    leave(room - each * length, first, full)
                    rank, left = rank + full * each, left - full * each
                if full < n and left:  # fewer pieces than a sequence of this run would hold
                    places.append((length, rank, left, first + full, left, capacity - room))
                    leave(room - left * length, first + full, 1)
                    full, left = full + 1, 0
                leave(room, first + full, n - full)
    return places


def pack(pieces: DataFrame, capacity: int = 2048) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces that have a ``length`` from 1 to ``capacity``."""
    spark = pieces.sparkSession
    salted = pieces.withColumn("salt_", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(SALT)))
    groups = salted.groupBy("length", "salt_").count()
    # at most capacity * SALT rows, then at most capacity: bounded by the parameters
    before = groups.select("length", "salt_", (F.sum("count").over(Window.partitionBy("length").orderBy("salt_")) - F.col("count")).alias("before_"))
    classes = [(int(r[0]), int(r[1])) for r in groups.groupBy("length").agg(F.sum("count")).collect()]
    places = plan_places(classes, capacity)
    plan = spark.createDataFrame(places, "length long, rank0_ long, n_ long, seq0_ long, each_ long, offset0_ long")
    own = Window.partitionBy("length", "salt_").orderBy("doc_id", "piece")
    ranked = salted.withColumn("local_", F.row_number().over(own) - 1).join(F.broadcast(before), ["length", "salt_"]).withColumn("rank_", F.col("before_") + F.col("local_"))
    k = F.col("rank_") - F.col("rank0_")
    placed = ranked.join(F.broadcast(plan), "length").where((k >= 0) & (k < F.col("n_")))
    place = {"sequence_id": F.col("seq0_") + F.floor(k / F.col("each_")), "offset": F.col("offset0_") + k % F.col("each_") * F.col("length")}
    return placed.withColumns(place).select(*pieces.columns, "sequence_id", "offset")


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Tokenise, cut and pack a table of documents; see the module."""
    return pack(materialize(cut_pieces(docs, tokenizer_path, capacity, end_id, id_col, text_col, with_ids), "pieces"), capacity)
