"""Token ids in Arrow stream-files of fixed-size lists.

A folder holds one Arrow IPC file per task. Each row is one sequence of
``length`` ids (``fixed_size_list``) with a mask of the same shape that is false
on the padding of the file's last row. Batches hold equally many rows, so the
place of any id is arithmetic and a memory-mapped reader slices it without a
copy. Files follow each other in ascending document order; an index table holds
each document's file, first id and count.

Defined results: null text counts as empty and gives the end id alone; rows with
the same document id each get their own range, in the order of their texts; null
ids come first; other columns are ignored; an empty table gives an empty index.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import materialize, shared_dir
from .textscan import released, scan, slices, small_batches
from .tokenization import tokenizer

ROWS_PER_BATCH = 512


class TokenFileWriter:
    """Collects ids and writes full rows; memory stays within one batch."""

    def __init__(self, uri: str, length: int, dtype: np.dtype):
        self.fs, self.path = pafs.FileSystem.from_uri(uri)
        self.temp = f"{self.path}.{uuid.uuid4().hex}.tmp"
        kind = pa.from_numpy_dtype(dtype)
        self.schema = pa.schema([("ids", pa.list_(pa.field("item", kind, False), length)), ("mask", pa.list_(pa.field("item", pa.bool_(), False), length))])
        self.out = self.fs.open_output_stream(self.temp)
        self.file = pa.ipc.new_file(self.out, self.schema)
        self.length, self.dtype, self.held, self.n_held = length, dtype, [], 0

    def add(self, ids: np.ndarray) -> None:
        self.held.append(ids.astype(self.dtype))
        self.n_held += len(ids)
        size = self.length * ROWS_PER_BATCH
        if self.n_held >= size:
            flat = np.concatenate(self.held)
            whole = len(flat) // size * size
            for i in range(0, whole, size):
                self._write(flat[i : i + size], size)
            self.held, self.n_held = [flat[whole:]], len(flat) - whole

    def _write(self, flat: np.ndarray, n: int) -> None:
        rows = -(-len(flat) // self.length)
        padded = np.zeros(rows * self.length, self.dtype)
        padded[: len(flat)] = flat
        mask = np.arange(len(padded)) < n
        arrays = [pa.FixedSizeListArray.from_arrays(pa.array(a), type=f.type) for a, f in zip((padded, mask), self.schema, strict=True)]
        self.file.write_batch(pa.record_batch(arrays, schema=self.schema))

    def close(self) -> None:
        """Finish and move into place; a second attempt of the task writes the same bytes."""
        if self.n_held:
            self._write(np.concatenate(self.held), self.n_held)
        self.file.close()
        self.out.close()
        self.fs.move(self.temp, self.path)


class TokenFile:
    """Random access to one file's ids; memory-mapped where the store is a local path."""

    def __init__(self, uri: str):
        fs, path = pafs.FileSystem.from_uri(uri)
        self.source = pa.memory_map(path) if isinstance(fs, pafs.LocalFileSystem) else fs.open_input_file(path)
        self.file = pa.ipc.open_file(self.source)
        self.length = self.file.schema.field("ids").type.list_size

    def batch(self, k: int, column: str = "ids") -> np.ndarray:
        part = self.file.get_batch(k).column(column)
        return part.flatten().to_numpy(zero_copy_only=column == "ids")

    def sequence(self, row: int) -> np.ndarray:
        at = row % ROWS_PER_BATCH * self.length
        return self.batch(row // ROWS_PER_BATCH)[at : at + self.length]

    def ids(self, start: int, n: int) -> np.ndarray:
        size, out = self.length * ROWS_PER_BATCH, []
        while n > 0:
            k, at = divmod(start, size)
            out.append(self.batch(k)[at : at + n])
            start, n = start + len(out[-1]), n - len(out[-1])
        return out[0] if len(out) == 1 else np.concatenate(out) if out else np.zeros(0, np.uint32)

    def close(self) -> None:
        self.source.close()


def write_token_files(docs: DataFrame, tokenizer_path: str, end_id: int = 1, length: int = 2048, id_col: str = "doc_id", text_col: str = "text", uri: str | None = None) -> tuple[str, DataFrame]:
    """Tokenise all texts and write their ids in ascending document order.

    Returns the folder and the index (doc_id, file, first, n_tokens). Ids are two
    bytes wide where the vocabulary allows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    folder = uri or shared_dir(spark, "token-files")
    ordered = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        tok, out, total = tokenizer(tokenizer_path), None, 0
        for batch in released(batches):
            for piece in slices(batch, "text", 1 << 20):
                if out is None:
                    fs, path = pafs.FileSystem.from_uri(folder)
                    fs.create_dir(path, recursive=True)
                    out = TokenFileWriter(f"{folder}/part-{part:06d}.arrow", length, np.uint16 if tok.library.get_vocab_size() <= 1 << 16 else np.uint32)
                flat, at = tok.encode(scan(piece.column("text"), False))
                flat = np.insert(flat, at[1:], end_id)
                out.add(flat)
                n = np.diff(at) + 1
                first = total + np.cumsum(n) - n
                total += len(flat)
                yield pa.record_batch({"doc_id": piece.column("doc_id"), "file": pa.array([part] * len(n), pa.int32()), "first": pa.array(first), "n_tokens": pa.array(n)})
        if out is not None:
            out.close()

    return folder, materialize(ordered.mapInArrow(write, "doc_id long, file int, first long, n_tokens long"), "token-index")


def read_token_files(folder: str, index: DataFrame) -> DataFrame:
    """Per document: its ids read back from the files, and where they start over all documents."""
    base = index.groupBy("file").agg(F.sum("n_tokens").alias("n")).select("file", (F.sum("n").over(Window.orderBy("file")) - F.col("n")).alias("base"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened, name = None, None
        for batch in released(batches):
            ids, crc = [], []
            for file, first, n in zip(*(batch.column(c).to_pylist() for c in ("file", "first", "n_tokens")), strict=True):
                if file != name:
                    if opened:
                        opened.close()
                    opened, name = TokenFile(f"{folder}/part-{file:06d}.arrow"), file
                crc.append(zlib.crc32(opened.ids(first, n).astype("<u4").tobytes()))
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "file": batch.column("file"), "first": batch.column("first"), "n_tokens": batch.column("n_tokens"), "ids_crc32": pa.array(crc, pa.int64())})
        if opened:
            opened.close()

    digests = index.mapInArrow(read, "doc_id long, file int, first long, n_tokens long, ids_crc32 long")
    return digests.join(base, "file").select("doc_id", (F.col("base") + F.col("first")).alias("start"), "n_tokens", "ids_crc32")
