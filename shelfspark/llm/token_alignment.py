"""Alignment of two tokenizers over a corpus, with counts of the id pairs that end together.

Each text is cut by a byte-level tokenizer A (over blank + text) and a SentencePiece
tokenizer B (which adds the blank itself). Byte offsets where tokens of both end cut
the tokens into groups; as every token has at least one byte, each such offset links
one A token with one B token.

First pass: tasks align their documents and add up the linked id pairs they meet. The
distinct pairs get a minimal perfect hash, built for buckets of B ids in tasks of their
own (levels of bit tables; keys that collide go on to the next level). The counts of
the tasks become dense vectors indexed by the hash, summed in a tree: leaves hold some
tasks each, the root of a bucket adds the leaves and marks the highest counts of each
B id. Buckets are written as files with their keys, against which every look-up is
verified. Second pass: documents are aligned again and look their pairs up; a worker
reads the buckets it needs and holds at most ``BUCKET_BYTES`` of them.

Neither tokenizer joins anything across the start of a run of white space behind other
text (checked for B against its pieces, and for A by leaving alone runs that other
Unicode spaces touch), so texts are cut there, and each worker keeps the alignments of
chunks that it has met, up to ``MEMO_BYTES``.

Defined results: null and empty texts, and texts whose tokens do not spell blank +
text in either tokenizer, have no tokens and no groups; strings of special tokens are
plain text; repeated rows count one by one; other columns are ignored; an empty table
gives an empty one.
"""

from __future__ import annotations

import io
import os
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, fields

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import discard, materialize, scratch, shared_dir
from .textscan import Words, mix, released, slices, small_batches
from .tokenization import Memo

MEMO_BYTES = 96 << 20
BUCKET_BYTES = 32 << 20
BUCKET_KEYS = 4096
#: Distinct pairs that a task holds before it hands them on.
HELD_PAIRS = 1 << 18
_BLANK_MARK = "▁"
_SPACES = np.zeros(256, bool)
_SPACES[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x1C, 0x1D, 0x1E, 0x1F]] = True
_open: dict[tuple[str, str], "Aligner"] = {}


@dataclass
class Learned:
    """Alignments of some chunks: counts of each, and links and groups (as text, a semicolon behind each) of all in a row."""

    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    links: np.ndarray
    n_bytes: np.ndarray
    text: np.ndarray
    plain: np.ndarray

    @classmethod
    def joined(cls, parts: list["Learned"]) -> "Learned":
        return cls(*(np.concatenate([getattr(p, f.name) for p in parts]) for f in fields(cls)))

    @classmethod
    def unspelt(cls) -> "Learned":
        """One chunk that the tokens don't spell."""
        none = np.zeros(1, np.int64)
        return cls(none, none, none, np.zeros(0, np.int64), none, np.zeros(0, np.uint8), np.zeros(1, bool))


def pair_keys(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a.astype(np.int64) << 32 | b.astype(np.int64)


class Aligner:
    """Both tokenizers, and what is known of the chunks met so far."""

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer, pre_tokenizers

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        printable = {c: b for b, c in zip(range(256), _byte_characters(pre_tokenizers.ByteLevel), strict=True)}
        a_bytes = [bytes(printable[c] for c in s) if (s := self.a.id_to_token(i)) is not None and all(c in printable for c in s) else b"" for i in range(self.a.get_vocab_size())]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        plain = [not (self.b.is_control(i) or self.b.is_unknown(i)) for i in range(len(pieces))]
        b_bytes = [b"" if not ok else bytes([int(s[3:5], 16)]) if self.b.is_byte(i) else s.replace(_BLANK_MARK, " ").encode() for i, (s, ok) in enumerate(zip(pieces, plain, strict=True))]
        self.tables = [(np.frombuffer(b"".join(t), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in t])])) for t in (a_bytes, b_bytes)]
        spelt = [f"{i}{c}".encode() for i in range(max(len(a_bytes), len(b_bytes))) for c in ",|;"]
        self.spellings = np.frombuffer(b"".join(spelt), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in spelt])])
        starts = [c for c in " \t\n\x0b\x0c\r" if not any(re.search(rf"[^{c}]{c}", s.replace(_BLANK_MARK, " ")) for s, ok in zip(pieces, plain, strict=True) if ok)]
        self.cut = np.zeros(256, bool)
        self.cut[[ord(c) for c in starts]] = True
        self.counts, self.lookup = None, None
        self.reset()

    def reset(self) -> None:
        self.memo = Memo(MEMO_BYTES, n_a=np.int32, n_b=np.int32, n_groups=np.int32, first_link=np.int64, first_byte=np.int64, n_bytes=np.int64, plain=np.bool_, best=np.int64, total=np.int64)
        self.links, self.text = np.zeros(0, np.int64), np.zeros(0, np.uint8)

    def chunks(self, texts: pa.Array) -> Words:
        """Chunks of blank + text; null and empty texts have none."""
        texts = texts.cast(pa.large_string())
        texts = pc.if_else(pc.equal(pc.fill_null(pc.binary_length(texts), 0), 0), pa.scalar("", pa.large_string()), pc.binary_join_element_wise(pa.scalar("", pa.large_string()), pc.fill_null(texts, ""), pa.scalar(" ", pa.large_string())))
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        raw = texts.buffers()[2]
        data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw and len(texts) else np.zeros(0, np.uint8)
        offsets = offsets - offsets[0]
        begins = self.cut[data]
        begins[1:] &= ~_SPACES[data[:-1]]
        at = np.flatnonzero(begins)
        at = at[at >= 3]
        one, two, three = data[at - 1], data[at - 2], data[at - 3]  # Unicode spaces before the run: the run is theirs too
        wide = (two == 0xC2) & ((one == 0x85) | (one == 0xA0)) | (three == 0xE1) & ((two == 0x9A) | (two == 0xA0)) | (three == 0xE3) & (two == 0x80) & (one == 0x80) | (three == 0xEF) & (two == 0xBB)
        wide |= (three == 0xE2) & ((two == 0x80) & ((one <= 0x8F) | (one >= 0xA8) & (one <= 0xAF)) | (two == 0x81) & (one >= 0x9F) & (one <= 0xAF))
        begins[at[wide]] = False
        begins[offsets[:-1][np.diff(offsets) > 0]] = True
        starts = np.flatnonzero(begins)
        return Words(data, starts, np.append(starts[1:], len(data)) if len(starts) else starts, np.searchsorted(starts, offsets))

    def _spell(self, which: int, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of the tokens, and where each ends."""
        table, offsets = self.tables[which]
        size = offsets[ids + 1] - offsets[ids]
        ends = np.cumsum(size)
        return table[np.repeat(offsets[ids] - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)], ends

    def _learn(self, chunks: list[bytes]) -> "Learned":
        """Alignments of the chunks, tokenised in a row; halves where the tokens don't spell what was given."""
        joined = b"".join(chunks)
        text = joined.decode("utf-8", "replace")
        a = np.array(self.a.encode(text, add_special_tokens=False).ids, np.int64)
        b = np.array(self.b.encode("a" + text), np.int64)  # a letter parts the blank that B adds from the first chunk
        spelt_a, ends_a = self._spell(0, a)
        spelt_b, ends_b = self._spell(1, b)
        bounds = np.cumsum([len(c) for c in chunks])
        head = int(np.searchsorted(ends_b, 2, "right"))
        cut = np.append(ends_b[:head], 0)[max(head - 1, 0)]
        if spelt_a.tobytes() != joined or cut != 2 or spelt_b[2:].tobytes() != joined or not (np.isin(bounds, ends_a).all() and np.isin(bounds, ends_b - 2).all()):
            if len(chunks) == 1:
                return self._learn_alone(chunks[0])
            half = len(chunks) // 2
            return Learned.joined([self._learn(chunks[:half]), self._learn(chunks[half:])])
        return self._grouped(a, ends_a, b[head:], ends_b[head:] - 2, bounds)

    def _learn_alone(self, chunk: bytes) -> "Learned":
        """One chunk by itself: it begins with the blank that B adds, unless it was cut at other white space."""
        text = chunk.decode("utf-8", "replace")
        if not text.startswith(" "):
            return Learned.unspelt()
        a = np.array(self.a.encode(text, add_special_tokens=False).ids, np.int64)
        b = np.array(self.b.encode(text[1:]), np.int64)
        (spelt_a, ends_a), (spelt_b, ends_b) = self._spell(0, a), self._spell(1, b)
        if spelt_a.tobytes() != chunk or spelt_b.tobytes() != chunk:
            return Learned.unspelt()
        return self._grouped(a, ends_a, b, ends_b, np.array([len(chunk)]))

    def _grouped(self, a: np.ndarray, ends_a: np.ndarray, b: np.ndarray, ends_b: np.ndarray, bounds: np.ndarray) -> "Learned":
        common, at_a, at_b = np.intersect1d(ends_a, ends_b, assume_unique=True, return_indices=True)
        upto_a, upto_b, upto = (np.searchsorted(e, bounds, "right") for e in (ends_a, ends_b, common))
        text, n_bytes = np.zeros(0, np.uint8), np.zeros(len(bounds), np.int64)
        if self.counts:  # groups are written in the second pass only
            group_a, group_b = np.searchsorted(at_a, np.arange(len(a))), np.searchsorted(at_b, np.arange(len(b)))
            order_a = np.arange(len(a)) + np.append(0, at_b + 1)[group_a]  # an A token stands behind the B tokens of the groups before its own
            order_b = np.arange(len(b)) + (at_a + 1)[group_b]
            last_a, last_b = np.isin(np.arange(len(a)), at_a), np.isin(np.arange(len(b)), at_b)
            token = np.empty(len(a) + len(b), np.int64)
            token[order_a], token[order_b] = 3 * a + np.where(last_a, 1, 0), 3 * b + np.where(last_b, 2, 0)
            table, offsets = self.spellings
            size = offsets[token + 1] - offsets[token]
            ends = np.cumsum(size)
            text = table[np.repeat(offsets[token] - ends + size, size) + np.arange(ends[-1])]
            close = ends[upto_a + upto_b - 1]  # just behind the semicolon of a chunk's last group
            n_bytes = np.diff(close, prepend=0)
        return Learned(np.diff(upto_a, prepend=0), np.diff(upto_b, prepend=0), np.diff(upto, prepend=0), pair_keys(a[at_a], b[at_b]), n_bytes, text, np.ones(len(bounds), bool))

    def known(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """Sorted distinct hashes of the chunks, all of them in the memo now, and each chunk's place among them."""
        hashes, first, inverse = np.unique(words.hashes(), return_index=True, return_inverse=True)
        new = self.memo.missing(hashes, self.links.nbytes + self.text.nbytes)
        if not len(self.memo.keys):
            self.links, self.text = np.zeros(0, np.int64), np.zeros(0, np.uint8)
        if len(new):
            chunks, parts, at = [words.text(i) for i in first[new]], [], 0
            ends = np.cumsum([len(c) for c in chunks])
            while at < len(chunks):  # some kilobytes at once, or one longer chunk
                to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + (1 << 14), "right")))
                parts.append(self._learn(chunks[at:to]))
                at = to
            found = Learned.joined(parts)
            best, total = np.zeros(len(chunks), np.int64), np.zeros(len(chunks), np.int64)
            if self.lookup:
                count, top = self.lookup.get(found.links)
                owner = np.repeat(np.arange(len(chunks)), found.n_groups)
                best = np.bincount(owner, top, len(chunks)).astype(np.int64)
                np.add.at(total, owner, count)
            self.memo.add(
                hashes[new], n_a=found.n_a, n_b=found.n_b, n_groups=found.n_groups, first_link=len(self.links) + np.cumsum(found.n_groups) - found.n_groups,
                first_byte=len(self.text) + np.cumsum(found.n_bytes) - found.n_bytes, n_bytes=found.n_bytes, plain=found.plain, best=best, total=total,
            )
            if not self.counts:
                self.links = np.concatenate([self.links, found.links])
            self.text = np.concatenate([self.text, found.text])
        return hashes, inverse

    def spelt(self, words: Words, hashes: np.ndarray, inverse: np.ndarray) -> np.ndarray:
        """Whether each text has tokens: it has chunks, and the tokens spell all of them."""
        wrong = np.concatenate([[0], np.cumsum(~self.memo.get(hashes, "plain")[inverse])])[words.offsets]
        return (np.diff(wrong) == 0) & (words.counts() > 0)


def _byte_characters(byte_level) -> list[str]:
    """The character that stands for each byte in byte-level vocabularies."""
    alphabet = set(byte_level.alphabet())
    kept = [chr(b) if chr(b) in alphabet else None for b in range(256)]
    rest = iter(sorted(c for c in alphabet if ord(c) > 255))
    return [c or next(rest) for c in kept]


def aligner(a_path: str, b_path: str, counts: tuple[str, int] | None = None) -> Aligner:
    """The worker's aligner; what it keeps of chunks holds for one table of counts (folder and buckets)."""
    if (a_path, b_path) not in _open:
        _open[a_path, b_path] = Aligner(a_path, b_path)
    found = _open[a_path, b_path]
    if found.counts != counts:
        found.reset()
        found.counts, found.lookup = counts, PairCounts(*counts) if counts else None
    return found


class PerfectHash:
    """Minimal perfect hash of distinct keys: bit tables by level, ranked by their set bits; the last few keys are sorted."""

    LEVELS, ROOM = 24, 1.6

    def __init__(self, levels: list[np.ndarray], rest: np.ndarray):
        self.levels, self.rest = levels, rest
        self.ranks = [np.cumsum(bits) - bits for bits in (x.astype(np.int64) for x in levels)]
        self.bases = np.concatenate([[0], np.cumsum([int(x.sum()) for x in levels])]).astype(np.int64)

    def __len__(self) -> int:
        return int(self.bases[-1]) + len(self.rest)

    @staticmethod
    def place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mix(keys.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15 * (level + 1) % (1 << 64))) % np.uint64(size)).astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray) -> "PerfectHash":
        levels = []
        for level in range(cls.LEVELS):
            if not len(keys):
                break
            size = int(len(keys) * cls.ROOM) + 1
            at = cls.place(keys, level, size)
            alone = np.bincount(at, minlength=size) == 1
            levels.append(alone)
            keys = keys[~alone[at]]
        return cls(levels, np.sort(keys))

    def index(self, keys: np.ndarray) -> np.ndarray:
        """The key's number; for anything else some number or -1, so callers compare keys."""
        out, open_ = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, bits in enumerate(self.levels):
            at = self.place(keys[open_], level, len(bits))
            hit = bits[at]
            out[open_[hit]] = self.bases[level] + self.ranks[level][at[hit]]
            open_ = open_[~hit]
        if len(self.rest) and len(open_):
            at = np.minimum(np.searchsorted(self.rest, keys[open_]), len(self.rest) - 1)
            hit = self.rest[at] == keys[open_]
            out[open_[hit]] = self.bases[-1] + at[hit]
        return out

    def arrays(self) -> dict[str, np.ndarray]:
        return {"sizes": np.array([len(x) for x in self.levels], np.int64), "bits": np.packbits(np.concatenate([*self.levels, np.zeros(0, bool)])), "rest": self.rest}

    @classmethod
    def load(cls, held) -> "PerfectHash":
        bits, levels, at = np.unpackbits(held["bits"]).astype(bool), [], 0
        for size in held["sizes"].tolist():
            levels.append(bits[at : at + size])
            at += size
        return cls(levels, held["rest"])


def _write(uri: str, **arrays: np.ndarray) -> None:
    """Write the arrays beside their place and move them there; a second attempt of the task writes the same."""
    fs, path = pafs.FileSystem.from_uri(uri)
    fs.create_dir(os.path.dirname(path), recursive=True)
    held = io.BytesIO()
    np.savez(held, **arrays)
    temp = f"{path}.{uuid.uuid4().hex}"
    with fs.open_output_stream(temp) as out:
        out.write(held.getvalue())
    fs.move(temp, path)


def _read(uri: str) -> dict[str, np.ndarray]:
    fs, path = pafs.FileSystem.from_uri(uri)
    with fs.open_input_stream(path) as f:
        return dict(np.load(io.BytesIO(f.read())))


class PairCounts:
    """Counts of pairs in written buckets; holds at most ``BUCKET_BYTES`` of them, those used last."""

    def __init__(self, folder: str, buckets: int):
        self.folder, self.buckets, self.held, self.size = folder, buckets, {}, 0

    def bucket(self, k: int) -> tuple[PerfectHash, dict[str, np.ndarray]]:
        if k in self.held:
            self.held[k] = self.held.pop(k)
        else:
            found = _read(f"{self.folder}/counts-{k:06d}.npz")
            self.held[k] = PerfectHash.load(found), found
            self.size += sum(x.nbytes for x in found.values())
            while self.size > BUCKET_BYTES and len(self.held) > 1:
                _, old = self.held.pop(next(iter(self.held)))
                self.size -= sum(x.nbytes for x in old.values())
        return self.held[k]

    def get(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Count of each key, and whether its B id has no higher one; a key that was never counted has 0."""
        count, top = np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        of = (keys & 0xFFFFFFFF) % self.buckets
        order = np.argsort(of, kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(of[order])) + 1) if len(keys) else ():
            hashed, found = self.bucket(int(of[part[0]]))
            at = hashed.index(keys[part])
            here = (at >= 0) & (found["keys"][at] == keys[part])
            count[part[here]], top[part[here]] = found["counts"][at[here]], found["top"][at[here]]
        return count, top


class _Sums:
    """Sorted keys and their sums, merged now and then."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> bool:
        """Whether there are more keys now than are to be held."""
        self.parts.append((keys, counts))
        self.size += len(keys)
        if len(self.parts) >= 64 or self.size > 2 * HELD_PAIRS:
            self.parts = [self.merged()]
            self.size = len(self.parts[0][0])
        return len(self.parts) == 1 and self.size > HELD_PAIRS

    def merged(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.parts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        keys, inverse = np.unique(np.concatenate([k for k, _ in self.parts]), return_inverse=True)
        sums = np.zeros(len(keys), np.int64)
        np.add.at(sums, inverse, np.concatenate([n for _, n in self.parts]))
        return keys, sums

    def take(self) -> pa.RecordBatch:
        keys, counts = self.merged()
        self.parts, self.size = [], 0
        return pa.record_batch({"key": pa.array(keys), "n": pa.array(counts), "task": pa.array(np.full(len(keys), TaskContext.get().partitionId(), np.int32))})


def pair_counts(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """(key, n, task): linked pairs of the documents of each task; ``key`` is A's id times 2^32 plus B's."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool, sums = aligner(a_path, b_path), _Sums()
        for batch in released(batches):
            for part in slices(batch, "text", 1 << 20):
                words = tool.chunks(part.column("text"))
                hashes, inverse = tool.known(words)
                times = np.bincount(inverse[tool.spelt(words, hashes, inverse)[words.owner()]], minlength=len(hashes))
                n_links, first = tool.memo.get(hashes, "n_groups").astype(np.int64) * (times > 0), tool.memo.get(hashes, "first_link")
                ends = np.cumsum(n_links)
                flat = tool.links[np.repeat(first - ends + n_links, n_links) + np.arange(ends[-1] if len(ends) else 0)]
                keys, back = np.unique(flat, return_inverse=True)
                if sums.add(keys, np.bincount(back, np.repeat(times, n_links), len(keys)).astype(np.int64)):
                    yield sums.take()
        yield sums.take()

    return docs.select(F.col("text")).mapInArrow(run, "key long, n long, task int")


def _runs(batches: Iterator[pa.RecordBatch], names: tuple[str, ...]) -> Iterator[tuple[tuple, list[pa.RecordBatch]]]:
    """Consecutive rows with equal values of the named columns, as slices of their batches; rows come sorted by these."""
    key, held = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(c).to_numpy(zero_copy_only=False) for c in names]
        edges = np.flatnonzero(np.any([np.diff(c) != 0 for c in columns], axis=0)) + 1
        for lo, hi in zip([0, *edges.tolist()], [*edges.tolist(), batch.num_rows], strict=True):
            now = tuple(int(c[lo]) for c in columns)
            if held and now != key:
                yield key, held
                held = []
            key = now
            held.append(batch.slice(lo, hi - lo))
    if held:
        yield key, held


def _joined(parts: list[pa.RecordBatch], name: str) -> np.ndarray:
    return np.concatenate([p.column(name).to_numpy(zero_copy_only=False) for p in parts])


def write_counts(counts: DataFrame, folder: str) -> int:
    """Write buckets of counts, indexed by a minimal perfect hash, below ``folder``; returns how many buckets there are."""
    spark = counts.sparkSession
    n_keys, last = counts.agg(F.count_distinct("key"), F.max("task")).first()
    buckets = max(1, -(-n_keys // BUCKET_KEYS))
    leaves = max(1, int((1 + (last or 0)) ** 0.5))
    placed = counts.select("key", "n", (F.col("key").bitwiseAND(0xFFFFFFFF) % buckets).cast("int").alias("bucket"), (F.col("task") % leaves).alias("leaf"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (bucket,), parts in _runs(batches, ("bucket",)):
            keys = np.unique(_joined(parts, "key"))
            found = PerfectHash.build(keys)
            ordered = np.empty(len(keys), np.int64)
            ordered[found.index(keys)] = keys
            _write(f"{folder}/hash-{bucket:06d}.npz", keys=ordered, **found.arrays())
            yield pa.record_batch({"bucket": pa.array([bucket], pa.int32()), "size": pa.array([len(keys)], pa.int64())})

    def leaf_vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (bucket, leaf), parts in _runs(batches, ("bucket", "leaf")):
            held = _read(f"{folder}/hash-{bucket:06d}.npz")
            keys = _joined(parts, "key")
            at = PerfectHash.load(held).index(keys)
            if (held["keys"][at] != keys).any():
                raise KeyError("a key that the hash was not built for")
            vector = np.zeros(len(held["keys"]), np.int64)
            np.add.at(vector, at, _joined(parts, "n"))
            yield pa.record_batch({"bucket": pa.array([bucket], pa.int32()), "leaf": pa.array([leaf], pa.int32()), "vector": pa.array([vector.tobytes()], pa.binary())})

    def root(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (bucket,), parts in _runs(batches, ("bucket",)):
            held = _read(f"{folder}/hash-{bucket:06d}.npz")
            total = np.zeros(len(held["keys"]), np.int64)
            for part in parts:
                for vector in part.column("vector"):
                    total += np.frombuffer(vector.as_buffer(), np.int64)
            b_ids, of = np.unique(held["keys"] & 0xFFFFFFFF, return_inverse=True)
            highest = np.zeros(len(b_ids), np.int64)
            np.maximum.at(highest, of, total)
            _write(f"{folder}/counts-{bucket:06d}.npz", **held, counts=total, top=total == highest[of])
            yield pa.record_batch({"bucket": pa.array([bucket], pa.int32()), "size": pa.array([len(total)], pa.int64())})

    keys = placed.select("bucket", "key").distinct().repartition("bucket").sortWithinPartitions("bucket")
    discard(materialize(keys.mapInArrow(hashed, "bucket int, size long"), "pair-hash"))
    vectors = placed.repartition("bucket", "leaf").sortWithinPartitions("bucket", "leaf").mapInArrow(leaf_vectors, "bucket int, leaf int, vector binary")
    discard(materialize(vectors.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(root, "bucket int, size long"), "pair-sums"))
    return buckets


def align(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups) for each row.

    ``groups`` reads ``a1,a2|b1;a3|b2,b3``. ``count_sum`` adds the corpus counts of the
    document's links; ``n_best`` are those whose count no other A id of their B id exceeds.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    folder = shared_dir(spark, "pair-counts")
    with scratch(spark):
        buckets = write_counts(materialize(pair_counts(rows, a_path, b_path), "pairs"), folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = aligner(a_path, b_path, (folder, buckets))
        for batch in released(batches):
            for part in slices(batch, "text", 1 << 20):
                words = tool.chunks(part.column("text"))
                hashes, inverse = tool.known(words)
                ok = tool.spelt(words, hashes, inverse)
                sums = {}
                for name in ("n_a", "n_b", "n_groups", "best", "total"):
                    sums[name] = np.diff(np.concatenate([[0], np.cumsum(tool.memo.get(hashes, name)[inverse].astype(np.int64))])[words.offsets]) * ok
                size, first = tool.memo.get(hashes, "n_bytes")[inverse], tool.memo.get(hashes, "first_byte")[inverse]
                texts = []
                for lo, hi, plain in zip(words.offsets[:-1].tolist(), words.offsets[1:].tolist(), ok.tolist(), strict=True):
                    if plain and hi > lo:
                        ends = np.cumsum(size[lo:hi])
                        spelt = tool.text[np.repeat(first[lo:hi] - ends + size[lo:hi], size[lo:hi]) + np.arange(ends[-1])]
                        texts.append(spelt[:-1].tobytes().decode())
                    else:
                        texts.append("")
                yield pa.record_batch({"doc_id": part.column("doc_id"), "n_a": pa.array(sums["n_a"]), "n_b": pa.array(sums["n_b"]), "n_groups": pa.array(sums["n_groups"]), "n_links": pa.array(sums["n_groups"]), "n_best": pa.array(sums["best"]), "count_sum": pa.array(sums["total"]), "groups": pa.array(texts, pa.string())})

    return rows.mapInArrow(run, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string")
