"""Exact BPE encoding in linear time by backtracking, and decoding by an offset table.

An Aho-Corasick automaton over the vocabulary finds the longest token that begins at
each place of a word. The encoder takes it if it goes with the token before it, else
the next shorter token; a place from which no token leads on is marked dead and the
token before it is taken back. Two tokens go together if replaying their merges never
joins a piece across their border; the answer is kept in a bounded table. So each
place is settled once, and the result is that of applying all merges in rank order.

Words end in a symbol of their own where the vocabulary marks word ends. Normaliser,
pre-tokeniser and special tokens are those of the ``tokenizers`` file. They never join
characters across ASCII white space, so the ids of a text are the ids of its words
``[^\\x20\\x09-\\x0D]+`` in a row; each worker keeps the ids of words it has met, up to
``memo_bytes``. Decoding writes the strings of the tokens, one blank between them, as a
file without a decoder does.

Defined results: a null text is empty and has no ids; null ids decode to null, ids
outside the vocabulary to nothing; repeated rows are kept; other columns are ignored
by ``encode`` and kept by ``decode``; an empty table gives an empty one.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .storage import unused
from .textscan import Words, released, scan, slices, small_batches
from .tokenization import Memo

#: Added to the last character of a word: the same byte at a word's end is another symbol.
END = 0x1000
PAIRS_KEPT = 1 << 18
PIECES_KEPT = 1 << 16
#: White space that may stand in a word; normalising adds blanks for it, or takes away those beside it.
SPACE_IN_WORD = re.compile(r"\s")
_open: dict[str, "BacktrackingEncoder"] = {}
_tables: dict[str, "OffsetDecoder"] = {}


class BacktrackingEncoder:
    def __init__(self, path: str, memo_bytes: int = 48 << 20):
        import ahocorasick
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, vocab = spec["model"], spec["model"]["vocab"]
        self.suffix = model["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        if model["type"] != "BPE" or model["continuing_subword_prefix"] or model["byte_fallback"] or any(t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"] for t in spec["added_tokens"]):
            raise ValueError("a byte-level BPE file with plain special tokens is needed")
        self.merged: dict[tuple[int, int], tuple[int, int]] = {}  # pair -> rank, token
        self.halves: dict[int, tuple[int, int]] = {}
        self.rank: dict[int, int] = {}
        parts = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        for rank, (left, right) in enumerate(parts):
            a, b, t = vocab[left], vocab[right], vocab[left + right]
            self.merged[a, b] = rank, t
            self.halves[t], self.rank[t] = (a, b), rank
        self.symbols = {t: self._single(s) for s, t in vocab.items() if t not in self.halves}
        for left, right in parts:
            self.symbols[vocab[left + right]] = self.symbols[vocab[left]] + self.symbols[vocab[right]]
        of = {s: t for t, s in self.symbols.items()}
        self.automaton = ahocorasick.Automaton()
        for s, t in of.items():
            self.automaton.add_word(s, (len(s), t))
        self.automaton.make_automaton()
        #: the longest token that a token begins with
        self.shorter = {t: next((of[s[:k]] for k in range(len(s) - 1, 0, -1) if s[:k] in of), None) for t, s in self.symbols.items()}
        self.size = {t: len(s) for t, s in self.symbols.items()}
        self.goes: dict[tuple[int, int], bool] = {}
        self.known: dict[str, list[int]] = {}
        self.memo, self.ids = Memo(memo_bytes, first=np.int64, count=np.int32), np.zeros(0, np.int32)

    def _single(self, s: str) -> str:
        return chr(END + ord(s[0])) if self.suffix and s.endswith(self.suffix) and len(s) == 1 + len(self.suffix) else s

    def _edge(self, token: int, side: int) -> list[tuple[int, float]]:
        """Tokens that stand at one end of a token while it is built, each with the rank of the merge that takes it in."""
        out, until = [(token, float("inf"))], float("inf")
        while token in self.halves:
            until, token = self.rank[token], self.halves[token][side]
            out.append((token, until))
        return out

    def compatible(self, left: int, right: int) -> bool:
        """Whether the tokens can stand side by side: no merge across their border comes before those that build them."""
        known = self.goes.get((left, right))
        if known is None:
            known = True
            for a, until_a in self._edge(left, 1):
                for b, until_b in self._edge(right, 0):
                    rank, _ = self.merged.get((a, b), (None, None))
                    if rank is not None and rank < until_a and rank <= until_b:  # of equal merges the left one is first
                        known = False
            if len(self.goes) >= PAIRS_KEPT:
                self.goes.clear()
            self.goes[left, right] = known
        return known

    def merge(self, piece: str) -> list[int]:
        """Token ids of one pre-token, given in byte-level characters."""
        word = piece[:-1] + chr(END + ord(piece[-1])) if self.suffix else piece
        n, sizes, shorter = len(word), self.size, self.shorter
        longest: list[int | None] = [None] * (n + 1)
        reach = [0] * (n + 1)
        for last, (size, token) in self.automaton.iter(word):
            if size > reach[last + 1 - size]:
                longest[last + 1 - size], reach[last + 1 - size] = token, size
        out: list[int] = []
        dead = bytearray(n + 1)
        at, token = 0, longest[0]
        while at < n:
            while token is not None:
                end = at + sizes[token]
                if not dead[end] and (not out or self.compatible(out[-1], token)):
                    break
                token = shorter[token]
            if token is not None:
                out.append(token)
                at, token = end, longest[end]
            elif out:
                dead[at] = 1
                token = out.pop()
                at -= sizes[token]
            else:
                raise ValueError(f"no token for {piece!r}")
        return out

    def _split(self, text: str) -> list[tuple[str, tuple[int, int]]]:
        return self.library.pre_tokenizer.pre_tokenize_str(text)

    def _normal(self, text: str) -> str:
        return self.library.normalizer.normalize_str(text) if self.library.normalizer else text

    def _piece(self, piece: str) -> list[int]:
        known = self.known.get(piece)
        if known is None:
            known = self.merge(piece)
            if len(piece) <= 40:
                if len(self.known) >= PIECES_KEPT:
                    self.known.clear()
                self.known[piece] = known
        return known

    def text(self, text: str) -> list[int]:
        """Ids of any text, special tokens found first."""
        out: list[int] = []
        while text:
            found = min(((at, -len(s), s) for s in self.special if (at := text.find(s)) >= 0), default=None)
            plain = text[: found[0]] if found else text
            for piece, _ in self._split(self._normal(plain)) if plain else ():
                out += self._piece(piece) if piece else ()
            if found is None:
                break
            out.append(self.special[found[2]])
            text = text[found[0] + len(found[2]) :]
        return out

    def words(self, words: list[str]) -> list[list[int]]:
        """Ids of each word; words are normalised and split together where a blank parts them safely."""
        out: list[list[int]] = []
        for k in range(0, len(words), 500):
            part = words[k : k + 500]
            plain = [i for i, w in enumerate(part) if not SPACE_IN_WORD.search(w)]
            joined = " ".join(part[i] for i in plain)
            normal = self._normal(joined)
            lengths = [len(w) for w in normal.split(" ")]
            if not plain or len(lengths) != len(plain) or any(s in joined for s in self.special):
                out += map(self.text, part)
                continue
            found: list[list[int]] = [[] for _ in part]
            for i in set(range(len(part))).difference(plain):
                found[i] = self.text(part[i])
            at, end = 0, lengths[0]
            for piece, (start, _) in self._split(normal):
                while start > end:
                    at += 1
                    end += 1 + lengths[at]
                found[plain[at]] += self._piece(piece)
            out += found
        return out

    def encode(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and the place where each text's begin, with the end at last."""
        hashes, first, inverse = np.unique(words.hashes(), return_index=True, return_inverse=True)
        new = self.memo.missing(hashes, self.ids.nbytes)
        if not len(self.memo.keys):
            self.ids = np.zeros(0, np.int32)
        if len(new):
            found = self.words([words.text(i).decode("utf-8", "replace") for i in first[new]])
            counts = np.array([len(x) for x in found], np.int32)
            self.memo.add(hashes[new], first=len(self.ids) + np.cumsum(counts) - counts, count=counts)
            self.ids = np.concatenate([self.ids, np.array([i for x in found for i in x], np.int32)])
        count = self.memo.get(hashes, "count")[inverse].astype(np.int64)
        ends = np.cumsum(count)
        within = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - count, count)
        flat = self.ids[np.repeat(self.memo.get(hashes, "first")[inverse], count) + within]
        return flat, np.concatenate([[0], ends])[words.offsets]


class OffsetDecoder:
    """All token strings in one row of bytes, and where each begins; a text is one gather."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(path)
        if library.decoder is not None:
            raise ValueError("the file has a decoder; tokens are not joined by blanks")
        tokens = [b"" if (s := library.id_to_token(i)) is None else s.encode() + b" " for i in range(1 + max(library.get_vocab().values()))]
        self.table = np.frombuffer(b"".join(tokens), np.uint8)
        self.offsets = np.concatenate([[0], np.cumsum([len(t) for t in tokens])])

    def decode(self, ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all texts in a row and where each begins; ``at`` has the bounds of the texts in ``ids``."""
        known = (ids >= 0) & (ids < len(self.offsets) - 1)
        first = self.offsets[np.where(known, ids, 0)]
        size = np.where(known, self.offsets[np.where(known, ids, 0) + 1] - first, 0)
        ends = np.concatenate([[0], np.cumsum(size)])
        out = self.table[np.repeat(first - ends[:-1], size) + np.arange(ends[-1])]
        bounds = ends[at]
        last = bounds[1:][np.diff(bounds) > 0] - 1  # the blank behind a text's last token
        kept = np.ones(len(out), bool)
        kept[last] = False
        return out[kept], bounds - np.concatenate([[0], np.cumsum(np.diff(bounds) > 0)])


def encoder(path: str) -> BacktrackingEncoder:
    """The worker's encoder for a file."""
    if path not in _open:
        _open[path] = BacktrackingEncoder(path)
    return _open[path]


def decoder(path: str) -> OffsetDecoder:
    """The worker's decoder for a file."""
    if path not in _tables:
        _tables[path] = OffsetDecoder(path)
    return _tables[path]


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids) for each row."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in released(batches):
            for part in slices(batch, "text", 1 << 20):
                flat, at = enc.encode(scan(part.column("text"), False))
                yield pa.record_batch({"doc_id": part.column("doc_id"), "ids": pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(flat))})

    return rows.mapInArrow(run, "doc_id long, ids array<int>")


def decode(df: DataFrame, path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """``df`` with the texts of its ids in ``out_col`` (underscores behind it if the name is taken)."""
    small_batches(df.sparkSession)
    out_col = unused(df, out_col)
    schema = T.StructType([*df.schema.fields, T.StructField(out_col, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = decoder(path)
        for batch in released(batches):
            column = batch.column(ids_col)
            sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
            bounds, lo = np.cumsum(sizes), 0
            while lo < batch.num_rows:  # a quarter of a million ids at once; a longer list is alone
                hi = max(lo + 1, int(np.searchsorted(bounds, (bounds[lo - 1] if lo else 0) + (1 << 18), "right")))
                part = batch.slice(lo, hi - lo)
                ids = pc.fill_null(pc.list_flatten(part.column(ids_col)), -1).to_numpy(zero_copy_only=False).astype(np.int64)
                data, at = table.decode(ids, np.concatenate([[0], np.cumsum(sizes[lo:hi])]))
                null = pc.is_null(part.column(ids_col)).to_numpy(zero_copy_only=False)
                mask = pa.array(~null).buffers()[1] if null.any() else None
                texts = pa.StringArray.from_buffers(hi - lo, pa.py_buffer(at.astype(np.int32).tobytes()), pa.py_buffer(data.tobytes()), mask)
                yield pa.RecordBatch.from_arrays([*part.columns, texts], names=[*part.schema.names, out_col])
                lo = hi

    return df.mapInArrow(run, schema)
