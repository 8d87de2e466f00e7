"""Token ids of whole texts from a ``tokenizers`` file, with a bounded word memo.

Normaliser and pre-tokeniser of the word-level BPE files never join characters
across ASCII white space, so the ids of a text are the ids of its words in a
row. Each worker keeps the ids of words it has met, up to ``MEMO_BYTES``, and
hands only new words to the library. ``tests/llm`` holds this against encoding
whole texts.
"""

from __future__ import annotations

import os

import numpy as np

from .textscan import Words

MEMO_BYTES = 48 << 20
_open: dict[str, "WordTokenizer"] = {}


class Memo:
    """Sorted word hashes with a row of values each; it starts anew before it outgrows ``limit`` bytes."""

    def __init__(self, limit: int, **kinds: type):
        self.limit, self.kinds = limit, kinds
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.values = {name: np.zeros(0, kind) for name, kind in self.kinds.items()}

    def missing(self, hashes: np.ndarray, extra: int = 0) -> np.ndarray:
        """Places in ``hashes`` (sorted, distinct) that are not known yet; all of them if the memo had to be emptied."""
        at = np.minimum(np.searchsorted(self.keys, hashes), max(len(self.keys) - 1, 0))
        new = np.flatnonzero(self.keys[at] != hashes) if len(self.keys) else np.arange(len(hashes))
        width = 8 + sum(v.itemsize for v in self.values.values())
        if len(new) and len(self.keys) and (len(self.keys) + len(new)) * width + extra > self.limit:
            self.clear()
            new = np.arange(len(hashes))
        return new

    def add(self, hashes: np.ndarray, **values: np.ndarray) -> None:
        """Merge sorted new hashes in."""
        at = np.searchsorted(self.keys, hashes)
        self.keys = np.insert(self.keys, at, hashes)
        for name, have in self.values.items():
            self.values[name] = np.insert(have, at, values[name])

    def get(self, hashes: np.ndarray, name: str) -> np.ndarray:
        return self.values[name][np.searchsorted(self.keys, hashes)]


def tokenizer(path: str) -> "WordTokenizer":
    """The worker's tokenizer for a file; its memo lasts as long as the worker."""
    if path not in _open:
        _open[path] = WordTokenizer(path)
    return _open[path]


class WordTokenizer:
    def __init__(self, path: str, memo_bytes: int = MEMO_BYTES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.memo = Memo(memo_bytes, first=np.int64, count=np.int32)
        self.ids = np.zeros(0, np.uint32)

    def _encode_new(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words, joined, and how many each has."""
        ids, counts = [np.zeros(0, np.uint32)], np.zeros(len(words), np.int32)
        for k in range(0, len(words), 2000):
            part = words[k : k + 2000]
            enc = self.library.encode(" ".join(part), add_special_tokens=False)
            starts = np.zeros(len(part), np.int64)
            np.cumsum([len(w) + 1 for w in part[:-1]], out=starts[1:])
            at = np.array([o[0] for o in enc.offsets], np.int64)
            counts[k : k + len(part)] = np.bincount(np.searchsorted(starts, at, "right") - 1, minlength=len(part))
            ids.append(np.array(enc.ids, np.uint32))
        return np.concatenate(ids), counts

    def encode(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and the place where each text's begin, with the end at last."""
        hashes, first, inverse = np.unique(words.hashes(), return_index=True, return_inverse=True)
        new = self.memo.missing(hashes, self.ids.nbytes)
        if not len(self.memo.keys):
            self.ids = np.zeros(0, np.uint32)
        if len(new):
            ids, counts = self._encode_new([words.text(i).decode("utf-8", "replace") for i in first[new]])
            self.memo.add(hashes[new], first=len(self.ids) + np.cumsum(counts) - counts, count=counts)
            self.ids = np.concatenate([self.ids, ids])
        count = self.memo.get(hashes, "count")[inverse].astype(np.int64)
        ends = np.cumsum(count)
        within = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - count, count)
        flat = self.ids[np.repeat(self.memo.get(hashes, "first")[inverse], count) + within]
        return flat, np.concatenate([[0], ends])[words.offsets]
