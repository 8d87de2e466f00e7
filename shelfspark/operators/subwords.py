"""Byte-pair merges over the distinct words of a batch, all words at once.

A round finds the lowest-ranked pair of each word and merges it wherever it stands in
that word, from the left; words without a ranked pair are done. There are as many
rounds as the word with most merges needs. The merge list is a published one, read
from a ``tokenizers`` file; words are spelt in its byte-level characters, the last one
marked as the end of a word where the file does so.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np

_NONE = np.int64(1 << 40)


def byte_characters() -> dict[int, str]:
    """The character of each byte in byte-level vocabularies: printable ones stand for themselves, the rest follow from U+0100 on."""
    kept = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(kept)]
    return {b: chr(b) for b in kept} | {b: chr(0x100 + i) for i, b in enumerate(rest)}


#: Ids of characters that no merge of a stated list has; those at a word's end lie above them.
_PLAIN, _AT_END = 1 << 26, 1 << 27


@dataclass
class Merges:
    """Sorted keys of ranked pairs of ids, with their ranks and the ids they merge into; and how words are spelt.

    ``first`` and ``last`` have the ids of bytes within a word and at its end; without
    them words are spelt in characters, whose ids are in ``pieces`` or made from their number.
    """

    keys: np.ndarray
    ranks: np.ndarray
    merged: np.ndarray
    first: np.ndarray | None
    last: np.ndarray | None
    pieces: list[str]
    end: str

    @classmethod
    def of(cls, merges: "str | list[tuple[str, str]]", end: str = "</w>") -> "Merges":
        """From a file, or from a list of pairs over characters."""
        if isinstance(merges, str):
            return cls.read(merges)
        vocab = {p: i for i, p in enumerate(dict.fromkeys(x for a, b in merges for x in (a, b, a + b)))}
        ranked = {(vocab[a], vocab[b]): (i, vocab[a + b]) for i, (a, b) in reversed(list(enumerate(merges)))}
        keys = np.array([a << 32 | b for a, b in ranked], np.int64)
        order = np.argsort(keys)
        ranks, merged = (np.array([v[k] for v in ranked.values()], np.int64)[order] for k in (0, 1))
        return cls(keys[order], ranks, merged, None, None, list(vocab), end)

    def piece(self, i: int) -> str:
        """The text of an id."""
        return self.pieces[i] if i < _PLAIN else chr(i - _AT_END) + self.end if i >= _AT_END else chr(i - _PLAIN)

    @classmethod
    def read(cls, path: str) -> "Merges":
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, end = model["vocab"], model.get("end_of_word_suffix") or ""
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys)
        of = byte_characters()
        first, last = (np.array([vocab.get(of[b] + s, -1) for b in range(256)], np.int64) for s in ("", end))
        names = [""] * (1 + max(vocab.values()))
        for piece, i in vocab.items():
            names[i] = piece
        return cls(keys[order], order.astype(np.int64), np.array([vocab[a + b] for a, b in pairs], np.int64)[order], first, last, names, end)

    def _spelt(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the bytes or characters of all words in a row, and how many each word has."""
        if self.first is not None:
            spelt = [w.encode("utf-8", "surrogatepass") for w in words]
            size = np.array([len(s) for s in spelt], np.int64)
            raw = np.frombuffer(b"".join(spelt), np.uint8)
            within, last = self.first, self.last
        else:
            size = np.array([len(w) for w in words], np.int64)
            symbols, raw = np.unique(np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32), return_inverse=True)
            known = {p: i for i, p in enumerate(self.pieces)}
            within, last = (np.array([known.get(chr(c) + s, base + c) for c in symbols.tolist()], np.int64) for s, base in (("", _PLAIN), (self.end, _AT_END)))
        ids, ends = within[raw], np.cumsum(size)[size > 0] - 1
        ids[ends] = last[raw[ends]]
        return ids, size

    def encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in a row, and where each word's begin, with the end at last."""
        if not self.keys.size:
            raise ValueError("no merges")
        ids, size = self._spelt(words)
        owner = np.repeat(np.arange(len(words)), size)
        known = ids >= 0
        ids, owner = ids[known], owner[known]
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(ids) > 1:
            ids, owner, finished = self._round(ids, owner)
            done.append(finished)
        done.append((ids, owner))
        ids, owner = (np.concatenate([d[i] for d in done]) for i in (0, 1))
        order = np.argsort(owner, kind="stable")
        return ids[order], np.searchsorted(owner[order], np.arange(len(words) + 1))

    def _round(self, ids: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray]]:
        pair = np.append(ids[:-1] << 32 | ids[1:], -1)
        at = np.minimum(np.searchsorted(self.keys, pair), len(self.keys) - 1)
        ranked = (self.keys[at] == pair) & np.append(owner[:-1] == owner[1:], False)
        rank = np.where(ranked, self.ranks[at], _NONE)
        starts = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
        sizes = np.diff(np.append(starts, len(owner)))
        least = np.repeat(np.minimum.reduceat(rank, starts), sizes)
        hit = ranked & (rank == least)
        # of pairs that overlap (aaa) the left one is first: every other of a run of hits
        place = np.arange(len(hit))
        run = np.maximum.accumulate(np.where(hit & ~np.append(False, hit[:-1]), place, 0))
        hit &= (place - run) % 2 == 0
        ids = np.where(hit, self.merged[at], ids)
        gone = np.append(False, hit[:-1])
        open_ = (least < _NONE) & ~gone
        idle = least == _NONE
        return ids[open_], owner[open_], (ids[idle], owner[idle])
