"""Token counts by unigram Viterbi, without building tokens.

An Aho-Corasick automaton over the vocabulary gives, for every end in a word, the
pieces that end there, longest first; dynamic programming carries the best score
and its piece count. Ties follow the unigram tokenizer of the ``tokenizers``
library: of equal scores the path with the earlier start (longer piece) stays; a
character that is no piece is unknown, at the least score of the vocabulary minus
10, and unknowns in a row count once.

A word is ``[^\\x20\\x09-\\x0D]+`` after the blank mark. Pieces with a blank mark
past their first character can't be met within a word, so words are independent;
each worker keeps the results of words it has met, up to ``memo_bytes``.

Defined results: null and empty texts have 0 tokens and score 0; repeated rows are
counted one by one; other columns are ignored; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textscan import released, scan, slices, small_batches
from .tokenization import Memo

BLANK = "▁"
UNKNOWN_PENALTY = 10.0
_open: dict[str, "UnigramCounter"] = {}


def vocabulary(path: str) -> dict[str, float]:
    """Pieces and scores of a SentencePiece file, without control, unknown and byte pieces."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    skip = lambda i: sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i)
    return {sp.id_to_piece(i): sp.get_score(i) for i in range(sp.get_piece_size()) if not skip(i)}


class UnigramCounter:
    def __init__(self, vocab: dict[str, float], memo_bytes: int = 24 << 20):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for piece, score in vocab.items():
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min(vocab.values()) - UNKNOWN_PENALTY
        self.memo = Memo(memo_bytes, count=np.int32, score=np.float64)

    def word(self, word: str) -> tuple[int, float]:
        """Piece count and score of the best path through the blank mark and the word."""
        text = BLANK + word
        n = len(text)
        best: list[float | None] = [0.0] + [None] * n
        pieces, unknown = [0] * (n + 1), [False] * (n + 1)
        at, penalty = 0, self.unknown

        def close(e: int) -> None:  # no piece of one character ends here
            score = best[e - 1] + penalty
            if best[e] is None or score > best[e]:
                best[e], unknown[e] = score, True
                pieces[e] = pieces[e - 1] + (not unknown[e - 1])

        single = True
        for last, (size, value) in self.automaton.iter(text):
            e = last + 1
            while at < e:  # ends are complete once the automaton has passed them
                if at and not single:
                    close(at)
                at, single = at + 1, False
            score = best[e - size] + value
            if best[e] is None or score > best[e]:
                best[e], pieces[e], unknown[e] = score, pieces[e - size] + 1, False
            single |= size == 1
        while at < n:
            if at and not single:
                close(at)
            at, single = at + 1, False
        if not single:
            close(n)
        return pieces[n], best[n]

    def count(self, words) -> tuple[np.ndarray, np.ndarray]:
        """Piece count and score of each word of a batch."""
        hashes, first, inverse = np.unique(words.hashes(), return_index=True, return_inverse=True)
        new = self.memo.missing(hashes)
        if len(new):
            found = [self.word(words.text(i).decode("utf-8", "replace")) for i in first[new]]
            self.memo.add(hashes[new], count=np.array([c for c, _ in found], np.int32), score=np.array([x for _, x in found]))
        return self.memo.get(hashes, "count")[inverse].astype(np.int64), self.memo.get(hashes, "score")[inverse]


def token_counts(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_tokens, score) for each row."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if model_path not in _open:
            _open[model_path] = UnigramCounter(vocabulary(model_path))
        counter = _open[model_path]
        for batch in released(batches):
            for part in slices(batch, "text", 1 << 20):
                words = scan(part.column("text"), False)
                counts, scores = counter.count(words)
                total = np.concatenate([[0], np.cumsum(counts)])[words.offsets]
                size = words.counts()
                sums = np.add.reduceat(np.append(scores, 0.0), np.minimum(words.offsets[:-1], len(scores))) * (size > 0) if part.num_rows else np.zeros(0)
                yield pa.record_batch({"doc_id": part.column("doc_id"), "n_words": pa.array(size), "n_tokens": pa.array(np.diff(total)), "score": pa.array(sums)})

    return rows.mapInArrow(run, "doc_id long, n_words long, n_tokens long, score double")
