from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer, pre_tokenizers

from shelfspark.llm import bpe, queries, token_alignment
from shelfspark.llm.textscan import scan

WORDS = public_tokenizers.path("word_bpe_49k.json")
BYTES = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
ODD = [
    "<|endoftext|>a<|startoftext|> B Σας ΣΑΣ ǅ don't I'LL 12a3 ½ ²  ", "aaaaaaa" * 50, "\x00\x01 \x1c\x1d", "</w> a</w>b <w", "a  b  \n c　", "x ▁ y", "▁", " ", "  two  blanks\n\n and \t tabs\r\nend \n", "“quoted” text – and… more",
    "éé ﻿ ​ x", "<0x41> <s> </s> <unk>", "\n", "a" * 5000 + " " + "日本" * 2000, "퟿\U0001f600 \U0001f468‍\U0001f469", "İstanbul ß ſ K",
]


def wild(n: int, seed: int = 5) -> list[str]:
    """Texts of letters, blanks, combining marks and symbols of many scripts."""
    rng = random.Random(seed)
    sets = [lambda: rng.randrange(32, 127), lambda: rng.choice([32, 32, 10, 9, 13, 160, 0x2003, 0x85]), lambda: rng.randrange(0xA0, 0x250), lambda: rng.randrange(0x300, 0x370), lambda: rng.randrange(0x370, 0x3100), lambda: rng.randrange(0x1F300, 0x1F700)]
    return ["".join(chr(rng.choice(sets[: 2 + i % 5])()) for _ in range(rng.randrange(80))) for i in range(n)] + ["".join(rng.choice("abeinst ") for _ in range(300)) for _ in range(n // 5)]


@pytest.fixture(scope="module")
def texts(spark):
    found = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    return found + ODD + wild(300)


@pytest.fixture(scope="module")
def docs(spark, texts, edge_docs):
    rows = [(1000 + i, t, "x", 7, None, 2) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, edge_docs.schema).unionByName(edge_docs).repartition(5)


def test_encoder_equals_the_library(texts):
    library, own = Tokenizer.from_file(WORDS), bpe.BacktrackingEncoder(WORDS, memo_bytes=100_000)
    for k in range(0, len(texts), 40):
        part = texts[k : k + 40]
        flat, at = own.encode(scan(pa.array(part, pa.string()), False))
        for i, text in enumerate(part):
            assert flat[at[i] : at[i + 1]].tolist() == library.encode(text or "", add_special_tokens=False).ids, text


def test_words_with_spaces_of_their_own_do_not_shift_the_others():
    """A blank that normalising takes away beside one word and one that it adds in another leave as many words as before."""
    own = bpe.BacktrackingEncoder(WORDS)
    for words in (["zero", "\u00a0", "one", "reing###", "y\u00a0z", "last"], ["a\u2003b", "two", "\u3000", "three"], ["\u00a0", "\u0085"]):
        assert own.words(words) == [own.text(w) for w in words] == [own.library.encode(w, add_special_tokens=False).ids for w in words]


def test_encoder_without_word_ends(texts):
    """The byte-level file has no end symbol: one pre-token at a time."""
    library, own = Tokenizer.from_file(BYTES), bpe.BacktrackingEncoder(BYTES)
    for text in texts:
        assert own.text(text or "") == library.encode(text or "", add_special_tokens=False).ids, text


def test_merges_in_rank_order_give_the_same():
    own, rng = bpe.BacktrackingEncoder(WORDS), random.Random(2)
    for _ in range(300):
        word = "".join(rng.choice("aeinrst") for _ in range(rng.randrange(1, 14)))
        ids = [next(t for t, s in own.symbols.items() if s == c) for c in word[:-1] + chr(bpe.END + ord(word[-1]))]
        while len(ids) > 1:
            rank, i = min((own.merged[p][0], i) if (p := (ids[i], ids[i + 1])) in own.merged else (10**9, 0) for i in range(len(ids) - 1))
            if rank == 10**9:
                break
            ids[i : i + 2] = [own.merged[ids[i], ids[i + 1]][1]]
        assert own.merge(word) == ids


def test_encode_and_decode(spark, docs, edge_docs):
    library = Tokenizer.from_file(WORDS)
    want = Counter()
    for r in docs.collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        want[r.doc_id, tuple(ids), library.decode(ids, skip_special_tokens=False)] += 1
    back = bpe.decode(bpe.encode(docs, WORDS), WORDS)
    assert Counter((r.doc_id, tuple(r.ids), r.decoded) for r in back.collect()) == want
    odd = spark.createDataFrame([(1, None, "d"), (2, [], None), (3, [320, -4, 10**8, None, 256], ""), (4, [256], "x")], "n long, ids array<long>, decoded string")
    got = {r.n: (r.decoded, r.decoded_) for r in bpe.decode(odd, WORDS).collect()}
    assert got == {1: ("d", None), 2: (None, ""), 3: ("", library.decode([320, 256])), 4: ("x", library.decode([256]))}
    assert bpe.decode(bpe.encode(docs.limit(0), WORDS), WORDS).collect() == []


def test_op12_digests(spark, docs, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    library = Tokenizer.from_file(WORDS)
    want = Counter()
    for r in docs.collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        want[r.doc_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()] += 1
    got = queries.op12_bpe_round_trip(spark, str(tmp_path))
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got.collect()) == want


def plain_alignment(texts: list[str | None]):
    """Tokens, groups and links of each text, tokenised whole."""
    a_lib, b_lib = Tokenizer.from_file(BYTES), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    a_lib.encode_special_tokens = True
    of_char = {c: b for b, c in enumerate(token_alignment._byte_characters(pre_tokenizers.ByteLevel))}

    def piece(i: int) -> bytes:
        return bytes([int(b_lib.id_to_piece(i)[3:5], 16)]) if b_lib.is_byte(i) else b_lib.id_to_piece(i).replace("▁", " ").encode()

    out = []
    for text in texts:
        raw = (" " + (text or "")).encode()
        a, b = a_lib.encode(" " + (text or ""), add_special_tokens=False).ids, b_lib.encode(text or "")
        spelt = [[bytes(of_char[c] for c in a_lib.id_to_token(i)) for i in a], [piece(i) for i in b]]
        if not text or b"".join(spelt[0]) != raw or b"".join(spelt[1]) != raw:
            out.append(([], [], [], []))
            continue
        ends = [np.cumsum([len(x) for x in s]).tolist() for s in spelt]
        links = [(x, y) for x, e in zip(a, ends[0], strict=True) for y in [dict(zip(ends[1], b, strict=True)).get(e)] if y is not None] if len(raw) < 3000 else None
        at = {e: i for i, e in enumerate(ends[1])}
        groups, i0, j0 = [], 0, 0
        for i, e in enumerate(ends[0]):
            if e in at:
                groups.append((a[i0 : i + 1], b[j0 : at[e] + 1]))
                i0, j0 = i + 1, at[e] + 1
        assert links is None or links == [(x[-1], y[-1]) for x, y in groups]
        out.append((a, b, groups, [(x[-1], y[-1]) for x, y in groups]))
    return out


def test_op11_equals_plain_alignment(spark, docs, tmp_path, monkeypatch):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(token_alignment, "BUCKET_KEYS", 300)
    rows = docs.collect()
    plain = plain_alignment([r.text for r in rows])
    counts = Counter(x for _, _, _, links in plain for x in links)
    highest: Counter = Counter()
    for (_, y), n in counts.items():
        highest[y] = max(highest[y], n)
    want = Counter()
    for r, (a, b, groups, links) in zip(rows, plain, strict=True):
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        want[r.doc_id, len(a), len(b), len(groups), len(links), sum(counts[x] == highest[x[1]] for x in links), sum(counts[x] for x in links), hashlib.sha256(text.encode()).hexdigest() if groups else ""] += 1
    got = queries.op11_tokenizer_alignment(spark, str(tmp_path)).collect()
    found = Counter((r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in got)
    assert found == want


def test_op11_without_rows(spark, docs, no_docs):
    assert token_alignment.align(no_docs, BYTES, PIECES).collect() == []
    assert [r.n_a for r in token_alignment.align(docs.where("text is null"), BYTES, PIECES).collect()] == [0, 0][: docs.where("text is null").count()]


def test_chunks_are_cut_where_neither_tokenizer_joins():
    tool = token_alignment.Aligner(BYTES, PIECES)
    texts = ["a b\n\n c", "x  y", "p\r\nq", "“z” k", None, ""]
    words = tool.chunks(pa.array(texts))
    got = [[words.text(i).decode() for i in range(lo, hi)] for lo, hi in zip(words.offsets[:-1], words.offsets[1:], strict=True)]
    assert got == [[" a", " b", "\n\n c"], [" x  y"], [" p\r\nq"], [" “z”", " k"], [], []]


@pytest.mark.parametrize("n", [0, 1, 2, 100, 5000])
def test_perfect_hash(n):
    rng = np.random.default_rng(n)
    keys = np.unique(rng.integers(0, 1 << 48, n))
    found = token_alignment.PerfectHash.build(keys)
    assert len(found) == len(keys) and sorted(found.index(keys)) == list(range(len(keys)))
    again = token_alignment.PerfectHash.load(found.arrays())
    assert (again.index(keys) == found.index(keys)).all()
    few = token_alignment.PerfectHash([np.zeros(3, bool)], np.array([5, 9]))
    assert few.index(np.array([9, 5, 7])).tolist() == [1, 0, -1]
