"""Merge rounds, vocabulary counts and decoding against plain versions and the tokenizer."""

from __future__ import annotations

import json
import random
from collections import Counter

import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from shelfspark.operators import text
from shelfspark.operators.subwords import Merges, byte_characters

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def merges():
    return Merges.read(PATH)


@pytest.fixture(scope="module")
def tokens(spark):
    return text.pretokenize(spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text"), "text")


def test_ids_of_every_distinct_word_equal_the_tokenizers(merges, tokens):
    words = [r.w for r in tokens.select(F.explode("tokens").alias("w")).distinct().collect()]
    words += ["aaaa", "aaaaa", "日本語", "é", "x" * 500, "'ll", "…”", "\U0001f600", "9", "ab" * 200]
    library = Tokenizer.from_file(PATH)
    flat, at = merges.encode(words)
    assert len(words) > 5000
    for w, lo, hi in zip(words, at[:-1], at[1:], strict=True):
        assert flat[lo:hi].tolist() == library.encode(w, add_special_tokens=False).ids, w


def test_rounds_equal_merging_pair_by_pair(merges):
    with open(PATH, encoding="utf-8") as f:
        model = json.load(f)["model"]
    ranks = {tuple(m): i for i, m in enumerate(model["merges"])}
    rng, of = random.Random(4), byte_characters()
    words = ["".join(rng.choice("aelnst") for _ in range(rng.randrange(12))) for _ in range(400)] + [""]
    flat, at = merges.encode(words)
    for w, lo, hi in zip(words, at[:-1], at[1:], strict=True):
        parts = [of[b] for b in w.encode()]
        parts[-1:] = [p + "</w>" for p in parts[-1:]]
        while len(parts) > 1:
            rank, i = min((ranks.get(p, 1 << 30), i) for i, p in enumerate(zip(parts, parts[1:])))
            if rank == 1 << 30:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        assert flat[lo:hi].tolist() == [model["vocab"][p] for p in parts]


def test_documents_keep_order_and_nulls(spark, tokens):
    library = Tokenizer.from_file(PATH)
    df = tokens.limit(20).select("doc_id", "tokens").unionByName(spark.createDataFrame([(-1, None), (-2, []), (-3, ["th", None, "the", "th"])], "doc_id long, tokens array<string>"))
    for r in df.join(text.encode_subwords(df, "doc_id", "tokens", PATH), "doc_id").collect():
        assert r.ids == [i for t in r.tokens or () for i in library.encode(t or "", add_special_tokens=False).ids]


def test_byte_characters_are_the_published_ones():
    from tokenizers.pre_tokenizers import ByteLevel

    assert set(byte_characters().values()) == set(ByteLevel.alphabet()) and len(byte_characters()) == 256


@pytest.mark.parametrize("held", [1 << 20, 4])
def test_counts_of_tokens(spark, held):
    rng = random.Random(1)
    lists = [None if i % 9 == 0 else [rng.choice("abcdefgh") if rng.random() < 0.9 else None for _ in range(rng.randrange(9))] for i in range(200)]
    df = spark.createDataFrame([(x,) for x in lists], "t array<string>").repartition(3)
    assert {r.token: r.n for r in text.token_counts(df, "t", held).collect()} == Counter(c for x in lists for c in x or () if c is not None)


def test_decoding_without_and_with_a_join(spark):
    vocab = spark.createDataFrame([(i, t) for i, t in enumerate(["a", "b", "<|x|>", "c\n", None, "<|y"])], "id int, token string")
    df = spark.createDataFrame([(1, [0, 1, 2, 3, 77, None, 5]), (2, []), (3, None), (4, [4, 2])], "k long, ids array<int>")
    want = {1: "a b c\n <|y", 2: "", 3: "", 4: ""}
    for most in (100, 2):
        assert {r.k: r.text for r in text.decode_tokens(df, "k", "ids", vocab, max_vocab=most).collect()} == want
    assert text.decode_tokens(df, "k", "ids", vocab, end_id=1).where("k = 1").first().text == "a"
    plan = text.decode_tokens(df, "k", "ids", vocab)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Generate" not in plan


def test_a_list_of_pairs_over_characters(spark):
    df = spark.createDataFrame([(1, ["cats", "at", "日本", "", None, "aab", "s"]), (2, None)], "k long, t array<string>")
    pairs = [("a", "t"), ("c", "at"), ("cat", "s</w>"), ("a", "a"), ("日", "本</w>"), ("a", "t")]
    got = {r.k: r.pieces for r in text.encode_subwords(df, "k", "t", pairs).collect()}
    assert got == {1: ["cats</w>", "a", "t</w>", "日本</w>", "aa", "b</w>", "s</w>"], 2: []}


def test_token_lists_are_worked_on_in_pieces(monkeypatch):
    """A batch of 10,000 long texts was flattened at once."""
    monkeypatch.setattr(text, "_VALUES_AT_ONCE", 10)
    lists = [["a"] * n for n in (3, 7, 0, 1, 25, 0, 10, 4)] + [None, ["b"]]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(lists))), pa.array(lists, pa.list_(pa.string()))], names=["key_", "tokens_"])
    pieces = list(text._pieces(iter([batch, batch.slice(0, 0)]), "tokens_"))
    assert [r for p in pieces for r in p.column("tokens_").to_pylist()] == lists
    assert all(len(p) == 1 or sum(len(x or ()) for x in p.column("tokens_").to_pylist()) <= 10 for p in pieces)
