from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from shelfspark.llm import language_id, lm_scoring, token_counts

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def tokens(text):
    return [*WORD.findall((text or "").translate(LOWER)), None]


def kneser_ney(train, texts):
    """Plain dictionaries; (n_known, base, score) for each text."""
    uni, bi = Counter(), Counter()
    for t in train:
        w = tokens(t)
        uni.update(w)
        bi.update(zip([0, *w], w))
    n, v, types = sum(uni.values()), len(uni), len(bi)

    def disc(c):
        n1, n2, n3, n4 = (max(1, sum(x == k for x in c)) for k in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2)
        d = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3]
        return [0, *(min(max(x, 0.01), k - 0.01) for k, x in enumerate(d, 1))]

    follow = Counter(b for _, b in bi)
    d2, d1 = disc(bi.values()), disc(follow.values())
    by = defaultdict(list)
    for (a, _), c in bi.items():
        by[a].append(c)
    spread = sum(d1[min(c, 3)] for c in follow.values()) / types if types else 1

    def p(a, b):
        f = follow[b]
        low = max(f - d1[min(f, 3)], 0) / max(types, 1) + spread / (v + 1)
        if a not in by:
            return low
        total, c = sum(by[a]), bi[a, b]
        return max(c - d2[min(c, 3)], 0) / total + sum(d2[min(x, 3)] for x in by[a]) / total * low

    for t in texts:
        w = tokens(t)
        yield sum(uni[x] > 0 for x in w), sum(math.log10((uni[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w), sum(math.log10(p(a, b)) for a, b in zip([0, *w], w))


@pytest.mark.parametrize("which", ["made_docs", "edge_docs"])
def test_lm_scores_match_plain_counting(request, which):
    docs = request.getfixturevalue(which)
    rows = docs.select("doc_id", "text").collect()
    train = [r.text for r in rows if r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 10]
    want = sorted(((-1 if r.doc_id is None else r.doc_id), len(tokens(r.text)), *map(lambda x: round(x, 6), e)) for r, e in zip(rows, kneser_ney(train, [r.text for r in rows]), strict=True))
    got = lm_scoring.lm_scores(docs, bits=3).collect()
    have = sorted(((-1 if r.doc_id is None else r.doc_id), r.n_tokens, r.n_known, round(r.base_score, 6), round(r.score, 6)) for r in got)
    assert len(have) == len(want)
    for a, b in zip(have, want, strict=True):
        assert a == pytest.approx(b, rel=1e-6, abs=1e-5)
    assert {r.train_tokens for r in got} == {sum(len(tokens(t)) for t in train)}


def test_lm_of_an_empty_table(no_docs):
    assert lm_scoring.lm_scores(no_docs, bits=2).count() == 0


def test_ranges_grow_with_the_input(made_docs):
    assert [lm_scoring.range_bits(n) for n in (0, 1 << 30, 1 << 36, 1 << 50)] == [7, 7, 12, 17]
    assert lm_scoring.train_model(made_docs.select("text")).words.bits == 7


def test_blocks_round_trip():
    import numpy as np

    keys = np.sort(np.random.default_rng(1).integers(0, 1 << 63, 1000).astype(np.uint64))
    keys, counts = lm_scoring.tally(np.concatenate([keys, keys[:10]]))
    k, c = lm_scoring.unpack_block(lm_scoring.pack_block(keys, counts))
    assert (k == keys).all() and (c == counts).all() and c.sum() == 1010


def test_language_held_out_accuracy(spark):
    import random

    rng = random.Random(5)
    stems = {"aa": ["lum", "tor", "ven", "sil"], "bb": ["krz", "szc", "dow", "niy"], "cc": ["oui", "eau", "tre", "ch"], "dd": ["und", "sch", "ein", "ge"], "ee": ["ção", "nho", "lh", "os"]}
    rows = [(i, " ".join("".join(rng.choice(stems[lang]) for _ in range(rng.randint(1, 3))) for _ in range(20)), lang) for i in range(300) for lang in [rng.choice([*stems])]]
    rows += [(900, None, "aa"), (901, "", "aa"), (902, "12 34 !", "bb"), (903, "lumtor", None), (None, "krzszc", "bb")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in language_id.identify(docs).collect()}
    assert len(got) == len(rows)
    held = [(i, lang) for i, _, lang in rows[:300] if zlib.crc32(str(i).encode()) % 5 == 0]
    assert held and all(got[i].held_out for i, _ in held)
    assert sum(got[i].lang_pred == lang for i, lang in held) >= 0.95 * len(held)
    assert [got[i].lang_pred for i in (900, 901, 902)] == ["und"] * 3 and got[903].lang_pred == "aa"
    assert all(0 <= r.score <= 1 for r in got.values())


def test_language_without_training_rows(spark, no_docs):
    assert language_id.identify(no_docs).count() == 0
    one = spark.createDataFrame([(1, "text", None)], "doc_id long, text string, lang string")
    assert language_id.identify(one).first().lang_pred == "und"


@pytest.mark.parametrize("n", [1, 2, 4, 6, 9, 40])
def test_codewords_tell_languages_apart(n):
    codes = language_id.codewords(n)
    assert len({tuple(c) for c in codes}) == n


def test_token_counts_match_the_library(spark, made_docs, edge_docs):
    from tokenizers import Tokenizer, models

    path = public_tokenizers.path("piece_bpe_32k.model")
    vocab = token_counts.vocabulary(path)
    library = Tokenizer(models.Unigram([("<unk>", 0.0), *vocab.items()], 0, False))
    counter = token_counts.UnigramCounter(vocab)
    texts = [r.text or "" for d in (made_docs, edge_docs) for r in d.select("text").collect()] + ["ȹȹȹxyȹ zz☃☃ ☃a ▁▁ a▁b"]
    words = sorted({w for t in texts for w in WORD.findall(t)} - {w for t in texts for w in WORD.findall(t) if "▁" in w[1:]})
    for w in words:
        assert counter.word(w)[0] == len(library.encode("▁" + w, add_special_tokens=False).ids), w


def test_token_counts_with_ties():
    from tokenizers import Tokenizer, models

    import random

    rng = random.Random(2)
    for _ in range(30):
        vocab = {"▁": -1.0} | {"".join(rng.choice("ab") for _ in range(rng.randint(1, 4))): float(-rng.randint(1, 4)) for _ in range(8)}
        library = Tokenizer(models.Unigram([("<unk>", min(vocab.values())), *vocab.items()], 0, False))
        counter = token_counts.UnigramCounter(vocab)
        for _ in range(40):
            w = "".join(rng.choice("abc") for _ in range(rng.randint(1, 12)))
            assert counter.word(w)[0] == len(library.encode("▁" + w, add_special_tokens=False).ids), (vocab, w)


def test_token_counts_of_edge_rows(edge_docs, no_docs):
    path = public_tokenizers.path("piece_bpe_32k.model")
    got = token_counts.token_counts(edge_docs, path).collect()
    assert len(got) == edge_docs.count()
    by = {r.doc_id: r for r in got}
    assert by[0].n_tokens == by[1].n_tokens == by[2].n_tokens == 0 and by[11].n_words == 30000
    assert token_counts.token_counts(no_docs, path).count() == 0


def test_languages_beside_clashing_columns_and_beyond_the_limit(spark):
    rows = [(i, " ".join(["aab", "bba", "abab"] * 9) if i % 2 else " ".join(["xyz", "zzy", "yx"] * 9), "one" if i % 2 else "two") for i in range(20)] + [(99, "qq", "junk")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("s")).withColumn("lang_pred", F.lit(1))
    model = language_id.fit(docs, max_languages=2)
    assert model.languages == ["one", "two"]
    got = language_id.predict(docs, model, names=("p", "q", "r")).collect()
    assert all(r.p == r.lang and r.score == "s" for r in got if r.lang != "junk")
    many = spark.createDataFrame([(f"l{i}", f"w{i} " * 5) for i in range(80)], "lang string, text string").coalesce(1)
    assert language_id.count_ngrams(many).select("lang").distinct().count() == 80


def plain_model(rows):
    """Weights and trust of each bit from whole tables of shares."""
    languages = sorted({lang for lang, _ in rows})
    share = np.full((len(languages), language_id.BUCKETS), 0.5)
    for lang, text in rows:
        raw = bytes(ord(c.lower()) if c.isascii() and c.isalpha() else 32 if c.isascii() else 0 for c in text) if text.isascii() else None
        raw = np.frombuffer(raw or bytes(b | 32 if 65 <= b <= 90 else b if b > 127 or 97 <= b <= 122 else 32 for b in text.encode()), np.uint8)
        for i in range(len(raw) - 2):
            h = (int(raw[i]) << 16 | int(raw[i + 1]) << 8 | int(raw[i + 2])) * 0x9E3779B1 & 0xFFFFFFFF
            share[languages.index(lang), h >> 17] += 1
    share /= share.sum(axis=1, keepdims=True)
    codes = language_id.codewords(len(languages))
    weights = np.stack([np.log(share[c > 0].mean(axis=0)) - np.log(share[c < 0].mean(axis=0)) for c in codes.T], axis=1)
    mean = share @ weights
    trust = np.clip(codes * mean / np.sqrt(np.maximum(share @ weights**2 - mean**2, 1e-9)) * 50**0.5, 0.05, 3)
    return languages, weights, trust / trust.sum(axis=1, keepdims=True)


@pytest.mark.parametrize("n", [2, 5, 9])
def test_language_model_equals_plain_counting(spark, n):
    rng = random.Random(n)
    rows = [(f"l{k}", " ".join("".join(rng.choice("abcdeé ü"[k % 4 :] + "xyzXY"[: 1 + k % 5]) for _ in range(rng.randrange(1, 9))) for _ in range(40))) for k in range(n) for _ in range(6)]
    languages, weights, trust = plain_model(rows)
    model = language_id.fit(spark.createDataFrame(rows, "lang string, text string").repartition(3))
    assert model.languages == languages
    assert np.allclose(model.weights, weights, atol=1e-4) and np.allclose(model.trust, trust, atol=1e-5)


def test_no_language_is_left_out(spark):
    """More languages than an early version learned; each has letters of its own."""
    rows = [(f"l{k:03d}", " ".join(chr(0x4E00 + 20 * k + (i * 7 + j) % 20) * 2 for j in range(30))) for k in range(260) for i in range(3)]
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(4)
    model = language_id.fit(docs)
    assert len(model.languages) == 260
    got = language_id.predict(docs, model).collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 0.99 * len(got)
    with pytest.raises(ValueError, match="more than"):
        language_id.MAX_LANGUAGES, before = 100, language_id.MAX_LANGUAGES
        try:
            language_id.fit(docs)
        finally:
            language_id.MAX_LANGUAGES = before


def test_language_of_long_texts_and_ties(spark):
    train = spark.createDataFrame([("a", "same words here"), ("b", "same words here"), ("c", "other " * 50)], "lang string, text string")
    docs = spark.createDataFrame([(1, "same words here"), (2, "other " * 400_000), (3, None), (4, "12 34")], "doc_id long, text string")
    got = {r.doc_id: r for r in language_id.predict(docs, language_id.fit(train)).collect()}
    assert got[1].lang_pred == "a" and got[1].ambiguous and got[2].lang_pred == "c" and not got[2].ambiguous
    assert (got[3].lang_pred, got[3].score, got[4].lang_pred) == ("und", 0.0, "und")
