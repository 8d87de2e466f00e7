from __future__ import annotations

import random

import pytest

#: Null, empty, blank and single-word texts, ties, repeats, other scripts, control characters, a very long text.
EDGE = [None, "", "   \n\t ", "one", "One two", "same text here", "same text here", "naïve café – ok", "日本語 テキスト", "a\x0bb\x0cc\x1fd e", "123 456", "word " * 30000]


def make_texts(n: int = 60, seed: int = 3) -> list[str]:
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 6))) for _ in range(150)]
    out = []
    for i in range(n):
        if i % 4 == 3 and out:
            words = out[rng.randrange(len(out))].split(" ")
            for _ in range(max(1, len(words) // 40)):
                words[rng.randrange(len(words))] = rng.choice(vocab)
            out.append(" ".join(words))
        else:
            out.append(" ".join(rng.choice(vocab) for _ in range(rng.randint(1, 120))))
    return out


@pytest.fixture(scope="session")
def edge_docs(spark):
    rows = [(i, t, "en", i, "x", 1) for i, t in enumerate(EDGE)] + [(None, "no id here", None, 0, None, None), (5, "same text here", "en", 5, "x", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, component long, key string, n int")


@pytest.fixture(scope="session")
def made_docs(spark):
    return spark.createDataFrame([(i * 7, t) for i, t in enumerate(make_texts())], "doc_id long, text string").repartition(4)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string")
