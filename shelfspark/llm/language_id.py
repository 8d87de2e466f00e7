"""Language identification by error-correcting output codes.

Every language gets a codeword; one binary classifier per bit, linear over hashed
byte n-grams of letters, tells which side a text is on. A classifier's weights
are log-odds of the n-gram distributions of its two sides, counted by Spark over
all training rows. Decoding sums, for every codeword, the logistic losses of its
bits, each weighted by how reliably that bit tells that language; the nearest
codeword wins, and a small lead over the second marks the result as ambiguous.

Defined results: null text, or text without a letter, is ``und`` with score 0;
rows with a null id are never learned from and count as held out; a null language
is not learned; without any training row every text is ``und``; repeated rows are
predicted one by one; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import materialize, scratch
from .textscan import released, slices, small_batches

N_GRAM = 3
BUCKETS = 1 << 15
MAX_LANGUAGES = 20_000
_SLICE = 1 << 20
_FOLD = np.arange(256, dtype=np.uint32)
_FOLD[:128] = 32  # ASCII other than letters reads as one blank
_FOLD[65:91] = np.arange(97, 123)
_FOLD[97:123] = np.arange(97, 123)


@dataclass
class LanguageModel:
    """Languages, their codewords in -1/+1, and a weight for each bucket and bit; size is bounded by BUCKETS and the languages."""

    languages: list[str]
    codes: np.ndarray  # languages x bits
    weights: np.ndarray  # BUCKETS x bits
    trust: np.ndarray  # languages x bits


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each byte n-gram of each text, in a row, and where each text's begin."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = _FOLD[np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]]] if raw else np.zeros(0, np.uint32)
    offsets = offsets - offsets[0]
    total = max(0, len(data) - N_GRAM + 1)
    h = np.zeros(total, np.uint32)
    for k in range(N_GRAM):
        h = (h << np.uint32(8)) | data[k : k + total]
    keep = np.ones(total, bool)
    for k in range(1, N_GRAM):  # n-grams that reach into the next text
        cut = offsets[1:-1] - k
        keep[cut[(cut >= 0) & (cut < total)]] = False
    bucket = ((h * np.uint32(0x9E3779B1)) >> np.uint32(32 - 15)).astype(np.int32)
    return bucket[keep], np.concatenate([[0], np.cumsum(keep)])[np.minimum(offsets, total)]


def codewords(n: int) -> np.ndarray:
    """-1/+1 codewords of n languages: all splits of up to six, else the best of seeded dense codes."""
    if n <= 6:
        bits = [(1, *b) for b in product((1, -1), repeat=n - 1) if -1 in b] or [(1,)]
        return np.array(bits).T
    rng, best, far = np.random.default_rng(7), None, -1
    width = int(np.ceil(15 * np.log2(n)))
    for _ in range(50 if n <= 2000 else 1):  # of very many languages the first code must do
        code = rng.choice([-1, 1], size=(n, width))
        code = code[:, np.abs(code.sum(axis=0)) < n]
        apart = (code @ code.T - np.eye(n) * 10**6).max() if n <= 2000 else 0
        if best is None or -apart > far:
            best, far = code, -apart
    return best


def count_ngrams(docs: DataFrame) -> DataFrame:
    """(lang, bucket, n) over all rows of (lang, text), combined within each task before the shuffle."""
    small_batches(docs.sparkSession)

    def counted(total: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for name, n in total.items():
            found = np.flatnonzero(n)
            yield pa.record_batch({"lang": pa.array([name] * len(found), pa.string()), "bucket": pa.array(found, pa.int32()), "n": pa.array(n[found], pa.int64())})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in released(batches):
            for part in slices(batch, "text", _SLICE):
                buckets, at = features(part.column("text"))
                lang = part.column("lang").dictionary_encode()
                owner = np.repeat(lang.indices.to_numpy(), np.diff(at))
                for k, name in enumerate(lang.dictionary.to_pylist()):
                    total[name] = total.get(name, 0) + np.bincount(buckets[owner == k], minlength=BUCKETS)
                if len(total) > 32:  # many languages: pass on what is counted so far
                    yield from counted(total)
                    total = {}
        yield from counted(total)

    return docs.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, max_languages: int | None = None) -> LanguageModel:
    """Fit on all rows of (lang, text), every language among them.

    Sums over languages and over buckets are made by Spark; what reaches the driver is the
    model: a row of bits a bucket, and a row of bits a language. More than
    ``MAX_LANGUAGES`` are refused. Only if ``max_languages`` is given, a choice is made:
    those with the most n-grams, of equal ones the least.
    """
    with scratch(docs.sparkSession):
        counts = materialize(count_ngrams(docs), "language-counts")
        sizes = counts.groupBy("lang").agg(F.sum("n").alias("n"))
        if max_languages is not None:
            sizes = sizes.orderBy(F.col("n").desc(), "lang").limit(max_languages)
            counts = counts.join(F.broadcast(sizes.select("lang")), "lang", "left_semi")
        found = sizes.limit(MAX_LANGUAGES + 1).collect()
        if len(found) > MAX_LANGUAGES:
            raise ValueError(f"more than {MAX_LANGUAGES} languages")
        totals = {r["lang"]: r["n"] + 0.5 * BUCKETS for r in sorted(found, key=lambda r: r["lang"])}
        if not totals:
            return LanguageModel([], np.zeros((0, 0)), np.zeros((BUCKETS, 0), np.float32), np.zeros((0, 0)))
        languages, total = list(totals), np.array(list(totals.values()))
        codes = codewords(len(languages))
        ones, width = codes > 0, codes.shape[1]
        number = {lang: k for k, lang in enumerate(languages)}
        spread = docs.sparkSession.sparkContext.broadcast((number, total, ones))

        def by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            number, total, ones = spread.value
            for batch in batches:
                k, bucket, n = _columns(batch, number)
                share = n / total[k]
                yield _summed("bucket", bucket, np.concatenate([share[:, None] * ones[k], share[:, None]], axis=1))

        dense = _gathered(counts.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(by_bucket, "bucket int, sums binary"), BUCKETS, width + 1)
        # each side's share of a bucket: the mean over its languages, each count raised by a half
        start = 0.5 / total
        one = dense[:, :width] + (start[:, None] * ones).sum(axis=0)
        other = dense[:, width:] - dense[:, :width] + (start[:, None] * ~ones).sum(axis=0)
        n_ones = ones.sum(axis=0)
        split = n_ones < len(languages)
        weights = np.zeros((BUCKETS, width), np.float32)
        weights[:, split] = np.log(one[:, split] / n_ones[split]) - np.log(other[:, split] / (len(languages) - n_ones[split]))
        shared = docs.sparkSession.sparkContext.broadcast(weights)

        def by_language(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            number, weights = spread.value[0], shared.value
            for batch in batches:
                for at in range(0, batch.num_rows, 1 << 14):
                    k, bucket, n = _columns(batch.slice(at, 1 << 14), number)
                    w = weights[bucket].astype(np.float64)
                    yield _summed("lang", k, np.concatenate([n[:, None] * w, n[:, None] * w**2], axis=1))

        sums = _gathered(counts.repartition("lang").sortWithinPartitions("lang").mapInArrow(by_language, "lang int, sums binary"), len(languages), 2 * width)
    w = weights.astype(np.float64)
    mean, square = ((sums[:, i * width : (i + 1) * width] + 0.5 * (w ** (i + 1)).sum(axis=0)) / total[:, None] for i in (0, 1))
    # how many standard deviations of a text of 50 n-grams each bit keeps each language from the border
    trust = np.clip(codes * mean / np.sqrt(np.maximum(square - mean**2, 1e-9)) * np.sqrt(50), 0.05, 3.0)
    return LanguageModel(languages, codes, weights, trust / trust.sum(axis=1, keepdims=True))


def _columns(batch: pa.RecordBatch, number: dict[str, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Language number, bucket and count of each row."""
    lang = batch.column("lang").dictionary_encode()
    names = np.array([number[x] for x in lang.dictionary.to_pylist()], np.int64)
    return names[lang.indices.to_numpy()], batch.column("bucket").to_numpy(), batch.column("n").to_numpy().astype(np.float64)


def _summed(name: str, keys: np.ndarray, rows: np.ndarray) -> pa.RecordBatch:
    """One row of sums for each run of equal keys."""
    starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    sums = np.add.reduceat(rows, starts, axis=0) if len(keys) else rows
    return pa.record_batch({name: pa.array(keys[starts], pa.int32()), "sums": pa.array([x.tobytes() for x in sums], pa.binary())})


def _gathered(df: DataFrame, n: int, width: int) -> np.ndarray:
    """Rows of sums by key, on the driver; their number is bounded by the model."""
    out = np.zeros((n, width))
    for key, sums in df.toLocalIterator(prefetchPartitions=True):
        out[key] += np.frombuffer(sums, np.float64)
    return out


def predict(docs: DataFrame, model: LanguageModel, min_lead: float = 0.05, keep: list[str] | None = None, names: tuple[str, str, str] = ("lang_pred", "score", "ambiguous")) -> DataFrame:
    """Add the language, its score (0 to 1) and whether it is ambiguous to rows with ``text``.

    ``keep`` names the columns to carry, ``names`` the new ones, which must differ from them.
    """
    small_batches(docs.sparkSession)
    keep = docs.columns if keep is None else keep
    fields = [docs.schema[c] for c in keep]
    source = docs if "text" in keep else docs.select(*keep, "text")
    spread = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = spread.value
        for batch in released(batches):
            for part in slices(batch, "text", _SLICE):
                text = part.column("text")
                letters = pc.fill_null(pc.match_substring_regex(text, r"\pL"), False).to_numpy(zero_copy_only=False)
                n = part.num_rows
                if m.languages:
                    buckets, at = features(text)
                    sums = np.concatenate([m.weights[buckets], np.zeros((1, m.weights.shape[1]), np.float32)])
                    size = np.diff(at)
                    # single precision over a megabyte would lose digits between texts; reduceat adds each text on its own
                    f = np.add.reduceat(sums, np.minimum(at[:-1], len(sums) - 1), axis=0) * (size > 0)[:, None] / np.maximum(size, 1)[:, None]
                    z = f * np.minimum(size, 200)[:, None] ** 0.5
                    loss = np.stack([(t * np.logaddexp(0, -c * z)).sum(axis=1) for c, t in zip(m.codes, m.trust, strict=True)], axis=1)
                    near = np.exp(-(loss - loss.min(axis=1, keepdims=True)) * m.codes.shape[1])
                    near /= near.sum(axis=1, keepdims=True)
                    best = near.argmax(axis=1)
                    top = np.sort(near, axis=1)[:, ::-1]
                    score = top[:, 0]
                    lead = score - (top[:, 1] if top.shape[1] > 1 else 0)
                else:
                    letters, best, score, lead = np.zeros(n, bool), np.zeros(n, int), np.zeros(n), np.zeros(n)
                languages = np.array([*m.languages, "und"], object)
                found = pa.array(np.where(letters, languages[best], "und"), pa.string()), pa.array(np.where(letters, score, 0.0), pa.float64()), pa.array(letters & (lead < min_lead))
                out = {c: part.column(c) for c in keep} | dict(zip(names, found, strict=True))
                yield pa.RecordBatch.from_arrays(list(out.values()), names=list(out))

    kinds = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), f"`{names[0]}` string, `{names[1]}` double, `{names[2]}` boolean"])
    return source.mapInArrow(run, kinds)


def held_out(id_col: str, folds: int) -> Column:
    """True for the rows that training leaves out: crc32 of the id as text, modulo folds, is 0; and for null ids."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == 0, F.lit(True))


def identify(docs: DataFrame, folds: int = 5, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Fit on the rows that are not held out, and predict all: (doc_id, held_out, lang_pred, score, ambiguous)."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    train = rows.where(~held_out("doc_id", folds) & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text")
    found = predict(rows.select("doc_id", "text"), fit(train), keep=["doc_id"])
    return found.select("doc_id", held_out("doc_id", folds).alias("held_out"), "lang_pred", "score", "ambiguous")
