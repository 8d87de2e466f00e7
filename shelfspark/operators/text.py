"""Text-corpus jobs: tokens and their ids over a table of documents."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .sequences import fit_length
from .subwords import Merges

# Fixed value: the published pre-token pattern.
PRETOKEN = r"('s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+)"


def normalize_text(c: Column, lower: bool = True) -> Column:
    out = F.regexp_replace(c, r"\s+", " ")
    return F.lower(out) if lower else out


def pretokenize(df: DataFrame, col: str, out: str = "tokens", pattern: str = PRETOKEN) -> DataFrame:
    """Contractions, runs of letters, single digits, runs of anything else, in lower case.

    No token holds white space, so it need not be collapsed first.
    """
    return df.withColumn(out, F.regexp_extract_all(F.lower(col), F.lit(pattern), 1))


#: Values of a list column that are worked on at once; a batch of long texts has far more.
_VALUES_AT_ONCE = 1 << 19


def _pieces(batches: Iterator[pa.RecordBatch], lists: str) -> Iterator[pa.RecordBatch]:
    """The rows of batches, as many at a time as have few values in ``lists``, one at least."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.list_value_length(batch.column(lists)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        begin = 0
        while begin < len(batch):
            end = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + _VALUES_AT_ONCE, "right")))
            yield batch.slice(begin, end - begin)
            begin = end


def encode_tokens(df: DataFrame, key: str, tokens: str, vocab: DataFrame, start_id: int, end_id: int, length: int, pad: int = 0, max_vocab: int = 500_000) -> DataFrame:
    """(key, ids): ids of known tokens between start and end, cut so that the end stays, padded to ``length``.

    A vocabulary of up to ``max_vocab`` tokens is read when the plan is built and looked
    up in the tasks, without a shuffle; a larger one is joined with the tokens. Null
    tokens count as none.
    """
    stated = vocab.select("token", "id").limit(max_vocab + 1).toPandas()
    if len(stated) <= max_vocab:
        return _encode_locally(df, key, tokens, stated, start_id, end_id, length, pad)
    rows = df.select(key, F.posexplode_outer(tokens).alias("pos_", "token")).join(vocab.select("token", "id"), "token", "left")
    ids = rows.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.when(F.col("id").isNotNull(), F.struct("pos_", F.col("id").cast("long").alias("id"))))), lambda x: x["id"]).alias("ids_"))
    whole = F.concat(F.array(F.lit(start_id).cast("long")), F.slice("ids_", 1, length - 2), F.array(F.lit(end_id).cast("long")))
    return ids.select(key, fit_length(whole, length, F.lit(pad).cast("long")).alias("ids"))


def _encode_locally(df: DataFrame, key: str, tokens: str, vocab: pd.DataFrame, start_id: int, end_id: int, length: int, pad: int) -> DataFrame:
    known = df.sparkSession.sparkContext.broadcast((pa.array(vocab["token"], pa.string()), vocab["id"].to_numpy(np.int64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, ids = known.value
        for batch in _pieces(batches, "tokens_"):
            lists = batch.column("tokens_")
            size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            at = pc.index_in(pc.list_flatten(lists), value_set=words)
            found = at.is_valid().to_numpy(zero_copy_only=False)
            owner = np.repeat(np.arange(len(size)), size)[found]
            n = np.bincount(owner, minlength=len(size))
            place = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
            kept = place < length - 2
            out = np.full((len(size), length), pad, np.int64)
            out[:, 0] = start_id
            out[owner[kept], place[kept] + 1] = ids[at.drop_null().to_numpy()[kept]]
            out[np.arange(len(size)), np.minimum(n, length - 2) + 1] = end_id
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(size) + 1, dtype=np.int32) * length), pa.array(out.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("key_"), flat], names=["key_", "ids"])

    kind = df.schema[key].dataType.simpleString()
    rows = df.select(F.col(key).alias("key_"), F.col(tokens).alias("tokens_"))
    return rows.mapInArrow(run, f"key_ {kind}, ids array<bigint>").withColumnRenamed("key_", key)


#: Words whose ids a worker keeps for batches to come.
_KEPT_WORDS = 200_000
_word_ids: dict[str, dict[str, np.ndarray]] = {}


def encode_subwords(df: DataFrame, key: str, tokens: str, merges: str | list[tuple[str, str]], end: str = "</w>") -> DataFrame:
    """Byte-pair merges of the tokens of each row, lowest rank first.

    ``merges`` is the path of a ``tokenizers`` file, and the result (key, ids); or a list
    of pairs over characters, ``end`` marking the last of a word, and the result
    (key, pieces). The distinct words of a batch are merged together, and only those
    that the worker hasn't met lately. The merges are read when the plan is built and
    sent to the tasks; nothing is shuffled. Null tokens count as none.
    """
    held, name = Merges.of(merges, end), "ids" if isinstance(merges, str) else "pieces"
    spread, own_words = df.sparkSession.sparkContext.broadcast(held), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if own_words not in _word_ids:
            _word_ids.clear()  # words of an earlier plan
        known, table_of = _word_ids.setdefault(own_words, {}), spread.value
        for batch in _pieces(batches, "tokens_"):
            lists = batch.column("tokens_")
            size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            coded = pc.fill_null(pc.list_flatten(lists), "").dictionary_encode()
            words = coded.dictionary.to_pylist()
            if len(known) > _KEPT_WORDS:
                known.clear()
            new = [w for w in words if w not in known]
            flat, at = table_of.encode(new)
            known.update((w, flat[lo:hi]) for w, lo, hi in zip(new, at[:-1], at[1:], strict=True))
            own = [known[w] for w in words]
            count = np.array([len(x) for x in own], np.int64)
            table, first = np.concatenate([*own, np.zeros(0, np.int64)]), np.cumsum(count) - count
            code = coded.indices.to_numpy(zero_copy_only=False)
            ends = np.append(0, np.cumsum(count[code]))
            ids = table[np.repeat(first[code] - ends[:-1], count[code]) + np.arange(ends[-1])]
            bounds = ends[np.append(0, np.cumsum(size))]
            values = pa.array(ids) if name == "ids" else pa.array([table_of.piece(i) for i in ids.tolist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("key_"), pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), values)], names=["key_", name])

    kind = df.schema[key].dataType.simpleString()
    rows = df.select(F.col(key).alias("key_"), F.col(tokens).alias("tokens_"))
    return rows.mapInArrow(run, f"key_ {kind}, {name} array<{'bigint' if name == 'ids' else 'string'}>").withColumnRenamed("key_", key)


# Fixed value: tokens that decoding skips.
SPECIAL = r"^<\|.*\|>$"


def decode_tokens(df: DataFrame, key: str, ids: str, vocab: DataFrame, end_id: int | None = None, max_vocab: int = 500_000) -> DataFrame:
    """(key, text): tokens of known ids, without ``<|...|>`` specials; from ``end_id`` on ids are dropped.

    A vocabulary of up to ``max_vocab`` tokens is read when the plan is built and looked
    up in the tasks, without a shuffle; a larger one is joined with the ids. Null ids
    count as none.
    """
    usable = vocab.select("id", "token").where(F.col("token").isNotNull() & ~F.col("token").rlike(SPECIAL))
    if end_id is not None:
        usable = usable.where(F.col("id") < end_id)
    stated = usable.limit(max_vocab + 1).toPandas()
    if len(stated) <= max_vocab:
        return _decode_locally(df, key, ids, stated)
    rows = df.select(key, F.posexplode_outer(ids).alias("pos_", "id")).join(usable, "id", "left")
    parts = F.array_sort(F.collect_list(F.when(F.col("token").isNotNull(), F.struct("pos_", "token"))))
    return rows.groupBy(key).agg(F.array_join(F.transform(parts, lambda x: x["token"]), " ").alias("text"))


def _decode_locally(df: DataFrame, key: str, ids: str, vocab: pd.DataFrame) -> DataFrame:
    spread = df.sparkSession.sparkContext.broadcast((pa.array(vocab["id"].to_numpy(np.int64)), pa.array(vocab["token"], pa.string())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, tokens = spread.value
        for batch in _pieces(batches, "ids_"):
            lists = batch.column("ids_")
            size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            at = pc.index_in(pc.list_flatten(lists), value_set=known)
            kept = np.append(0, np.cumsum(at.is_valid().to_numpy(zero_copy_only=False)))
            bounds = kept[np.append(0, np.cumsum(size))]
            words = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), tokens.take(at.drop_null()))
            yield pa.RecordBatch.from_arrays([batch.column("key_"), pc.binary_join(words, " ")], names=["key_", "text"])

    kind = df.schema[key].dataType.simpleString()
    rows = df.select(F.col(key).alias("key_"), F.col(ids).cast("array<bigint>").alias("ids_"))
    return rows.mapInArrow(run, f"key_ {kind}, text string").withColumnRenamed("key_", key)


def token_counts(df: DataFrame, tokens: str, held: int = 1 << 19) -> DataFrame:
    """(token, n): how often each token stands in the lists; tasks count theirs first and hand on a row a token."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[pa.Table] = []

        def merged() -> pa.Table:
            return pa.concat_tables(parts).group_by("token").aggregate([("n", "sum")]).rename_columns(["token", "n"])

        for batch in _pieces(batches, "tokens_"):
            found = pc.value_counts(pc.list_flatten(batch.column("tokens_")).drop_null())
            parts.append(pa.table({"token": found.field("values"), "n": found.field("counts")}))
            if sum(p.num_rows for p in parts) > held:
                parts = [merged()]
                if parts[0].num_rows > held // 2:
                    yield from parts.pop().combine_chunks().to_batches()
        if parts:
            yield from merged().combine_chunks().to_batches()

    return df.select(F.col(tokens).alias("tokens_")).mapInArrow(run, "token string, n long").groupBy("token").agg(F.sum("n").alias("n"))


def corpus_vocab(df: DataFrame, tokens: str, size: int) -> DataFrame:
    """(token, id): the ``size`` most frequent tokens, ids by frequency and then token."""
    top = token_counts(df, tokens).orderBy(F.col("n").desc(), "token").limit(size)
    own = top.agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("c"), "token"))), lambda x: x["token"]).alias("t"))
    return own.select(F.posexplode("t").alias("id", "token"))


def join_regions(df: DataFrame, key: str, order: str, text: str) -> DataFrame:
    """(key, text): lines that aren't empty, in order, joined by newlines."""
    parts = F.array_sort(F.collect_list(F.when(F.trim(text) != "", F.struct(F.col(order).alias("o"), F.col(text).alias("t")))))
    return df.groupBy(key).agg(F.array_join(F.transform(parts, lambda x: x["t"]), "\n").alias("text"))
