"""Jobs over tables of stored filters and query strings."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import written
from .predicate_index import PredicateIndex

#: Filters of one wording that a row of ``_shared`` holds at most, about.
IDS_AT_ONCE = 4096

# Token classes of a query string in matching order, with their patterns.
TOKENS = [
    ("escaped", r"\\@"),
    ("modality", r"@has:(?:audio|speech|text|motion)"),
    ("bracket", r"\(|\)"),
    ("not", r"!"),
    ("and", r"&"),
    ("or", r"\|"),
    ("fileext", r"@\.[a-zA-Z0-9]{2,4}(?=\s|$|[&|!()])"),
    ("mode", r"@(?:audiocontent|imagecontent|ocr|transcript)"),
    ("filetype", r"@(?:video|gif|picture|image|photo|audio|sound)"),
    ("logical", r"@date(?:[<>=]=?)[^\s@&|!()]+"),
    ("logical", r"@date\?[0-9]{4}(?:[\d.]*)"),
    ("logical", r"@(?:size|length|duration|width|height|fps|score)(?:[<>=]=?)[^\s@&|!()]+"),
    ("folder", r"@folder:[^\s@&|!()]*"),
    ("invalid", r"@[^\s]*"),
]
ANY = "(?i)(" + "|".join(p for _, p in TOKENS) + ")"
# Fixed value: a folder tag that is well formed.
FOLDER = r"(?i)^@folder:[a-zA-Z0-9_\- ]+(?:/[a-zA-Z0-9_\- ]+){0,4}$"


def match_saved_searches(files: DataFrame, clauses: DataFrame, numeric: list[str], text: list[str], max_compiled: int = 500, max_literals: int | None = None, held: int = 250_000) -> DataFrame:
    """(query_id, file_id): files that satisfy every clause of a stored filter.

    ``clauses`` (query_id, clause_id, column, op, value, negated) is in conjunctive
    normal form: literals with the same clause_id are alternatives. Null makes a
    literal neither true nor false, negated or not; a literal of an unknown column or
    operator, or without a fitting value, is never true.

    Up to ``held`` literals are read when the plan is built. Up to ``max_compiled`` become
    expressions that one pass over the files evaluates. More become a predicate index,
    which is sent to the tasks once; there each file looks up its values, and nothing is
    shuffled. Of more than ``held``, filters that say the same are matched once, and what
    they find is given to each of them; if more than ``held`` literals are left, these are
    dealt by filter into parts of about that many, and every part meets all files in tasks
    of its own. More than ``max_literals`` are refused, if that is given.
    """
    literals = clauses.select("query_id", "clause_id", "column", "op", "value", "negated")
    few = held if max_literals is None else min(held, max_literals)
    stated = literals.limit(few + 1).collect()
    if len(stated) > few:
        n = literals.count()
        if max_literals is not None and n > max_literals:
            raise ValueError(f"more than {max_literals} literals; give the filters in parts")
        return _shared(files, literals, numeric, text, held)
    if len(stated) <= max_compiled:
        return _compiled(files, stated, {*numeric}, {*text})
    return _indexed(files, stated, numeric, text)


def _cells(files: DataFrame, numeric: list[str], text: list[str]) -> DataFrame:
    return files.select(F.col("file_id").alias("file_id_"), *(F.col(c).cast("double").alias(c) for c in numeric), *(F.col(c).cast("string").alias(c) for c in text))


def _matches(index: PredicateIndex, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for rows, ids in index.match(batch):
        yield pa.RecordBatch.from_arrays([pa.array(ids), batch.column("file_id_").take(pa.array(rows))], ["query_id", "file_id"])


def _indexed(files: DataFrame, clauses: list, numeric: list[str], text: list[str]) -> DataFrame:
    spread = files.sparkSession.sparkContext.broadcast(PredicateIndex(clauses, numeric, text))
    cells = _cells(files, numeric, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _matches(spread.value, batch)

    return cells.mapInArrow(run, f"query_id long, file_id {cells.schema['file_id_'].dataType.simpleString()}")


def _shared(files: DataFrame, literals: DataFrame, numeric: list[str], text: list[str], held: int) -> DataFrame:
    """Filters of the same literals are matched as one, the least of them; its files then meet the ids of all of them.

    The ids go to every share of the files, so that neither a filter that many have stored nor
    one that finds many files is one task's work.
    """

    def found(one: DataFrame) -> DataFrame:
        n = one.count()
        return _indexed(files, one.collect(), numeric, text) if n <= held else _dealt(files, one, -(-n // held), numeric, text)

    wording = F.to_json(F.struct(F.sort_array(F.collect_set(F.struct(*(c for c in literals.columns if c != "query_id")))).alias("all")))
    said = written(literals.groupBy("query_id").agg(F.sha2(wording, 256).alias("said_")), "filter-wordings")
    first = written(said.groupBy("said_").agg(F.min("query_id").alias("first_"), F.count("*").alias("n_")), "filter-firsts")
    own = lambda many: literals.join(first.where(F.col("n_") > 1 if many else F.col("n_") == 1).select(F.col("first_").alias("query_id")), "query_id", "left_semi")
    if first.where("n_ > 1").isEmpty():
        return found(literals)
    shares = 2 * files.sparkSession.sparkContext.defaultParallelism
    piece = F.pmod(F.xxhash64("query_id"), F.ceil(F.col("n_") / IDS_AT_ONCE).cast("long"))
    ids = said.join(first.where("n_ > 1"), "said_").groupBy("first_", piece.alias("piece_")).agg(F.collect_list(F.col("query_id").cast("long")).alias("ids_"))
    ids = ids.select("first_", "ids_", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))).alias("share_"))
    once = found(own(True)).select(F.col("query_id").alias("first_"), "file_id", F.pmod(F.xxhash64("file_id"), F.lit(shares)).cast("int").alias("share_"))
    every = once.join(ids, ["first_", "share_"]).select(F.explode("ids_").alias("query_id"), "file_id")
    return every if first.where("n_ = 1").isEmpty() else every.unionByName(found(own(False)))


def _dealt(files: DataFrame, literals: DataFrame, parts: int, numeric: list[str], text: list[str]) -> DataFrame:
    """A task gets one part of the filters, then a share of the files: it holds an index over the part, and the files pass by."""
    shares = max(1, -(-2 * files.sparkSession.sparkContext.defaultParallelism // parts))
    cells = _cells(files, numeric, text)
    part = F.pmod(F.xxhash64("query_id"), F.lit(parts))
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    own = literals.select(part.alias("part_"), all_of(shares).alias("share_"), F.struct(literals.columns).alias("literal_"))
    shared = cells.select(all_of(parts).alias("part_"), F.pmod(F.xxhash64("file_id_"), F.lit(shares)).alias("share_"), "*")
    both = own.unionByName(shared, allowMissingColumns=True).withColumn("task_", (F.col("part_") * shares + F.col("share_")).cast("int"))
    first = both.repartitionById(parts * shares, "task_").sortWithinPartitions(F.col("literal_").isNull()).select("literal_", *cells.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stated: list[tuple] = []
        index = None
        for batch in batches:
            n = len(batch) - batch.column("literal_").null_count  # these come first
            if n:
                stated.extend(zip(*(x.to_pylist() for x in batch.column("literal_").slice(0, n).flatten()), strict=True))
            if n < len(batch):
                index = index or PredicateIndex(stated, numeric, text)
                stated = []
                yield from _matches(index, batch.slice(n))

    return first.mapInArrow(run, f"query_id long, file_id {cells.schema['file_id_'].dataType.simpleString()}")


def _compiled(files: DataFrame, clauses: list, numeric: set[str], text: set[str]) -> DataFrame:
    """One Column a filter; a file's filters come out of one array."""

    def literal(r) -> Column:
        unknown = F.lit(None).cast("boolean")
        if r["column"] in numeric:
            try:
                value = float(r["value"])
            except (TypeError, ValueError):
                return unknown
            tests = {">": Column.__gt__, ">=": Column.__ge__, "<": Column.__lt__, "<=": Column.__le__, "=": Column.__eq__}
            truth = tests[r["op"]](F.col(r["column"]).cast("double"), value) if r["op"] in tests else unknown
        elif r["column"] in text and r["value"] is not None:
            truth = F.col(r["column"]) == r["value"] if r["op"] == "=" else F.col(r["column"]).ilike(r["value"]) if r["op"] == "like" else unknown
        else:
            return unknown
        return F.coalesce(~truth if r["negated"] else truth, F.lit(False))

    filters: dict[int, dict[int, Column]] = {}
    for r in clauses:
        own = filters.setdefault(r["query_id"], {})
        own[r["clause_id"]] = own[r["clause_id"]] | literal(r) if r["clause_id"] in own else literal(r)
    hits = [F.when(reduce(Column.__and__, own.values()), F.lit(q).cast("long")) for q, own in filters.items()]
    found = F.array_compact(F.array(*hits)) if hits else F.array().cast("array<long>")
    return files.select(F.explode(found).alias("query_id"), "file_id")


def lex_query_log(df: DataFrame, col: str, custom: list[str] = ()) -> DataFrame:
    """(query_id, pos, token, class) for every tag and operator of each query string, and the ``text`` between them.

    ``custom`` holds the known custom tags, in lower case without ``@``; a token that
    would be invalid is ``custom`` if its word is one of them.
    """
    kind = reduce(lambda c, k: c.when(F.col("token").rlike(f"(?i)^(?:{k[1]})$"), k[0]), TOKENS[1:], F.when(F.col("token").rlike(r"^\\@$"), "escaped"))
    folder = F.when((kind == "folder") & ~F.col("token").rlike(FOLDER), "invalid").otherwise(kind)
    known = F.substring(F.lower("token"), 2, 1 << 30).isin(list(custom)) if custom else F.lit(False)
    named = F.when((folder == "invalid") & known, "custom").otherwise(folder)
    # the texts between tokens alternate with the tokens, one more of them
    gaps = F.transform(F.split(F.regexp_replace(F.col(col), ANY, "\x01"), "\x01"), lambda x: F.struct(F.trim(x).alias("token"), F.lit(True).alias("plain")))
    tags = F.transform(F.regexp_extract_all(F.col(col), F.lit(ANY), 1), lambda x: F.struct(x.alias("token"), F.lit(False).alias("plain")))
    both = F.flatten(F.transform(F.arrays_zip(gaps.alias("g"), tags.alias("t")), lambda z: F.array(z["g"], z["t"])))
    parts = F.filter(both, lambda x: x.isNotNull() & (x["token"] != ""))
    tokens = df.select("query_id", F.posexplode(parts).alias("pos", "x_")).select("query_id", F.col("pos").cast("long").alias("pos"), "x_.*")
    return tokens.select("query_id", "pos", "token", F.when(F.col("plain"), "text").otherwise(named).alias("class"))


def query_log_features(df: DataFrame, col: str) -> DataFrame:
    """Free text, search space, and the first score bound of each query string."""
    q = F.lower(F.col(col))
    space = reduce(lambda c, s: c.when(q.contains(f"@{s}"), s), ("imagecontent", "ocr", "transcript"), F.when(q.contains("@audiocontent"), "audiocontent")).otherwise("default")
    parts = F.filter(F.transform(F.split(F.regexp_replace(F.col(col), ANY, "\x01"), "\x01"), lambda x: F.trim(x)), lambda x: x != "")
    bound = lambda g: F.regexp_extract(F.col(col), r"@score([<>=]=?)(\d+(?:\.\d+)?)", g)
    return df.select("query_id", F.array_join(parts, " ").alias("free_text"), space.alias("space"), F.when(bound(1) != "", bound(1)).alias("score_op"), bound(2).try_cast("double").alias("score_value"))
