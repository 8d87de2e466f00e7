"""Registered queries of predicates, vectors, ranking, sequences and text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import vectors
from ..operators import predicates as p
from ..operators import saved_queries, search, sequences, tags, text, vector_index
from ..sources import io
from .fixtures import DIM, FILES, FILESV, files, files_with_vectors, query_vector, query_vectors, table
from .registry import query

_MEDIA = "media_type IN ('image', 'video', 'audio')"


# --- predicates: each as a filter over media files

_PREDICATES = {
    "p01_is_type": ("media_type = 'image' OR media_type = 'audio'", lambda: p.is_type("photo") | p.is_type("sound")),
    "p02_is_gif": ("ext = 'gif'", p.is_gif),
    "p03_has_ext": ("ext = 'png'", lambda: p.has_ext("PNG")),
    "p04_in_folder": ("rel_path ILIKE 'src1/EN/%'", lambda: p.in_folder("src1/EN")),
    "p05_cmp": ("size_bytes > 900 AND duration_ms <= 120000 OR width >= 640 AND height < 512 OR fps = 24", lambda: p.cmp("size", ">", "900") & p.cmp("duration", "<=", 120000) | p.cmp("width", ">=", 640) & p.cmp("height", "<", 512) | p.cmp("fps", "==", "24")),
    "p06_date_cmp": ("mtime >= 1704844800000 AND mtime < 1706000000000", lambda: p.date_cmp(">=", "2024-01-10") & p.date_cmp("<", 1706000000)),
    "p07_has_modality": ("has_text = 1", lambda: p.has("text")),
    "p08_and": ("media_type = 'image' AND has_text = 1", lambda: p.is_type("image") & p.has("text")),
    "p09_or": ("media_type = 'video' OR ext = 'gif'", lambda: p.is_type("video") | p.is_gif()),
    "p10_not": ("NOT (duration_ms > 60000)", lambda: ~p.cmp("duration", ">", 60000)),
    "p11_grouping": ("NOT (ext = 'gif') AND (media_type = 'image' OR NOT (has_text = 1 AND width > 100))", lambda: ~p.is_gif() & (p.is_type("image") | ~(p.has("text") & p.cmp("width", ">", 100)))),
}
for _name, (_sql, _pred) in _PREDICATES.items():
    query(_name, f"{FILES} SELECT DISTINCT rel_path FROM files WHERE ({_sql}) AND {_MEDIA}")(lambda spark, sf_dir, pred=_pred: p.filter_files(files(spark, sf_dir), pred()))


@query("p12_base_media", f"{FILES} SELECT file_id FROM files WHERE {_MEDIA}")
def _(spark, sf_dir):
    return files(spark, sf_dir).where(p.base_media()).select("file_id")


@query("p13_filter_files", f"{FILES} SELECT DISTINCT rel_path FROM files WHERE status = 'indexed' AND {_MEDIA}")
def _(spark, sf_dir):
    return p.filter_files(files(spark, sf_dir), F.col("status") == "indexed")


@query("p14_score_between", f"{FILES} SELECT rel_path, CAST(file_id % 101 AS DOUBLE) AS score FROM files WHERE file_id % 101 BETWEEN 50 AND 75")
def _(spark, sf_dir):
    return p.score_between(files(spark, sf_dir).select("rel_path", (F.col("file_id") % 101).cast("double").alias("score")), 50, 75)


@query("p15_visible", "SELECT doc_id FROM documents WHERE doc_id % 5 <> 0")
def _(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("a/"), F.when(F.col("doc_id") % 5 == 0, ".x").otherwise("x")).alias("rel_path"))
    return p.visible(d).select("doc_id")


_CLAUSES = [
    (1, 1, "media_type", "=", "image", False), (1, 2, "size_bytes", ">", "1000", False), (2, 1, "ext", "=", "gif", False), (2, 1, "ext", "=", "mp4", False), (2, 2, "has_text", "=", "1", True),
    (3, 1, "rel_path", "like", "SRC1/%", False), (3, 2, "duration_ms", ">", "60000", True), (4, 1, "width", "<=", "640", False), (4, 1, "fps", ">=", "48", False),
]


@query(
    "p16_saved_searches",
    f"{FILES} SELECT CAST(1 AS BIGINT) AS query_id, file_id FROM files WHERE media_type = 'image' AND size_bytes > 1000 UNION ALL SELECT 2, file_id FROM files WHERE ext IN ('gif', 'mp4') AND NOT (has_text = 1) UNION ALL SELECT 3, file_id FROM files WHERE rel_path ILIKE 'src1/%' AND NOT (duration_ms > 60000) UNION ALL SELECT 4, file_id FROM files WHERE width <= 640 OR fps >= 48",
)
def _(spark, sf_dir):
    clauses = spark.createDataFrame(_CLAUSES, "query_id long, clause_id int, column string, op string, value string, negated boolean")
    return saved_queries.match_saved_searches(files(spark, sf_dir), clauses, ["size_bytes", "has_text", "duration_ms", "width", "fps"], ["media_type", "ext", "rel_path"])


#: A filter for each customer: a type or an extension, a window of sizes, and a folder that it is in or not.
_MANY = (
    "cq AS (SELECT c_custkey AS query_id, CASE c_custkey % 3 WHEN 0 THEN 'image' WHEN 1 THEN 'video' ELSE 'audio' END AS kind, CASE WHEN c_custkey % 2 = 0 THEN 'gif' ELSE 'wav' END AS e, CAST(c_custkey * 37 % 5000 AS BIGINT) AS lo, c_custkey % 4 AS s FROM customer) "
    "SELECT query_id, file_id FROM files JOIN cq ON (media_type = kind OR ext = e) AND size_bytes > lo AND NOT size_bytes >= lo + 60 AND CASE WHEN s = 0 THEN rel_path ILIKE 'SRC1/%' ELSE NOT (rel_path ILIKE 'src' || s || '/e_/%') END"
)


@query("p16_many_saved_searches", f"{FILES}, {_MANY}")
def _(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("query_id"), (F.col("c_custkey") % 4).cast("string").alias("s"), (F.col("c_custkey") * 37 % 5000).cast("long").alias("lo"))
    literal = lambda n, column, op, value, negated=False: F.struct(F.lit(n).alias("clause_id"), F.lit(column).alias("column"), F.lit(op).alias("op"), value.cast("string").alias("value"), (negated if isinstance(negated, Column) else F.lit(negated)).alias("negated"))
    kind = F.element_at(F.array(F.lit("image"), F.lit("video"), F.lit("audio")), (F.col("query_id") % 3 + 1).cast("int"))
    folder = F.when(F.col("s") == "0", "SRC1/%").otherwise(F.concat(F.lit("src"), F.col("s"), F.lit("/e_/%")))
    literals = [
        literal(1, "media_type", "=", kind), literal(1, "ext", "=", F.when(F.col("query_id") % 2 == 0, "gif").otherwise("wav")), literal(2, "size_bytes", ">", F.col("lo")), literal(3, "size_bytes", ">=", F.col("lo") + 60, True), literal(4, "rel_path", "like", folder, F.col("s") != "0"),
    ]
    clauses = c.select("query_id", F.inline(F.array(*literals)))
    return saved_queries.match_saved_searches(files(spark, sf_dir), clauses, ["size_bytes"], ["media_type", "ext", "rel_path"])


_SUFFIX = " @has:text & (@image | !@.gif ) @score>50.5 @date?2024 @size>=10mb \\\\@x @ocr @folder:a/b @folder:a//b @bogus @Trip"
_LEXED = ["@has:text", "&", "(", "@image", "|", "!", "@.gif", ")", "@score>50.5", "@date?2024", "@size>=10mb", "\\@", "x", "@ocr", "@folder:a/b", "@folder:a//b", "@bogus", "@Trip"]
_CLASSES = ["modality", "and", "bracket", "filetype", "or", "not", "fileext", "bracket", "logical", "logical", "logical", "escaped", "text", "mode", "folder", "invalid", "invalid", "custom"]


def query_log(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark")
    plain = F.regexp_replace("text", r"[@&|!()\\\n]", " ")
    return b.select(F.col("item_id").cast("long").alias("query_id"), F.concat(plain, F.lit(_SUFFIX.replace("\\\\", "\\"))).alias("q"))


_P17 = "log AS (SELECT CAST(item_id AS BIGINT) AS query_id, trim(regexp_replace(text, '[@&|!()\\\\\n]', ' ', 'g')) AS t FROM benchmark), own AS (SELECT query_id, t, CASE WHEN t = '' THEN 0 ELSE 1 END AS shift FROM log)"
_LEXED_ROWS = ", ".join(f"({i}, '{t}', '{c}')" for i, (t, c) in enumerate(zip(_LEXED, _CLASSES, strict=True)))


@query("p17_lex_query_log", f"WITH {_P17} SELECT query_id, CAST(0 AS BIGINT) AS pos, t AS token, 'text' AS class FROM own WHERE t <> '' UNION ALL SELECT query_id, CAST(i + shift AS BIGINT), token, class FROM own, (VALUES {_LEXED_ROWS}) AS v(i, token, class)")
def _(spark, sf_dir):
    return saved_queries.lex_query_log(query_log(spark, sf_dir), "q", ["trip"])


@query("p18_query_log_features", "SELECT CAST(item_id AS BIGINT) AS query_id, trim(regexp_replace(text, '[@&|!()\\\\\n]', ' ', 'g')) || ' x' AS free_text, 'ocr' AS space, '>' AS score_op, CAST(50.5 AS DOUBLE) AS score_value FROM benchmark")
def _(spark, sf_dir):
    return saved_queries.query_log_features(query_log(spark, sf_dir), "q")


# --- vectors

_D = "list_transform({}, lambda x: CAST(x AS DOUBLE))"


@query("v01_cosine", f"SELECT a.vec_id, b.vec_id AS other, round(CAST(list_cosine_similarity({_D.format('a.embedding')}, {_D.format('b.embedding')}) AS DOUBLE), 5) AS score FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def _(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    other = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("vec_id").alias("other"), F.col("embedding").alias("b"))
    return e.join(other, "vec_id").select("vec_id", "other", F.round(vectors.cosine(F.col("embedding"), F.col("b")), 5).alias("score"))


@query("v02_dim_guard", "SELECT vec_id, CAST(CASE WHEN vec_id % 3 <> 0 THEN 64 END AS BIGINT) AS n FROM embeddings")
def _(spark, sf_dir):
    v = F.when(F.col("vec_id") % 3 == 0, F.slice("embedding", 1, 10)).otherwise(F.col("embedding"))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.size(vectors.of_dim(v, DIM)).cast("long").alias("n"))


_PAIR = "e AS (SELECT label, vec_id, unnest(embedding) AS x, unnest(range(64)) AS pos FROM embeddings)"


@query("v03_vec_mean", f"WITH {_PAIR} SELECT CAST(label AS BIGINT) AS label, pos, round(avg(CAST(x AS DOUBLE)), 5) AS mean, round(CAST(max(x) AS DOUBLE), 5) AS top FROM e GROUP BY label, pos")
def _(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(F.col("label").cast("long").alias("label"), F.posexplode("embedding").alias("pos", "x"))
    return e.groupBy("label", F.col("pos").cast("long").alias("pos")).agg(F.round(F.avg(F.col("x").cast("double")), 5).alias("mean"), F.round(F.max("x").cast("double"), 5).alias("top"))


@query("v04_vec_mean_max_rows", "SELECT a.vec_id, i AS pos, (CAST(a.embedding[i + 1] AS DOUBLE) + CAST(b.embedding[i + 1] AS DOUBLE)) / 2 AS mean, greatest(CAST(a.embedding[i + 1] AS DOUBLE), CAST(b.embedding[i + 1] AS DOUBLE)) AS top FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1, range(64) r(i)")
def _(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    vs = F.array("embedding", "b", F.lit(None).cast("array<float>"))
    both = e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b")), "vec_id")
    out = both.select("vec_id", F.posexplode(F.arrays_zip(vectors.vec_mean(vs).alias("m"), vectors.vec_max(vs).alias("t"))).alias("pos", "z"))
    return out.select("vec_id", F.col("pos").cast("long").alias("pos"), F.col("z.m").alias("mean"), F.col("z.t").alias("top"))


_NORM = "sqrt(list_sum(list_transform({0}, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))))"


@query("v05_l2_normalize", f"SELECT vec_id, i AS pos, round(CASE WHEN vec_id % 9 = 0 THEN 0.0 ELSE CAST(embedding[i + 1] AS DOUBLE) / {_NORM.format('embedding')} END, 5) AS x FROM embeddings, range(64) r(i)")
def _(spark, sf_dir):
    v = F.when(F.col("vec_id") % 9 == 0, F.array_repeat(F.lit(0.0), DIM)).otherwise(F.col("embedding").cast("array<double>"))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(vectors.l2_normalize(v)).alias("pos", "x")).select("vec_id", F.col("pos").cast("long").alias("pos"), F.round("x", 5).alias("x"))


_VS = ("clip_emb", "metadata_emb", "ocr_emb", "transcript_emb")
_FUSED = (
    "fparts AS (SELECT file_id, i AS pos, list_filter([" + ", ".join(f"CAST({c}[i + 1] AS DOUBLE)" for c in _VS) + "], lambda x: x IS NOT NULL) AS xs FROM filesv, range(64) r(i)), "
    "fmix AS (SELECT file_id, pos, 0.4 * list_avg(xs) + 0.6 * list_max(xs) AS x FROM fparts WHERE len(xs) > 0), "
    "fused AS (SELECT file_id, pos, x / sqrt(sum(x * x) OVER (PARTITION BY file_id)) AS x FROM fmix)"
)


@query("v06_fuse_embeddings", f"{FILESV}, {_FUSED} SELECT file_id, pos, round(x, 4) AS x FROM fused")
def _(spark, sf_dir):
    f = vectors.fuse_embeddings(files_with_vectors(spark, sf_dir, *_VS))
    return f.select("file_id", F.posexplode("search_emb").alias("pos", "x")).select("file_id", F.col("pos").cast("long").alias("pos"), F.round("x", 4).alias("x"))


@query("v07_choose_space", f"{FILESV} SELECT file_id, clap_emb IS NOT NULL AS present FROM filesv")
def _(spark, sf_dir):
    return files_with_vectors(spark, sf_dir, "clap_emb").select("file_id", F.col(vectors.choose_space("audiocontent")).isNotNull().alias("present"))


@query("v08_text_override", f"{FILESV} SELECT file_id, round(CAST(COALESCE(ocr_emb, clip_emb)[1] AS DOUBLE), 5) AS x FROM filesv")
def _(spark, sf_dir):
    return files_with_vectors(spark, sf_dir, "ocr_emb", "clip_emb").select("file_id", F.round(vectors.text_override(F.col("ocr_emb"), F.col("clip_emb"))[0].cast("double"), 5).alias("x"))


@query("v09_scale_channels", "SELECT vec_id, i AS pos, round((CAST(embedding[i + 1] AS DOUBLE) / 255.0 - CASE i % 3 WHEN 0 THEN 0.5 WHEN 1 THEN 0.4 ELSE 0.3 END) / CASE i % 3 WHEN 0 THEN 0.2 WHEN 1 THEN 0.25 ELSE 0.5 END, 6) AS x FROM embeddings, range(64) r(i)")
def _(spark, sf_dir):
    v = vectors.scale_channels(F.col("embedding"), [0.5, 0.4, 0.3], [0.2, 0.25, 0.5])
    return table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(v).alias("pos", "x")).select("vec_id", F.col("pos").cast("long").alias("pos"), F.round("x", 6).alias("x"))


@query("v10_argmax", "SELECT vec_id, CAST(list_position(embedding, list_max(embedding)) - 1 AS BIGINT) AS best FROM embeddings")
def _(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", vectors.argmax(F.col("embedding")).alias("best"))


@query("v10_top_class_text", "SELECT user_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_type) AS r FROM events) WHERE r = 1")
def _(spark, sf_dir):
    return vectors.top_class(table(spark, sf_dir, "events"), "user_id", "event_type", "value")


@query("v10_top_class", "SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS r FROM events) WHERE r = 1")
def _(spark, sf_dir):
    return vectors.top_class(table(spark, sf_dir, "events"), "user_id", "event_id", "value")


_HASHED = "hashed AS (SELECT doc_id, ('0x' || substr(md5(w), 1, 8))::BIGINT % 64 AS pos FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w FROM documents))"


@query("v11_embed_column", f"WITH {_HASHED}, n AS (SELECT doc_id, pos, count(*) AS n FROM hashed GROUP BY doc_id, pos) SELECT doc_id, pos, round(n / sqrt(CAST(sum(n * n) OVER (PARTITION BY doc_id) AS DOUBLE)), 5) AS x FROM n")
def _(spark, sf_dir):
    e = vectors.embed_column(table(spark, sf_dir, "documents"), "text", dim=DIM)
    # the plain posexplode infers a filter on the vector, and pushes it down to where the vector is made a second time
    return e.select("doc_id", F.posexplode_outer("embedding").alias("pos", "x")).where("x > 0").select("doc_id", F.col("pos").cast("long").alias("pos"), F.round("x", 5).alias("x"))


def letter_counts(batches):
    """A plug-in: how often each of 26 letters occurs."""
    for texts in batches:
        for t in texts:
            yield [t.lower().count(c) for c in "abcdefghijklmnopqrstuvwxyz"]


@query("v11_embed_plug_in", "SELECT doc_id, i AS pos, CAST(length(lower(text)) - length(replace(lower(text), chr(97 + CAST(i AS INT)), '')) AS BIGINT) AS n FROM documents, range(26) r(i)")
def _(spark, sf_dir):
    e = vectors.embed_column(table(spark, sf_dir, "documents"), "text", letter_counts, 26)
    return e.select("doc_id", F.posexplode("embedding").alias("pos", "x")).select("doc_id", F.col("pos").cast("long").alias("pos"), F.col("x").cast("long").alias("n"))


def fails_on_thirteens(batches):
    """A plug-in: the digits of a number; fails on multiples of 13."""
    for numbers in batches:
        for n in numbers:
            if int(n) % 13 == 0:
                raise ValueError(f"{n} is unlucky")
            yield [float(n), float(len(n))]


@query(
    "v11_embed_errors",
    "SELECT doc_id, CASE WHEN doc_id % 13 <> 0 AND doc_id % 5 <> 0 THEN CAST(length(CAST(doc_id AS VARCHAR)) AS BIGINT) END AS digits, CASE WHEN doc_id % 13 = 0 AND doc_id % 5 <> 0 THEN 'ValueError: ' || CAST(doc_id AS VARCHAR) || ' is unlucky' END AS metadata_error, "
    "CASE WHEN (doc_id + 1) % 13 = 0 THEN 'embed_failed' ELSE 'indexed' END AS status FROM documents",
)
def _(spark, sf_dir):
    """Errors of two columns: that of the metadata is told, that of the OCR text makes the status too."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 5 != 0, F.col("doc_id").cast("string")).alias("metadata"), (F.col("doc_id") + 1).cast("string").alias("ocr"))
    e = vectors.embed_column(d, "metadata", fails_on_thirteens, 2, "metadata_emb", "metadata_error")
    e = vectors.embed_column(e, "ocr", fails_on_thirteens, 2, "ocr_emb", "ocr_error")
    return e.select("doc_id", F.element_at("metadata_emb", 2).cast("long").alias("digits"), "metadata_error", vectors.status_of(["ocr_error"]).alias("status"))


@query("v06_fuse_embeddings_native", f"{FILESV}, {_FUSED} SELECT file_id, pos, round(x, 4) AS x FROM fused")
def _(spark, sf_dir):
    f = vectors.fuse_embeddings(files_with_vectors(spark, sf_dir, *_VS), arrow=False)
    return f.select("file_id", F.posexplode("search_emb").alias("pos", "x")).select("file_id", F.col("pos").cast("long").alias("pos"), F.round("x", 4).alias("x"))


@query("a09_compare_vectors", "SELECT a.vec_id, round(CAST(list_max(list_transform(range(1, 65), lambda i: abs(CAST(a.embedding[i] AS DOUBLE) - CAST(b.embedding[i] AS DOUBLE)))) AS DOUBLE), 5) AS max_error, round(sqrt(list_avg(list_transform(range(1, 65), lambda i: pow(CAST(a.embedding[i] AS DOUBLE) - b.embedding[i], 2)))), 5) AS rmse FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def _(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    both = e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b")), "vec_id")
    return both.select("vec_id", vectors.compare_vectors(F.col("embedding"), F.col("b")).alias("c")).select("vec_id", F.round("c.max_error", 5).alias("max_error"), F.round("c.rmse", 5).alias("rmse"))


@query("a10_array_stats", f"SELECT vec_id, round(CAST(list_min(embedding) AS DOUBLE), 5) AS lo, round(CAST(list_max(embedding) AS DOUBLE), 5) AS hi, round(list_avg({_D.format('embedding')}), 5) AS mean FROM embeddings")
def _(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", vectors.array_stats(F.col("embedding")).alias("s"))
    return e.select("vec_id", *(F.round(f"s.{c}", 5).alias(c) for c in ("lo", "hi", "mean")))


# --- ranking

_Q7 = "q AS (SELECT embedding AS qvec FROM embeddings WHERE vec_id = 7)"
_SIM = "CAST(list_cosine_similarity(list_transform({0}, lambda x: CAST(x AS DOUBLE)), list_transform(qvec, lambda x: CAST(x AS DOUBLE))) AS DOUBLE)"
_SCORED = "scored AS (SELECT rel_path, CASE WHEN status = 'embed_failed' THEN -1.0 ELSE " + _SIM.format("clip_emb") + f" END AS score FROM filesv, q WHERE {_MEDIA} AND (clip_emb IS NOT NULL OR status = 'embed_failed'))"
_NORMED = "ends AS (SELECT min(score) AS lo, max(score) AS hi FROM scored WHERE score >= 0), normed AS (SELECT rel_path, CASE WHEN score < 0 THEN score WHEN hi = lo THEN 100.0 ELSE (score - lo) / (hi - lo) * 100 END AS score FROM scored, ends)"


def clip_scored(spark, sf_dir, arrow=True):
    return search.semantic_scores(files_with_vectors(spark, sf_dir, "clip_emb"), query_vector(spark, sf_dir), "imagecontent", arrow)


def rounded(df, digits=4):
    return df.withColumn("score", F.round("score", digits))


@query("k01_semantic_scores", f"{FILESV}, {_Q7}, {_SCORED} SELECT rel_path, round(score, 5) AS score FROM scored")
def _(spark, sf_dir):
    return rounded(clip_scored(spark, sf_dir), 5)


@query("k01_semantic_scores_native", f"{FILESV}, {_Q7}, {_SCORED} SELECT rel_path, round(score, 5) AS score FROM scored")
def _(spark, sf_dir):
    return rounded(clip_scored(spark, sf_dir, arrow=False), 5)


@query("k02_audio_scores", f"{FILESV}, {_Q7} SELECT rel_path, round(CASE WHEN status = 'embed_failed' THEN -1.0 ELSE {_SIM.format('clap_emb')} END, 5) AS score FROM filesv, q WHERE media_type IN ('audio', 'video')")
def _(spark, sf_dir):
    return rounded(search.audio_scores(files_with_vectors(spark, sf_dir, "clap_emb"), query_vector(spark, sf_dir)), 5)


_FUZZY = "the and entier"


@query("k03_fuzzy_text")  # a table of characters in SQL is too slow for whole texts; tests/test_operators.py has a plain version
def _(spark, sf_dir):
    return rounded(search.fuzzy_text_scores(files(spark, sf_dir), _FUZZY), 5)


_TITLES = (
    "WITH RECURSIVE q AS (SELECT 'Forest lime Metallic' AS q0), titles AS (SELECT p_partkey AS id, lower(p_name) AS t, lower(q0) AS q FROM part, q), "
    "r(id, i, row) AS (SELECT id, 0, list_transform(range(length(q)), lambda x: 0) FROM titles UNION ALL SELECT id, i + 1, list_transform(range(1, length(q) + 1), lambda j: list_max(list_transform(range(1, j + 1), lambda p: greatest(row[p], CASE WHEN substr(q, p, 1) = substr(t, i + 1, 1) THEN CASE WHEN p > 1 THEN row[p - 1] ELSE 0 END + 1 ELSE 0 END)))) FROM r JOIN titles USING (id) WHERE i < length(t)), "
    "scored AS (SELECT id, CAST(list_max(row) AS DOUBLE) / least(length(t), length(q)) AS score FROM r JOIN titles USING (id) WHERE i = length(t)) "
)


def titles(spark, sf_dir):
    """Names of parts as the texts of files."""
    return table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("rel_path"), F.lit("image").alias("media_type"), F.lit("indexed").alias("status"), F.col("p_name").alias("ocr_text"))


@query("k03_fuzzy_titles", f"{_TITLES} SELECT CAST(id AS VARCHAR) AS rel_path, round(score, 5) AS score FROM scored")
def _(spark, sf_dir):
    return rounded(search.fuzzy_text_scores(titles(spark, sf_dir), "Forest lime Metallic"), 5)


@query("k03_fuzzy_titles_best", f"{_TITLES} SELECT CAST(id AS VARCHAR) AS rel_path, round(score, 5) AS score FROM scored ORDER BY scored.score DESC, CAST(id AS VARCHAR) LIMIT 20")
def _(spark, sf_dir):
    return rounded(search.fuzzy_text_best(titles(spark, sf_dir), "Forest lime Metallic", 20), 5)


@query("k04_minmax", f"{FILESV}, {_Q7}, {_SCORED}, {_NORMED} SELECT rel_path, round(score, 3) AS score FROM normed")
def _(spark, sf_dir):
    return rounded(search.minmax_0_100(clip_scored(spark, sf_dir)), 3)


@query("k05_rank", f"{FILESV}, {_Q7}, {_SCORED}, {_NORMED} SELECT rel_path, round(score, 3) AS score, row_number() OVER (ORDER BY round(score, 3) DESC, rel_path) AS place FROM normed")
def _(spark, sf_dir):
    return search.placed(rounded(search.minmax_0_100(clip_scored(spark, sf_dir)), 3))


@query("k06_search", f"{FILESV}, {_Q7}, {_SCORED}, {_NORMED} SELECT rel_path, round(score, 3) AS score FROM normed WHERE score >= 50 AND rel_path IN (SELECT rel_path FROM files WHERE media_type = 'image' AND size_bytes > 500)")
def _(spark, sf_dir):
    f = files_with_vectors(spark, sf_dir, "clip_emb")
    return rounded(search.search(f, p.is_type("image") & p.cmp("size", ">", 500), query_vector(spark, sf_dir), "imagecontent", lo=50), 3)


_BATCH = (
    "bq AS (SELECT vec_id AS query_id, embedding AS qvec FROM embeddings WHERE vec_id % 20 = 0), "
    "bscored AS (SELECT query_id, rel_path, CASE WHEN status = 'embed_failed' THEN -1.0 ELSE " + _SIM.format("clip_emb") + f" END AS score FROM filesv, bq WHERE {_MEDIA} AND (clip_emb IS NOT NULL OR status = 'embed_failed')), "
    "bnormed AS (SELECT query_id, rel_path, score AS raw, min(score) FILTER (WHERE score >= 0) OVER (PARTITION BY query_id) AS lo, max(score) FILTER (WHERE score >= 0) OVER (PARTITION BY query_id) AS hi FROM bscored), "
    "branked AS (SELECT query_id, rel_path, CASE WHEN raw < 0 THEN raw WHEN hi = lo THEN 100.0 ELSE (raw - lo) / (hi - lo) * 100 END AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(raw, 9) DESC, rel_path) AS r FROM bnormed)"
)


@query("k07_search_batch", f"{FILESV}, {_BATCH} SELECT query_id, CAST(r AS BIGINT) AS place, round(score, 3) AS score FROM branked WHERE r <= 10")
def _(spark, sf_dir):
    f = files_with_vectors(spark, sf_dir, "clip_emb")
    out = search.search_batch(f, query_vectors(spark, sf_dir), 10, "imagecontent")
    return out.select("query_id", F.col("rank").cast("long").alias("place"), F.round("score", 3).alias("score"))


_NEAREST = (
    "bq AS (SELECT vec_id AS query_id, embedding AS qvec FROM embeddings WHERE vec_id % 20 = 0), near AS (SELECT query_id, rel_path, list_cosine_similarity(CAST(clip_emb AS DOUBLE[]), CAST(qvec AS DOUBLE[])) AS score FROM filesv, bq WHERE clip_emb IS NOT NULL AND status <> 'embed_failed'), "
    "ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rel_path) AS r FROM near)"
)


@query("k11_nearest_vectors", f"{FILESV}, {_NEAREST} SELECT query_id, r AS place, round(score, 5) AS score FROM ranked WHERE r <= 10")
def _(spark, sf_dir):
    """The index of all clip vectors, searched for every twentieth vector."""
    folder = io.shared_folder(spark, "vector-index")
    vector_index.build(files_with_vectors(spark, sf_dir, "clip_emb"), folder, DIM, "imagecontent")
    out = vector_index.nearest(spark, folder, query_vectors(spark, sf_dir), 10)
    return out.select("query_id", F.col("rank").cast("long").alias("place"), F.round("score", 5).alias("score"))


@query("k08_score_badge", f"{FILES} SELECT file_id, 'img ' || CAST(CAST(round(file_id % 97 + 0.25) AS INT) AS VARCHAR) || '%' AS badge FROM files")
def _(spark, sf_dir):
    s = files(spark, sf_dir).select("file_id", (F.col("file_id") % 97 + 0.25).cast("double").alias("score"))
    return search.score_badge(s, "imagecontent").select("file_id", "badge")


@query("k09_audio_fallback", f"{FILESV}, {_Q7}, {_SCORED} SELECT rel_path, round(score, 5) AS score FROM scored")
def _(spark, sf_dir):
    f = files_with_vectors(spark, sf_dir, "clip_emb").withColumns({"search_emb": F.col("clip_emb"), "clap_emb": F.lit(None).cast("array<float>")})
    return rounded(search.semantic_scores(f, query_vector(spark, sf_dir), search.space_with_fallback(f, "audiocontent")), 5)


_NAMES = "tag_names AS (SELECT DISTINCT '@' || p_brand AS tag, CAST(1 AS INT) AS category FROM part UNION SELECT DISTINCT '@folder:' || source, 2 FROM documents)"


@query("k10_suggest", f"WITH {_NAMES}, hits AS (SELECT p.prefix, t.tag, row_number() OVER (PARTITION BY p.prefix ORDER BY category, tag) AS r FROM tag_names t JOIN (VALUES ('@brand'), ('@FOLDER:src1'), ('@')) p(prefix) ON starts_with(lower(tag), lower(prefix))) SELECT prefix, CAST(r AS INT) AS rank, tag FROM hits WHERE r <= 8")
def _(spark, sf_dir):
    names = table(spark, sf_dir, "part").select(F.concat(F.lit("@"), "p_brand").alias("tag"), F.lit(1).alias("category")).union(table(spark, sf_dir, "documents").select(F.concat(F.lit("@folder:"), "source"), F.lit(2))).distinct()
    return search.suggest(names, spark.createDataFrame([("@brand",), ("@FOLDER:src1",), ("@",)], "prefix string"))


@query("j04_hybrid", f"{FILES} SELECT rel_path, CAST(file_id AS DOUBLE) AS score FROM files WHERE file_id % 2 = 0 AND media_type = 'image'")
def _(spark, sf_dir):
    f = files(spark, sf_dir)
    return tags.hybrid(p.filter_files(f, p.is_type("image")), f.where("file_id % 2 = 0").select("rel_path", F.col("file_id").cast("double").alias("score")))


# --- sequences

_SEQ = "s AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events)"


@query(
    "q01_peak_envelope",
    f"WITH {_SEQ}, c AS (SELECT user_id, i // greatest(1, (n + 19) // 20) AS segment, greatest(max(value / 4 - 80), -100.0) AS db FROM s GROUP BY 1, 2), g AS (SELECT user_id, r AS segment FROM (SELECT DISTINCT user_id FROM events), range(20) t(r)) "
    "SELECT g.user_id, CAST(g.segment AS INT) AS segment, round(CASE WHEN db IS NULL THEN 0.05 ELSE greatest(0.05, least(1.0, CASE WHEN db > -100 THEN pow(10.0, db / 20) ELSE 0 END)) END, 6) AS peak FROM g LEFT JOIN c USING (user_id, segment)",
)
def _(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("db", F.col("value") / 4 - 80)
    return sequences.peak_envelope(e, "user_id", ["ts", "event_id"], "db").withColumn("peak", F.round("peak", 6))


_COLLAPSED = (
    f"WITH {_SEQ}, b AS (SELECT *, event_type = 'click' OR event_type = COALESCE(lag(event_type) OVER (PARTITION BY user_id ORDER BY i), 'click') AS dropped FROM s), c AS (SELECT *, sum(CASE WHEN dropped THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY i) AS kept FROM b), "
    "e AS (SELECT *, row_number() OVER (PARTITION BY user_id, kept ORDER BY i) - CASE WHEN kept > 0 THEN 1 ELSE 0 END AS streak FROM c), f AS (SELECT *, min(CASE WHEN streak > {most} AND kept > 0 THEN i END) OVER (PARTITION BY user_id) AS stop FROM e) "
    "SELECT user_id, COALESCE(string_agg(CASE WHEN NOT dropped AND (stop IS NULL OR i < stop) THEN event_type END, '' ORDER BY i), '') AS decoded FROM f GROUP BY user_id"
)


@query("q02_collapse_repeats", _COLLAPSED.format(most=30))
def _(spark, sf_dir):
    return sequences.collapse_repeats(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "event_type", "click")


@query("q02_collapse_repeats_cut", _COLLAPSED.format(most=3))  # a limit that users of the table reach
def _(spark, sf_dir):
    return sequences.collapse_repeats(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "event_type", "click", max_streak=3)


@query(
    "q03_threshold_runs",
    f"WITH {_SEQ}, a AS (SELECT user_id, i, n, COALESCE(CASE WHEN i - lag(i) OVER (PARTITION BY user_id ORDER BY i) - 1 > 2 THEN 1 ELSE 0 END, 1) AS fresh FROM s WHERE value > 20), b AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY i) AS run FROM a), "
    "c AS (SELECT user_id, run, min(i) AS lo, max(i) AS hi, max(n) AS n FROM b GROUP BY user_id, run HAVING max(i) - min(i) + 1 >= 5) SELECT user_id, CAST(greatest(0, lo - 5) AS BIGINT) AS start, CAST(least(n, hi + 6) AS BIGINT) AS \"end\" FROM c",
)
def _(spark, sf_dir):
    return sequences.threshold_runs(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "value", 20.0)


@query("q04_fit_length", "SELECT l_orderkey, CASE WHEN count(*) >= 4 THEN string_agg(l_partkey, ',' ORDER BY l_linenumber) FILTER (WHERE l_linenumber <= 4) ELSE string_agg(l_partkey, ',' ORDER BY l_linenumber) || repeat(',-1', CAST(4 - count(*) AS INT)) END AS fit FROM (SELECT l_orderkey, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS l_linenumber FROM lineitem) GROUP BY l_orderkey")
def _(spark, sf_dir):
    own = F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda x: x["l_partkey"])
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(own.alias("v"))
    return rows.select("l_orderkey", F.array_join(sequences.fit_length(F.col("v"), 4, -1).cast("array<string>"), ",").alias("fit"))


@query("q05_log_scale_clamp", "SELECT event_id, round((greatest(log10(greatest(value, 1e-10)), max(log10(greatest(value, 1e-10))) OVER (PARTITION BY user_id) - 8) + 4) / 4, 6) AS scaled FROM events")
def _(spark, sf_dir):
    return sequences.log_scale_clamp(table(spark, sf_dir, "events"), "user_id", "value").select("event_id", F.round("scaled", 6).alias("scaled"))


# --- text

_ASCII = r"('s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+)"
_SQL_ASCII = _ASCII.replace("'", "''")


@query("t01_normalize", "SELECT doc_id, lower(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM documents")
def _(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.normalize_text(F.col("text")).alias("t"))


_TOKENS = f"toks AS (SELECT doc_id, regexp_extract_all(lower(regexp_replace(text, '\\s+', ' ', 'g')), '{_SQL_ASCII}', 1) AS tokens FROM documents)"


def documents(spark, sf_dir):
    """Whole texts over all cores, though there be fewer files than these."""
    return io.spread(table(spark, sf_dir, "documents").select("doc_id", "text"))


def ascii_tokens(spark, sf_dir):
    return text.pretokenize(documents(spark, sf_dir), "text", pattern=_ASCII).select("doc_id", "tokens")


@query("t02_pretokenize", f"WITH {_TOKENS} SELECT doc_id, CAST(len(tokens) AS BIGINT) AS n, md5(array_to_string(tokens, ' ')) AS digest FROM toks")
def _(spark, sf_dir):
    return ascii_tokens(spark, sf_dir).select("doc_id", F.size("tokens").cast("long").alias("n"), F.md5(F.array_join("tokens", " ").cast("binary")).alias("digest"))


_UNICODE = text.PRETOKEN.replace("'", "''")


@query("t02_pretokenize_unicode", f"SELECT doc_id, CAST(len(regexp_extract_all(lower(regexp_replace(text, '\\s+', ' ', 'g')), '{_UNICODE}', 1)) AS BIGINT) AS n FROM documents")
def _(spark, sf_dir):
    return text.pretokenize(documents(spark, sf_dir), "text").select("doc_id", F.size("tokens").cast("long").alias("n"))


#: As many tokens as the vocabularies of the models that such ids are for.
_SIZE, _START, _END = 49_000, 49_406, 49_407
_VOCAB = f"flat AS (SELECT doc_id, unnest(tokens) AS token, unnest(range(len(tokens))) AS pos FROM toks), vocab AS (SELECT token, row_number() OVER (ORDER BY count(*) DESC, token) - 1 AS id FROM flat GROUP BY token ORDER BY count(*) DESC, token LIMIT {_SIZE})"
_IDS = f"{_VOCAB}, known AS (SELECT f.doc_id, v.id, row_number() OVER (PARTITION BY f.doc_id ORDER BY f.pos) AS r FROM flat f JOIN vocab v USING (token))"


@query("t03_encode_tokens", f"WITH {_TOKENS}, {_IDS}, cut AS (SELECT d.doc_id, COALESCE(string_agg(id, ',' ORDER BY r) FILTER (WHERE r <= 62), '') AS s, count(id) FILTER (WHERE r <= 62) AS n FROM toks d LEFT JOIN known k USING (doc_id) GROUP BY d.doc_id) SELECT doc_id, '{_START}' || CASE WHEN n > 0 THEN ',' ELSE '' END || s || ',{_END}' || repeat(',0', CAST(62 - n AS INT)) AS ids FROM cut")
def _(spark, sf_dir):
    tokens = io.written(ascii_tokens(spark, sf_dir), "tokens")
    vocab = text.corpus_vocab(tokens, "tokens", _SIZE)
    ids = text.encode_tokens(tokens, "doc_id", "tokens", vocab, _START, _END, 64)
    return ids.select("doc_id", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"))


@query("t04_encode_subwords")  # 49,000 merges in SQL would need them as a table; tests/test_subwords.py has a plain version and the tokenizer
def _(spark, sf_dir):
    import public_tokenizers

    tokens = text.pretokenize(documents(spark, sf_dir), "text").select("doc_id", "tokens")
    out = text.encode_subwords(tokens, "doc_id", "tokens", public_tokenizers.path("word_bpe_49k.json"))
    return out.select("doc_id", F.size("ids").cast("long").alias("n"), F.md5(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary")).alias("digest"))


@query("t05_decode_tokens", f"WITH {_TOKENS}, {_IDS} SELECT d.doc_id, COALESCE(string_agg(v.token, ' ' ORDER BY k.r), '') AS text FROM toks d LEFT JOIN known k ON k.doc_id = d.doc_id AND k.r <= 62 LEFT JOIN vocab v ON v.id = k.id AND v.id < 20000 GROUP BY d.doc_id")
def _(spark, sf_dir):
    tokens = io.written(ascii_tokens(spark, sf_dir), "tokens")
    vocab = io.written(text.corpus_vocab(tokens, "tokens", _SIZE), "vocab")
    ids = text.encode_tokens(tokens, "doc_id", "tokens", vocab, _START, _END, 64, pad=-1)
    return text.decode_tokens(ids, "doc_id", "ids", vocab, end_id=20_000)


@query("t06_join_regions", "SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS text FROM conversations WHERE trim(text) <> '' GROUP BY conv_id")
def _(spark, sf_dir):
    return text.join_regions(table(spark, sf_dir, "conversations"), "conv_id", "turn", "text")
