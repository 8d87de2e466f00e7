"""Edge rules that the tables don't show."""

from __future__ import annotations

import struct
import zlib
from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from shelfspark.functions import scalars, vectors
from shelfspark.operators import catalog, predicates, saved_queries, search, sequences, tags, text
from shelfspark.sources import buckets, io, schemas
from shelfspark.streaming.index_stream import catalogued, index_stream, system_tags


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def values(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


# --- paths and catalog


def test_path_parts_of_odd_names(spark):
    paths = ["a.PNG", ".x.png", ".hidden", "d_1/e/f.tar.gz", "noext", "a/b/c/d/e/f/g.png", "x."]
    got = {r.rel_path: (r.name, r.stem, r.ext, r.parent_rel_path, r.depth) for r in catalog.with_path_parts(frame(spark, [(p,) for p in paths], "rel_path string")).collect()}
    assert got["a.PNG"] == ("a.PNG", "a", "png", "", 0)
    assert got[".x.png"] == (".x.png", ".x", "png", "", 0)
    assert got[".hidden"] == (".hidden", ".hidden", None, "", 0)
    assert got["d_1/e/f.tar.gz"] == ("f.tar.gz", "f.tar", "gz", "d_1/e", 2)
    assert got["noext"][2] is None and got["x."][2] is None
    assert got["a/b/c/d/e/f/g.png"][4] == 6


def test_folder_tags_stop_after_five_levels_and_skip_the_root(spark):
    f = frame(spark, [(1, "a/b/c/d/e/f/g.png"), (2, "root.png")], "file_id long, rel_path string")
    got = values(catalog.derive_folder_tags(f), "file_id", "slug")
    assert got == [(1, "folder:a"), (1, "folder:a/b"), (1, "folder:a/b/c"), (1, "folder:a/b/c/d"), (1, "folder:a/b/c/d/e")]
    assert {r.rel_path for r in catalog.derive_folders(f).collect()} == {"", "a", "a/b", "a/b/c", "a/b/c/d", "a/b/c/d/e", "a/b/c/d/e/f"}


def test_media_types_of_all_extensions(spark):
    rows = [(e.upper(), t) for t, es in schemas.MEDIA_EXTENSIONS.items() for e in es] + [(None, "unknown"), ("zzz", "unknown")]
    df = catalog.with_media_type(frame(spark, rows, "ext string, want string"))
    assert df.where("media_type <> want").count() == 0


def test_probes_of_bad_json(spark):
    df = frame(spark, [("{bad",), (None,), ('{"format":{"duration":"x"}}',), ('{"streams":[]}',)], "j string")
    assert [r.duration_ms for r in catalog.parse_audio_probe(df, "j").collect()] == [None] * 4
    got = catalog.parse_video_probe(df, "j").collect()
    assert [(r.width, r.fps, r.has_audio) for r in got] == [(None, None, 0)] * 4


def test_custom_tags_of_bad_json(spark):
    assert values(catalog.load_custom_tags(frame(spark, [('{"a":"b"}',), ("[1",), (None,)], "j string"), "j"), "slug", "description") == [("a", "b")]


def test_usage_counts_and_seeds_win(spark):
    t = frame(spark, [(1, "image", "@IMAGE", "custom", "user"), (2, "new", "@new", "custom", "user")], "file_id long, slug string, display_name string, kind string, source string")
    got = {r.slug: (r.display_name, r.kind, r.usage_count) for r in catalog.tag_usage_counts(catalog.build_tag_dimension(t), t).collect()}
    assert got["image"] == ("@image", "type", 1) and got["new"] == ("@new", "custom", 1) and got["has:text"] == ("@has:text", "modality", 0)


def test_null_status_counts_as_indexed(spark):
    got = values(catalog.index_status(frame(spark, [("a", None), ("b", "embed_failed")], "rel_path string, status string")), "rel_path", "index_status")
    assert got == [("a", "indexed"), ("b", "failed")]


def test_tiers(spark):
    f = frame(spark, [(1, "image"), (2, "audio"), (3, "text")], "file_id long, media_type string")
    assert values(catalog.plan_stages(f, "low"), "file_id", "stage") == [(1, "clip"), (1, "metadata"), (2, "metadata")]
    assert (2, "clap") in values(catalog.plan_stages(f, "full"), "file_id", "stage")
    with pytest.raises(ValueError):
        catalog.plan_stages(f, "huge")


# --- predicates


def test_negation_keeps_null_out(spark):
    f = frame(spark, [("a", "gif", "image"), ("b", None, "image"), ("c", "png", "image")], "rel_path string, ext string, media_type string")
    assert values(predicates.filter_files(f, ~predicates.is_gif()), "rel_path") == [("c",)]


def test_folder_pattern_ignores_case_and_underscore_is_wild(spark):
    f = frame(spark, [("Dir_1/x",), ("dirA1/x",), ("dir1/x",)], "rel_path string")
    assert values(f.where(predicates.in_folder("dir_1")), "rel_path") == [("Dir_1/x",), ("dirA1/x",)]
    with pytest.raises(ValueError):
        predicates.in_folder("a//b")


def test_literals_are_checked_when_built():
    for bad in ("10mb", None):
        with pytest.raises(ValueError):
            predicates.cmp("size", ">", bad)
    with pytest.raises(ValueError):
        predicates.has_ext("toolong")
    now = datetime(2024, 3, 5, 13, 0, tzinfo=UTC)
    assert predicates.date_ms("today", now) - predicates.date_ms("yesterday", now) == 86_400_000
    assert predicates.date_ms(1700000000) == predicates.date_ms(1700000000000) == 1700000000000


# --- scores


def test_cosine_of_zero_and_wrong_length(spark):
    f = frame(spark, [("z", [0.0, 0.0], None), ("w", [1.0], None), ("n", None, None), ("a", [1.0, 0.0], None), ("o", [-1.0, 0.0], None), ("f", None, "embed_failed")], "rel_path string, clip_emb array<float>, status string")
    f = f.withColumn("media_type", F.lit("image"))
    for arrow in (True, False):
        got = dict(values(search.semantic_scores(f, [2.0, 0.0], "imagecontent", arrow), "rel_path", "score"))
        assert got == {"z": 0.0, "a": 1.0, "o": -1.0, "f": -1.0}


def test_normalising_rules(spark):
    one = lambda *s: dict(values(search.minmax_0_100(frame(spark, [(str(i), float(x)) for i, x in enumerate(s)], "rel_path string, score double")), "rel_path", "score"))
    assert one(0.4) == {"0": 100.0}
    assert one(0.4, 0.4) == {"0": 100.0, "1": 100.0}
    assert one(0.0, 1.0, 0.5, -0.3) == {"0": 0.0, "1": 100.0, "2": 50.0, "3": -0.3}
    assert one(-1.0) == {"0": -1.0}


def test_tags_do_not_change_normalising_and_bounds_are_inclusive(spark):
    f = frame(spark, [("a", "gif", [1.0, 0.0]), ("b", "png", [1.0, 1.0]), ("c", "png", [0.0, 1.0])], "rel_path string, ext string, clip_emb array<float>").withColumns({"media_type": F.lit("image"), "status": F.lit("indexed")})
    got = dict(values(search.search(f, predicates.has_ext("png"), [1.0, 0.0], "imagecontent"), "rel_path", "score"))
    assert got["c"] == 0.0 and 70 < got["b"] < 71
    assert values(search.search(f, None, [1.0, 0.0], "imagecontent", lo=100), "rel_path") == [("a",)]
    assert values(search.search(f, predicates.is_gif()), "rel_path") == [("a",)]
    with pytest.raises(ValueError):
        search.search(f)


def test_batch_search_equals_single_searches(spark):
    rows = [(f"p{i:02d}", [float((i * k) % 7 - 3) for k in range(1, 5)] if i % 6 else None, "embed_failed" if i % 11 == 0 else "indexed") for i in range(40)]
    f = frame(spark, rows, "rel_path string, clip_emb array<float>, status string").withColumn("media_type", F.lit("image")).repartition(5)
    queries = [(1, [1.0, 2.0, 0.0, -1.0]), (2, [0.0, 0.0, 0.0, 1.0])]
    got = search.search_batch(f, frame(spark, queries, "query_id long, qvec array<double>"), 6, "imagecontent").collect()
    for qid, q in queries:
        want = [(round(r.score, 6), r.rel_path) for r in search.search(f, None, q, "imagecontent").collect()]
        own = [(round(r.score, 6), r.rel_path) for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == qid]
        assert own == sorted(want, key=lambda r: (-r[0], r[1]))[:6]


def test_longest_common_subsequence(spark):
    import random

    def lcs(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            last = 0
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
        return row[-1]

    rng = random.Random(1)
    texts = ["".join(rng.choice("abcé ") for _ in range(rng.randint(1, 90))) for _ in range(60)] + [None, ""]
    f = frame(spark, [(str(i), t, None) for i, t in enumerate(texts)], "rel_path string, ocr_text string, status string").withColumn("media_type", F.lit("image"))
    q = "Abc cab éa"
    got = dict(values(search.fuzzy_text_scores(f, q), "rel_path", "score"))
    for i, t in enumerate(texts):
        assert got[str(i)] == pytest.approx(lcs(q.lower(), t) / min(len(q), len(t)) if t else -1.0)


def test_audio_space_falls_back(spark):
    f = frame(spark, [(None,)], "clap_emb array<float>")
    assert search.space_with_fallback(f, "audiocontent") == "default"
    with pytest.raises(ValueError):
        vectors.choose_space("smell")


def test_fusing_without_vectors_gives_null(spark):
    f = frame(spark, [([3.0, 4.0], None, None, None), (None, None, None, None)], "clip_emb array<float>, metadata_emb array<float>, ocr_emb array<float>, transcript_emb array<float>")
    got = [r.search_emb for r in vectors.fuse_embeddings(f).collect()]
    assert got[0] == pytest.approx([0.6, 0.8]) and got[1] is None


def test_vector_blobs(spark):
    df = frame(spark, [(bytearray(struct.pack("<2f", 1.5, -2.0)),), (bytearray(b"123"),), (None,)], "b binary")
    assert [r.v for r in df.select(vectors.decode_vectors(F.col("b"), 2).alias("v")).collect()] == [[1.5, -2.0], None, None]


def test_plugin_embedder_survives_bad_rows(spark):
    def embed(batches):
        for batch in batches:
            for t in batch:
                yield [float(len(t)), 1 / len(t)]

    df = frame(spark, [("ab",), ("",), (None,)], "t string")
    assert [r.embedding for r in vectors.embed_column(df, "t", embed, dim=2).collect()] == [[2.0, 0.5], None, None]


# --- tags


def test_add_and_remove_tags(spark):
    files = frame(spark, [(1, "a"), (2, "b")], "file_id long, rel_path string")
    have = frame(spark, [(1, "x", "user"), (1, "x", "system")], "file_id long, slug string, source string")
    known = frame(spark, [("x", "@x", "custom")], "slug string, display_name string, kind string")
    new = frame(spark, [(1, "@X "), (2, "@@y"), (2, "@@y"), (9, "x"), (2, "@")], "file_id long, name string")
    ft, dim = tags.add_tags(have, known, new, files)
    assert values(ft, "file_id", "slug", "source") == [(1, "x", "system"), (1, "x", "user"), (2, "@y", "user")]
    assert values(dim, "slug") == [("@y",), ("x",)]
    assert values(tags.remove_tags(ft, frame(spark, [(1, "@x")], "file_id long, name string")), "file_id", "slug", "source") == [(1, "x", "system"), (2, "@y", "user")]


# --- saved queries and sequences


def test_token_classes(spark):
    q = "cat @image & @has:text | !(@.gif) @.toolong \\@x @nope @folder: @score>50 @date?2024 @ocr"
    got = [(r.token, r["class"]) for r in saved_queries.lex_query_log(frame(spark, [(1, q)], "query_id long, q string"), "q").orderBy("pos").collect()]
    assert got == [("cat", "text"), ("@image", "filetype"), ("&", "and"), ("@has:text", "modality"), ("|", "or"), ("!", "not"), ("(", "bracket"), ("@.gif", "fileext"), (")", "bracket"), ("@.toolong", "invalid"), ("\\@", "escaped"), ("x", "text"), ("@nope", "invalid"), ("@folder:", "invalid"), ("@score>50", "logical"), ("@date?2024", "logical"), ("@ocr", "mode")]


def test_collapse_repeats_rule(spark):
    def ctc(s, limit):
        out, last, streak = "", "-", 0
        for c in s:
            if c in ("-", last):
                streak += 1
                if streak > limit and out:
                    break
            else:
                streak, out = 0, out + c
            last = c
        return out

    strings = ["--aa-ab--b", "----", "a---------b", "---------ab", "aabb", "a-a-a", "abbbbbbbbbc"]
    rows = [(i, t, c) for i, s in enumerate(strings) for t, c in enumerate(s)]
    for limit in (3, 30):
        got = dict(values(sequences.collapse_repeats(frame(spark, rows, "k long, t long, s string"), "k", ["t"], "s", "-", limit), "k", "decoded"))
        assert got == {i: ctc(s, limit) for i, s in enumerate(strings)}


def test_peak_envelope_of_short_and_empty_keys(spark):
    rows = [(1, i, -20.0 * (i + 1)) for i in range(3)] + [(2, 0, None)]
    got = {(r.k, r.segment): r.peak for r in sequences.peak_envelope(frame(spark, rows, "k long, t long, v double"), "k", ["t"], "v", 5).collect()}
    assert [round(got[1, s], 6) for s in range(5)] == [0.1, 0.05, 0.05, 0.05, 0.05] and {got[2, s] for s in range(5)} == {0.5}


def test_fit_length_modes(spark):
    df = frame(spark, [([1, 2, 3],)], "v array<int>")
    fit = lambda n, mode: df.select(sequences.fit_length(F.col("v"), n, 0, mode).alias("f")).first()[0]
    assert fit(2, "constant") == [1, 2] and fit(5, "constant") == [1, 2, 3, 0, 0]
    assert fit(8, "repeat") == [1, 2, 3, 1, 2, 3, 0, 0] and fit(2, "repeat") == [1, 2]


def test_tokens_round_trip(spark):
    df = frame(spark, [(1, "It's 42 cats, it's"), (2, "")], "k long, t string")
    tokens = text.pretokenize(df, "t")
    assert tokens.first().tokens == ["it", "'s", "4", "2", "cats", ",", "it", "'s"]
    vocab = text.corpus_vocab(tokens, "tokens", 100)
    ids = text.encode_tokens(tokens, "k", "tokens", vocab, 900, 901, 12)
    assert {r.k: (len(r.ids), r.ids[0], 901 in r.ids) for r in ids.collect()} == {1: (12, 900, True), 2: (12, 900, True)}
    assert dict(values(text.decode_tokens(ids.withColumn("ids", F.filter("ids", lambda i: (i != 0) | F.lit(True))), "k", "ids", vocab.where("id > 0"), 900), "k", "text"))[1].split()[0] == "it"
    assert {r.k: r.pieces for r in text.encode_subwords(tokens, "k", "tokens", [("a", "t"), ("c", "at"), ("cat", "s</w>")]).collect()}[1][6] == "cats</w>"


# --- files and streams


def png(width, height):
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress((b"\0" + b"\0" * 3 * width) * height)) + chunk(b"IEND", b"")


def test_scanning_files(spark, tmp_path):
    (tmp_path / "a/b/c/d/e/f").mkdir(parents=True)
    (tmp_path / "x.png").write_bytes(png(7, 5))
    (tmp_path / "bad.png").write_bytes(b"no image")
    (tmp_path / "a/t.txt").write_text("hello " * 300)
    (tmp_path / "a/b/c/d/e/deep.txt").write_text("5")
    (tmp_path / "a/b/c/d/e/f/deeper.txt").write_text("6")
    got = dict(values(io.scan_corpus(spark, str(tmp_path)), "rel_path", "size_bytes"))
    assert got == {"x.png": len(png(7, 5)), "bad.png": 8, "a/t.txt": 1800, "a/b/c/d/e/deep.txt": 1}
    sizes = {r.origin.rsplit("/", 1)[-1]: (r.width, r.height) for r in io.image_dimensions(spark, str(tmp_path)).collect() if r.origin.endswith("png")}
    assert sizes == {"x.png": (7, 5), "bad.png": (None, None)}
    assert len(io.read_text_files(spark, str(tmp_path / "a/t.txt")).first().text) == 1000


def test_snapshots(spark, tmp_path):
    folder = str(tmp_path / "catalog")
    schema = {"files": schemas.FILES}
    assert io.load_catalog(spark, folder, schema)["files"].count() == 0
    io.publish_snapshot({"files": frame(spark, [(1,)], "id long")}, folder)
    first = io.current_version(spark, folder)
    with pytest.raises(Exception):
        io.publish_snapshot({"files": frame(spark, [(2,)], "id long").select(F.raise_error(F.lit("stop")).cast("long").alias("id"))}, folder)
    assert io.current_version(spark, folder) == first
    assert sorted(x.name for x in (tmp_path / "catalog").iterdir() if not x.name.startswith(".")) == ["CURRENT", first]
    io.publish_snapshot({"files": frame(spark, [(2,), (3,)], "id long")}, folder)
    assert values(io.load_catalog(spark, folder, schema)["files"].select("id"), "id") == [(2,), (3,)]
    assert io.drop_versions(spark, folder) == 0 and io.drop_versions(spark, folder, older_than_s=-60) == 1
    assert values(io.load_catalog(spark, folder, schema)["files"].select("id"), "id") == [(2,), (3,)]
    assert io.drop_versions(spark, str(tmp_path / "none")) == 0


def test_stream_equals_batch(spark, tmp_path):
    source, folder, check = (str(tmp_path / x) for x in ("in", "catalog", "check"))
    schema = "file_id long, rel_path string"
    first = frame(spark, [(1, "a/x.png"), (2, "a/y.txt"), (3, "b/z.mp4")], schema)
    second = frame(spark, [(4, "a/x.png"), (5, "c/w.mp3")], schema)
    first.write.parquet(source)
    run = lambda: index_stream(spark, source, first.schema, folder, check).awaitTermination()
    run()
    one = buckets.manifest(spark, folder)
    run()
    assert buckets.manifest(spark, folder) == one
    second.write.mode("append").parquet(source)
    run()
    want = catalog.upsert_files(catalogued(first), catalogued(second))
    folders, marks = catalog.derive_folders(want), system_tags(want)
    got = {n: buckets.read_table(spark, folder, n, df.schema) for n, df in (("files", want), ("folders", folders), ("file_tags", marks))}
    for name, all_of in (("files", want), ("folders", folders), ("file_tags", marks)):
        key = lambda t: tuple(map(str, t))
        assert sorted((tuple(r) for r in got[name].select(all_of.columns).collect()), key=key) == sorted((tuple(r) for r in all_of.collect()), key=key), name


def test_scalars_off_the_tables(spark):
    df = frame(spark, [("1500", "2024-01-02"), ("x", "nonsense")], "n string, d string")
    got = df.select(scalars.try_int(F.col("n")).alias("i"), scalars.parse_epoch_ms(F.col("d")).alias("ms"), scalars.parse_epoch_ms(F.col("n")).alias("n")).collect()
    assert [tuple(r) for r in got] == [(1500, 1704153600000, 1500000), (None, None, None)]


# --- plans that replaced plainer ones


def test_plugin_is_set_up_once_a_task(spark):
    def embed(batches):
        import random

        tag = random.random()
        for batch in batches:
            for t in batch:
                if t == "bad":
                    raise ValueError(t)
                yield [tag]

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    df = frame(spark, [(i, f"t{i}") for i in range(40)], "i int, t string").coalesce(1)
    assert len({r.embedding[0] for r in vectors.embed_column(df, "t", embed, dim=1).collect()}) == 1
    df = df.unionByName(frame(spark, [(40, "bad"), (41, None)], "i int, t string")).coalesce(1)
    got = {r.i: r.embedding for r in vectors.embed_column(df, "t", embed, dim=1).collect()}
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert all(got[i] for i in range(40)) and got[40] is None and got[41] is None


def test_best_class_of_any_type(spark):
    rows = frame(spark, [(1, "b", 2.0), (1, "a", 2.0), (1, "c", 1.0), (2, "z", None), (2, "y", -1.0)], "k int, c string, s double")
    assert sorted(tuple(r) for r in vectors.top_class(rows, "k", "c", "s").collect()) == [(1, "a", 2.0), (2, "y", -1.0)]


def test_days_begin_in_the_zone_of_the_session(spark):
    from datetime import UTC, datetime

    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
        now = datetime(2024, 3, 1, 16, tzinfo=UTC)  # already the second of March there
        assert predicates.date_ms("today", now) == int(datetime(2024, 3, 1, 15, tzinfo=UTC).timestamp() * 1000)
        assert predicates.date_ms("2024-03-02") == int(datetime(2024, 3, 1, 15, tzinfo=UTC).timestamp() * 1000)
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_compiled_filters_equal_joined_ones(spark):
    files = frame(spark, [(i, i % 7 if i % 5 else None, ["a", "B_c", None][i % 3]) for i in range(60)], "file_id long, n long, t string")
    clauses = [(1, 1, "n", ">", "3", False), (1, 2, "t", "like", "b%", False), (2, 1, "n", "<=", "2", True), (3, 1, "n", "=", "x", False), (4, 1, "t", "=", "a", True), (4, 1, "n", "=", "4", False), (5, 1, "zz", "=", "a", False), (6, 1, "n", "=", "1", False), (6, 2, "n", "=", "2", False)]
    frame_ = frame(spark, clauses, "query_id long, clause_id int, column string, op string, value string, negated boolean")
    got = [sorted(tuple(r) for r in saved_queries.match_saved_searches(files, frame_, ["n"], ["t"], max_compiled=m).collect()) for m in (100, 0)]
    assert got[0] == got[1] and {q for q, _ in got[0]} == {1, 2, 4}


def test_tokens_are_encoded_alike_in_the_tasks_and_by_a_join(spark):
    df = frame(spark, [(1, list("abxcabx")), (2, []), (3, None), (4, ["x"]), (5, list("aaaaaaaaaaaa"))], "k long, toks array<string>")
    vocab = frame(spark, [("a", 10), ("b", 11), ("c", 12)], "token string, id int")
    got = [sorted((r.k, r.ids) for r in text.encode_tokens(df, "k", "toks", vocab, 1, 2, 6, -1, max_vocab=m).collect()) for m in (10, 0)]
    assert got[0] == got[1] and got[0][0] == (1, [1, 10, 11, 12, 10, 2]) and got[0][1] == (2, [1, 2, -1, -1, -1, -1])


def test_places_follow_the_rank(spark):
    rows = [(f"p{i:03d}", float(i * 37 % 50)) for i in range(200)]
    got = {r.rel_path: r.place for r in search.placed(frame(spark, rows, "rel_path string, score double").repartition(5)).collect()}
    assert got == {p: i + 1 for i, (p, _) in enumerate(sorted(rows, key=lambda r: (-r[1], r[0])))}


def test_fuzzy_scores_of_whole_texts_match_a_plain_table(spark):
    import random

    rng = random.Random(3)
    query = "the and entier"
    rows = [(f"p{i}", "image", "embed_failed" if i % 9 == 0 else None, "".join(rng.choice("then adirXT") for _ in range(rng.randint(0, 300)))) for i in range(60)] + [("n", "image", None, None), ("p1x", "audio", "indexed", "THE AND ENTIER")]

    def lcs(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            last = 0
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
        return row[-1]

    want = {p: -1.0 if s == "embed_failed" or not t else lcs(query, t.lower()) / min(len(query), len(t)) for p, _, s, t in rows}
    got = {r.rel_path: r.score for r in search.fuzzy_text_scores(frame(spark, rows, "rel_path string, media_type string, status string, ocr_text string"), query).collect()}
    assert got.keys() == want.keys() and all(abs(got[p] - want[p]) < 1e-9 for p in want)


def test_suggestions_for_prefixes_of_several_lengths(spark):
    names = frame(spark, [("@Brand1", 1), ("@brand2", 1), ("@x", 2), ("@", 3)], "tag string, category int")
    got = [tuple(r) for r in search.suggest(names, frame(spark, [("@BR",), ("@",), ("@brand2z",), ("",), (None,)], "prefix string"), k=3).orderBy("prefix", "rank").collect()]
    assert [(p, t) for p, _, t in got] == [("", "@Brand1"), ("", "@brand2"), ("", "@x"), ("@", "@Brand1"), ("@", "@brand2"), ("@", "@x"), ("@BR", "@Brand1"), ("@BR", "@brand2")]
