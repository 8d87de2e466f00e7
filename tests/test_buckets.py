"""Bucketed tables: what a commit touches, what a failed or repeated one leaves."""

from __future__ import annotations

import os
import time

import pytest
from pyspark.sql import functions as F

from shelfspark.sources import buckets
from shelfspark.streaming.index_stream import catalogued, merge_batch

SCHEMA = "path string, v long"


def rows_of(spark, folder):
    schema = spark.createDataFrame([], SCHEMA).schema
    return sorted((tuple(r) for r in buckets.read_table(spark, folder, "t", schema).collect()), key=str)


def tree(folder):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, fs in os.walk(folder) for f in fs if f.startswith("part-")}


@pytest.fixture
def table(spark, tmp_path):
    folder = str(tmp_path / "t")
    rows = [(f"p{i}", i) for i in range(200)] + [(None, -1)]
    buckets.commit(spark, folder, [buckets.Change("t", "path", spark.createDataFrame(rows, SCHEMA))], buckets=16)
    return folder, dict(rows)


def test_a_batch_rewrites_touched_buckets_only(spark, table):
    folder, rows = table
    before, files = tree(folder), buckets.manifest(spark, folder)["tables"]["t"]["files"]
    fresh = spark.createDataFrame([("p3", 1000), ("new", 7)], SCHEMA)
    buckets.commit(spark, folder, [buckets.Change("t", "path", fresh)])
    after = buckets.manifest(spark, folder)["tables"]["t"]["files"]
    hit = set(map(str, buckets.touched(fresh, "path", 16)))
    assert len(hit) <= 2 and {b for b in after if after[b] != files.get(b)} == hit
    assert {f: t for f, t in tree(folder).items() if f in before} == before  # no old file changed
    assert len(tree(folder)) - len(before) == len(hit)
    assert rows_of(spark, folder) == sorted((rows | {"p3": 1000, "new": 7}).items(), key=str)


def test_winners_deletes_and_nulls(spark, table):
    folder, rows = table
    rivals = spark.createDataFrame([("p1", 9), ("p1", 5), ("p1", 5), (None, 3), (None, 4)], SCHEMA)
    buckets.commit(spark, folder, [buckets.Change("t", "path", rivals, gone=spark.createDataFrame([("p7", 0)], SCHEMA), order=("v",))])
    want = rows | {"p1": 5, None: 3}
    del want["p7"]
    assert rows_of(spark, folder) == sorted(want.items(), key=str)
    everything = spark.createDataFrame([], SCHEMA)
    buckets.commit(spark, folder, [buckets.Change("t", "path", everything, gone=buckets.read_table(spark, folder, "t", everything.schema))])
    assert rows_of(spark, folder) == [] and buckets.manifest(spark, folder)["tables"]["t"]["files"] == {}


def test_a_repeated_batch_changes_nothing(spark, table):
    folder, _ = table
    change = lambda v: [buckets.Change("t", "path", spark.createDataFrame([("p1", v)], SCHEMA))]
    version = buckets.commit(spark, folder, change(50), batch=("s", 4))
    held = tree(folder)
    assert buckets.commit(spark, folder, change(60), batch=("s", 4)) == buckets.commit(spark, folder, change(60), batch=("s", 2)) == version
    assert tree(folder) == held and ("p1", 50) in rows_of(spark, folder)
    assert buckets.commit(spark, folder, change(60), batch=("other", 0)) == version + 1


def test_a_failed_commit_leaves_no_files(spark, table):
    folder, rows = table
    held, before = tree(folder), buckets.manifest(spark, folder)
    bad = spark.createDataFrame([("p1", 1)], SCHEMA).withColumn("v", F.raise_error(F.lit("stop")).cast("long"))
    good = spark.createDataFrame([("p2", 1)], SCHEMA)
    with pytest.raises(Exception, match="stop"):
        buckets.commit(spark, folder, [buckets.Change("t", "path", good), buckets.Change("t2", "path", bad)])
    assert tree(folder) == held and buckets.manifest(spark, folder) == before
    assert rows_of(spark, folder) == sorted(rows.items(), key=str)


def test_of_two_writers_one_has_to_retry(spark, table, monkeypatch):
    folder, _ = table
    held = tree(folder)
    stale = buckets.manifest(spark, folder) | {"version": 0}
    monkeypatch.setattr(buckets, "manifest", lambda *_: stale)
    with pytest.raises(buckets.VersionTaken):
        buckets.commit(spark, folder, [buckets.Change("t", "path", spark.createDataFrame([("p1", 1)], SCHEMA))])
    assert tree(folder) == held and not [f for f in os.listdir(f"{folder}/manifests") if f.endswith(".temp")]


def test_vacuum_keeps_what_the_newest_version_names(spark, table):
    folder, rows = table
    buckets.commit(spark, folder, [buckets.Change("t", "path", spark.createDataFrame([("p1", 1)], SCHEMA))])
    assert buckets.vacuum(spark, folder) == 0
    time.sleep(0.01)
    assert buckets.vacuum(spark, folder, older_than_s=-60) == 1
    assert len([f for f in os.listdir(f"{folder}/manifests") if f.endswith(".json")]) == 1
    assert rows_of(spark, folder) == sorted((rows | {"p1": 1}).items(), key=str)
    assert len(tree(folder)) == len(buckets.manifest(spark, folder)["tables"]["t"]["files"])


def test_keys_are_read_from_their_buckets(spark, table):
    folder, _ = table
    keys = spark.createDataFrame([("p5",), ("p6",), ("none",)], "path string")
    got = buckets.read_keys(spark, folder, "t", spark.createDataFrame([], SCHEMA).schema, keys)
    assert sorted(tuple(r) for r in got.collect()) == [("p5", 5), ("p6", 6)]
    assert len(got.inputFiles()) <= 3 < len(tree(folder))


def test_a_path_under_a_new_id_takes_its_tags_along(spark, tmp_path):
    folder = str(tmp_path / "c")
    schema = "file_id long, rel_path string"
    merge_batch(catalogued(spark.createDataFrame([(1, "a/x.png"), (2, "b/y.mp3"), (9, "a/x.png")], schema)), folder)
    merge_batch(catalogued(spark.createDataFrame([(3, "a/x.png")], schema)), folder)
    held = buckets.manifest(spark, folder)
    tags = buckets.read_table(spark, folder, "file_tags", spark.createDataFrame([], "file_id long, slug string").schema, at=held)
    assert sorted(tuple(r) for r in tags.collect()) == [(2, ".mp3"), (2, "audio"), (2, "folder:b"), (3, ".png"), (3, "folder:a"), (3, "image")]
    assert held["version"] == 2


def test_a_merge_is_made_anew_if_another_writer_was_first(spark, tmp_path, monkeypatch):
    folder, seen = str(tmp_path / "c"), []
    files = lambda *rows: catalogued(spark.createDataFrame(list(rows), "file_id long, rel_path string"))
    merge_batch(files((1, "a/x.png")), folder, n_buckets=4)
    commit = buckets.commit

    def slow(spark, folder, changes, *rest, **named):
        if not seen:
            seen.append(1)
            merge_batch(files((2, "a/x.png"), (3, "b/z.png")), folder)
        return commit(spark, folder, changes, *rest, **named)

    monkeypatch.setattr(buckets, "commit", slow)
    assert merge_batch(files((4, "a/x.png")), folder) == 3
    schema = spark.createDataFrame([], "file_id long, rel_path string").schema
    assert sorted(tuple(r) for r in buckets.read_table(spark, folder, "files", schema).collect()) == [(3, "b/z.png"), (4, "a/x.png")]
    tags = buckets.read_table(spark, folder, "file_tags", spark.createDataFrame([], "file_id long, slug string").schema)
    assert {r.file_id for r in tags.collect()} == {3, 4}


def test_rebucketing_keeps_rows_and_later_commits(spark, table):
    folder, rows = table
    schema = spark.createDataFrame([], SCHEMA).schema
    assert buckets.rebucket(spark, folder, "t", schema, 5) == 2
    assert len(buckets.manifest(spark, folder)["tables"]["t"]["files"]) == 5
    buckets.commit(spark, folder, [buckets.Change("t", "path", spark.createDataFrame([("p9", -9)], SCHEMA))])
    assert rows_of(spark, folder) == sorted((rows | {"p9": -9}).items(), key=str)


def test_a_large_bucket_is_written_by_several_tasks(spark, tmp_path):
    folder, old = str(tmp_path / "t"), spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    rows = spark.range(0, 40_000, numPartitions=8).select(F.sha2(F.col("id").cast("string"), 256).alias("path"), F.col("id").alias("v"))
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "256k")
    try:
        buckets.commit(spark, folder, [buckets.Change("t", "path", rows)], buckets=2)
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", old)
    assert len(tree(folder)) >= 6
    held = buckets.manifest(spark, folder)["tables"]["t"]["files"]
    assert sorted(held) == ["0", "1"] and rows_of(spark, folder) == sorted(map(tuple, rows.collect()), key=str)
    for b in (0, 1):
        own = buckets.read_table(spark, folder, "t", rows.schema, [b])
        assert own.where(buckets.bucket_of(F.col("path"), 2) != b).isEmpty() and not own.isEmpty()


def test_a_merge_derives_its_rows_once(spark, tmp_path, monkeypatch):
    kept, commit = [], buckets.commit

    def seen(spark, folder, changes, *rest, **named):
        kept.extend(c.rows.storageLevel.useMemory for c in changes)
        return commit(spark, folder, changes, *rest, **named)

    monkeypatch.setattr(buckets, "commit", seen)
    merge_batch(catalogued(spark.createDataFrame([(1, "a/x.png"), (2, "b/y.mp3")], "file_id long, rel_path string")), str(tmp_path / "c"))
    assert kept == [True] * 3
    assert spark._jsparkSession.sharedState().cacheManager().isEmpty()
