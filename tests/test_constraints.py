"""The constraint report on a small catalog with known faults."""

from __future__ import annotations

from shelfspark.operators import catalog


def made(spark):
    frame = spark.createDataFrame
    return {
        "files": frame([(1, "a/x.png", "image"), (2, "a/x.png", "image"), (2, "b", None), (None, None, "image"), (None, None, "x"), (3, "a/x.png", "image")], "file_id long, rel_path string, media_type string"),
        "folders": frame([("", 0, None), ("a", 1, ""), ("a", 9, "gone"), ("c", -1, "gone")], "rel_path string, depth int, parent_rel_path string"),
        "tags": frame([("t",), ("t",), (None,), (None,), ("u",)], "slug string"),
        "file_tags": frame([(1, "t", "user"), (1, "t", "user"), (1, "t", "system"), (7, "v", "user"), (7, "v", None), (7, "v", None), (None, "u", "user")], "file_id long, slug string, source string"),
    }


def test_every_check(spark):
    got = {r.check: r.violations for r in catalog.validate_catalog(made(spark)).collect()}
    assert got == {
        "files.rel_path unique": 2, "files.file_id unique": 2, "folders.rel_path unique": 1, "tags.slug unique": 2, "file_tags unique": 2, "files not null": 3, "folders.depth range": 2,
        "folders.parent exists": 2, "file_tags.file exists": 3, "file_tags.tag exists": 3,
    }


def test_empty_tables_have_no_violations(spark):
    empty = {n: df.limit(0) for n, df in made(spark).items()}
    assert {r.violations for r in catalog.validate_catalog(empty).collect()} == {0}


def test_every_table_is_read_once(spark, tmp_path):
    held = {}
    for n, df in made(spark).items():
        df.write.parquet(f"{tmp_path}/{n}")
        held[n] = spark.read.parquet(f"{tmp_path}/{n}")
    plan = catalog.validate_catalog(held)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 4
