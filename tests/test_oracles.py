"""Every registered query of the library against its SQL, at the smallest scale."""

from __future__ import annotations

import os

import pytest

import __spark_entry__
from shelfspark import plans

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SPARK_TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    return con


def rows(names: list[str], found: list[tuple]) -> list[tuple]:
    order = sorted(range(len(names)), key=names.__getitem__)
    clean = lambda x: round(x, 6) + 0.0 if isinstance(x, float) else x
    return sorted((tuple(clean(r[i]) for i in order) for r in found), key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, duck, name):
    df = __spark_entry__.queries()[name](spark, SF_DIR)
    got = df.collect()
    sql = plans.ORACLE_SQL.get(name)
    if sql is None:
        assert len(got)
        return
    want = duck.sql(sql)
    types = dict(zip(want.columns, map(str, want.types), strict=True))
    assert {c: SPARK_TYPES.get(t, t) for c, t in df.dtypes} == types
    assert rows(df.columns, [tuple(r) for r in got]) == rows(list(want.columns), want.fetchall())


def test_entry_gives_rows(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_oracles_name_queries():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
