"""Every query with SQL, held against DuckDB on the smallest tables."""

from __future__ import annotations

import importlib
from pathlib import Path

import pytest

from rungmill.plans import queries

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables here")


def same(spark, name, f, sql):
    import duckdb

    c = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        c.execute(f"create view {p.stem} as from '{p}'")
    got, want = f(spark, str(DATA)), c.execute(sql)
    names = [x[0] for x in want.description]
    assert set(names) == set(got.columns), name
    assert sorted(repr(tuple(r[n] for n in names)) for r in got.collect()) == sorted(map(repr, want.fetchall())), name


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_sql(spark, name):
    same(spark, name, queries.QUERIES[name], queries.ORACLE[name])


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE)))
def test_without_sql(spark, name):
    assert queries.QUERIES[name](spark, str(DATA)).count() > 0


def test_entry(spark):
    entry = importlib.import_module("__spark_entry__")
    assert entry.entry(spark).count() > 0 and set(entry.oracle_sql()) <= set(entry.queries()) and set(queries.QUERIES) <= set(entry.queries())
