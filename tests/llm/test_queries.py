from __future__ import annotations

from pathlib import Path

import pytest

from rungmill.llm import queries

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables here")
FOUND = {
    "p1_found": ["table_name", "id_a", "id_b"], "p2_found": ["kept_ordinal", "copy_ordinal"], "p3_found": ["record_ordinal", "rung", "defect"], "p4_found": ["record_ordinal", "group_ordinal"],
    "p6_found": ["table_name", "record_ordinal"], "p8_found": ["doc_id", "item_id"], "p9_found": ["doc_id"],
}


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_sql(spark, name):
    import duckdb

    c = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        c.execute(f"create view {p.stem} as from '{p}'")
    got, want = queries.QUERIES[name](spark, str(DATA)), c.execute(queries.ORACLE[name])
    names = [x[0] for x in want.description]
    assert set(names) == set(got.columns)
    assert sorted(repr(tuple(r[n] for n in names)) for r in got.collect()) == sorted(map(repr, want.fetchall()))


@pytest.mark.parametrize("name", sorted(FOUND))
def test_columns(spark, name):
    df = queries.QUERIES[name](spark, str(DATA))
    assert df.columns == FOUND[name] and df.count() == df.distinct().count()
