"""Every query of the rest that has SQL, against DuckDB on the smallest tables."""

from pathlib import Path

import pytest

from attest import starfigures, starrules, starschema

duckdb = pytest.importorskip("duckdb")
DATA = "/root/testdata/sf0.001"
MODULES = (starschema, starrules, starfigures)
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="no tables")


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        con.sql(f"create view {p.stem} as select * from '{p}'")
    return con


def plain(v):
    return round(v, 6) + 0.0 if isinstance(v, float) else v


@pytest.mark.parametrize("name", [k for m in MODULES for k in m.ORACLES])
def test_same_as_sql(spark, tables, name):
    m = next(m for m in MODULES if name in m.ORACLES)
    got, want = m.QUERIES[name](spark, DATA), tables.sql(m.ORACLES[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    at = [want.columns.index(c) for c in columns]
    assert sorted((tuple(plain(r[c]) for c in columns) for r in got.collect()), key=str) == sorted((tuple(plain(r[i]) for i in at) for r in want.fetchall()), key=str)
