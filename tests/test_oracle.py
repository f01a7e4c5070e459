"""Every registered query with SQL gives DuckDB's rows."""

import datetime
from pathlib import Path

import duckdb
import pytest

from graphloom.queries import ORACLE_SQL, QUERIES

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for path in Path(SF_DIR).glob("*.parquet"):
        con.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def plain(row):
    return tuple(round(v, 6) if isinstance(v, float) else v.isoformat() if isinstance(v, datetime.date) else v for v in row)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_rows(spark, tables, name):
    got = QUERIES[name](spark, SF_DIR)
    want = tables.sql(ORACLE_SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    rows = [plain(r) for r in got.select(*sorted(got.columns)).collect()]
    expected = [plain(r) for r in want.select(*sorted(want.columns)).fetchall()]
    assert sorted(rows, key=repr) == sorted(expected, key=repr)
