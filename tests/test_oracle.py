"""Every named query against its SQL counterpart."""

import os
from pathlib import Path

import duckdb
import pytest

from tidemark.catalog import QUERIES
from tidemark.oracle import ORACLE

SF = Path(os.environ.get("TIDEMARK_SF_DIR", "/root/testdata/sf0.001"))

pytestmark = pytest.mark.skipif(not SF.exists(), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in SF.glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    return value + 0.0 if isinstance(value, float) else value


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((repr(tuple(plain(row[i]) for i in order)) for row in rows))


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)


def compare(spark, con, sf, name):
    df = QUERIES[name](spark, str(sf))
    cursor = con.execute(ORACLE[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(df.columns)
    rows = df.collect()
    assert table(df.columns, rows) == table(names, cursor.fetchall())
    return len(rows)


#: Too few trips for a row in the smallest tables.
LARGER = ("percentiles_raw", "route_documents", "journeys_best")


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, duck, name):
    compare(spark, duck, SF, name)


@pytest.mark.parametrize("name", LARGER)
def test_query_matches_sql_on_larger_tables(spark, name):
    sf, con = SF.parent / "sf0.01", duckdb.connect()
    for path in sf.glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    assert compare(spark, con, sf, name)
