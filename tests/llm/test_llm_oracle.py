"""The training-data queries against their SQL counterparts."""

from pathlib import Path

import duckdb
import pytest

from tidemark.llm.oracle import ORACLE
from tidemark.llm.queries import QUERIES

SF = Path("/root/testdata/sf0.001")

pytestmark = pytest.mark.skipif(not SF.exists(), reason="no test tables")


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    df = QUERIES[name](spark, str(SF))
    cursor = con.execute(ORACLE[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(df.columns)
    want = [dict(zip(names, r, strict=True)) for r in cursor.fetchall()]
    got = [r.asDict() for r in df.collect()]
    key = lambda rows: sorted(repr(sorted(r.items())) for r in rows)
    assert got and key(got) == key(want)
