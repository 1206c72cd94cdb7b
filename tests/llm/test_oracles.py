"""The training-data queries that SQL can express, against DuckDB on the same tables."""

import os

import pytest

from feedlake.llm.queries import ORACLE_SQL, QUERIES

duckdb = pytest.importorskip("duckdb")


@pytest.mark.parametrize("name", list(ORACLE_SQL))
def test_query(spark, sf, name):
    db = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark"):
        p = f"{sf}/{t}.parquet"
        db.execute(f"create view {t} as select * from '{p}{'/*.parquet' if os.path.isdir(p) else ''}'")
    q = db.execute(ORACLE_SQL[name])
    columns, want = [c[0] for c in q.description], sorted(q.fetchall(), key=repr)
    assert sorted((tuple(r) for r in QUERIES[name](spark, sf).select(*columns).collect()), key=repr) == want
