"""Every registered query of the library against DuckDB on the same tables."""

import math
import os

import pytest

import __spark_entry__ as entry
from feedlake.registry import REGISTRY

duckdb = pytest.importorskip("duckdb")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db(sf):
    c = duckdb.connect()
    for t in TABLES:
        p = f"{sf}/{t}.parquet"
        c.execute(f"create view {t} as select * from '{p}{'/*.parquet' if os.path.isdir(p) else ''}'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v if v is None or isinstance(v, (int, bool)) else str(v)


def ordered(columns, rows):
    at = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted((tuple(plain(r[i]) for i in at) for r in rows), key=repr)


@pytest.mark.parametrize("name", [n for n, q in REGISTRY.items() if q[1]])
def test_query(spark, sf, db, name):
    df = REGISTRY[name][0](spark, sf)
    found = ordered(df.columns, [tuple(r) for r in df.collect()])
    q = db.execute(REGISTRY[name][1])
    assert found == ordered([c[0] for c in q.description], q.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_without_the_training_data_operators():
    """The entry points import, and hold all other queries, where the subpackage and the pipeline are missing."""
    import subprocess
    import sys

    code = "import sys\nfor m in ('feedlake.llm', 'corpus_pipeline'): sys.modules[m] = None\nimport __spark_entry__ as e, feedlake.registry as r\nassert set(e.queries()) == set(r.REGISTRY)\nassert not any('llm' in m for m in sys.modules if sys.modules[m])"
    root = os.path.dirname(os.path.abspath(entry.__file__))
    subprocess.run([sys.executable, "-c", code], check=True, cwd=root)
