"""Every registered query with SQL gives the rows DuckDB gives, on the smallest tables."""

import os
from pathlib import Path

import duckdb
import pytest

from palimpsest.plans import registry

DATA = Path(os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001"))
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables")


def plain(value):
    if value is None or value != value:
        return "NULL"
    return f"{value:.6g}" if isinstance(value, float) else str(value)


@pytest.fixture(scope="module")
def duck():
    db = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        db.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return db


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_equals_sql(spark, duck, name):
    frame = registry.QUERIES[name](spark, str(DATA))
    cursor = duck.execute(registry.SQL[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(frame.columns) == sorted(columns)
    want = sorted(tuple(map(plain, r)) for r in cursor.fetchall())
    got = sorted(tuple(plain(r[c]) for c in columns) for r in frame.collect())
    assert got == want


def test_entry_is_registered():
    import __spark_entry__

    assert set(registry.QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
