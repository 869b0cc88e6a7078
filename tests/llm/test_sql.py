"""Registered queries against their SQL on the smallest tables."""

import duckdb
import pytest

from palimpsest.llm.queries import QUERIES
from palimpsest.llm.sql import SQL

from .odd import DATA


def plain(value):
    return "NULL" if value is None or value != value else f"{value:.9g}" if isinstance(value, float) else str(value)


def same_rows(spark, name, sql):
    frame = QUERIES[name](spark, str(DATA))
    db = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        db.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    cursor = db.execute(sql)
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(frame.columns)
    assert sorted(tuple(plain(r[c]) for c in columns) for r in frame.collect()) == sorted(tuple(map(plain, r)) for r in cursor.fetchall())


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
@pytest.mark.parametrize("name", sorted(set(SQL) - {"op5_license_scans"}))
def test_query_equals_sql(spark, name):
    same_rows(spark, name, SQL[name])
