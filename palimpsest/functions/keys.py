"""The key space of tables: ``/s/<table>`` holds a schema, ``/d/<table>/<pk>`` a row.

Keys stay strings in storage, so prefix filters reach the Parquet scan; their order is that of the
UTF-8 bytes. Identity is always by typed primary-key columns; key strings are for scans and display.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

SCHEMA_PREFIX, ROW_PREFIX = "/s/", "/d/"


def check_table_name(name: str) -> str:
    if not name or "/" in name:
        raise ValueError(f"not a table name: {name!r}")
    return name


def pk_text(columns: Sequence[str | Column]) -> Column:
    """Primary-key values joined by ``/``; null if one of them is null."""
    parts = [(F.col(c) if isinstance(c, str) else c).cast("string") for c in columns]
    return F.concat(*[x for p in parts for x in (F.lit("/"), p)][1:])


def row_key(table: str, columns: Sequence[str | Column]) -> Column:
    return F.concat(F.lit(f"{ROW_PREFIX}{check_table_name(table)}/"), pk_text(columns))


def table_of_schema_key(key: Column) -> Column:
    return F.substr(key, F.lit(len(SCHEMA_PREFIX) + 1))


def table_of_row_key(key: Column) -> Column:
    return F.split(key, "/", 4)[2]


def pk_of_row_key(key: Column) -> Column:
    """What follows the table's name, slashes and all."""
    return F.split(key, "/", 4)[3]


def scalar_json(value: Column) -> Column:
    text = F.to_json(F.array(value), {"ignoreNullFields": "false"})
    return F.substring(text, 2, F.length(text) - 2)


def row_json(columns: Sequence[str | Column]) -> Column:
    """A row as a compact JSON array in column order; null stays null."""
    parts = [scalar_json(F.col(c) if isinstance(c, str) else c) for c in columns]
    return F.concat(F.lit("["), F.concat_ws(",", *parts), F.lit("]"))
