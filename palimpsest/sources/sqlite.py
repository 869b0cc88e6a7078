"""SQLite as a Spark data source, and its tables as versioned ones.

``spark.read.format("sqlite").option("path", file).option("table", name)`` reads a table in ranges
of its rowid. Values come by the affinity of the declared type; those that don't fit it are null,
never an error. Tables without a primary key get their rowid as column ``rowid`` and key.
"""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator, Sequence
from contextlib import closing
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

ROWS_PER_PARTITION = 250_000


def quote(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def affinity(declared: str) -> T.DataType:
    """SQLite's rules for column affinity, numeric as double."""
    name = declared.upper()
    if "INT" in name:
        return T.LongType()
    if any(x in name for x in ("CHAR", "CLOB", "TEXT")):
        return T.StringType()
    if not name or "BLOB" in name:
        return T.BinaryType()
    return T.DoubleType()


@dataclass(frozen=True)
class Table:
    name: str
    columns: tuple[str, ...]
    types: tuple[str, ...]
    primary_key: tuple[str, ...]
    has_rowid: bool

    def schema(self) -> T.StructType:
        lead = [T.StructField("rowid", T.LongType())] if self.primary_key == ("rowid",) and "rowid" not in self.columns else []
        return T.StructType([*lead, *(T.StructField(c, affinity(t)) for c, t in zip(self.columns, self.types, strict=True))])


def describe(path: str, name: str) -> Table:
    with closing(sqlite3.connect(f"file:{path}?mode=ro", uri=True)) as db:
        info = db.execute(f"PRAGMA table_info({quote(name)})").fetchall()
        if not info:
            raise ValueError(f"no such table: {name}")
        key = tuple(r[1] for r in sorted((r for r in info if r[5]), key=lambda r: r[5]))
        try:
            db.execute(f"SELECT rowid FROM {quote(name)} LIMIT 1")
            has_rowid = True
        except sqlite3.OperationalError:
            has_rowid = False
        return Table(name, tuple(r[1] for r in info), tuple(r[2] or "" for r in info), key or ("rowid",), has_rowid)


def table_names(path: str) -> list[str]:
    with closing(sqlite3.connect(f"file:{path}?mode=ro", uri=True)) as db:
        return [r[0] for r in db.execute("SELECT name FROM sqlite_master WHERE type = 'table' AND name NOT LIKE 'sqlite!_%' ESCAPE '!' ORDER BY name")]


def _fit(value, kind: T.DataType):
    if value is None:
        return None
    if isinstance(kind, T.BinaryType):
        return value if isinstance(value, bytes) else str(value).encode()
    if isinstance(value, bytes):
        value = value.decode("utf-8", "replace")
    if isinstance(kind, T.StringType):
        return str(value)
    try:
        return int(value) if isinstance(kind, T.LongType) and float(value).is_integer() else float(value) if isinstance(kind, T.DoubleType) else None
    except (ValueError, OverflowError):
        return None


class _Range(InputPartition):
    def __init__(self, low: int | None, high: int | None):
        self.low, self.high = low, high


class SqliteReader(DataSourceReader):
    def __init__(self, path: str, table: Table, schema: T.StructType):
        self.path, self.table, self.schema = path, table, schema

    def partitions(self) -> Sequence[InputPartition]:
        if not self.table.has_rowid:
            return [_Range(None, None)]
        with closing(sqlite3.connect(f"file:{self.path}?mode=ro", uri=True)) as db:
            low, high, n = db.execute(f"SELECT min(rowid), max(rowid), count(*) FROM {quote(self.table.name)}").fetchone()
        if not n:
            return [_Range(None, None)]
        parts = max(1, -(-n // ROWS_PER_PARTITION))
        step = -(-(high - low + 1) // parts)
        return [_Range(s, min(s + step - 1, high)) for s in range(low, high + 1, step)]

    def read(self, partition: _Range) -> Iterator[tuple]:
        names = ", ".join("rowid" if f.name == "rowid" and "rowid" not in self.table.columns else quote(f.name) for f in self.schema)
        where, args = ("", ()) if partition.low is None else (" WHERE rowid BETWEEN ? AND ?", (partition.low, partition.high))
        kinds = [f.dataType for f in self.schema]
        with closing(sqlite3.connect(f"file:{self.path}?mode=ro", uri=True)) as db:
            for row in db.execute(f"SELECT {names} FROM {quote(self.table.name)}{where}", args):
                yield tuple(_fit(v, k) for v, k in zip(row, kinds, strict=True))


class SqliteSource(DataSource):
    """Options: path, table."""

    @classmethod
    def name(cls) -> str:
        return "sqlite"

    def _table(self) -> Table:
        return describe(self.options["path"], self.options["table"])

    def schema(self) -> T.StructType:
        return self._table().schema()

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return SqliteReader(self.options["path"], self._table(), schema)


def read_table(spark: SparkSession, path: str, name: str) -> DataFrame:
    spark.dataSource.register(SqliteSource)
    return spark.read.format("sqlite").option("path", path).option("table", name).load()
