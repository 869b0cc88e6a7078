"""Differences of two versions: of key-value entries, of rows and columns, of databases.

All are null-safe full outer joins on the key. Values are compared by type: NaN equals NaN, and an
integer differs from a float only where their columns' types do.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ADDED, DELETED, MODIFIED = "added", "deleted", "modified"


def _status(old: Column, new: Column) -> Column:
    return F.when(old.isNull(), ADDED).when(new.isNull(), DELETED).otherwise(MODIFIED)


def kv_diff(old: DataFrame, new: DataFrame, prefix: str = "") -> DataFrame:
    """(key, change_type, old_value, new_value) of keys whose entries differ; a prefix is applied before the join."""
    if prefix:
        old, new = (d.where(F.col("key").startswith(prefix)) for d in (old, new))
    a = old.select("key", F.struct(F.col("value").alias("v")).alias("o"))
    b = new.select("key", F.struct(F.col("value").alias("v")).alias("n"))
    both = a.join(b, "key", "full_outer").where(~F.col("o").eqNullSafe(F.col("n")))
    return both.select("key", _status(F.col("o"), F.col("n")).alias("change_type"), F.col("o.v").alias("old_value"), F.col("n.v").alias("new_value"))


def summary(events: DataFrame) -> DataFrame:
    """One row: added, deleted, modified, total."""
    count = lambda kind: F.count(F.when(F.col("change_type") == kind, 1)).alias(kind)
    return events.agg(count(ADDED), count(DELETED), count(MODIFIED), F.count("*").alias("total"))


def row_diff(old: DataFrame, new: DataFrame, pk: Sequence[str]) -> DataFrame:
    """Key columns, status, old and new row (structs), and the array of changed columns of rows that differ.

    The changed columns are those of the new version, key columns apart. Where the lists of columns
    differ, rows are not compared and the result is empty.
    """
    columns = [c for c in new.columns if c not in pk]
    same = list(old.columns) == list(new.columns)
    a = old.select(*pk, F.struct(*(columns if same else [F.lit(1).alias("_")]), F.lit(True).alias("_here")).alias("old"))
    b = new.select(*pk, F.struct(*(columns if same else [F.lit(1).alias("_")]), F.lit(True).alias("_here")).alias("new"))
    both = a.join(b, list(pk), "full_outer")
    if not same:
        both = both.limit(0)
        columns = []
    changed = F.array_compact(F.array(*[F.when(~F.col(f"old.`{c}`").eqNullSafe(F.col(f"new.`{c}`")), F.lit(c)) for c in columns])) if columns else F.expr("array()").cast("array<string>")
    status = _status(F.col("old"), F.col("new"))
    rows = both.select(*pk, status.alias("status"), "old", "new", F.when(status == MODIFIED, changed).otherwise(F.expr("array()").cast("array<string>")).alias("changed_columns"))
    return rows.where((F.col("status") != MODIFIED) | (F.size("changed_columns") > 0))


def column_counts(rows: DataFrame) -> DataFrame:
    """(column, changes, pct of modified rows), by changes descending, then name."""
    modified = rows.where(F.col("status") == MODIFIED)
    counted = modified.select(F.explode("changed_columns").alias("column")).groupBy("column").agg(F.count("*").alias("changes"))
    total = modified.agg(F.count("*").alias("n"))
    return counted.select("column", "changes", (F.col("changes") * 100.0 / total.scalar()).alias("pct")).orderBy(F.col("changes").desc(), "column")


@dataclass(frozen=True)
class SchemaChange:
    added_columns: tuple[str, ...]
    removed_columns: tuple[str, ...]
    columns_differ: bool
    types_differ: bool
    key_differs: bool

    @property
    def any(self) -> bool:
        return self.columns_differ or self.types_differ or self.key_differs


def schema_change(old: DataFrame, new: DataFrame, old_pk: Sequence[str], new_pk: Sequence[str]) -> SchemaChange:
    a, b = dict(old.dtypes), dict(new.dtypes)
    return SchemaChange(
        tuple(c for c in new.columns if c not in a), tuple(c for c in old.columns if c not in b), old.columns != new.columns,
        any(a[c] != b[c] for c in a if c in b), tuple(old_pk) != tuple(new_pk),
    )


@dataclass
class TableDiff:
    """Difference of one table: the schemas' and, where the lists of columns agree, the rows'."""

    name: str
    schema: SchemaChange
    rows: DataFrame

    def counts(self) -> dict[str, int]:
        got = {r["status"]: r["n"] for r in self.rows.groupBy("status").agg(F.count("*").alias("n")).collect()}
        return {k: got.get(k, 0) for k in (ADDED, DELETED, MODIFIED)}

    def columns(self) -> DataFrame:
        return column_counts(self.rows)

    def summary(self) -> str:
        n = self.counts()
        return describe(self.schema, n, [r["column"] for r in self.columns().collect()] if n[MODIFIED] else [])


def describe(schema: SchemaChange, n: Mapping[str, int], columns: Sequence[str]) -> str:
    parts = ["schema changed"] if schema.any else []
    parts += [f"{sign}{n[k]} rows" for sign, k in (("+", ADDED), ("-", DELETED), ("~", MODIFIED)) if n[k]]
    if n[MODIFIED]:
        parts.append("columns: " + ", ".join(sorted(columns)))
    return ", ".join(parts) or "no changes"


def table_diff(name: str, old: DataFrame, new: DataFrame, old_pk: Sequence[str], new_pk: Sequence[str]) -> TableDiff:
    change = schema_change(old, new, old_pk, new_pk)
    on = [c for c in new_pk if c in old.columns] if set(new_pk) <= set(old.columns) else list(new_pk)
    if not set(on) <= set(old.columns):  # the key itself is new: nothing to match rows by
        empty = new.select(*on).limit(0)
        rows = row_diff(empty, new.select(*on).limit(0), on)
    else:
        rows = row_diff(old, new, on)
    return TableDiff(name, change, rows)


@dataclass
class DatabaseDiff:
    """Tables that came and went, and the differences of those in both; these are counted once, all tables in one aggregation."""

    added: list[str]
    removed: list[str]
    common: dict[str, TableDiff]
    _counts: dict[str, dict[str, int]] | None = None
    _columns: dict[str, list[str]] | None = None

    def counts(self) -> dict[str, dict[str, int]]:
        """Rows added, deleted and modified in each table of both."""
        if self._counts is None:
            empty = {name: {k: 0 for k in (ADDED, DELETED, MODIFIED)} for name in self.common}
            columns: dict[str, list[str]] = {name: [] for name in self.common}
            rows = None
            for name, t in self.common.items():
                part = t.rows.select(F.lit(name).alias("name"), "status", "changed_columns")
                rows = part if rows is None else rows.unionByName(part)
            # a row counts under its status and, if it was modified, under each of its columns
            if rows is not None:
                named = F.transform("changed_columns", lambda c: F.concat(F.lit("="), c))
                for r in rows.select("name", "status", F.explode(F.concat(F.array(F.lit("")), named)).alias("c")).groupBy("name", "status", "c").agg(F.count("*").alias("n")).collect():
                    if r["c"]:
                        columns[r["name"]].append(r["c"][1:])
                    else:
                        empty[r["name"]][r["status"]] = r["n"]
            self._counts, self._columns = empty, columns
        return self._counts

    def changed(self) -> dict[str, TableDiff]:
        return {k: v for k, v in self.common.items() if v.schema.any or any(self.counts()[k].values())}

    @property
    def has_changes(self) -> bool:
        return bool(self.added or self.removed or self.changed())

    def totals(self) -> dict[str, int]:
        return {k: sum(n[k] for n in self.counts().values()) for k in (ADDED, DELETED, MODIFIED)}

    def summary(self) -> str:
        n = self.counts()
        parts = [f"+ table {t}" for t in self.added] + [f"- table {t}" for t in self.removed]
        parts += [f"~ table {k}: {describe(v.schema, n[k], self._columns[k])}" for k, v in self.changed().items()]
        return "\n".join(parts) or "no changes"


Version = Mapping[str, tuple[DataFrame, Sequence[str]]]


def db_diff(old: Version, new: Version, tables: Sequence[str] | None = None) -> DatabaseDiff:
    """Tables that came and went, and the differences of those in both. No tables named means all."""
    wanted = set(tables) if tables else set(old) | set(new)
    added, removed = sorted((set(new) - set(old)) & wanted), sorted((set(old) - set(new)) & wanted)
    common = sorted(set(old) & set(new) & wanted)
    return DatabaseDiff(added, removed, {t: table_diff(t, old[t][0], new[t][0], old[t][1], new[t][1]) for t in common})
