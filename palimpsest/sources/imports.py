"""SQLite files into a repository."""

from __future__ import annotations

import time
import warnings
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import functions as F

from palimpsest.operators import validate
from palimpsest.sources import sqlite
from palimpsest.sources.repository import Draft, Repository


@dataclass(frozen=True)
class Progress:
    """A table that was put into a draft, and the totals so far."""

    table: str
    rows: int
    seconds: float
    all_rows: int
    all_seconds: float

    @property
    def rate(self) -> float:
        """Rows a second of this table."""
        return self.rows / max(self.seconds, 1e-9)


def import_table(draft: Draft, path: str, name: str) -> int:
    """Put a table's rows into a draft; how many. An empty table is passed over and leaves no schema."""
    table = sqlite.describe(path, name)
    rows = sqlite.read_table(draft.repo.spark, path, name)
    n = rows.count()
    if n:
        lead = ("INTEGER",) if table.schema().names[0] == "rowid" and "rowid" not in table.columns else ()
        draft.create_table(name, table.schema(), table.primary_key, (*lead, *table.types))
        draft.replace_rows(name, rows)
    return n


def import_database(repo: Repository, path: str, tables: Sequence[str] | None = None, *, merge: bool = False, message: str | None = None, author: str = "", progress: Callable[[Progress], None] | None = None) -> tuple[str, dict[str, int]]:
    """Commit a SQLite file's tables; (commit, rows by table).

    The snapshot holds the imported tables only, so others vanish from it; with ``merge`` they stay.
    Unknown names in ``tables`` are warned of. ``progress`` is told of every table read, and of the
    commit, which cuts and writes them all, as a table without name.
    """
    there = sqlite.table_names(path)
    if tables and (unknown := [t for t in tables if t not in there]):
        warnings.warn(f"no such tables in {path}: {', '.join(unknown)}", stacklevel=2)
    wanted = [t for t in there if not tables or t in tables]
    draft = repo.draft(empty=not merge)
    counts, begun = {}, time.monotonic()

    def tell(table: str, n: int, since: float) -> None:
        if progress:
            now = time.monotonic()
            progress(Progress(table, n, now - since, sum(counts.values()), now - begun))

    for t in wanted:
        since = time.monotonic()
        counts[t] = import_table(draft, path, t)
        tell(t, counts[t], since)
    since = time.monotonic()
    default = f"Import tables {', '.join(wanted)} from {Path(path).name}" if tables else f"Import from {Path(path).name}"
    made = draft.commit(message or default, author)
    tell("", sum(counts.values()), since)
    return made, counts


def sorted_problems(repo: Repository, table: str, ref: str = "HEAD", limit: int = 5) -> list[tuple[str, str, str | None]]:
    """The first problems of a table's order: keys that occur twice, and leaves that don't begin above the one before; (key, problem, key before)."""
    snap = repo.snapshot(ref)
    twice = validate.duplicates(snap.keyed(table), ["_key"], limit).select("_key", F.lit("duplicate").alias("problem"), F.col("_key").alias("previous"))
    leaves = snap.leaves(table)
    after = leaves.select((F.col("ord") + 1).alias("ord"), F.col("last_key").alias("previous"))
    across = leaves.join(after, "ord").where(F.col("first_key") <= F.col("previous")).select(F.col("first_key").alias("_key"), F.lit("out of order").alias("problem"), "previous")
    return [tuple(r) for r in twice.unionByName(across).orderBy("_key", "problem").limit(limit).collect()]
