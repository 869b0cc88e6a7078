"""Versioned tables on Spark."""

from palimpsest.operators.chunking import Spec
from palimpsest.operators.diff import DatabaseDiff, TableDiff, db_diff, kv_diff, row_diff, table_diff
from palimpsest.session import session
from palimpsest.sources.commits import Commit, CommitStore, RefConflict
from palimpsest.sources.imports import import_database, import_table
from palimpsest.sources.remotes import Remote
from palimpsest.sources.repository import Draft, Repository, Snapshot, TableInfo

__all__ = [
    "Commit", "CommitStore", "DatabaseDiff", "Draft", "RefConflict", "Remote", "Repository", "Snapshot", "Spec", "TableDiff", "TableInfo",
    "db_diff", "import_database", "import_table", "kv_diff", "row_diff", "session", "table_diff",
]
