"""Scans of key-ordered snapshots; sorting happens only where a result is shown."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def prefix(entries: DataFrame, start: str, key: str = "key") -> DataFrame:
    """Entries whose key starts so; the filter is pushed into the Parquet scan."""
    return entries.where(F.col(key).startswith(start)) if start else entries


def seek(entries: DataFrame, target: str, key: str = "key") -> DataFrame:
    """Entries from the first key that is not below the target on."""
    return entries.where(F.col(key) >= F.lit(target))


def point(entries: DataFrame, wanted: str, key: str = "key") -> DataFrame:
    return entries.where(F.col(key) == F.lit(wanted))


def ordered(entries: DataFrame, key: str = "key", limit: int | None = None) -> DataFrame:
    out = entries.orderBy(key)
    return out if limit is None else out.limit(limit)
