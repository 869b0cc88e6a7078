"""Content hashes and the boundary predicate of content-defined chunks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Hex digits of a node's hash: 16 bytes of SHA-256.
NODE_DIGITS = 32


def boundary_hash(key: Column, seed: int) -> Column:
    """The first 32 bits of SHA-256 over the seed (4 bytes, big-endian) and the key, as a long."""
    digest = F.sha2(F.concat(F.unhex(F.lit(f"{seed & 0xFFFFFFFF:08x}")), key.cast("binary")), 256)
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")


def entry_digest(key: Column, value: Column) -> Column:
    """SHA-256 of an entry with both lengths spelled out, so that no two entries share a text; a null value differs from an empty one."""
    size = lambda c: F.octet_length(c).cast("string")
    return F.sha2(F.concat(size(key), F.lit(":"), key.cast("string"), F.coalesce(F.concat(size(value), F.lit(":"), value.cast("string")), F.lit("-"))), 256)


def node_hash(parts: Column) -> Column:
    """Hash of a node from its ordered array of parts."""
    return F.substring(F.sha2(F.array_join(parts, "|"), 256), 1, NODE_DIGITS)
