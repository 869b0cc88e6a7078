"""Other repositories to push to and pull from, and stores by name.

A remote is a path that Hadoop's file systems reach; credentials belong into their configuration and
are refused here::

    [remotes.origin]
    type = "file"        # or "hadoop", for any URL
    path = "/srv/warehouse"

    [remotes.backup]
    type = "s3"          # s3a://tables/shop, with Hadoop's credentials for the bucket
    bucket = "tables"
    prefix = "shop"      # may be left out
"""

from __future__ import annotations

import tempfile
import tomllib
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import SparkSession

from palimpsest.sources.files import CachedFiles, Files
from palimpsest.sources.repository import Repository


@dataclass(frozen=True)
class Remote:
    name: str
    type: str
    path: str

    def open(self, spark: SparkSession) -> Repository:
        """The repository there; its folders appear with the first push."""
        return Repository(spark, self.path)


def load(text: str) -> dict[str, Remote]:
    found = tomllib.loads(text).get("remotes", {})
    out = {}
    for name, spec in found.items():
        if secret := [k for k in spec if "secret" in k or "access_key" in k]:
            raise ValueError(f"remote {name!r}: {', '.join(secret)} must not be stored here")
        kind = spec.get("type")
        if kind not in ("file", "hadoop", "s3"):
            raise ValueError(f"remote {name!r}: type must be file, hadoop or s3, not {kind!r}")
        if not spec.get("bucket" if kind == "s3" else "path"):
            raise ValueError(f"remote {name!r}: {'bucket' if kind == 's3' else 'path'} is missing")
        path = "/".join(p.strip("/") for p in ("s3a://" + spec["bucket"], spec.get("prefix", "")) if p.strip("/")) if kind == "s3" else spec["path"]
        out[name] = Remote(name, kind, path)
    return out


def load_file(path: str) -> dict[str, Remote]:
    return load(Path(path).read_text())


def path_of(spec: str) -> str:
    """The path of a store's name: ``:memory:`` (a temporary folder of this machine), ``file://...``, ``cached-file://...``, ``s3a://...`` and other URLs with a Hadoop file system.

    Rows of a cached store are Parquet files, which the operating system's page cache holds; ``files_of`` keeps the texts of its commits.
    """
    if spec == ":memory:":
        return "file://" + tempfile.mkdtemp(prefix="palimpsest-")
    if spec.startswith("cached-file://"):
        return "file://" + spec.removeprefix("cached-file://")
    if "://" in spec:
        return spec
    raise ValueError(f"not a store: {spec!r}")


def files_of(spark: SparkSession, spec: str) -> Files:
    if spec == ":memory:" and not spark.sparkContext.master.startswith("local"):
        raise ValueError(":memory: is a folder of this machine, which executors of a cluster don't see")
    return (CachedFiles if spec.startswith("cached-file://") else Files)(spark, path_of(spec))
