"""Tables written to the shared folder to cut lineage, and deleted once what was made of them is written."""

from __future__ import annotations

import atexit
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

CONF = "spark.checkpoint.dir"
_scopes = threading.local()
_unscoped: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names; a temporary one only where none is set and the session runs on this machine alone."""
    found = spark.conf.get(CONF, None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(f"set {CONF} to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="palimpsest-")
        spark.conf.set(CONF, found)
    return found.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables cut inside are deleted at the end: what is read from them must be written or collected by then."""
    stack = _scopes.__dict__.setdefault("stack", [])
    stack.append([])
    try:
        yield
    finally:
        for path in stack.pop():
            _delete(spark, path)


@atexit.register
def sweep() -> None:
    """Delete the tables of this process that were cut outside of any scope."""
    while _unscoped:
        spark, path = _unscoped.pop()
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001  the session is gone: whoever owns the folder clears it
            return


def cut(df: DataFrame) -> DataFrame:
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    stack = _scopes.__dict__.get("stack")
    if stack:
        stack[-1].append(path)
    else:
        _unscoped.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)
