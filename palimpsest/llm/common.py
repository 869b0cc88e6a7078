"""Helpers shared by the training-data operators: staged tables, Arrow plumbing, tokenizer."""

from __future__ import annotations

import atexit
import ctypes
import json
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CHECKPOINT_CONF = "spark.checkpoint.dir"
_staged: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    A cluster names it in ``spark.checkpoint.dir``. Only where that is unset and the session runs on
    this machine alone (tests), a temporary folder is made and set for the session.
    """
    found = spark.conf.get(CHECKPOINT_CONF, None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="palimpsest-")
        spark.conf.set(CHECKPOINT_CONF, found)
    return found.rstrip("/")


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    This cuts the lineage: a lost executor costs the tasks that read the table, not what made it.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _staged.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


@atexit.register
def sweep() -> None:
    """Delete the staged tables of this process; results that read them must be written before."""
    while _staged:
        spark, path = _staged.pop()
        try:
            jvm = spark.sparkContext._jvm
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # noqa: BLE001  the session is gone: whoever owns the folder clears it
            return


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def only(df: DataFrame, **columns: str | Column) -> DataFrame:
    """Just these columns under these names, so that no other column of ``df`` can clash."""
    return df.select(*[(F.col(f"`{c}`") if isinstance(c, str) else c).alias(name) for name, c in columns.items()])


def unused(df: DataFrame, name: str) -> str:
    """``name``, or with underscores behind it, so that no column of ``df`` has it in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def release() -> None:
    """Give freed memory back to the system: a Python worker outlives its tasks, and later stages need the room."""
    pa.default_memory_pool().release_unused()
    if trim := _trim():
        trim(0)


@lru_cache(1)
def _trim() -> Callable[[int], int] | None:
    try:
        return ctypes.CDLL(None).malloc_trim
    except (AttributeError, OSError):  # another C library
        return None


def map_rows(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]]], schema: T.StructType) -> DataFrame:
    """mapInArrow with a set-up step per task: ``make()`` returns the function of a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = None
        for batch in batches:
            if batch.num_rows:
                step = step or make()
                yield from step(batch)
                release()

    return df.mapInArrow(run, schema)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column end to end, and the n + 1 offsets of its rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("").cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or at[-1] == at[0]:
        return np.zeros(0, np.uint8), np.zeros(len(at), np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words whose output bits depend on all input bits (splitmix64's finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _special(path: str) -> list[str]:
    """The special tokens of a tokenizer file; its vocabulary is not read."""
    with open(path, encoding="utf-8") as f:
        text = f.read()
    at = text.find('"added_tokens"')
    return [x["content"] for x in json.JSONDecoder().raw_decode(text[text.index("[", at) :])[0]] if at >= 0 else []


@lru_cache(1)
def encoder(path: str) -> Callable[[str], list[int]]:
    """Text to ids as the Hugging Face tokenizer file at ``path`` gives them, without special tokens added.

    Where the byte-level BPE ranks of the same vocabulary lie beside the file (``.tiktoken``), the
    faster implementation does the work; it yields the same ids (tests hold both against each
    other). Texts that spell a special token go to the tokenizer file itself. A worker builds it once.
    """
    import base64
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    ranks_path = path.removesuffix(".json") + ".tiktoken"
    if not os.path.exists(ranks_path):
        plain = Tokenizer.from_file(path)
        return lambda text: plain.encode(text, add_special_tokens=False).ids
    import public_tokenizers
    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    special = _special(path)
    slow: list[Tokenizer] = []

    def encode(text: str) -> list[int]:
        if any(s in text for s in special):
            if not slow:
                slow.append(Tokenizer.from_file(path))
            return slow[0].encode(text, add_special_tokens=False).ids
        return fast.encode_ordinary(text)

    return encode


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
