"""A batch applied to a chunked table: only the leaves that it touches are read and cut again.

A leaf begins behind a cut, and where it ends hangs on nothing before that. So the touched leaves,
each with some untouched ones behind it as guards, are cut as one short table: if the last guard of
every run of neighbours comes out as it was, every run begins and ends at a cut, and all other
leaves stay. Runs whose last guard changed get more guards. The leaves are those of the whole
table cut anew.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.operators import chunking
from palimpsest.sources.staging import cut

#: Runs are numbers on the driver. A batch that touches more leaves, or more than this share of them, has the whole
#: table cut: the same leaves, and cheaper then.
MOST_LEAVES, MOST_SHARE = 200_000, 0.2
#: Untouched leaves behind a touched one at first, and how they grow.
GUARDS, GROWTH = 1, 4


def _nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a sorted partition of keys (ord null) and leaves' last keys: the leaves that keys came before, and in the last row its first leaf and whether keys came behind its last."""
    names = ["part", "ord", "first", "open"]
    part, first, waiting = TaskContext.get().partitionId(), None, False
    for batch in batches:
        ords = batch.column(batch.schema.names.index("ord")).fill_null(-1).to_numpy(zero_copy_only=False)
        if not len(ords):
            continue
        at = np.flatnonzero(ords >= 0)
        hit = np.diff(at, prepend=-1) > 1
        if len(at):
            hit[0] |= waiting
            first = int(ords[at[0]]) if first is None else first
        waiting = not len(at) or int(at[-1]) < len(ords) - 1
        found = ords[at[hit]]
        n = len(found)
        yield pa.RecordBatch.from_arrays([pa.array([part] * n, pa.int32()), pa.array(found, pa.int64()), pa.nulls(n, pa.int64()), pa.array([False] * n, pa.bool_())], names=names)
    yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.nulls(1, pa.int64()), pa.array([first], pa.int64()), pa.array([bool(waiting)], pa.bool_())], names=names)


def touched(leaves: DataFrame, wanted: DataFrame, n: int) -> np.ndarray | None:
    """Numbers of the leaves that the keys fall to: the first that doesn't end before the key, or else the last of the ``n``. None if there are too many.

    Keys and bounds are shuffled once, by ranges; of the answer, a row a partition and the numbers go to the driver.
    """
    both = wanted.select("_key", F.lit(None).cast("long").alias("ord")).unionByName(leaves.select(F.col("last_key").alias("_key"), "ord"))
    found = cut(both.repartitionByRange("_key").sortWithinPartitions("_key", "ord").mapInArrow(_nearest, "part int, ord long, first long, open boolean"))
    if found.count() > MOST_LEAVES:
        return None
    ords = {r["ord"] for r in found.where("ord is not null").collect()}
    after = n - 1
    for r in sorted(found.where("ord is null").collect(), key=lambda r: -r["part"]):
        if r["open"]:
            ords.add(after)
        after = after if r["first"] is None else r["first"]
    return np.array(sorted(ords), np.int64)


def runs(ords: np.ndarray, guards: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last leaf of every run of touched leaves and their guards."""
    upto = np.maximum.accumulate(np.minimum(ords + guards, n - 1))
    new = np.append(True, ords[1:] > upto[:-1])
    return ords[new], upto[np.append(new[1:], True)]


def _shifted(places: np.ndarray, by: np.ndarray) -> Callable[[str], Column]:
    """A number plus that of ``by`` for how many of the places are not above it."""

    @F.pandas_udf("long")
    def shift(ords: pd.Series) -> pd.Series:
        return ords + by[np.searchsorted(places, ords.to_numpy(), "right")]

    return shift


def apply(leaves: DataFrame, wanted: DataFrame, changed: Callable[[DataFrame], DataFrame], spec: chunking.Spec, salt: str, measure: chunking.Measure, size: int) -> tuple[DataFrame, chunking.Chunked]:
    """The leaves of a table after a batch that changes the ``wanted`` keys, and the chunks cut anew (numbered among themselves).

    ``changed`` gives the rows (with _key) that such leaves hold after the batch, whose own entries have about ``size`` bytes.
    """
    spark = leaves.sparkSession

    def cut_again(some: DataFrame) -> chunking.Chunked:
        held = some.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0]
        return chunking.chunk(changed(some), spec, salt, measure, held + size)

    n = leaves.count()
    ords = touched(leaves, wanted, n) if n else None
    if ords is not None and not len(ords):
        return leaves, chunking.chunk(changed(leaves.limit(0)), spec, salt, measure, size)
    guards = None if ords is None else np.full(len(ords), GUARDS)
    while guards is not None:
        starts, ends = runs(ords, guards, n)
        if int((ends - starts + 1).sum()) > min(MOST_LEAVES, MOST_SHARE * n):
            break
        inside = F.broadcast(spark.createDataFrame(pd.DataFrame({"a": starts, "b": ends}), "a long, b long").select(F.explode(F.sequence("a", "b")).alias("ord")))
        made = cut_again(leaves.join(inside, "ord", "left_semi"))
        if made.wrong:
            return leaves, made
        last = F.broadcast(spark.createDataFrame(pd.DataFrame({"ord": ends}), "ord long"))
        same = leaves.join(last, "ord").select("leaf_hash", F.col("ord").alias("old")).join(made.leaves.select("leaf_hash", "ord"), "leaf_hash")
        kept = {r["old"]: r["ord"] for r in same.collect()}
        lost = np.array([e != n - 1 and int(e) not in kept for e in ends])
        if not lost.any():
            total = made.leaves.count()
            # a run's last new chunk is its last guard; that of the table's end is the last of all
            to = np.array([total - 1 if e == n - 1 else kept[int(e)] for e in ends], np.int64)
            old = ends - starts + 1
            new = np.diff(to, prepend=-1)
            stay = leaves.join(inside, "ord", "left_anti").withColumn("ord", _shifted(starts, np.append(0, np.cumsum(new - old)))("ord"))
            fresh = made.leaves.withColumn("ord", _shifted(to[:-1] + 1, starts - np.append(0, np.cumsum(old)[:-1]))("ord"))
            return cut(stay.select(made.leaves.columns).unionByName(fresh)), made
        run = np.searchsorted(starts, ords, "right") - 1
        guards = np.where(lost[run], guards * GROWTH, guards)
    made = cut_again(leaves)
    return made.leaves, made
