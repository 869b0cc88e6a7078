"""Content-defined chunks of a key-ordered table, cut in parallel and yet exactly as one scan would cut.

Going through the entries in key order, a chunk ends behind an entry whose boundary hash is under a
threshold that doubles with every ``target`` bytes since the last cut; never under ``least``, always
at ``most`` bytes. So equal content gives equal chunks, whatever its history, and a small change
moves few boundaries.

A cut depends on the bytes since the one before, so a range partition must know the bytes its
predecessor leaves over. The rows are shuffled once, by ranges of keys; every sorted partition is cut
as if it began a chunk, and written with its chunks' numbers and hashes. As the count starts anew at
every cut, what a predecessor leaves over changes a few chunks at a partition's start at most: only
these are cut again, up to the first cut that both ways share, and only the chunks there and across
partitions are hashed again.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.functions import hashes
from palimpsest.sources.staging import cut

#: Bytes of entries that one task folds at most, and what is worth a task of its own while cores are idle.
PARTITION_BYTES, WORTHWHILE_BYTES = 64 << 20, 1 << 20
#: A row a partition goes to the driver and back to all tasks, so partitions grow beyond this many. They are read as streams.
MOST_PARTITIONS = 50_000
#: Text of entries against what the optimizer takes their rows for; only tasks' sizes hang on it.
EXPANSION = 4
#: An estimate beyond this is none: the entries are measured instead.
NO_ESTIMATE = 1 << 46
#: Chunks of a partition's start that are looked at first for a shared cut.
LOOK = 8
#: Up to so many nodes a level is folded on the driver; beyond, like the entries.
DRIVER_NODES = 200_000
CHILD_HASH_BYTES = 16


@dataclass(frozen=True)
class Spec:
    """Chunk sizes in bytes, the share of keys that may end a chunk, and the seed of their hash."""

    pattern: float = 0.01
    seed: int = 42
    least: int = 4096
    target: int = 65536
    most: int = 262144


def cuts(sizes: np.ndarray, marks: np.ndarray, spec: Spec, carried: int = 0) -> tuple[np.ndarray, int]:
    """Places of entries that end a chunk, and the bytes left over; ``carried`` bytes came before."""
    upto = np.cumsum(sizes, dtype=np.int64)
    n, out, origin = len(sizes), [], -carried
    base, cap = float(int(spec.pattern * 2**32)), float(2**31)
    while True:
        i, forced = int(np.searchsorted(upto, origin + spec.least)), int(np.searchsorted(upto, origin + spec.most))
        found = -1
        while i < min(forced, n) and found < 0:
            j = min(i + 256, forced, n)
            threshold = np.floor(np.minimum(base * np.exp2((upto[i:j] - origin) / spec.target), cap))
            hit = np.flatnonzero(marks[i:j] < threshold)
            if len(hit):
                found = i + int(hit[0])
            i = j
        if found < 0:
            if forced >= n:
                return np.array(out, np.int64), int(upto[-1] - origin) if n else carried
            found = forced
        out.append(found)
        origin = int(upto[found])


@dataclass
class Chunked:
    """A table in chunks: ``rows`` (the table's columns, _key, _ord), and ``leaves`` (ord, leaf_hash, first_key, last_key, n_entries, n_bytes)."""

    rows: DataFrame
    leaves: DataFrame
    #: A key that is null or occurs twice, if there is any: then the chunks mean nothing.
    wrong: tuple[str | None] | None


Measure = Callable[[DataFrame], DataFrame]
DIGEST = 64


def _fold(spec: Spec, salt: str, kept: list[str]):
    """A sorted partition to its rows with _cut (number of the chunk, as if the partition began one), _leaf (at the end of a chunk, its hash) and _bad."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, number, digest, last = 0, 0, hashlib.sha256(f"{salt}|".encode()), None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            names = batch.schema.names
            column = {c: batch.column(names.index(c)) for c in names}
            places, held = cuts(column["_size"].to_numpy(zero_copy_only=False), column["_mark"].to_numpy(zero_copy_only=False), spec, held)
            hexes = "".join(column["_digest"].to_pylist()).encode()
            marks = np.zeros(n, np.int64)
            leaf: list[str | None] = [None] * n
            at = 0
            for place in places.tolist():
                digest.update(hexes[at * DIGEST : (place + 1) * DIGEST])
                leaf[place] = digest.hexdigest()[: hashes.NODE_DIGITS]
                digest, at = hashlib.sha256(f"{salt}|".encode()), place + 1
                if at < n:
                    marks[at] = 1
            digest.update(hexes[at * DIGEST :])
            keys = column["_key"].to_pylist()
            bad = [k is None or k == p for k, p in zip(keys, [last, *keys[:-1]], strict=True)]
            last = keys[-1]
            out = [batch.column(names.index(c)) for c in kept]
            yield pa.RecordBatch.from_arrays([*out, pa.array(number + np.cumsum(marks)), pa.array(leaf, pa.string()), pa.array(bad)], names=[*kept, "_cut", "_leaf", "_bad"])
            number += int(marks.sum()) + (at == n and len(places) > 0)

    return run


def _refold(spec: Spec, carried: dict[int, int], whole: dict[int, int], look: dict[int, int]):
    """The start of a partition cut again behind ``carried`` bytes: the new cuts before the first that was one before, and the chunk which that ends."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("_pos", ignore_index=True)
        part = int(rows["_part"].iloc[0])
        new, tail = cuts(rows["_size"].to_numpy(np.int64), rows["_mark"].to_numpy(np.int64), spec, carried[part])
        number = rows["_cut"].to_numpy(np.int64)
        ends = np.append(number[1:] != number[:-1], number[-1] < whole[part]) if len(number) else np.zeros(0, bool)
        shared = np.flatnonzero(ends[new])
        if len(shared):
            upto = int(new[shared[0]])
            found = ([int(x) for x in rows["_pos"].to_numpy()[new[: shared[0]]]], int(number[upto]), -1, True)
        else:
            # without a shared cut every chunk is new
            found = ([int(x) for x in rows["_pos"].to_numpy()[new]], whole[part], int(tail), look[part] > whole[part])
        return pd.DataFrame([(part, *found)], columns=["part", "places", "shared", "tail", "done"])

    return run


def estimate(rows: DataFrame) -> int:
    """Bytes of entries, by the optimizer's statistics."""
    return int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) * EXPANSION


def _partitions(rows: DataFrame, measure: Measure, size: int | None) -> int:
    """How many range partitions: chunks don't depend on it."""
    guess = estimate(rows) if size is None else size
    if guess > NO_ESTIMATE:
        guess = measure(rows).agg(F.coalesce(F.sum("_size"), F.lit(0))).first()[0]
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return min(MOST_PARTITIONS, max(1, -(-guess // PARTITION_BYTES), min(cores, guess // WORTHWHILE_BYTES)))


def hash_leaves(rows: DataFrame, salt: str) -> DataFrame:
    """(ord, leaf_hash, first_key, last_key, n_entries, n_bytes) of rows with _ord, _key, _size and _digest."""
    parts = F.transform(F.sort_array(F.collect_list(F.struct("_key", "_digest"))), lambda e: e["_digest"])
    return rows.groupBy(F.col("_ord").alias("ord")).agg(
        F.substring(F.sha2(F.concat(F.lit(f"{salt}|"), F.array_join(parts, "")), 256), 1, hashes.NODE_DIGITS).alias("leaf_hash"),
        F.min("_key").alias("first_key"), F.max("_key").alias("last_key"), F.count("*").alias("n_entries"), F.sum("_size").alias("n_bytes"),
    )


def chunk(rows: DataFrame, spec: Spec, salt: str, measure: Measure, size: int | None = None) -> Chunked:
    """Cut ``rows`` (with _key) into chunks. ``measure`` adds _size, _mark and _digest, from the other columns alone. ``size``: bytes of entries, where they are known.

    One shuffle of the rows, by ranges of their keys; they are written once, as range bounds are
    sampled anew at each evaluation. The tables last as long as the scope they are cut in.
    """
    names = rows.columns
    kept = [*names, "_size"]
    schema = T.StructType([*rows.schema.fields, T.StructField("_size", T.LongType()), T.StructField("_cut", T.LongType()), T.StructField("_leaf", T.StringType()), T.StructField("_bad", T.BooleanType())])
    ranged = measure(rows.repartitionByRange(_partitions(rows, measure, size), "_key")).select(*names, "_size", "_mark", "_digest").sortWithinPartitions("_key")
    placed = cut(ranged.mapInArrow(_fold(spec, salt, kept), schema).withColumn("_part", F.spark_partition_id()).withColumn("_pos", F.monotonically_increasing_id()))
    local = cut(placed.groupBy("_part", "_cut").agg(F.count("*").alias("n_entries"), F.sum("_size").alias("n_bytes"), F.min("_key").alias("first_key"), F.max("_key").alias("last_key"), F.max("_leaf").alias("leaf_hash"), F.max(F.when(F.col("_bad"), F.struct("_key"))).alias("wrong")))
    # of every partition: complete chunks, and the bytes behind the last of them
    ends = {r["_part"]: (r["n"], r["tail"], r["wrong"]) for r in local.groupBy("_part").agg(F.count("leaf_hash").alias("n"), F.coalesce(F.sum(F.when(F.col("leaf_hash").isNull(), F.col("n_bytes"))), F.lit(0)).alias("tail"), F.max("wrong").alias("wrong")).collect()}
    parts = sorted(ends)
    wrong = next((tuple(ends[p][2]) for p in parts if ends[p][2] is not None), None)

    again: dict[int, tuple[int, list[int], int, int]] = {}  # of a start cut again: bytes before it, new cuts, chunk that a shared cut ends, bytes left over if there is none
    carried: dict[int, int] = {}
    look: dict[int, int] = {}
    while wrong is None:
        left, stale = 0, []
        for p in parts:
            carried[p] = left
            if not left:
                left = ends[p][1]
            elif p in again and again[p][0] == left:
                left = ends[p][1] if again[p][3] < 0 else again[p][3]
            else:
                stale.append(p)
                left = ends[p][1] + (0 if ends[p][0] else left)
        if not stale:
            break
        asked = {p: look.setdefault(p, LOOK) for p in stale}
        window = F.coalesce(*[F.when(F.col("_part").isin([p for p in stale if asked[p] == k]), k) for k in sorted(set(asked.values()))])
        starts = measure(placed.where(F.col("_cut") < window).select(*names, "_part", "_pos", "_cut")).select("_part", "_pos", "_cut", "_size", "_mark")
        for r in starts.groupBy("_part").applyInPandas(_refold(spec, {p: carried[p] for p in stale}, {p: ends[p][0] for p in stale}, asked), "part int, places array<long>, shared long, tail long, done boolean").collect():
            if r["done"]:
                again[r["part"]] = (carried[r["part"]], list(r["places"]), r["shared"], r["tail"])
            else:
                look[r["part"]] *= 8

    # the number of a row's chunk: those before its partition, new ones of its start, and those behind the shared cut
    fixes, before = [], 0
    for p in parts:
        n = ends[p][0]
        _, places, shared, tail = again[p] if carried.get(p) else (0, [], 0, -1)
        fixes.append((p, before, places, shared, bool(carried.get(p)), n))
        before += len(places) + (n - shared if tail < 0 else 0)
    fix = rows.sparkSession.createDataFrame(fixes, "_part int, _base long, _places array<long>, _shared long, _moved boolean, _n long")
    if sum(len(f[2]) for f in fixes) <= 4 * MOST_PARTITIONS:
        fix = F.broadcast(fix)
    number = F.col("_base") + F.when(F.col("_cut") > F.col("_shared"), F.size("_places") + F.col("_cut") - F.col("_shared")).otherwise(F.size(F.filter("_places", lambda x: x < F.col("_pos"))))
    numbered = placed.join(fix, "_part").withColumn("_ord", number.cast("long"))
    # whole chunks inside a partition keep their hashes
    whole = local.join(fix, "_part").where((F.col("_cut") < F.col("_n")) & (~F.col("_moved") | (F.col("_cut") > F.col("_shared"))))
    whole = whole.select((F.col("_base") + F.when(F.col("_cut") > F.col("_shared"), F.size("_places") + F.col("_cut") - F.col("_shared")).otherwise(0)).cast("long").alias("ord"), "leaf_hash", "first_key", "last_key", "n_entries", "n_bytes")
    rest = numbered.where((F.col("_cut") >= F.col("_n")) | (F.col("_moved") & (F.col("_cut") <= F.col("_shared")))).select(*names, "_ord")
    leaves = cut(whole.unionByName(hash_leaves(measure(rest), salt)))
    return Chunked(numbered.select(*names, "_ord"), leaves, wrong)


def _mark(key: str, seed: int) -> int:
    return int.from_bytes(hashlib.sha256((seed & 0xFFFFFFFF).to_bytes(4) + key.encode()).digest()[:4])


def node_hash(parts: list[str]) -> str:
    return hashlib.sha256("|".join(parts).encode()).hexdigest()[: hashes.NODE_DIGITS]


EDGES = "parent_hash string, ord long, child_hash string, separator string, level int"


def _children(seed: int) -> Measure:
    """A child counts as an entry: its first key and its hash."""
    return lambda rows: rows.select("*", (F.octet_length("_key") + CHILD_HASH_BYTES).cast("long").alias("_size"), hashes.boundary_hash(F.col("_key"), seed).alias("_mark"), F.sha2(F.concat("child_hash", F.lit(":"), "_key"), 256).alias("_digest"))


def tree(spark: SparkSession, level: DataFrame, spec: Spec, empty: str) -> tuple[str, DataFrame]:
    """Root hash and edges over (ord, leaf_hash, first_key): internal levels are cut like the entries, each child counting as its hash and first key.

    Levels of over ``DRIVER_NODES`` nodes are cut like a table; both ways give the same nodes.
    """
    edges = spark.createDataFrame([], EDGES)
    depth = 1
    n = level.count()
    while n > DRIVER_NODES:
        made = chunk(level.select(F.col("first_key").alias("_key"), F.col("leaf_hash").alias("child_hash")), spec, f"level {depth}", _children(spec.seed))
        up = made.leaves
        if (above := up.count()) >= n:  # keys so long that each would be a node of its own: the tree is closed below
            break
        place = F.row_number().over(Window.partitionBy("_ord").orderBy("_key")) - 1
        named = made.rows.join(up.select(F.col("ord").alias("_ord"), F.col("leaf_hash").alias("parent_hash")), "_ord").withColumn("ord", place.cast("long"))
        edges = edges.unionByName(named.select("parent_hash", "ord", "child_hash", F.when(F.col("ord") > 0, F.col("_key")).alias("separator"), F.lit(depth).alias("level")))
        level, n, depth = up, above, depth + 1
    nodes = [(r["leaf_hash"], r["first_key"]) for r in level.orderBy("ord").select("leaf_hash", "first_key").toLocalIterator()]
    rows = []
    while len(nodes) > 1:
        sizes = np.array([len(k.encode()) + CHILD_HASH_BYTES for _, k in nodes], np.int64)
        places, _ = cuts(sizes, np.array([_mark(k, spec.seed) for _, k in nodes], np.int64), spec)
        bounds = [0, *[int(p) + 1 for p in places]]
        bounds += [len(nodes)] if bounds[-1] != len(nodes) else []
        if len(bounds) > len(nodes):  # keys so long that each would be a node of its own: close the tree
            bounds = [0, len(nodes)]
        above = []
        for s, e in zip(bounds, bounds[1:], strict=False):
            digests = "".join(hashlib.sha256(f"{h}:{k}".encode()).hexdigest() for h, k in nodes[s:e])
            name = hashlib.sha256(f"level {depth}|{digests}".encode()).hexdigest()[: hashes.NODE_DIGITS]
            rows += [(name, i, h, k if i else None, depth) for i, (h, k) in enumerate(nodes[s:e])]
            above.append((name, nodes[s][1]))
        nodes, depth = above, depth + 1
    if rows:
        edges = edges.unionByName(spark.createDataFrame(rows, EDGES))
    return (nodes[0][0] if nodes else empty), edges
