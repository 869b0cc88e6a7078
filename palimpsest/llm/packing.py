"""Best-fit packing with certified bin counts.

Documents become token pieces of at most ``capacity``; pieces are dealt to partitions of bounded
size and packed best-fit decreasing. Dual-feasible functions give each partition a lower bound on
its number of sequences. Where partitions stay above their bounds, the documents of their unfilled
sequences are poured together: a cohort's into one new partition, which packs them anew. A cohort
keeps the outcome if it needs fewer sequences, and this is repeated until none does. Every
partition's count and bound are those of the documents it holds in the end.

Null and empty texts are one piece of one token (the end token). Documents that repeat are packed
as often as they occur. An empty table gives an empty result. A long text is encoded as a whole, in a
slice of its own; slices are bounded by bytes, and so is what a task holds. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.llm import common, shingles

CAPACITY = 1024
END_TOKEN = 2
#: Pieces that one task packs: a task holds so many rows of some 50 bytes.
PIECES_PER_PARTITION = 32_768


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces; of a longer document only the first piece may be shorter."""
    if n <= capacity:
        return [(0, n)]
    head = n % capacity
    return ([(0, head)] if head else []) + [(s, capacity) for s in range(head, n, capacity)]


def pieces(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, capacity: int = CAPACITY, end_token: int = END_TOKEN, keep_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, and ids (array of int) with ``keep_ids``."""
    path = tokenizer or common.default_tokenizer()
    src = common.only(docs, doc_id=id_col, text=text_col)
    fields = [T.StructField("doc_id", src.schema["doc_id"].dataType), T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType())]
    fields += [T.StructField("ids", T.ArrayType(T.IntegerType()))] if keep_ids else []

    def make() -> Callable:
        encode = common.encoder(path)

        def cut_up(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows, piece, start, length, crc, kept = [], [], [], [], [], []
            for i, text in enumerate(batch.column(1)):
                ids = encode(text.as_py() or "")
                ids.append(end_token)
                arr = np.array(ids, "<u4")
                for k, (s, n) in enumerate(cut(len(arr), capacity)):
                    rows.append(i)
                    piece.append(k)
                    start.append(s)
                    length.append(n)
                    crc.append(zlib.crc32(arr[s : s + n]))
                    if keep_ids:
                        kept.append(arr[s : s + n].astype(np.int32))
            columns = [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            columns += [pa.array(kept, pa.list_(pa.int32()))] if keep_ids else []
            return pa.RecordBatch.from_arrays(columns, names=[f.name for f in fields])

        def step(batch: pa.RecordBatch):
            for part in shingles.slices(batch, (1,)):
                yield cut_up(part)

        return step

    return common.map_rows(src, make, T.StructType(fields))


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item. Items come in decreasing length, ties in given order; each goes to the fullest bin with room.

    Bit r of ``room`` tells that some bin has r places left, so that the best fit is the lowest set bit from the item's length on.
    """
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    free: list[list[int]] = [[] for _ in range(capacity + 1)]
    room = count = 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        if fits := room >> n:
            left = n + (fits & -fits).bit_length() - 1
            b = free[left].pop()
            if not free[left]:
                room ^= 1 << left
        else:
            left, b, count = capacity, count, count + 1
        bins[i], offsets[i] = b, capacity - left
        if rest := left - n:
            free[rest].append(b)
            room |= 1 << rest
    return bins, offsets


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """No packing needs fewer bins: the largest of the bounds that two families of dual-feasible functions give.

    Cut-off functions: over capacity - t counts as a whole bin, under t as nothing.
    Rounding functions u(k): x stays where (k + 1) x / capacity is whole, else it becomes floor((k + 1) x / capacity) / k bins.
    """
    if not len(lengths):
        return 0
    count = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
    size = np.arange(capacity + 1, dtype=np.int64)
    best = 0
    for t in range(capacity // 2 + 1):
        kept = np.where(size > capacity - t, capacity, np.where(size < t, 0, size))
        best = max(best, -(-int(count @ kept) // capacity))
    for k in range(1, 64):
        scaled = (k + 1) * size
        value = np.where(scaled % capacity == 0, k * size, scaled // capacity * capacity)
        best = max(best, -(-int(count @ value) // (k * capacity)))
    return best


_PACKED = "part long, row long, length long, bin long, offset long, fill long, bins long, bound long"


def _packer(capacity: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "row"], ascending=[False, True], kind="stable", ignore_index=True)
        lengths = rows["length"].to_numpy(np.int64)
        bins, offsets = best_fit_decreasing(lengths, capacity)
        fill = np.bincount(bins, weights=lengths).astype(np.int64)
        return rows[["part", "row", "length"]].assign(bin=bins, offset=offsets, fill=fill[bins], bins=len(fill), bound=lower_bound(lengths, capacity))

    return pack


def cohorts(loose: list[tuple[int, int]], most: int) -> dict[int, int]:
    """Cohort of each (partition, documents of its unfilled sequences): two partitions at least, and as many as hold ``most`` documents together."""
    groups: list[list[int]] = []
    held = most
    for part, n in sorted(loose, key=lambda x: (x[1], x[0])):
        if not groups or (held + n > most and len(groups[-1]) > 1):
            groups.append([])
            held = 0
        groups[-1].append(part)
        held += n
    if len(groups) > 1 and len(groups[-1]) == 1:
        alone = groups.pop()
        groups[-1] += alone
    return {part: i for i, group in enumerate(groups) if len(group) > 1 for part in group}


def pack(staged: DataFrame, *, capacity: int = CAPACITY, per_partition: int = PIECES_PER_PARTITION, rounds: int | None = None) -> DataFrame:
    """Add sequence_id, offset, partition, partition_bins and partition_bound to a table of pieces with a ``length`` of at most ``capacity``.

    ``staged`` must give the same rows at each reading (a written table). Full pieces are a sequence
    of their own and are not moved. Every partition's bins are numbered on their own; full pieces
    have negative numbers. Exchanges go on while one saves a sequence, or for ``rounds`` rounds.
    """
    keyed = staged.withColumn("row", F.monotonically_increasing_id())
    keyed = common.stage(keyed, "pieces")
    loose = keyed.where(F.col("length") < capacity).select("row", "length")
    parts = max(1, -(-loose.count() // per_partition))
    dealt = loose.withColumn("part", F.pmod(F.xxhash64(F.lit(0), "row"), F.lit(parts)))
    work = _packer(capacity)
    state = common.stage(dealt.groupBy("part").applyInPandas(work, _PACKED), "packed")
    fresh, turn = parts, 0
    while parts > 1 and (rounds is None or turn < rounds):
        turn += 1
        is_open = (F.col("bins") > F.col("bound")) & (F.col("fill") < capacity)
        to = cohorts([tuple(r) for r in state.where(is_open).groupBy("part").count().collect()], per_partition)
        if not to:
            break
        spots = F.broadcast(staged.sparkSession.createDataFrame([(p, fresh + i) for p, i in to.items()], "part long, target long"))
        fresh += len(set(to.values()))
        open_bins = state.where(is_open).join(spots, "part")
        again = common.stage(open_bins.select("row", "length", F.col("target").alias("part")).groupBy("part").applyInPandas(work, _PACKED), "repacked")
        was = open_bins.groupBy("target").agg(F.countDistinct("part", "bin").alias("was"))
        now = again.groupBy(F.col("part").alias("target")).agg(F.first("bins").alias("now"))
        won = [r["target"] for r in was.join(now, "target").where("now < was").collect()]
        if not won:
            break
        givers = F.broadcast(spots.where(F.col("target").isin(won)).select("part", F.lit(True).alias("gave")))
        kept = state.join(givers, "part", "left").where(F.col("gave").isNull() | ~is_open)
        # what a giver keeps are full sequences: so many does it need, and no fewer
        full = kept.where("gave").groupBy("part").agg((F.sum("length") / capacity).cast("long").alias("full"))
        kept = kept.join(full, "part", "left").withColumn("bins", F.coalesce("full", "bins")).withColumn("bound", F.coalesce("full", "bound"))
        state = common.stage(kept.select(*again.columns).unionByName(again.where(F.col("part").isin(won))), "exchanged")
    placed = state.select("row", "offset", (F.col("part") * F.lit(1 << 36) + F.col("bin")).alias("sequence_id"), F.col("part").alias("partition"), F.col("bins").alias("partition_bins"), F.col("bound").alias("partition_bound"))
    full = keyed.where(F.col("length") >= capacity).select(
        *keyed.columns, F.lit(0).cast("long").alias("offset"), (-1 - F.col("row")).alias("sequence_id"),
        F.lit(None).cast("long").alias("partition"), F.lit(None).cast("long").alias("partition_bins"), F.lit(None).cast("long").alias("partition_bound"),
    )
    return keyed.where(F.col("length") < capacity).join(placed, "row").unionByName(full).drop("row")


def best_fit(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, capacity: int = CAPACITY, end_token: int = END_TOKEN, keep_ids: bool = False, per_partition: int = PIECES_PER_PARTITION, rounds: int | None = None) -> DataFrame:
    """Pack documents into sequences of at most ``capacity`` tokens.

    Per piece: doc_id, piece, start, length, ids_crc32 (and ids), offset, sequence_id, and the
    partition with the bin count and the bound it was packed under (null for full pieces).
    """
    return pack(pieces(docs, id_col=id_col, text_col=text_col, tokenizer=tokenizer, capacity=capacity, end_token=end_token, keep_ids=keep_ids), capacity=capacity, per_partition=per_partition, rounds=rounds)
