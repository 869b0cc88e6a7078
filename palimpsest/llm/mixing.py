"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

1. Targets. Sources in code point order (null last) take the weights in turn and share
   ``share`` x all words by weight; a target stops at ``cap`` x its source's words and the excess is
   shared anew by weight. That is one water level: target = min(weight x level, cap x size).
2. Blocks. A document's block of its source is a hash of its id, so blocks are random samples of
   about ``block_words`` words and no source is sorted or gathered as a whole.
3. Quotas. A source gives each of its blocks floor(target / size) times, then, in a permuted order,
   every block that fits into what is left of the rest. What is left then is met by documents of
   further blocks, until none fits; at last the shortest one beyond is taken if that comes nearer.
4. Splitting tree. The vector of block units by source is halved again and again over the output
   shards by multivariate-hypergeometric draws seeded by the node, so each shard can compute its own
   exact quotas from the root, and they add up to the sources' units. Of very many sources no task
   holds the vector: all units are put into the order of a seeded hash and cut into equal runs, which
   draws from the same distribution.
5. Shards draw disjoint ranges of each source's permuted units, and order their documents by a
   seeded hash.

Null and empty texts have size 0. Null sources are one source. Rows that repeat (same id, source
and size) are taken together. Sources without words have target 0. A text of any length is one
document: where it doesn't fit into what is left, shorter ones are taken. An empty table gives an empty
result. Other columns are ignored by ``plan`` and kept by ``Plan.apply``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm import common

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
SHARE = 1.5
CAP = 2.0
BLOCK_WORDS = 1 << 18
SHARD_WORDS = 1 << 22
#: Documents of split blocks among which the last words are looked for exactly.
LAST = 64
#: numpy's hypergeometric draw takes populations under 10^9: blocks grow beyond this many.
MOST_UNITS = 1 << 28
#: One row a source, of under 100 bytes, goes to the driver, to every shard's task, and to all tasks that
#: size a source's documents. Of more sources the units are dealt out by a sorted hash, and joins shuffle.
MOST_SOURCES = 10_000
#: Subset sums are taken in so many steps at most, whatever a text's length.
MOST_SUMS = 1 << 22


def size_of(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def source_key(source: Column) -> Column:
    """Null-free, and apart from every real name."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit(""))


def targets(sources: DataFrame, *, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """Add ``target`` to (src, source_size); one row a source."""
    named = Window.orderBy(F.col("src") == "", "src")
    by_level = Window.orderBy("full_at", "src")
    whole = Window.partitionBy()
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.row_number().over(named) - 1) % len(weights) + 1)
    levels = sources.withColumn("weight", w).withColumn("full_at", cap * F.col("source_size") / F.col("weight"))
    upto = by_level.rowsBetween(Window.unboundedPreceding, 0)
    levels = levels.select("*", F.sum(cap * F.col("source_size")).over(upto).alias("held"), F.sum("weight").over(upto).alias("held_weight"), (share * F.sum("source_size").over(whole)).alias("all"), F.sum("weight").over(whole).alias("all_weight"))
    # at the level where this source is full, all sources together hold no more than is to be shared
    levels = levels.withColumn("full", F.col("held") + F.col("full_at") * (F.col("all_weight") - F.col("held_weight")) <= F.col("all"))
    level = (F.max("all").over(whole) - F.coalesce(F.sum(F.when(F.col("full"), cap * F.col("source_size"))).over(whole), F.lit(0.0))) / F.sum(F.when(~F.col("full"), F.col("weight"))).over(whole)
    return levels.withColumn("level", level).select(*sources.columns, F.when(F.col("full"), cap * F.col("source_size")).otherwise(F.least(F.col("weight") * F.col("level"), cap * F.col("source_size"))).cast("double").alias("target"))


def shard_quotas(units: np.ndarray, shards: int, shard: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(first unit, number of units) of each source for one shard: a walk from the tree's root to the leaf."""
    counts, first, total = units.astype(np.int64), np.zeros(len(units), np.int64), int(units.sum())
    lo, hi = 0, shards
    while hi - lo > 1:
        mid = (lo + hi) // 2
        draws = np.random.default_rng([seed, lo, hi])
        left = draws.multivariate_hypergeometric(counts, mid * total // shards - lo * total // shards, method="marginals")
        if shard < mid:
            counts, hi = left, mid
        else:
            first, counts, lo = first + left, counts - left, mid
    return first, counts


def best_subset(words: list[int], rest: float) -> list[int]:
    """Places of numbers with the largest sum of at most ``rest``. Bit s of a set tells that some subset so far has sum s.

    Where ``rest`` is over ``MOST_SUMS`` the numbers are rounded up to a ``MOST_SUMS``-th of it, so the sum still fits.
    """
    step = max(1, -(-int(rest) // MOST_SUMS))
    words, rest = [-(-n // step) for n in words], int(rest) // step
    reached, before, limit = 1, [], (1 << rest + 1) - 1
    for n in words:
        before.append(reached)
        reached |= reached << n & limit
    best = reached.bit_length() - 1
    out = []
    for i in range(len(words) - 1, -1, -1):
        if not before[i] >> best & 1:
            out.append(i)
            best -= words[i]
    return out


def _whole(rows: pd.DataFrame) -> pd.DataFrame:
    """A source's blocks in their order: each that fits into what is left is taken (``slot``: as which), the others are passed over."""
    rows = rows.sort_values("turn", kind="stable", ignore_index=True)
    left, slots, skipped = float(rows["rest"].iloc[0]), [], False
    taken = 0
    for n in rows["words"].to_list():
        fits = n <= left and (n > 0 or not skipped)
        slots.append(taken if fits else -1)
        skipped |= not fits
        if fits:
            left -= n
            taken += 1
    return rows.drop(columns=["words", "rest"]).assign(slot=slots, taken=taken, left=left)


def _choose(rows: pd.DataFrame) -> pd.DataFrame:
    """Documents that fit into ``left`` words: in order what fits, and of the last ``LAST`` the best subset for what is left then."""
    rows = rows.sort_values(["turn", "doc_id", "size"], kind="stable", ignore_index=True)
    words, rest = rows["words"].to_list(), float(rows["left"].iloc[0])
    split, taken = max(0, len(rows) - LAST), np.zeros(len(rows), bool)
    for i in range(split):
        if words[i] <= rest:
            taken[i] = True
            rest -= words[i]
    taken[[split + i for i in best_subset(words[split:], rest)]] = True
    return rows.loc[taken, ["src", "block", "doc_id", "size", "words"]]


def _chosen(placed: DataFrame, blocks: DataFrame, seed: int) -> DataFrame:
    """Documents (src, block, doc_id, size) of blocks not taken whole, which together come near each source's ``left``.

    The first look takes them in hash order from as few blocks as hold enough; further looks, needed only where
    documents were too long, from the longest down, so that each at least halves what is left.
    """
    spare = blocks.where((F.col("slot") < 0) & (F.col("left") > 0)).select("src", "block", "turn", "left")
    loose = placed.select("src", "block", "doc_id", "size").join(spare, ["src", "block"])
    loose = loose.groupBy("src", "block", "doc_id", "size").agg(F.sum("size").alias("words"), F.first("turn").alias("block_turn"), F.first("left").alias("left"))
    loose = common.stage(loose.where(F.col("words") < 2 * F.col("left")), "loose")
    shape = loose.select("src", "block", "doc_id", "size", "words").schema
    chosen, look = loose.select(*shape.names).limit(0), 0
    while True:
        taken = chosen.groupBy("src").agg(F.sum("words").alias("got"))
        rows = loose.join(taken, "src", "left").withColumn("left", F.col("left") - F.coalesce("got", F.lit(0))).drop("got").where("left > 0")
        if look:
            picked = chosen.select(F.col("src").alias("c_src"), F.col("doc_id").alias("c_doc_id"), F.col("size").alias("c_size"))
            rows = rows.join(picked, (F.col("src") == F.col("c_src")) & F.col("doc_id").eqNullSafe(F.col("c_doc_id")) & (F.col("size") == F.col("c_size")), "left_anti")
        fits = rows.where((F.col("words") <= F.col("left")) & (F.col("words") > 0))
        held = fits.groupBy("src", "block").agg(F.sum("words").alias("fit"), F.first("block_turn").alias("block_turn"), F.first("left").alias("room"))
        before = F.coalesce(F.sum("fit").over(Window.partitionBy("src").orderBy("block_turn").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        held = common.stage(held.withColumn("before", before).where(F.col("before") < F.col("room")).select("src", "block"), "held")
        if held.isEmpty():
            break
        order = F.xxhash64(F.lit(seed + 1), "doc_id", "size") if not look else -F.col("words")
        cut = rows.where(F.col("words") <= F.col("left")).join(held, ["src", "block"], "left_semi").withColumn("turn", order)
        found = common.stage(cut.groupBy("src").applyInPandas(_choose, shape), "chosen")
        chosen, look = chosen.unionByName(found) if look else found, look + 1
    last = rows.where((F.col("words") > F.col("left")) & (F.col("words") < 2 * F.col("left")))
    last = last.groupBy("src").agg(F.min(F.struct("words", "block_turn", "doc_id", "size", "block")).alias("d")).select("src", "d.block", "d.doc_id", "d.size", "d.words")
    return common.stage(chosen.unionByName(last).select("src", "block", "doc_id", "size"), "chosen")


@dataclass
class Plan:
    """What a mix takes: tables of sources, of blocks with the shards of their copies, and of documents chosen from split blocks."""

    sources: DataFrame
    blocks: DataFrame
    chosen: DataFrame
    shards: int
    few_sources: bool
    seed: int

    def apply(self, docs: DataFrame, *, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", size_col: str | None = None) -> DataFrame:
        """``docs`` in one struct ``doc``, with size, source_size, target, copies, and the shard of each copy."""
        size = F.col(f"`{size_col}`") if size_col else size_of(F.col(f"`{text_col}`"))
        rows = docs.select(F.struct("*").alias("doc"), F.col(f"`{id_col}`").alias("doc_id"), source_key(F.col(f"`{source_col}`")).alias("src"), size.alias("size"))
        sources = self.sources.select("src", "source_size", "target", "n_blocks")
        rows = rows.join(F.broadcast(sources) if self.few_sources else sources, "src")
        rows = rows.withColumn("block", _block(self.seed)).join(self.blocks, ["src", "block"])
        chosen = self.chosen.select(F.col("src").alias("c_src"), F.col("doc_id").alias("c_doc_id"), F.col("size").alias("c_size"), F.lit(True).alias("picked"))
        rows = rows.join(chosen, (F.col("src") == F.col("c_src")) & F.col("doc_id").eqNullSafe(F.col("c_doc_id")) & (F.col("size") == F.col("c_size")), "left")
        held = F.when(F.col("split") & F.col("picked").isNull(), F.slice("block_shards", 1, F.greatest(F.size("block_shards") - 1, F.lit(0)))).otherwise(F.col("block_shards"))
        return rows.select("doc", "doc_id", "size", "source_size", "target", held.alias("shards")).withColumn("copies", F.size("shards"))


def _block(seed: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id")), F.col("n_blocks"))


def _by_tree(units: DataFrame, shards: int, seed: int) -> DataFrame:
    """(src, unit, shard): every shard walks the tree to its own quotas."""
    by_source = units.groupBy("src").agg((F.max("unit") + 1).alias("n")).orderBy("src").collect()
    names, counts = [r["src"] for r in by_source], np.array([r["n"] for r in by_source], np.int64)

    def leaf(frames):
        for frame in frames:
            for shard in frame["id"]:
                first, n = shard_quotas(counts, shards, int(shard), seed)
                held = np.flatnonzero(n)
                if len(held):
                    yield pd.DataFrame({"src": [names[i] for i in held], "shard": int(shard), "first": first[held], "n": n[held]})

    quotas = units.sparkSession.range(shards).mapInPandas(leaf, "src string, shard long, first long, n long")
    return quotas.select("src", "shard", F.explode(F.sequence("first", F.col("first") + F.col("n") - 1)).alias("unit"))


def _by_order(units: DataFrame, shards: int, seed: int) -> DataFrame:
    """(src, unit, shard): all units in the order of a seeded hash, cut into equal runs; a sort, and one row a range partition."""
    order = (F.xxhash64(F.lit(seed), "src", "unit"), "src", "unit")
    ordered = common.stage(units.select("src", "unit").orderBy(*order).withColumn("at", F.monotonically_increasing_id()), "ordered")
    placed = ordered.withColumn("part", F.shiftright("at", 33)).withColumn("place", F.col("at").bitwiseAND((1 << 33) - 1))
    held = placed.groupBy("part").agg(F.count("*").alias("n"))
    held = held.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"), F.sum("n").over(Window.partitionBy()).alias("total"))
    return placed.join(held, "part").select("src", "unit", F.expr(f"((before + place + 1) * {shards} - 1) div total").alias("shard"))


def plan(docs: DataFrame, *, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP, block_words: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS, seed: int = 7) -> tuple[Plan, DataFrame]:
    """The mix of ``docs`` and the table (doc_id, src, size) it was made from, both from one pass over the texts."""
    spark = docs.sparkSession
    sizes = common.stage(docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{source_col}`").alias("source"), size_of(F.col(f"`{text_col}`")).alias("size")), "sizes")
    keyed = sizes.withColumn("src", source_key(F.col("source")))
    sources = keyed.groupBy("src").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    sources = common.stage(targets(sources, weights=weights, share=share, cap=cap), "targets")
    n_sources, words, target_words = sources.agg(F.count("*"), F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("target"), F.lit(0.0))).first()
    block_words = max(block_words, -(-words // MOST_UNITS))
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    sources = sources.withColumn("n_blocks", F.greatest(F.lit(1), F.ceil(F.greatest("source_size", "n_docs") / F.lit(block_words)))).withColumn("passes", passes).withColumn("rest", F.col("target") - F.col("passes") * F.col("source_size"))
    few = n_sources <= MOST_SOURCES
    plain = sources.select("src", "n_blocks", "passes", "rest")
    placed = keyed.join(F.broadcast(plain) if few else plain, "src").withColumn("block", _block(seed))

    # blocks in a permuted order; a source has words / block_words of them
    turn = F.pmod(F.col("block") * 2_147_483_647 + seed, F.col("n_blocks"))
    blocks = placed.groupBy("src", "block").agg(F.sum("size").alias("words"), F.first("n_blocks").alias("n_blocks"), F.first("passes").alias("passes"), F.first("rest").alias("rest")).withColumn("turn", turn)
    blocks = common.stage(blocks.groupBy("src").applyInPandas(_whole, "src string, block long, n_blocks long, passes long, turn long, slot long, taken long, left double"), "quotas")
    chosen = _chosen(placed, blocks, seed)
    # split blocks come after the whole ones
    splits = chosen.select("src", "block").distinct().withColumn("nth", F.row_number().over(Window.partitionBy("src").orderBy("block")))
    blocks = blocks.join(splits, ["src", "block"], "left").withColumn("split", F.col("nth").isNotNull()).withColumn("slot", F.when(F.col("slot") >= 0, F.col("slot")).otherwise(F.col("taken") + F.col("nth") - 1))
    chosen = chosen.select("src", "doc_id", "size")

    # units: block copies, numbered by pass and then by the block's turn, in the last pass by its slot; the shards share them out
    copies = F.col("passes") + F.when(F.col("slot").isNotNull(), 1).otherwise(0)
    units = blocks.select("src", "block", "split", F.explode(F.when(copies > 0, F.sequence(F.lit(0), (copies - 1).cast("int")))).alias("pass"), "turn", "n_blocks", "passes", "slot")
    # numbers of blocks that hold no document stay unused
    units = units.withColumn("unit", F.col("pass") * F.col("n_blocks") + F.when(F.col("pass") < F.col("passes"), F.col("turn")).otherwise(F.col("slot")))
    shards = max(1, int(-(-target_words // shard_words)))
    owners = _by_tree(units, shards, seed) if few else _by_order(units, shards, seed)
    owned = units.join(owners, ["src", "unit"]).groupBy("src", "block").agg(F.sort_array(F.collect_list(F.struct("pass", "shard"))).alias("copies"))
    blocks = blocks.select("src", "block", "split").join(owned, ["src", "block"], "left")
    blocks = common.stage(blocks.select("src", "block", "split", F.coalesce(F.col("copies.shard"), F.expr("array()").cast("array<bigint>")).alias("block_shards")), "shards")
    return Plan(sources, blocks, chosen, shards, few, seed), sizes


def mix(docs: DataFrame, **options) -> DataFrame:
    """Per document: doc_id, size, source_size, target, copies (times the mix takes it), shards (of its copies)."""
    made, sizes = plan(docs, **options)
    return made.apply(sizes, size_col="size", source_col="source").drop("doc")


def shards(docs: DataFrame, *, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", **options) -> DataFrame:
    """The mix itself: all columns of ``docs``, a row for each copy, with ``_shard`` (with one more underscore if there is such a column); dealt by shard and shuffled inside."""
    names = {"id_col": id_col, "source_col": source_col, "text_col": text_col}
    made, _ = plan(docs, **names, **options)
    rows = made.apply(docs, **names).select("doc", "doc_id", F.posexplode("shards").alias("copy", "shard"))
    rows = rows.repartition("shard").sortWithinPartitions("shard", F.xxhash64(F.lit(made.seed + 2), "doc_id", "copy"))
    return rows.select("doc.*", F.col("shard").alias(common.unused(docs, "_shard")))
