"""Near-duplicates by ProbMinHash, banding and exact verification.

A text is a weighted set: its distinct five-word shingles with how often they occur. The similarity
is the probability Jaccard index J_P, which does not depend on the scale of the weights and equals
the Jaccard index where all shingles occur once. ProbMinHash (Ertl 2020): every shingle is a Poisson
process with its weight as rate; each arrival goes to a random register, which keeps the earliest.
A shingle is dropped once its next arrival is later than the latest register. Two texts agree in a
register with probability J_P.

Texts that agree in all six registers of one of 32 bands are candidates: at J_P = 0.8 a pair is
missed with probability (1 - 0.8^6)^32 < 1e-4. Candidates are verified by their exact J_P.

No group is expanded into pairs. Equal texts are one node. A bucket's least node is its leader, and
all others are verified against it. For a turn (or more, by a constant), those outside their leader's component
(strays) are verified against one row drawn from inside and one from outside of it in each bucket, and
components are joined; a turn costs as many pairs as there are strays. The strays that stay are
compared with all their buckets in blocks: a task gets bounded numbers of strays and of other rows,
counts common shingles by an inverted index, and returns one link for each stray and component. So
every candidate pair is verified or its ends are joined through others, and classes are exact for
the candidates.

Null and empty texts, and texts of white space, have no shingles: they are near only to equal texts
(null counts as empty). Repeated rows are equal texts; of rows equal in id and text one is kept. Null
ids are kept; a class of them alone has a null class id. Of a long text only the hashes of its words
and shingles are held, in a slice of its own. An empty table gives an empty result. Other columns are
ignored, and returned by ``deduplicate`` as they are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.llm import common, shingles
from palimpsest.llm.components import components

THRESHOLD = 0.8
BANDS, ROWS = 32, 6
#: Turns in which strays are verified against drawn rows, before all of them are compared in blocks.
PROBES = 1
#: Strays and rows that a block compares.
BLOCK_STRAYS, BLOCK_ROWS = 256, 2048
_STEP = np.uint64(0x9E3779B97F4A7C15)


def prob_minhash(rows: np.ndarray, keys: np.ndarray, weights: np.ndarray, n_rows: int, registers: int) -> np.ndarray:
    """Registers (n_rows x registers) of weighted sets given as flat (row, key, weight), rows ascending; 0 where a row is empty."""
    first = np.full(n_rows * registers, np.inf)
    held = np.zeros(n_rows * registers, np.uint64)
    limit = np.full(n_rows, np.inf)
    state, time, rate = common.mix64(keys + np.uint64(1)), np.zeros(len(keys)), 1.0 / weights
    while len(rows):
        # several arrivals at once where few shingles are left
        for _ in range(max(1, min(32, 100_000 // len(rows)))):
            state = state + _STEP
            drawn = common.mix64(state)
            time = time - np.log(((drawn >> np.uint64(11)) + np.uint64(1)) * 2.0**-53) * rate
            at = rows * registers + ((common.mix64(drawn ^ _STEP) >> np.uint64(32)) * np.uint64(registers) >> np.uint64(32)).astype(np.int64)
            np.minimum.at(first, at, time)
            won = first[at] == time
            held[at[won]] = keys[won]
        present = np.unique(rows) if len(rows) < n_rows else np.arange(n_rows)
        limit[present] = first.reshape(n_rows, registers)[present].max(1)
        alive = time < limit[rows]
        rows, keys, state, time, rate = rows[alive], keys[alive], state[alive], time[alive], rate[alive]
    return held.reshape(n_rows, registers)


def band_hashes(held: np.ndarray, bands: int, per_band: int) -> np.ndarray:
    out = np.empty((len(held), bands), np.int64)
    for b in range(bands):
        h = np.full(len(held), b + 1, np.uint64)
        for j in range(per_band):
            h = common.mix64(h * _STEP + held[:, b * per_band + j])
        out[:, b] = h.view(np.int64)
    return out


def probability_jaccard(a_keys: np.ndarray, a: np.ndarray, b_keys: np.ndarray, b: np.ndarray) -> float:
    """J_P = sum over common d of 1 / sum over all e of max(a_e / a_d, b_e / b_d); by ascending b / a the inner sums are prefix sums."""
    _, i, j = np.intersect1d(a_keys, b_keys, assume_unique=True, return_indices=True)
    if not len(i):
        return 0.0
    a_in, b_in = a[i].astype(float), b[j].astype(float)
    order = np.argsort(b_in / a_in, kind="stable")
    a_in, b_in = a_in[order], b_in[order]
    up_to = a.sum() - a_in.sum() + np.cumsum(a_in)
    beyond = b.sum() - np.cumsum(b_in)
    return float((1 / (up_to / a_in + beyond / b_in)).sum())


def row_key(doc_id: Column, node: Column) -> Column:
    """Tells rows of different id or text apart: the text's digest, of fixed length, and the id."""
    return F.concat(node, F.coalesce(F.concat(F.lit("="), doc_id.cast("string")), F.lit("")))


def digest(text: Column) -> Column:
    return F.substring(F.sha2(F.coalesce(text, F.lit("")), 256), 1, 32)


def signatures(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", bands: int = BANDS, rows: int = ROWS, shingle: int = shingles.SHINGLE) -> DataFrame:
    """doc_id, node (digest of the text), bands (array of long; empty without shingles)."""
    src = common.only(docs, doc_id=id_col, text=text_col)
    schema = T.StructType([T.StructField("doc_id", src.schema["doc_id"].dataType), T.StructField("node", T.StringType()), T.StructField("bands", T.ArrayType(T.LongType()))])

    def make() -> Callable:
        def step(batch: pa.RecordBatch):
            for part in shingles.slices(batch, (1,)):
                data, at = common.utf8(part.column(1))
                nodes = [hashlib.sha256(data[s:e]).hexdigest()[:32] for s, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                row, keys, counts, offsets = shingles.weighted(part.column(1), shingle)
                hashed = band_hashes(prob_minhash(row, keys, counts, part.num_rows, bands * rows), bands, rows)
                filled = offsets[1:] > offsets[:-1]
                ends = np.concatenate([[0], np.cumsum(filled * bands)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(nodes, pa.string()), pa.ListArray.from_arrays(pa.array(ends), pa.array(hashed[filled].ravel()))], names=schema.names)

        return step

    return common.map_rows(src, make, schema)


def similarities(pairs: DataFrame, texts: DataFrame, *, shingle: int = shingles.SHINGLE) -> DataFrame:
    """(a, b, similarity) of pairs (a, b) of keys in ``texts`` (id, text)."""
    both = pairs.join(texts.withColumnsRenamed({"id": "b", "text": "b_text"}), "b").join(texts.withColumnsRenamed({"id": "a", "text": "a_text"}), "a")

    def make() -> Callable:
        def step(batch: pa.RecordBatch):
            for part in shingles.slices(batch, (2, 3)):
                (_, a, a_n, a_at), (_, b, b_n, b_at) = (shingles.weighted(part.column(c), shingle) for c in (2, 3))
                found = [probability_jaccard(a[s:e], a_n[s:e], b[t:u], b_n[t:u]) for s, e, t, u in zip(a_at[:-1], a_at[1:], b_at[:-1], b_at[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(found, pa.float64())], names=["a", "b", "similarity"])

        return step

    return common.map_rows(both.select("a", "b", "a_text", "b_text"), make, T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType()), T.StructField("similarity", T.DoubleType())]))


def block_links(ids: np.ndarray, roots: np.ndarray, stray: np.ndarray, column: pa.Array, threshold: float, shingle: int) -> list[tuple[int, int]]:
    """For each stray and each other component among the rows, one link to it, if there is any.

    J_P is at most the sum of the lesser shares of the common shingles. That sum, and the number of
    common shingles, come from an inverted index; where all shingles of both texts occur once, J_P
    is the Jaccard index of these numbers, and else it is computed for the pairs the bound leaves.
    """
    parts = [shingles.weighted(part.column(0), shingle) for part in shingles.slices(pa.RecordBatch.from_arrays([column], names=["text"]), (0,))]
    keys, counts = np.concatenate([p[1] for p in parts]), np.concatenate([p[2] for p in parts])
    sizes = np.concatenate([np.diff(p[3]) for p in parts])
    at = np.concatenate([[0], np.cumsum(sizes)])
    row = np.repeat(np.arange(len(ids)), sizes)
    total = np.bincount(row, weights=counts, minlength=len(ids))
    plain = total == sizes
    share = counts / total[row]
    order = np.argsort(keys, kind="stable")
    listed, of_row, of_share = keys[order], row[order], share[order]
    out = []
    for x in np.flatnonzero(stray).tolist():
        own = slice(at[x], at[x + 1])
        lo, hi = np.searchsorted(listed, keys[own], "left"), np.searchsorted(listed, keys[own], "right")
        spots = np.repeat(lo - np.concatenate([[0], np.cumsum(hi - lo)[:-1]]), hi - lo) + np.arange(int((hi - lo).sum()))
        common_n = np.bincount(of_row[spots], minlength=len(ids))
        exact = plain & plain[x]
        other = (roots != roots[x]) & (common_n > 0)
        hits = np.flatnonzero(exact & other & (common_n >= threshold * (sizes[x] + sizes - common_n))).tolist()
        if (other & ~exact).any():
            bound = np.bincount(of_row[spots], weights=np.minimum(of_share[spots], np.repeat(share[own], hi - lo)), minlength=len(ids))
            hits += [y for y in np.flatnonzero(~exact & other & (bound >= threshold - 1e-9)).tolist() if probability_jaccard(keys[own], counts[own], keys[at[y] : at[y + 1]], counts[at[y] : at[y + 1]]) >= threshold]
        met = {int(roots[y]): int(ids[y]) for y in hits}
        out += [(int(ids[x]), y) for y in met.values()]
    return out


def _against_all(placed: DataFrame, work: DataFrame, texts: DataFrame, threshold: float, shingle: int) -> DataFrame:
    """Links (a, b) between strays and the other rows of their buckets, compared in blocks."""
    blocks = work.select("bucket", F.ceil(F.col("strays") / BLOCK_STRAYS).cast("int").alias("across"), F.ceil(F.col("n") / BLOCK_ROWS).cast("int").alias("down"))
    rows = placed.join(blocks, "bucket")
    wide, tall = F.pmod(F.xxhash64("id"), F.col("across")).cast("int"), F.pmod(F.xxhash64("id", F.lit(1)), F.col("down")).cast("int")
    # a stray goes to every block of its column, and as another row to every block of its row
    compared = rows.where("stray").select("bucket", "id", "root", F.lit(True).alias("stray"), wide.alias("i"), F.explode(F.sequence(F.lit(0), F.col("down") - 1)).alias("j"))
    others = rows.select("bucket", "id", "root", F.lit(False).alias("stray"), tall.alias("j"), F.explode(F.sequence(F.lit(0), F.col("across") - 1)).alias("i"))
    both = compared.unionByName(others).join(texts, "id")

    def compare(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        found = block_links(table["id"].to_numpy(), table["root"].to_numpy(), table["stray"].to_numpy(), table["text"].combine_chunks(), threshold, shingle)
        return pa.table({"a": pa.array([max(p) for p in found], pa.int64()), "b": pa.array([min(p) for p in found], pa.int64())})

    return both.groupBy("bucket", "i", "j").applyInArrow(compare, "a long, b long").distinct()


def classes(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS, shingle: int = shingles.SHINGLE) -> DataFrame:
    """doc_id, class_id (the least id of the class), row (this row's key), kept (true of one row of each class)."""
    signed = common.stage(signatures(docs, id_col=id_col, text_col=text_col, bands=bands, rows=rows, shingle=shingle), "signatures")
    nodes = common.stage(signed.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("bands").alias("bands")).withColumn("id", F.monotonically_increasing_id()), "nodes")
    named = nodes.select("id", row_key(F.col("doc_id"), F.col("node")).alias("row"))

    # buckets of two nodes and more: a count and a minimum for each, then back to their members
    hashed = nodes.select("id", F.explode("bands").alias("bucket"))
    shared = hashed.groupBy("bucket").agg(F.count("*").alias("n"), F.min("id").alias("leader")).where("n > 1").select("bucket", "leader")
    members = common.stage(hashed.join(shared, "bucket"), "members")

    # the texts of the candidates, once
    wanted = members.select("id").distinct().join(named, "id")
    keyed = docs.select(row_key(F.col(f"`{id_col}`"), digest(F.col(f"`{text_col}`"))).alias("row"), F.col(f"`{text_col}`").alias("text"))
    texts = common.stage(keyed.join(wanted, "row").groupBy("id").agg(F.first("text").alias("text")), "texts")

    def verify(pairs: DataFrame, name: str) -> DataFrame:
        return common.stage(similarities(pairs.distinct(), texts, shingle=shingle), name)

    led = verify(members.where("id <> leader").select(F.col("leader").alias("a"), F.col("id").alias("b")), "led")
    found = common.stage(components(led.where(F.col("similarity") >= threshold).select("a", "b")), "components")
    root = F.coalesce(F.col("root"), F.col("id"))
    for turn in range(PROBES + 1):
        placed = members.join(found.withColumnRenamed("key", "id"), "id", "left").select("bucket", "id", "leader", root.alias("root"))
        heads = placed.where("id = leader").select("bucket", F.col("root").alias("head"))
        placed = common.stage(placed.join(heads, "bucket").withColumn("stray", F.col("root") != F.col("head")), "placed")
        # of each bucket with strays: one row drawn from inside and one from outside of its leader's component
        salted = F.struct(F.xxhash64(F.lit(turn), "id"), "id")
        work = placed.groupBy("bucket").agg(F.count("*").alias("n"), F.count(F.when(F.col("stray"), 1)).alias("strays"), F.min(F.when(~F.col("stray") & (F.col("id") != F.col("leader")), salted)).alias("inner"), F.min(F.when(F.col("stray"), salted)).alias("outer")).where("strays > 0")
        work = common.stage(work.select("bucket", "n", "strays", F.array_compact(F.array("inner.id", "outer.id")).alias("probes")), "work")
        if work.isEmpty():
            break
        strays = placed.where("stray").select("bucket", F.col("id").alias("x"), F.col("root").alias("x_root"))
        if turn < PROBES:
            drawn = strays.join(work, "bucket").select("x", "x_root", F.explode("probes").alias("id")).join(placed.select("id", "root").distinct(), "id").where("root <> x_root")
            more = verify(drawn.select(F.least("id", "x").alias("a"), F.greatest("id", "x").alias("b")), "probed").where(F.col("similarity") >= threshold).select("a", "b")
        else:
            more = common.stage(_against_all(placed, work, texts, threshold, shingle), "remaining")
        found = common.stage(components(found.select(F.col("key").alias("a"), F.col("root").alias("b")).unionByName(more)), "components")

    rooted = nodes.select("id", "node", "doc_id").join(found.withColumnRenamed("key", "id"), "id", "left").select("id", "node", "doc_id", root.alias("root"))
    firsts = rooted.groupBy("root").agg(F.min("doc_id").alias("class_id"), F.min_by("node", F.struct(F.col("doc_id").isNull(), "doc_id", "node")).alias("first"))
    answer = rooted.join(firsts, "root").select("node", "class_id", row_key(F.col("class_id"), F.col("first")).alias("keep"))
    # equal rows are counted before the join, and only one of them is kept
    counted = signed.groupBy("doc_id", "node").agg(F.count("*").cast("int").alias("n"))
    row = row_key(F.col("doc_id"), F.col("node"))
    return counted.join(answer, "node").select("doc_id", "class_id", row.alias("row"), (F.col("keep") == row).alias("least"), F.explode(F.sequence(F.lit(1), F.col("n"))).alias("copy")).select("doc_id", "class_id", "row", (F.col("least") & (F.col("copy") == 1)).alias("kept"))


def deduplicate(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with one row of each class: that of the least id."""
    kept = classes(docs, id_col=id_col, text_col=text_col, **options).where("kept").select("row")
    name = common.unused(docs, "_row")
    return docs.withColumn(name, row_key(F.col(f"`{id_col}`"), digest(F.col(f"`{text_col}`")))).join(kept.withColumnRenamed("row", name), name, "left_semi").dropDuplicates([name]).drop(name)
