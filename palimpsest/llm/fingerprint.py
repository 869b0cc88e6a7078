"""I-Match fingerprints, with DataFrame functions only.

A document's terms are the distinct words of its lower-cased text. The lexicon holds the terms whose
document frequency lies in a band (neither everywhere nor nearly unique). Each of several randomised
subsets of the lexicon gives one hash: that of the document's terms in the subset, sorted. Subsets
range from an eighth to a 1024th of the lexicon, so that texts of any length have subsets that hold
a few of their terms: such a hash survives an edit that spares those few. The last subset is the
whole lexicon, so that no text with a term in the band is without a hash of its own.

The lexicon is bounded: terms in at least ``low`` of all documents number at most (distinct terms
of an average document) / ``low``, however many documents there are. It is sent to all tasks only after
its count is checked, and joined by shuffle beyond.

A text without any term in the band is hashed by all its terms, in every subset. Null and empty
texts have no terms: their fingerprint is all gaps, and equals itself. Repeated rows (same id and
text) are one document in the order of documents, and each gets its row. Null ids come last. A long
text is one row throughout. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm import common

SEPARATOR = r"[^\p{L}\p{N}]+"
LOW, HIGH = 0.001, 0.05
#: Share of the lexicon in each subset.
SUBSETS = (*(2.0 ** -(3 + k // 2) for k in range(16)), 1.0)
#: Lexicon rows are under 100 bytes; up to so many travel with the plan as a look-up table of so many buckets.
MOST_BROADCAST = 500_000
BUCKETS = 1 << 16
GAP = "_"


def terms(text: Column) -> Column:
    return F.array_remove(F.array_distinct(F.split(F.lower(text), SEPARATOR)), "")


def lexicon(texts: DataFrame, *, low: float = LOW, high: float = HIGH, subsets: tuple[float, ...] = SUBSETS) -> DataFrame:
    """(term, h, mask) of the terms in the band, from a table with a ``text`` column; bit k of the mask: the term is in subset k."""
    n = texts.count()
    counts = texts.select(F.explode(terms(F.coalesce("text", F.lit("")))).alias("term")).groupBy("term").agg(F.count("*").alias("n"))
    band = counts.where((F.col("n") >= low * n) & (F.col("n") <= max(high * n, 1)))
    mask = F.lit(0)
    for k, share in enumerate(subsets):
        mask = mask + F.when(F.conv(F.substring(F.md5(F.concat(F.lit(f"{k}:"), "term").cast("binary")), 1, 8), 16, 10).cast("long") < int(share * 2**32), 1 << k).otherwise(0)
    return common.stage(band.select("term", F.substring(F.md5(F.col("term").cast("binary")), 1, 16).alias("h"), mask.cast("int").alias("mask")), "lexicon")


def _in_subset(k: int) -> Callable[[Column], Column]:
    return lambda e: e.mask.bitwiseAND(1 << k) != 0


def _print(entries: Column, plain: Column, subsets: int) -> Column:
    """Fingerprint of sorted (h, mask) entries; ``plain`` where there are none."""
    hashes = []
    for k in range(subsets):
        inside = F.transform(F.filter(entries, _in_subset(k)), lambda e: e.h)
        hashes.append(F.when(F.size(inside) == 0, F.lit(GAP)).otherwise(F.substring(F.md5(F.concat_ws("", inside).cast("binary")), 1, 12)))
    return F.when(F.size(entries) == 0, F.array_join(F.array_repeat(plain, subsets), "-")).otherwise(F.concat_ws("-", *hashes))


def plain_hash(found: Column) -> Column:
    """What stands for the terms of a text that has none in the band."""
    return F.when(F.size(found) == 0, F.lit(GAP)).otherwise(F.substring(F.md5(F.concat_ws(" ", F.sort_array(found)).cast("binary")), 1, 12))


def likeness(a: Column, b: Column) -> Column:
    """Of the subsets in which either text has a term, the share with equal hashes; 1 where there is none."""
    pairs = F.zip_with(F.split(a, "-"), F.split(b, "-"), lambda x, y: F.when((x == GAP) & (y == GAP), F.lit(None)).otherwise((x == y).cast("double")))
    seen = F.filter(pairs, lambda x: x.isNotNull())
    return F.when(F.size(seen) == 0, F.lit(1.0)).otherwise(F.aggregate(seen, F.lit(0.0), lambda s, x: s + x) / F.size(seen))


def _bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def lookup_table(words: DataFrame) -> DataFrame:
    """One row, one column: the lexicon as an array of buckets of (term, h, mask), by the term's hash."""
    filled = words.groupBy(_bucket(F.col("term")).alias("at")).agg(F.collect_list(F.struct("term", "h", "mask")).alias("found"))
    every = words.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("at")).join(filled, "at", "left")
    none = F.expr("array()").cast(filled.schema["found"].dataType)
    return every.agg(F.transform(F.sort_array(F.collect_list(F.struct("at", F.coalesce("found", none).alias("found")))), lambda b: b.found).alias("lexicon"))


def _entries_by_table(rows: DataFrame, words: DataFrame, columns: list[str]) -> DataFrame:
    """Entries found inside each row: the table is one constant of the plan, and no term leaves its row."""
    def one(lexicon: Column) -> Column:
        def find(found: Column) -> Column:
            hits = F.transform(found, lambda t: F.filter(F.get(lexicon, _bucket(t)), lambda e: e.term == t))
            return F.array_sort(F.transform(F.flatten(hits), lambda e: F.struct(e.h.alias("h"), e["mask"].alias("mask"))))

        return F.transform(F.array(*[F.col(c) for c in columns]), find)

    kept, plain = [c for c in rows.columns if c not in columns], [f"_plain_{i}" for i in range(len(columns))]
    listed = rows.select(*kept, *[terms(F.col(c)).alias(c) for c in columns])
    listed = listed.select(*kept, *columns, *[plain_hash(F.col(c)).alias(p) for p, c in zip(plain, columns, strict=True)], lookup_table(words).scalar().alias("_lexicon"))
    # the one use of the table, so that the optimizer puts the constant in its place and no row carries it
    found = listed.select(*kept, *plain, F.get(F.transform(F.array("_lexicon"), one), 0).alias("_entries"))
    return found.select(*kept, *plain, *[F.get("_entries", i).alias(f"_entries_{i}") for i in range(len(columns))])


def _marked(i: int) -> Callable[[Column], Column]:
    return lambda term: F.struct(F.lit(i).alias("i"), term.alias("term"))


def _entries_by_join(rows: DataFrame, words: DataFrame, columns: list[str], key: str) -> DataFrame:
    """The same for lexicons of any size: every term of every row meets the lexicon in a shuffle, and goes back to its row."""
    # the empty term marks each text, so that those without any term in the band stay
    marked = words.unionByName(words.sparkSession.createDataFrame([("", None, 0)], "term string, h string, mask int"))
    kept, plain = [c for c in rows.columns if c not in columns], [f"_plain_{i}" for i in range(len(columns))]
    found = rows.select(*kept, *[terms(F.col(c)).alias(c) for c in columns]).select(
        *kept, *[plain_hash(F.col(c)).alias(p) for p, c in zip(plain, columns, strict=True)],
        F.flatten(F.array(*[F.transform(F.concat(F.col(c), F.array(F.lit(""))), _marked(i)) for i, c in enumerate(columns)])).alias("_all"),
    )
    # only columns beside the generator: what is computed there is computed for every term
    found = found.select(*kept, *plain, F.explode("_all").alias("_e")).select(*kept, *plain, F.col("_e.term").alias("term"), F.col("_e.i").alias("_i"))
    hits = found.join(marked, "term")
    return hits.groupBy(key).agg(
        *[F.first(c).alias(c) for c in [*(c for c in kept if c != key), *plain]],
        *[F.sort_array(F.collect_set(F.when((F.col("_i") == i) & F.col("h").isNotNull(), F.struct("h", "mask")))).alias(f"_entries_{i}") for i in range(len(columns))],
    )


def fingerprint(rows: DataFrame, words: DataFrame, columns: list[str], *, key: str, subsets: int = len(SUBSETS)) -> DataFrame:
    """``rows`` with <column>_print in place of each text column; rows of one ``key`` (not null) are alike and may become one."""
    kept = [c for c in rows.columns if c not in columns]
    found = _entries_by_table(rows, words, columns) if words.count() <= MOST_BROADCAST else _entries_by_join(rows, words, columns, key)
    return found.select(*kept, *[_print(F.col(f"_entries_{i}"), F.col(f"_plain_{i}"), subsets).alias(f"{c}_print") for i, c in enumerate(columns)])


def successors(ids: DataFrame) -> DataFrame:
    """(k, next) over a table (k, doc_id) of distinct k, ordered by doc_id (null last), then k; the last is followed by the first.

    Only ids are sorted. Inside a range partition the next row follows by a window; the last row of
    each partition takes the first of the next one, from a table of one row a partition.
    """
    ordered = common.stage(ids.orderBy(F.col("doc_id").asc_nulls_last(), "k").withColumn("at", F.monotonically_increasing_id()), "ordered")
    placed = ordered.select("k", "at", F.shiftright("at", 33).alias("part"))
    inner = Window.partitionBy("part").orderBy("at")
    firsts = placed.groupBy("part").agg(F.min_by("k", "at").alias("first"))
    over = Window.orderBy("part")
    firsts = firsts.select("part", F.coalesce(F.lead("first").over(over), F.first("first").over(over.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("across"))
    return placed.withColumn("next", F.lead("k").over(inner)).join(firsts, "part").select("k", F.coalesce("next", "across").alias("next"))


def row_key(doc_id: Column, text: Column) -> Column:
    """A hash of id and text; the id's length is spelled out, so that no two pairs share a string, nor does a null id with any other."""
    return F.substring(F.sha2(F.concat(F.coalesce(F.concat(F.octet_length(doc_id).cast("string"), F.lit(":"), doc_id), F.lit("-")), F.lit(":"), text), 256), 1, 32)


def with_edits(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", low: float = LOW, high: float = HIGH) -> DataFrame:
    """Fingerprints of each document, of its edited text (the last quarter replaced by the start of the next document), and their likenesses.

    The texts are dealt once by key; both joins and the collection of terms use that dealing.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    key = row_key(F.col(f"`{id_col}`").cast("string"), text)
    texts = docs.select(key.alias("k"), text.alias("text"))
    words = lexicon(texts.select("text"), low=low, high=high)
    ids = docs.select(key.alias("k"), F.col(f"`{id_col}`").alias("doc_id"), F.length(text).alias("n"))
    ids = common.stage(ids.groupBy("k", "doc_id").agg(F.first("n").alias("n"), F.count("*").alias("copies")), "ids")
    order = common.stage(successors(ids.select("k", "doc_id")).join(ids.select("k", "doc_id", F.expr("n div 4").cast("int").alias("q"), "copies"), "k"), "order")
    # the first quarter-length of each document's successor; rows of a successor that repeat give the same
    starts = texts.join(order.select(F.col("next").alias("k"), F.col("k").alias("owner"), "doc_id", "q", "copies"), "k")
    starts = starts.select(F.col("owner").alias("k"), F.left("text", F.col("q")).alias("start"), "doc_id", "q", "copies", F.col("k").alias("next")).groupBy("k").agg(*[F.first(c).alias(c) for c in ("start", "doc_id", "q", "copies", "next")])
    both = texts.join(starts, "k").select("k", "doc_id", F.length("text").alias("n_chars"), "next", "copies", "text", F.concat(F.expr("left(text, length(text) - q)"), "start").alias("edited"))
    both = both.withColumn("edited_sha256", F.sha2("edited", 256))
    prints = common.stage(fingerprint(both, words, ["text", "edited"], key="k").dropDuplicates(["k"]), "prints")
    following = prints.select(F.col("k").alias("next"), F.col("text_print").alias("next_print"))
    rows = prints.join(following, "next").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return rows.select(
        "doc_id", F.col("n_chars").cast("long").alias("n_chars"), "edited_sha256", F.col("text_print").alias("fingerprint"), F.col("edited_print").alias("edited_fingerprint"),
        likeness(F.col("text_print"), F.col("edited_print")).alias("near_edited"), likeness(F.col("text_print"), F.col("next_print")).alias("near_next"),
    )
