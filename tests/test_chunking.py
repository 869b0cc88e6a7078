"""Chunks do not depend on how entries came or were dealt; parallel cuts equal those of one scan."""

import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from palimpsest.functions import hashes
from palimpsest.operators import chunking, validate

SPEC = chunking.Spec(pattern=0.1, least=256, target=2048, most=8192)


def one_scan(sizes, marks, spec):
    out, held = [], 0
    for i, (size, mark) in enumerate(zip(sizes, marks, strict=True)):
        held += int(size)
        if held < spec.least:
            continue
        limit = np.floor(min(int(spec.pattern * 2**32) * float(np.exp2(held / spec.target)), 2.0**31))
        if held >= spec.most or mark < limit:
            out.append(i)
            held = 0
    return out, held


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10_000), st.integers(0, 600), st.integers(0, 300))
def test_cuts_equal_a_plain_scan(seed, n, carried):
    rng = np.random.default_rng(seed)
    sizes, marks = rng.integers(1, 400, n), rng.integers(0, 2**32, n)
    if carried >= SPEC.least:
        carried = SPEC.least - 1
    got, tail = chunking.cuts(sizes, marks, SPEC, carried)
    first = np.concatenate([[carried], sizes]) if carried else sizes
    want, held = one_scan(first, np.concatenate([[2**32], marks]) if carried else marks, SPEC)
    assert got.tolist() == [w - bool(carried) for w in want] and tail == held


def rows(spark, n, parts=3):
    return spark.range(n).repartition(parts).select(F.format_string("key%06d", F.col("id")).alias("_key"), F.concat(F.lit("v"), F.repeat(F.lit("x"), (F.col("id") % 50).cast("int"))).alias("v"))


def measure(frame):
    size = (F.octet_length("_key") + F.octet_length("v")).cast("long")
    return frame.select("*", size.alias("_size"), hashes.boundary_hash(F.col("_key"), SPEC.seed).alias("_mark"), hashes.entry_digest(F.col("_key"), F.col("v")).alias("_digest"))


def expected(spark, n, spec):
    plain = measure(rows(spark, n)).orderBy("_key").collect()
    cuts, _ = one_scan([r["_size"] for r in plain], [r["_mark"] for r in plain], spec)
    starts, out, at = {c + 1 for c in cuts}, [], 0
    for i, r in enumerate(plain):
        at += i in starts
        out.append((r["_key"], at, r["_digest"], r["_size"]))
    return out


@pytest.mark.parametrize("parts", [1, 5, 40])
@pytest.mark.parametrize("look", [chunking.LOOK, 1])
def test_parallel_equals_sequential(spark, monkeypatch, parts, look):
    """Chunk numbers, hashes, bounds and sizes, for partitions of many chunks and of hardly one."""
    monkeypatch.setattr(chunking, "_partitions", lambda *_: parts)
    monkeypatch.setattr(chunking, "LOOK", look)
    made = chunking.chunk(rows(spark, 3000), SPEC, "salt", measure)
    want = expected(spark, 3000, SPEC)
    assert made.wrong is None and made.rows.columns == ["_key", "v", "_ord"]
    assert [tuple(r) for r in made.rows.select("_key", "_ord").orderBy("_key").collect()] == [w[:2] for w in want] and want[-1][1] > 20
    leaves = {r["ord"]: r for r in made.leaves.collect()}
    assert sorted(leaves) == sorted({w[1] for w in want})
    for i, leaf in leaves.items():
        own = [w for w in want if w[1] == i]
        name = hashlib.sha256(("salt|" + "".join(w[2] for w in own)).encode()).hexdigest()[:32]
        assert tuple(leaf[c] for c in ("leaf_hash", "first_key", "last_key", "n_entries", "n_bytes")) == (name, own[0][0], own[-1][0], len(own), sum(w[3] for w in own))


def test_wrong_keys_are_told(spark):
    twice = rows(spark, 50).unionByName(rows(spark, 50).where("_key = 'key000007'"))
    assert chunking.chunk(twice, SPEC, "", measure).wrong == ("key000007",)
    assert chunking.chunk(rows(spark, 0), SPEC, "", measure).leaves.count() == 0


def test_tree_is_closed_and_its_hash_follows_content(spark, monkeypatch):
    leaves = chunking.chunk(rows(spark, 2000), SPEC, "", measure).leaves
    small = chunking.Spec(pattern=0.2, least=64, target=256, most=512)
    root, edges = chunking.tree(spark, leaves, small, "empty")
    again, _ = chunking.tree(spark, chunking.chunk(rows(spark, 2000, parts=7), SPEC, "", measure).leaves, small, "empty")
    other, _ = chunking.tree(spark, chunking.chunk(rows(spark, 1999), SPEC, "", measure).leaves, small, "empty")
    assert root == again != other
    got = sorted(tuple(r) for r in edges.select("parent_hash", "ord", "child_hash", F.coalesce("separator", F.lit("-")), "level").collect())
    assert {r[2] for r in got} - {r[0] for r in got} == {r["leaf_hash"] for r in leaves.collect()}
    assert {r[0] for r in got} - {r[2] for r in got} == {root} and max(r[4] for r in got) > 1
    assert chunking.tree(spark, leaves.limit(0), small, "empty")[0] == "empty"
    # levels that are cut like a table give the same nodes
    monkeypatch.setattr(chunking, "DRIVER_NODES", 3)
    monkeypatch.setattr(chunking, "_partitions", lambda *_: 2)
    far, spread = chunking.tree(spark, leaves, small, "empty")
    assert far == root and sorted(tuple(r) for r in spread.select("parent_hash", "ord", "child_hash", F.coalesce("separator", F.lit("-")), "level").collect()) == got
    assert validate.node_problems(leaves.withColumnRenamed("leaf_hash", "node_hash"), spread.where("level = 1")).count() == 0


def test_keys_longer_than_a_node_end_the_tree(spark, monkeypatch):
    monkeypatch.setattr(chunking, "DRIVER_NODES", 3)
    level = spark.createDataFrame([(i, f"h{i}", f"{i:03}" + "k" * 600) for i in range(9)], "ord long, leaf_hash string, first_key string")
    root, edges = chunking.tree(spark, level, chunking.Spec(pattern=0.2, least=64, target=256, most=512), "empty")
    assert {r["parent_hash"] for r in edges.collect()} == {root} and edges.count() == 9
