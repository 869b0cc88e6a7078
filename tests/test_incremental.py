"""A batch cut into the leaves it touches gives what cutting the whole table gives."""

import bisect
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.operators import chunking, incremental
from palimpsest.sources.repository import Repository

SPEC = chunking.Spec(pattern=0.2, least=64, target=512, most=2048)
KIND = "id string, v string"


def test_runs_join_what_guards_reach():
    starts, ends = incremental.runs(np.array([0, 3, 4, 9]), np.array([1, 1, 2, 5]), 12)
    assert (starts.tolist(), ends.tolist()) == ([0, 3, 9], [1, 6, 11])


@pytest.mark.parametrize("parts", [1, 7])
def test_keys_fall_to_leaves(spark, parts):
    rng = random.Random(parts)
    last = sorted(rng.sample(range(1000, 9000), 60))
    wanted = [*rng.sample(range(1000, 9999), 25), last[3], last[-1], 9999, 1]
    leaves = spark.createDataFrame([(f"{k}", i) for i, k in enumerate(last)], "last_key string, ord long").repartition(parts)
    some = spark.createDataFrame([(f"{k:04}",) for k in wanted], "_key string")
    expected = {min(bisect.bisect_left(last, k), 59) for k in wanted}
    assert incremental.touched(leaves, some, 60).tolist() == sorted(expected)
    assert incremental.touched(leaves, some.limit(0), 60).tolist() == []


@pytest.fixture(scope="module")
def base(spark, tmp_path_factory):
    r = Repository.init(spark, str(tmp_path_factory.mktemp("inc")), "me", SPEC)
    d = r.draft()
    d.create_table("t", KIND, ["id"])
    d.insert_rows("t", frame(spark, rows(400)))
    d.commit("first")
    return r


def rows(n):
    return {f"{i * 2:05}": "x" * (i * 7 % 40) for i in range(n)}


def frame(spark, found):
    return spark.createDataFrame(list(found.items()), KIND)


BATCHES = {
    "nothing": ({}, []),
    "one value": ({"00400": "new"}, []),
    "longer value": ({"00400": "y" * 3000}, []),
    "before all and behind all": ({"0": "a", "zzz": "b" * 100}, []),
    "last entry of all gone": ({}, ["00798"]),
    "gone and not there": ({}, ["00003", "00004", "nowhere"]),
    "some": ({f"{i:05}": "z" * (i % 90) for i in range(101, 799, 97)}, [f"{i:05}" for i in range(0, 800, 122)]),
    "a stretch": ({f"{i:05}": "s" * (i % 30) for i in range(201, 301)}, [f"{i:05}" for i in range(400, 500, 2)]),
    "all gone": ({}, list(rows(400))),
}


@pytest.mark.parametrize(("name", "share"), [*((n, 1.0) for n in BATCHES), ("some", 0.0)])
def test_equals_a_rebuild(spark, base, monkeypatch, name, share):
    monkeypatch.setattr(incremental, "MOST_SHARE", share)
    batch, gone = BATCHES[name]
    d = base.draft()
    if gone:
        d.delete_rows("t", spark.createDataFrame([(g,) for g in gone], "id string"))
    d.insert_rows("t", frame(spark, batch) if batch else spark.createDataFrame([], KIND))
    assert "t" in d.patches and "t" not in d.changed
    want = {k: v for k, v in (rows(400) | batch).items() if k not in gone}
    assert {r["id"]: r["v"] for r in d._rows("t").collect()} == want
    got = base.snapshot_at(d.write())
    again = base.draft()
    again.replace_rows("t", frame(spark, want) if want else spark.createDataFrame([], KIND))
    whole = base.snapshot_at(again.write())
    assert got.root == whole.root
    assert {r["id"]: r["v"] for r in got.table("t").collect()} == want
    leaves = got.leaves("t").orderBy("ord").collect()
    assert [r["ord"] for r in leaves] == list(range(len(leaves))) and sum(r["n_entries"] for r in leaves) == len(want)
    assert got.problems().count() == 0


def test_guards_grow_until_cuts_agree(spark, tmp_path, monkeypatch):
    """Forced cuts agree late or never, so that guards have to grow."""
    spec, seen = chunking.Spec(pattern=0.0, least=64, target=1 << 40, most=400), []
    r = Repository.init(spark, str(tmp_path / "forced"), "me", spec)
    d = r.draft()
    d.create_table("t", KIND, ["id"])
    d.insert_rows("t", frame(spark, rows(300)))
    d.commit("first")
    monkeypatch.setattr(incremental, "MOST_SHARE", 1.0)
    real = incremental.runs
    monkeypatch.setattr(incremental, "runs", lambda *a: seen.append(1) or real(*a))
    d = r.draft()
    d.insert_rows("t", frame(spark, {"00101": "w" * 33}))
    root = d.write()
    again = r.draft()
    again.replace_rows("t", frame(spark, rows(300) | {"00101": "w" * 33}))
    assert len(seen) > 1 and root == again.write()


def test_batches_that_are_wrong_or_not_by_key(spark, base):
    d = base.draft()
    d.insert_rows("t", spark.createDataFrame([("a", "1"), ("a", "2")], KIND))
    with pytest.raises(ValueError, match="not unique"):
        d.write()
    d = base.draft()
    d.insert_rows("t", spark.createDataFrame([(None, "1")], KIND))
    with pytest.raises(ValueError, match="null"):
        d.write()
    d = base.draft()
    d.delete_rows("t", spark.createDataFrame([(4,)], "id long"))
    assert "t" in d.changed and "t" not in d.patches
    d = base.draft()
    d.insert_rows("t", frame(spark, {"a": "1"}))
    d.drop_table("t")
    d.create_table("t", KIND, ["id"])
    assert d._rows("t").count() == 0


def test_few_leaves_are_ranges_for_the_scan(base):
    some = base.snapshot().leaves("t").where(F.col("ord").isin(3, 4, 20))
    plan = base.snapshot().keyed("t", some)._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(_key" in plan
    assert base.snapshot().keyed("t", some).count() == some.agg(F.sum("n_entries")).first()[0]
