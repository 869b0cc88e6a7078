import itertools
import math
import re
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from palimpsest.llm import mixing

from .odd import documents, empty, odd


def shares(sizes):
    """The rule by hand: share by weight, stop at twice the size, share the excess anew."""
    weights = [(5, 2, 1)[i % 3] for i in range(len(sizes))]
    out, left, open_ = [0.0] * len(sizes), 1.5 * sum(sizes), set(range(len(sizes)))
    while open_ and left > 1e-9:
        total = sum(weights[i] for i in open_)
        over = [i for i in open_ if left * weights[i] / total > 2 * sizes[i] + 1e-9]
        if not over:
            for i in open_:
                out[i] = left * weights[i] / total
            break
        for i in over:
            out[i] = 2.0 * sizes[i]
            left -= out[i]
            open_.remove(i)
    return out


@settings(max_examples=12, deadline=None)
@given(st.lists(st.integers(0, 1000), min_size=1, max_size=8))
def test_targets(spark, sizes):
    frame = spark.createDataFrame([(f"=s{i}", n) for i, n in enumerate(sizes)], "src string, source_size long")
    got = {r["src"]: r["target"] for r in mixing.targets(frame).collect()}
    assert np.allclose([got[f"=s{i}"] for i in range(len(sizes))], shares(sizes))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 50), min_size=1, max_size=6), st.integers(1, 9), st.integers(0, 99))
def test_quotas_of_all_shards_tile_the_units(units, shards, seed):
    units = np.array(units)
    got = [mixing.shard_quotas(units, shards, s, seed) for s in range(shards)]
    at = np.zeros(len(units), int)
    for first, n in got:
        assert (first == at).all() and (n >= 0).all()
        at = first + n
    assert (at == units).all()
    totals = [int(n.sum()) for _, n in got]
    assert max(totals) - min(totals) <= 1


def test_mix_meets_its_targets(spark):
    docs = documents(spark, "sf0.01")
    rows = mixing.mix(docs, block_words=2000, shard_words=50_000).collect()
    texts = {r["doc_id"]: r for r in docs.collect()}
    assert len(rows) == len(texts)
    per = {}
    for r in rows:
        text = texts[r["doc_id"]]
        assert r["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", text["text"])) and 0 <= r["copies"] <= 2 and len(r["shards"]) == r["copies"]
        s = per.setdefault(text["source"], [0, 0, r["target"], r["source_size"]])
        s[0] += r["size"]
        s[1] += r["size"] * r["copies"]
    order = sorted(per)
    assert np.allclose([per[s][2] for s in order], shares([per[s][0] for s in order]))
    assert all(abs(taken - target) <= max(30, 0.01 * target) and size == said for size, taken, target, said in per.values())
    again = {r["doc_id"]: r["shards"] for r in mixing.mix(docs, block_words=2000, shard_words=50_000).collect()}
    assert again == {r["doc_id"]: r["shards"] for r in rows}
    made = mixing.shards(docs, block_words=2000, shard_words=50_000)
    assert made.count() == sum(r["copies"] for r in rows) and made.columns == [*docs.columns, "_shard"]
    assert made.select("_shard").distinct().count() > 3


def test_odd_rows(spark):
    rows = mixing.mix(odd(spark)).collect()
    assert len(rows) == 10 and sum(r["size"] == 0 for r in rows) == 3
    assert mixing.shards(odd(spark)).columns == [*odd(spark).columns, "_shard"]
    named = odd(spark).withColumnRenamed("size", "_shard")
    assert mixing.shards(named).columns == [*named.columns, "_shard_"] and mixing.shards(named).select(named.columns).count() == mixing.shards(odd(spark)).count()
    assert mixing.mix(empty(spark)).count() == 0
    none = odd(spark).withColumn("text", F.lit(None).cast("string"))
    assert all(r["target"] == 0 for r in mixing.mix(none).collect())


def test_documents_longer_than_the_remainder_are_passed_over(spark):
    # one source, target 1.5 x its words: a whole pass, and a rest that the long document does not fit into
    for long in (300_000, 70_000):
        docs = spark.createDataFrame([(i, "s", "w " * (long if i == 77 else 1 + i % 200)) for i in range(1200)], "doc_id long, source string, text string")
        for seed in (1, 2, 3):
            rows = mixing.mix(docs, block_words=4000, seed=seed).collect()
            target = rows[0]["target"]
            fit = sum(r["size"] for r in rows if r["size"] < 1000)
            want = min(target, sum(r["size"] for r in rows) + fit) if long == 300_000 else target
            assert abs(sum(r["size"] * r["copies"] for r in rows) - want) <= 1


def test_draws_follow_the_multivariate_hypergeometric_law():
    """A shard's counts over many seeds against their exact means, and against the law itself by chi-square."""
    units, shards, n = np.array([6, 3, 1]), 4, 4000
    draws = np.array([mixing.shard_quotas(units, shards, 2, seed)[1] for seed in range(n)])
    size = int(draws[0].sum())
    assert (draws.sum(1) == size).all()
    assert np.allclose(draws.mean(0), units * size / units.sum(), atol=0.05)
    whole = math.comb(int(units.sum()), size)
    law = {k: math.prod(math.comb(int(u), j) for u, j in zip(units, k, strict=True)) / whole for k in itertools.product(*(range(min(u, size) + 1) for u in units)) if sum(k) == size}
    seen = Counter(map(tuple, draws.tolist()))
    assert set(seen) <= set(law)
    chi = sum((seen[k] - n * p) ** 2 / (n * p) for k, p in law.items())
    assert chi < len(law) - 1 + 4 * math.sqrt(2 * (len(law) - 1))


def test_many_sources_are_dealt_out_by_order(spark, monkeypatch):
    docs = documents(spark, "sf0.01")
    want = {r["doc_id"]: (r["target"], r["copies"]) for r in mixing.mix(docs, block_words=2000, shard_words=50_000).collect()}
    monkeypatch.setattr(mixing, "MOST_SOURCES", 0)
    rows = mixing.mix(docs, block_words=2000, shard_words=50_000).collect()
    assert {r["doc_id"]: (r["target"], r["copies"]) for r in rows} == want
    units = spark.createDataFrame([(f"={s}", u) for s, n in (("a", 50), ("b", 7), ("c", 1)) for u in range(n)], "src string, unit long")
    got = mixing._by_order(units, 5, 3).collect()
    assert len({(r["src"], r["unit"]) for r in got}) == 58
    assert sorted(Counter(r["shard"] for r in got).values()) == [11, 11, 12, 12, 12]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=9), st.integers(0, 120))
def test_best_subset_against_all_subsets(words, rest):
    found = mixing.best_subset(words, rest)
    assert len(set(found)) == len(found)
    want = max(sum(c) for k in range(len(words) + 1) for c in itertools.combinations(words, k) if sum(c) <= rest)
    assert sum(words[i] for i in found) == want


def test_best_subset_of_long_texts_is_bounded_and_close():
    words = [7 * 10**7 + 13 * i for i in range(40)]
    rest = 10**9
    got = sum(words[i] for i in mixing.best_subset(words, rest))
    assert rest - 8 * 10**7 < got <= rest
