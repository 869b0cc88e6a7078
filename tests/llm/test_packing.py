import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from palimpsest.llm import common, packing

from .odd import documents, empty, odd

_plain = None


def check_layout(rows, capacity):
    at = defaultdict(list)
    for r in rows:
        at[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in at.values():
        end = 0
        for offset, n in sorted(parts):
            assert offset == end
            end += n
        assert 0 < end <= capacity
    return len(at)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=80))
def test_best_fit_and_its_bound(lengths):
    n = np.array(lengths, np.int64)
    bins, offsets = packing.best_fit_decreasing(n, 64)
    used = bins.max() + 1 if len(n) else 0
    assert packing.lower_bound(n, 64) <= used
    assert packing.lower_bound(n, 64) >= -(-n.sum() // 64)
    for b in range(used):
        at = np.flatnonzero(bins == b)
        at = at[np.argsort(offsets[at])]
        assert offsets[at].tolist() == np.concatenate([[0], np.cumsum(n[at])[:-1]]).tolist() and n[at].sum() <= 64


def test_bound_never_exceeds_the_optimum():
    def optimum(items, room):
        items = sorted(items, reverse=True)

        def fits(i, free, k):
            if i == len(items):
                return True
            tried = set()
            for b in range(k):
                if free[b] >= items[i] and free[b] not in tried:
                    tried.add(free[b])
                    free[b] -= items[i]
                    if fits(i + 1, free, k):
                        return True
                    free[b] += items[i]
            return False

        return next(k for k in range(len(items) + 1) if fits(0, [room] * k, k))

    rng = np.random.default_rng(2)
    for _ in range(60):
        items = rng.integers(1, 21, rng.integers(1, 9))
        assert packing.lower_bound(items, 20) <= optimum(items.tolist(), 20)


def test_cut():
    assert packing.cut(10, 10) == [(0, 10)] and packing.cut(25, 10) == [(0, 5), (5, 10), (15, 10)] and packing.cut(20, 10) == [(0, 10), (10, 10)]


def test_tokens_are_those_of_the_tokenizer(spark):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(common.default_tokenizer())
    encode = common.encoder(common.default_tokenizer())
    texts = [r["text"] or "" for r in documents(spark, "sf0.01").collect()] + ["", " ", "a <|endoftext|> b", "é\U0001f600 ñ\n\n x"]
    assert [encode(t) for t in texts] == [e.ids for e in plain.encode_batch(texts, add_special_tokens=False)]


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=60), st.lists(st.sampled_from([" ", "  ", "\n", "\t", "\r\n", "'s", "'LL", "don't", "é", "ñ", "\u00a0", "\u200b", "\U0001f600", "12", "٣", "a", "The", "<|endoftext|>", "<|", "…", "ſ"]), max_size=20).map("".join)))
def test_tokens_of_any_text(text):
    from tokenizers import Tokenizer

    global _plain
    _plain = _plain or Tokenizer.from_file(common.default_tokenizer())
    assert common.encoder(common.default_tokenizer())(text) == _plain.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("per_partition", [10_000, 25])
def test_all_documents_are_packed(spark, per_partition):
    docs = documents(spark)
    rows = packing.best_fit(docs, keep_ids=True, per_partition=per_partition, rounds=2).collect()
    n = check_layout(rows, 1024)
    encode = common.encoder(common.default_tokenizer())
    ids = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r["doc_id"], r["piece"])):
        assert r["start"] == len(ids[r["doc_id"]]) and r["length"] == len(r["ids"]) and (r["piece"] == 0 or r["length"] == 1024)
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4"))
        ids[r["doc_id"]] += r["ids"]
    assert dict(ids) == {r["doc_id"]: [*encode(r["text"]), 2] for r in docs.collect()}
    assert n <= 1.1 * sum(map(len, ids.values())) / 1024 + 1


def test_exchange_never_needs_more(spark):
    rng = np.random.default_rng(4)
    staged = spark.createDataFrame([(i, 0, 0, int(n), 0) for i, n in enumerate(rng.integers(300, 700, 400))], "doc_id long, piece int, start long, length long, ids_crc32 long")
    before = check_layout(packing.pack(staged, per_partition=50, rounds=0).collect(), 1024)
    after = packing.pack(staged, per_partition=50, rounds=2).collect()
    assert check_layout(after, 1024) <= before and sorted(r["doc_id"] for r in after) == list(range(400))


def test_odd_rows(spark):
    rows = packing.best_fit(odd(spark)).collect()
    check_layout(rows, 1024)
    per = defaultdict(int)
    for r in rows:
        per[r["doc_id"]] += r["length"]
    assert per[1] == per[2] == 1 and per[5] == 2 * per[0] and None in per
    assert packing.best_fit(empty(spark)).count() == 0


@pytest.mark.parametrize("n", [400, 450])
def test_exchange_closes_gaps_and_its_certificates_hold(spark, n):
    rng = np.random.default_rng(4)
    lengths = rng.integers(200, 500, n)
    staged = spark.createDataFrame([(i, 0, 0, int(x), 0) for i, x in enumerate(lengths)], "doc_id long, piece int, start long, length long, ids_crc32 long")
    before = check_layout(packing.pack(staged, per_partition=50, rounds=0).collect(), 1024)
    rows = packing.pack(staged, per_partition=50).collect()
    after = check_layout(rows, 1024)
    assert after < before and sorted(r["doc_id"] for r in rows) == list(range(n))
    held = defaultdict(list)
    for r in rows:
        held[r["partition"]].append(r)
    for own in held.values():
        bins = len({r["sequence_id"] for r in own})
        assert {(r["partition_bins"], r["partition_bound"]) for r in own} == {(bins, packing.lower_bound(np.array([r["length"] for r in own]), 1024))}


def test_cohorts():
    assert packing.cohorts([(3, 10)], 100) == {} and packing.cohorts([], 100) == {}
    assert packing.cohorts([(i, 40) for i in range(5)], 100) == {0: 0, 1: 0, 2: 1, 3: 1, 4: 1}
    assert packing.cohorts([(0, 90), (1, 90), (2, 90)], 100) == {0: 0, 1: 0, 2: 0}
