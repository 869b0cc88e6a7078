from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from palimpsest.llm import components, neardup, shingles

from .odd import documents, empty, odd


def weighted_set(text):
    words = "".join(c.lower() if c.isascii() else c for c in text or "").split()
    return Counter(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else Counter()


def j_p(a, b):
    return sum(1 / sum(max(a[e] / a[d], b[e] / b[d]) for e in a.keys() | b.keys()) for d in a.keys() & b.keys())


def brute(texts, threshold=0.8):
    sets, root = [weighted_set(t) for t in texts], list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            common = sum((sets[i] & sets[j]).values())
            if (texts[i] or "") == (texts[j] or "") or (common and j_p(sets[i], sets[j]) >= threshold):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(texts))]


def test_exact_similarity():
    rng = np.random.default_rng(0)
    for _ in range(40):
        a = " ".join(rng.choice(list("abc"), 30))
        b = " ".join([*a.split()[: rng.integers(0, 30)], *rng.choice(list("abc"), 10)])
        _, k, n, at = shingles.weighted(pa.array([a, b]))
        assert np.isclose(neardup.probability_jaccard(k[: at[1]], n[: at[1]], k[at[1] :], n[at[1] :]), j_p(weighted_set(a), weighted_set(b)))


def test_registers_agree_with_probability_j_p():
    base = [f"w{i}" for i in range(200)]
    texts = [" ".join(base), " ".join(base[:160] + ["x", "y"] * 20), " ".join(base * 3)]
    row, keys, counts, at = shingles.weighted(pa.array(texts))
    held = neardup.prob_minhash(row, keys, counts, 3, 4096)
    for i, j in ((0, 1), (0, 2)):
        want = j_p(weighted_set(texts[i]), weighted_set(texts[j]))
        assert abs((held[i] == held[j]).mean() - want) < 0.03


def test_signature_does_not_depend_on_neighbours():
    texts = ["one two three four five six seven", "", "a b", "one two three four five six seven"]
    row, keys, counts, _ = shingles.weighted(pa.array(texts))
    held = neardup.prob_minhash(row, keys, counts, 4, 64)
    row, keys, counts, _ = shingles.weighted(pa.array(texts[3:]))
    assert (held[0] == held[3]).all() and (held[3] == neardup.prob_minhash(row, keys, counts, 1, 64)[0]).all() and (held[1] == 0).all()


def test_words():
    data, at = np.frombuffer(b"Ab  cd\n\xc3\xa9 x", np.uint8), np.array([0, 2, 2, 7, 11])
    words, of = shingles.word_hashes(data, at)
    assert of.tolist() == [0, 1, 1, 2, 4]
    other, _ = shingles.word_hashes(np.frombuffer(b"aB cd", np.uint8), np.array([0, 5]))
    assert words[0] == other[0] and words[1] == other[1]


def test_components(spark):
    rng = np.random.default_rng(3)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 400, (250, 2))] + [(i, i + 1) for i in range(1000, 1060)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {r["key"]: r["root"] for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: find(x) for x in list(root) if find(x) != x}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("sf", ["sf0.001"])
def test_classes_are_those_of_brute_force(spark, sf):
    rows = documents(spark, sf).orderBy("doc_id").collect()
    want = [rows[i]["doc_id"] for i in brute([r["text"] for r in rows])]
    got = {r["doc_id"]: r["class_id"] for r in neardup.classes(documents(spark, sf)).collect()}
    assert [got[r["doc_id"]] for r in rows] == want and len(set(want)) < len(want)


@pytest.mark.parametrize(("strays", "block"), [(256, 2048), (3, 5)])
def test_a_group_of_many_near_copies(spark, monkeypatch, strays, block):
    """Copies with up to a dozen changed words: most pairs of them are just above or below the threshold."""
    monkeypatch.setattr(neardup, "BLOCK_STRAYS", strays)
    monkeypatch.setattr(neardup, "BLOCK_ROWS", block)
    rng = np.random.default_rng(6)
    base = [f"word{i}" for i in range(150)]
    texts = []
    for n in range(90):
        words = list(base)
        for place in rng.integers(0, 150, rng.integers(0, 7)):
            words[place] = f"new{n}x{place}"
        texts.append(" ".join(words))
    got = {r["doc_id"]: r["class_id"] for r in neardup.classes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    want = brute(texts)
    assert len(set(want)) > 3 and [got[i] for i in range(len(texts))] == want


def test_odd_rows(spark):
    got = {}
    for r in neardup.classes(odd(spark)).collect():
        got.setdefault(r["doc_id"], set()).add((r["class_id"], r["kept"]))
    assert got[0] == {(0, True)} and got[5] == {(0, False)} and got[1] == {(1, True)} and got[2] == {(1, False)}
    assert got[3] == {(3, True)} and got[None] == {(None, True)}
    kept = neardup.deduplicate(odd(spark))
    assert kept.columns == odd(spark).columns and kept.count() == 7
    assert neardup.classes(empty(spark)).count() == 0 and neardup.deduplicate(empty(spark)).count() == 0
    assert neardup.deduplicate(odd(spark).withColumnRenamed("row", "_row")).columns.count("_row") == 1


def test_one_of_equal_rows_is_kept(spark):
    docs = spark.createDataFrame([(0, "a text of some words"), (0, "a text of some words"), (1, "a text of some words"), (None, "-"), (None, "-")], "doc_id long, text string")
    rows = neardup.classes(docs).collect()
    assert len(rows) == 5 and {r["class_id"] for r in rows if r["kept"]} == {None, 0} and sum(r["kept"] for r in rows) == 2
    assert neardup.deduplicate(docs).count() == 2


def test_long_data_is_hashed_in_parts(monkeypatch):
    rng = np.random.default_rng(1)
    text = " ".join("x" * int(n) for n in rng.integers(1, 30, 3000)) + " " + "y" * 700 + "  end"
    data = np.frombuffer(text.encode(), np.uint8)
    at = np.array([0, 10, 10, 20_000, len(data)])
    whole, places = shingles.word_hashes(data, at)
    monkeypatch.setattr(shingles, "SLICE_BYTES", 64)
    parts, same = shingles.word_hashes(data, at)
    assert (whole == parts).all() and (places == same).all()
