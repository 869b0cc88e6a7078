import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from palimpsest.llm import quality

from .odd import DATA, documents, empty, odd


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(1)
    lengths = [1, 4, 2, 6]
    doc = np.repeat(np.arange(4), lengths)
    good, transition = rng.normal(0, 2, len(doc)), rng.normal(0, 1, (2, 2))
    p, pairs = quality.marginals(good, transition, doc)
    want, want_pairs = np.zeros(len(doc)), np.zeros((2, 2))
    for d in range(4):
        at = np.flatnonzero(doc == d)
        total, seen, both = 0.0, np.zeros(len(at)), np.zeros((2, 2))
        for y in itertools.product((0, 1), repeat=len(at)):
            w = np.exp(sum((good[i] / 2 if a else -good[i] / 2) for i, a in zip(at, y, strict=True)) + sum(transition[a, b] for a, b in itertools.pairwise(y)))
            total += w
            seen += w * np.array(y)
            for a, b in itertools.pairwise(y):
                both[a, b] += w
        want[at], want_pairs = seen / total, want_pairs + both / total
    assert np.allclose(p, want) and np.allclose(pairs, want_pairs)


def test_long_chains_stay_finite():
    p, _ = quality.marginals(np.full(50_000, 40.0), np.array([[3.0, -3], [-3, 3]]), np.zeros(50_000, int))
    assert np.isfinite(p).all() and p.min() > 0.99


def test_lines_and_their_neighbours():
    x, doc, size = quality.features(pa.array(["a b\nA B!\n\nA B!", None, "x"]))
    assert doc.tolist() == [0, 0, 0, 0, 1, 2] and size.tolist() == [3, 4, 0, 4, 0, 1]
    x, _, _ = quality.features(pa.array(["same line\nsame line\nother"]))
    assert x[:, -4:].tolist() == [[0, 1, 0, 1], [1, 0, 1, 1], [0, 0, 1, 0]]


def test_held_out_accuracy(spark):
    docs = documents(spark, "sf0.01")
    labels = spark.read.parquet(f"{DATA.parent}/sf0.01/labels.parquet")
    model = quality.train(docs, labels)
    rows = quality.score(docs, model).join(labels, "doc_id").where("held_out").collect()
    assert len(rows) > 50
    assert np.mean([r["predicted"] == r["quality"] for r in rows]) >= 0.95
    assert np.mean([r["predicted"] for r in rows if r["quality"] == 1]) >= 0.97
    # labels of held-out rows are never learnt: turning them around changes nothing
    turned = labels.withColumn("quality", F.when(quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert np.array_equal(quality.train(docs, turned).weights, model.weights)
    odds = quality.score(odd(spark), model).collect()
    assert len(odds) == 10 and all(0 <= r["score"] <= 1 for r in odds)
    same = {r["doc_id"]: r["score"] for r in odds}
    assert same[1] == same[2] and same[0] == same[5]
    assert quality.score(empty(spark), model).count() == 0
    kept = quality.keep_good(odd(spark), model)
    assert kept.columns == odd(spark).columns


def test_without_labels_all_get_a_half(spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    rows = quality.score(odd(spark), quality.train(odd(spark), none)).collect()
    assert all(abs(r["score"] - 0.5) < 1e-6 for r in rows)
    one = spark.createDataFrame([(i, 1) for i in range(9)], "doc_id long, quality int")
    assert all(r["score"] > 0.99 for r in quality.score(odd(spark), quality.train(odd(spark), one)).collect())


def test_one_long_document_does_not_end_the_sample(spark):
    ids = spark.range(200).where(~quality.held_out(F.col("id"))).orderBy(F.xxhash64("id")).limit(41)
    ids = [r["id"] for r in ids.collect()]
    texts = {i: "a plain line of words that goes on." if i % 2 else "@@ ## 17 || !!" for i in ids}
    docs = [(i, "\n".join([texts[i]] * (300 if k == 0 else 2))) for k, i in enumerate(ids)]
    labels = spark.createDataFrame([(i, i % 2) for i in ids], "doc_id long, quality int")
    models = [quality.train(spark.createDataFrame(rows, "doc_id long, text string"), labels, most_lines=100) for rows in (docs, docs[1:])]
    assert np.array_equal(models[0].weights, models[1].weights)
    scored = [r["score"] for r in quality.score(spark.createDataFrame([(1, texts[i]) for i in ids], "doc_id long, text string"), models[0]).collect()]
    assert max(scored) - min(scored) > 0.5
