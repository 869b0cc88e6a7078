"""The pipeline against its stages done by hand."""

import pytest

import corpus_pipeline
from palimpsest.llm import common, mixing, neardup, packing, quality, secrets

from .odd import DATA, documents, empty, odd
from .test_neardup import brute
from .test_packing import check_layout


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
def test_stages(spark, tmp_path):
    sf = str(DATA)
    docs, kept = documents(spark), {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf).write.parquet(str(tmp_path / str(i)))
        out = spark.read.parquet(str(tmp_path / str(i)))
        if i < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == documents(spark).columns
        kept[name] = (docs, out)
        docs = out
    names = [n for n, _ in corpus_pipeline.STAGES]

    before, after = kept[names[0]]
    model = quality.train(before, common.table(spark, sf, "labels"))
    good = {r["doc_id"] for r in quality.score(before, model).where("predicted = 1").collect()}
    assert {r["doc_id"] for r in after.collect()} == good and len(good) < before.count()

    before, after = kept[names[1]]
    rows = before.orderBy("doc_id").collect()
    assert sorted(r["doc_id"] for r in after.collect()) == sorted({rows[i]["doc_id"] for i in brute([r["text"] for r in rows])})

    before, after = kept[names[2]]
    texts = {r["doc_id"]: r["text"] for r in before.collect()}
    net = secrets.default_net()
    for r in after.collect():
        ((_, every, _),) = secrets.find([texts[r["doc_id"]]], net)
        assert r["text"] == secrets.cut_out(texts[r["doc_id"]], every) and r["n_chars"] == len(r["text"])

    before, after = kept[names[3]]
    want = sorted(r["doc_id"] for r in mixing.mix(before).collect() for _ in range(r["copies"]))
    assert sorted(r["doc_id"] for r in after.collect()) == want

    before, after = kept[names[4]]
    check_layout(after.collect(), packing.CAPACITY)
    encode = common.encoder(common.default_tokenizer())
    assert sum(r["length"] for r in after.collect()) == sum(len(encode(r["text"])) + 1 for r in before.collect())


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
def test_run_gives_the_last_stage(spark):
    rows = corpus_pipeline.run(spark, str(DATA)).collect()
    check_layout(rows, packing.CAPACITY)
    assert neardup.THRESHOLD == 0.8


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
@pytest.mark.parametrize("make", [odd, empty])
def test_stages_stand_odd_rows(spark, tmp_path, make):
    """Nulls, empty and long texts, repeated rows, an empty table, and extra columns with the names that stages use themselves."""
    docs = make(spark).withColumnsRenamed({"size": "_shard", "row": "_row", "k": "copies", "section": "doc"})
    columns = docs.columns
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(DATA))
        last = i == len(corpus_pipeline.STAGES) - 1
        assert last or out.columns == columns
        out.write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        assert bool(docs.count()) == (make is odd)
    check_layout(docs.collect(), packing.CAPACITY)
