import hashlib

from palimpsest.llm import fingerprint

from .odd import documents, empty, odd


def test_odd_rows(spark):
    rows = fingerprint.with_edits(odd(spark)).collect()
    assert len(rows) == 10
    by = {r["doc_id"]: r for r in rows}
    assert by[0]["fingerprint"] == by[5]["fingerprint"] and by[1]["fingerprint"] == by[2]["fingerprint"]
    assert set(by[2]["fingerprint"]) == {"_", "-"} and by[1]["n_chars"] == 0 and by[1]["near_next"] == 1.0
    # the null id is last, and followed by the first
    text = "no id at all, but some words to look at"
    want = text[: len(text) - len(text) // 4] + "plain words stand here in one short line of text"[: len(text) // 4]
    assert by[None]["edited_sha256"] == hashlib.sha256(want.encode()).hexdigest()
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in rows)
    assert fingerprint.with_edits(empty(spark)).count() == 0


def test_one_document_follows_itself(spark):
    r = fingerprint.with_edits(spark.createDataFrame([(1, "abcdefgh")], "doc_id long, text string")).first()
    assert r["edited_sha256"] == hashlib.sha256(b"abcdefab").hexdigest() and r["near_next"] == 1.0


def test_likeness_tells_copies_from_others(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    r = fingerprint.with_edits(docs).selectExpr("avg(near_edited) as e", "avg(near_next) as n", "count(*) as c").first()
    assert r["c"] == docs.count() and r["e"] > 0.2 and r["n"] < 0.1


def test_large_lexicons_are_not_broadcast(spark, monkeypatch):
    small = [tuple(r) for r in fingerprint.with_edits(odd(spark)).orderBy("doc_id", "fingerprint").collect()]
    monkeypatch.setattr(fingerprint, "MOST_BROADCAST", -1)
    assert [tuple(r) for r in fingerprint.with_edits(odd(spark)).orderBy("doc_id", "fingerprint").collect()] == small


def test_short_texts_have_prints_of_their_own(spark, monkeypatch):
    # two terms in each text, all in the band; most fall into none of the thin subsets
    docs = spark.createDataFrame([(i, f"left{i // 2} right{(i + 1) // 2}") for i in range(60)] + [(60, "")], "doc_id long, text string")
    words = fingerprint.lexicon(docs, high=0.9)
    for most in (fingerprint.MOST_BROADCAST, -1):
        monkeypatch.setattr(fingerprint, "MOST_BROADCAST", most)
        prints = {r["doc_id"]: r["text_print"] for r in fingerprint.fingerprint(docs, words, ["text"], key="doc_id").collect()}
        assert len(set(prints.values())) == 61 and [i for i, p in prints.items() if set(p) == {"_", "-"}] == [60]


def test_ids_and_texts_that_run_into_each_other(spark):
    docs = spark.createDataFrame([("a:b", "c d e f"), ("a", "b:c d e f"), ("z", "other words entirely"), ("-", "same"), (None, "same")], "doc_id string, text string")
    rows = fingerprint.with_edits(docs).collect()
    assert sorted((r["doc_id"] or "", r["n_chars"]) for r in rows) == [("", 4), ("-", 4), ("a", 9), ("a:b", 7), ("z", 20)]


def test_unrelated_short_texts_share_no_print(spark):
    docs = spark.createDataFrame([(i, f"w{i * 7 % 101} v{i * 13 % 103} u{i}") for i in range(500)], "doc_id long, text string")
    rows = fingerprint.with_edits(docs).collect()
    assert len({r["fingerprint"] for r in rows}) == 500


def test_both_lookups_agree_on_documents(spark, monkeypatch):
    docs = documents(spark)
    want = sorted(tuple(r) for r in fingerprint.with_edits(docs).collect())
    monkeypatch.setattr(fingerprint, "MOST_BROADCAST", -1)
    assert sorted(tuple(r) for r in fingerprint.with_edits(docs).collect()) == want
