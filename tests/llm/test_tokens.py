from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from palimpsest.llm import common, tokens

from .odd import documents, empty, odd


def test_lines_against_the_tokenizers_own_offsets(spark):
    plain = Tokenizer.from_file(common.default_tokenizer())
    rows = tokens.count(documents(spark).limit(40), rule="first").collect()
    texts = {r["doc_id"]: r["text"] for r in documents(spark).limit(40).collect()}
    got = {}
    for r in rows:
        got.setdefault(r["doc_id"], []).append((r["section"], r["start"], r["end"], r["n_tokens"], r["doc_tokens"]))
    for i, text in texts.items():
        lines = text.splitlines(keepends=True) if "\r" not in text else None
        parts = sorted(got[i])
        assert "".join(text[s:e] for _, s, e, _, _ in parts) == text
        if lines:
            assert [text[s:e] for _, s, e, _, _ in parts] == text.split("\n")[:0] + [x + "\n" for x in text.split("\n")[:-1]] + ([text.split("\n")[-1]] if text.split("\n")[-1] else [])
        encoded = plain.encode(text, add_special_tokens=False)
        assert sum(p[3] for p in parts) == len(encoded.ids) == parts[0][4]
        if text.isascii():
            starts = [s for s, _ in encoded.offsets]
            assert [p[3] for p in parts] == [sum(s <= a < e for a in starts) for _, s, e, _, _ in parts]


def test_rules_on_a_crossing_token():
    ends = np.array([4, 10, 12])  # tokens [0,4) [4,10) [10,12)
    starts, stops = np.array([0, 6, 11]), np.array([6, 11, 12])
    first, crossing = tokens.attribute(ends, starts, stops, "first")
    most, _ = tokens.attribute(ends, starts, stops, "most")
    share, _ = tokens.attribute(ends, starts, stops, "share")
    assert first.tolist() == [2, 1, 0] and most.tolist() == [1, 2, 0] and crossing.tolist() == [1, 2, 1]
    assert np.allclose(share, [1 + 2 / 6, 4 / 6 + 0.5, 0.5]) and np.isclose(share.sum(), 3)


def test_sections_with_gaps(spark):
    docs = spark.createDataFrame([(1, "naïve text here", [(0, 5), (11, 15)]), (2, "abc", None), (3, None, [(0, 2)])], "doc_id long, text string, spans array<struct<a:int,b:int>>")
    rows = {(r["doc_id"], r["section"]): r for r in tokens.count(docs, sections_col="spans", rule="share").collect()}
    assert set(rows) == {(1, 0), (1, 1), (3, 0)} and rows[3, 0]["n_tokens"] == 0
    assert 0 < rows[1, 1]["n_tokens"] <= 1 and rows[1, 0]["n_tokens"] >= 1
    with pytest.raises(ValueError):
        tokens.count(docs, rule="last")


def test_odd_rows(spark):
    rows = tokens.count(odd(spark)).collect()
    none = [r for r in rows if r["doc_id"] in (1, 2)]
    assert len(none) == 2 and all((r["start"], r["end"], r["n_tokens"]) == (0, 0, 0) for r in none)
    assert len([r for r in rows if r["doc_id"] == 7]) == 2 and tokens.count(empty(spark)).count() == 0


def by_hand(text, spans, token_bytes, rule):
    """Every byte's section, then every token's, one by one."""
    n, owner = len(text.encode()), {}
    at = [len(text[:i].encode()) for i in range(len(text) + 1)]
    cut = [(i, at[min(max(s, 0), len(text))], at[min(max(e, 0), len(text))]) for i, (s, e) in enumerate(spans) if s is not None and e is not None]
    upto = 0
    for i, s, e in sorted(cut, key=lambda x: x[1]):
        owner |= dict.fromkeys(range(max(s, upto), e), i)
        upto = max(upto, e)
    out, first = [0.0] * len(spans), 0
    for size in token_bytes:
        held = Counter(owner.get(b, -1) for b in range(first, first + size))
        if rule == "share":
            for i, k in held.items():
                if i >= 0:
                    out[i] += k / size
        elif rule == "first":
            if owner.get(first, -1) >= 0:
                out[owner[first]] += 1
        else:
            best = max((i for i in held if i >= 0), key=lambda i: (held[i], -min(b for b in range(first, first + size) if owner.get(b) == i)), default=-1)
            if best >= 0 and (held[best] * 2 >= size or held[best] >= held[-1]):
                out[best] += 1
        first += size
    assert first == n
    return out


@pytest.mark.parametrize("rule", tokens.RULES)
def test_rules_against_every_byte_of_documents(spark, rule):
    """Chance sections, overlapping, out of order, beyond the text and without bounds, and the lines, of documents in all languages."""
    rng = np.random.default_rng(5)
    rows = [(r["doc_id"], r["text"][:1500]) for r in documents(spark).limit(70).collect() if r["text"]] + [(-1, "añé\U0001f600ñ ßß\n\nx")]
    spans = {i: [[int(x) for x in rng.integers(-3, len(t) + 4, 2)] for _ in range(rng.integers(1, 7))] + [[None, 4]] for i, t in rows}
    path = common.default_tokenizer()
    encode, lengths = common.encoder(path), tokens.byte_lengths(path)
    frame = spark.createDataFrame([(i, t, spans[i]) for i, t in rows], "doc_id long, text string, s array<array<int>>")
    frame = frame.withColumn("spans", F.transform("s", lambda x: F.struct(x[0].alias("a"), x[1].alias("b"))))
    given, lines = {}, {}
    for out, found in ((given, tokens.count(frame, sections_col="spans", rule=rule)), (lines, tokens.count(frame, rule=rule))):
        for r in found.collect():
            out.setdefault(r["doc_id"], {})[r["section"]] = (r["start"], r["end"], r["n_tokens"])
    for i, text in rows:
        sizes = lengths[encode(text)].tolist()
        for out, wanted in ((given[i], spans[i]), (lines[i], None)):
            sections = [[s, e] for _, (s, e, _) in sorted(out.items())]
            assert wanted is None or sections == wanted
            assert np.allclose([n for _, (_, _, n) in sorted(out.items())], by_hand(text, sections, sizes, rule))


def test_sections_that_are_null(spark):
    docs = spark.createDataFrame([(1, "some text", [None, (0, 4), (5, None)])], "doc_id long, text string, spans array<struct<a:int,b:int>>")
    assert [(r["start"], r["end"], r["n_tokens"] > 0) for r in tokens.count(docs, sections_col="spans").orderBy("section").collect()] == [(None, None, False), (0, 4, True), (5, None, False)]
