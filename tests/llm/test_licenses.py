from math import ceil, comb

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.llm import licenses
from palimpsest.llm.sql import SQL

from .odd import DATA, documents, empty, odd
from .test_sql import same_rows


def test_bands_guarantee():
    for c in licenses.classes():
        assert comb(c.n - ceil(licenses.CONTAINMENT * c.least), c.k) / comb(c.n, c.k) <= licenses.MISS
        assert c.n == 2 * c.words - licenses.SHINGLE + 1


def test_every_template_is_found_at_every_place(spark):
    filler = [f"word{i}" for i in range(400)]
    rows, want = [], set()
    for n, (name, text) in enumerate(licenses.TEMPLATES.items()):
        for place in (0, 1, 7, 63, 130):
            doc = n * 1000 + place
            rows.append((doc, " ".join([*filler[:place], text.upper(), *filler[place : place + 150]])))
            want.add((doc, name))
    found = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    whole = {(r["doc_id"], r["template"]) for r in found if r["containment"] == 1.0}
    assert want <= whole
    assert all(r["first_word"] == r["doc_id"] % 1000 for r in found if (r["doc_id"], r["template"]) in want)


def test_part_of_a_template_under_the_threshold(spark):
    text = licenses.TEMPLATES["isc"].split()
    rows = spark.createDataFrame([(1, " ".join(text[:12])), (2, " ".join(text[:30]))], "doc_id long, text string")
    assert [r["doc_id"] for r in licenses.scan(rows).collect()] == [2]


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
def test_query_equals_brute_force(spark):
    same_rows(spark, "op5_license_scans", SQL["op5_license_scans"])


def test_odd_rows_and_no_templates(spark):
    assert [(r["doc_id"], r["template"]) for r in licenses.scan(odd(spark)).collect()] == [(8, "mit-notice")]
    assert licenses.scan(empty(spark)).count() == 0
    assert licenses.scan(documents(spark), templates={}).count() == 0


def test_templates_beside_repeated_filler(spark):
    # some of these one-word fillers have a shingle hash below all of a template's
    names = ("isc", "mpl-2.0", "bsd-3-clause-endorsement", "unlicense")
    rows = [(n * 1000 + f, " ".join([*[f"fill{f}"] * 70, licenses.TEMPLATES[name], *[f"fill{f}"] * 70])) for n, name in enumerate(names) for f in range(300)]
    found = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r["doc_id"] // 1000, r["doc_id"] % 1000) for r in found if r["template"] == names[r["doc_id"] // 1000] and r["containment"] == 1.0} == {(n, f) for n in range(4) for f in range(300)}


def test_recall_of_edited_templates(spark):
    """Templates with replaced words, at chance places in text: all that still reach the containment are found, for any number of templates."""
    rng = np.random.default_rng(8)
    rows = []
    for n, text in enumerate(licenses.TEMPLATES.values()):
        for i in range(25):
            words = text.split()
            for place in rng.integers(0, len(words), rng.integers(0, 1 + len(words) // 25)):
                words[place] = f"new{place}"
            lead = [f"w{x}" for x in rng.integers(0, 5000, rng.integers(0, 200))]
            rows.append((n * 100 + i, " ".join([*lead, *words, *lead[::-1]])))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    shingled = lambda f, c: f.select(c, licenses.shingles(licenses.words(F.col("text"))).alias("s")).collect()
    own = {r["name"]: set(r["s"]) for r in shingled(spark.createDataFrame(list(licenses.TEMPLATES.items()), "name string, text string"), "name")}
    want = {(r["doc_id"], name) for r in shingled(docs, "doc_id") for name, t in own.items() if len(t & set(r["s"])) / len(t) >= licenses.CONTAINMENT}
    got = {(r["doc_id"], r["template"]) for r in licenses.scan(docs).collect()}
    assert got <= want and len(got) >= 0.995 * len(want) and len(want) > 300


def test_many_templates_are_joined(spark, monkeypatch):
    rows = [(i, f"some words before it {t} and some words behind it {t if i % 3 else ''}") for i, t in enumerate(licenses.TEMPLATES.values())]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted(tuple(r) for r in licenses.scan(docs).collect())
    monkeypatch.setattr(licenses, "MOST_SHINGLES", 10)
    assert sorted(tuple(r) for r in licenses.scan(docs).collect()) == want and len(want) >= len(rows)
    assert [(r["doc_id"], r["template"]) for r in licenses.scan(odd(spark)).collect()] == [(8, "mit-notice")]
