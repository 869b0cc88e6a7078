"""A small table with what operators must stand: nulls, empty and long texts, ties, repeated rows, clashing extra columns."""

from pathlib import Path

DATA = Path("/root/testdata/sf0.001")
LONG = ("lorem ipsum dolor sit amet " * 4000).strip()
TEXTS = [
    (0, "plain words stand here in one short line of text"),
    (1, None),
    (2, ""),
    (3, " \n\n \t"),
    (4, LONG),
    (5, "plain words stand here in one short line of text"),
    (5, "plain words stand here in one short line of text"),
    (None, "no id at all, but some words to look at"),
    (7, "é\U0001f600 ß Straße ñandú\nsecond line\n"),
    (8, 'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" Released under the MIT License.'),
]
EXTRA = "size int, piece string, section double, k string, score string, row string, shard int, text2 string"


def odd(spark, n_extra=True):
    rows = [(i, t, None if i == 2 else "en", None if i in (1, 7) else f"s{(i or 0) % 2}", None if t is None else len(t)) for i, t in TEXTS]
    kind = "doc_id long, text string, lang string, source string, n_chars long"
    if n_extra:
        rows, kind = [(*r, 1, "p", 0.5, "k", "s", "r", 2, None) for r in rows], f"{kind}, {EXTRA}"
    return spark.createDataFrame(rows, kind)


def empty(spark):
    return odd(spark).limit(0)


def documents(spark, sf="sf0.001"):
    return spark.read.parquet(f"{DATA.parent}/{sf}/documents.parquet")
