"""License scans, with DataFrame functions only.

Documents and templates are runs of words (lower case, split at all but letters and digits) and of
five-word shingles. Templates come in classes by length; longer ones are cut into overlapping parts
of the largest class. For each class, a document's overlapping windows are twice the class's words
long and advance by its words, so that every part lies whole in one window. The MinHash signature of a
window, as of a part, is its ``k`` lowest distinct shingle hashes; each is a band of one row, and a
window and a part that share a band are a candidate. A part has at most k shingles, so its signature
holds them all. If the window holds ``CONTAINMENT`` of the part's t shingles, that is s = ceil(0.8 t) of
the window's n, all of them miss the window's signature with probability C(n - s, k) / C(n, k): ``bands``
picks k so that this is at most ``MISS`` for the shortest part of the class.

A retrieved template is verified exactly: the share of its distinct shingles that the document
holds. The templates' hashes are constants of the plan, and every document is one row throughout:
nothing is shuffled or collected, whatever the documents hold. Of very many templates (over
``MOST_SHINGLES`` distinct shingles) the signatures are a table, and meet those of the documents in joins.

Null and empty texts, and texts of under five words, match nothing. A document has one row for each
template it matches; repeated rows have theirs each. A long text is one row, with windows to its end. An
empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from math import ceil, comb

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import common

SEPARATOR = r"[^\p{L}\p{N}]+"
SHINGLE = 5
CLASSES = (8, 16, 64)
MISS = 1e-3
CONTAINMENT = 0.8
#: Hash buckets of the first look-up; their bits are constants of the plan.
BITS = 1 << 16
#: The hashes of templates with so many distinct shingles together travel in the plan; more are joined.
MOST_SHINGLES = 20_000

# Notices, opening paragraphs and short licenses as they are worded.
TEMPLATES: dict[str, str] = {
    "mit-notice": "Released under the MIT License.",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "gpl-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "cc-by-nc-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "bsd-2-clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd-3-clause-endorsement": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "gpl-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "mit-disclaimer": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    "unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
}


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), SEPARATOR), "")


def shingles(found: Column) -> Column:
    """Hashes of all runs of five words, in order; empty where there are fewer words."""
    n = F.size(found)
    run = F.transform(F.sequence(F.lit(0), F.greatest(n - SHINGLE, F.lit(0))), lambda i: F.xxhash64(*[F.get(found, i + j) for j in range(SHINGLE)]))
    return F.when(n >= SHINGLE, run).otherwise(F.expr("array()").cast("array<bigint>"))


def bands(n: int, t: int, miss: float = MISS, containment: float = CONTAINMENT) -> int:
    """Signature size at which a window of n shingles that holds ``containment`` of a part's t is missed with probability ``miss`` at most."""
    held = ceil(containment * t)
    return next(k for k in range(1, n + 1) if comb(n - held, k) / comb(n, k) <= miss)


@dataclass(frozen=True)
class Class:
    """Parts of up to ``words`` words and at least ``least`` shingles; windows of ``n`` shingles, every ``words``; signatures of k."""

    words: int
    least: int
    n: int
    k: int


def classes(sizes: tuple[int, ...] = CLASSES) -> list[Class]:
    out, shorter = [], SHINGLE - 1
    for w in sizes:
        least, n = shorter + 1 - SHINGLE + 1, 2 * w - SHINGLE + 1
        out.append(Class(w, least, n, bands(n, least)))
        shorter = w
    return out


def _literal(values: list[int]) -> Column:
    return F.expr("array(" + ",".join(f"{v}L" if v > -(2**63) else f"-{2**63 - 1}L - 1L" for v in values) + ")") if values else F.expr("array()").cast("array<bigint>")


def _signatures(run: Column, length: int, step: int, k: int) -> Column:
    """The lowest k distinct hashes of every window, end to end: repeats would fill a signature."""
    starts = F.sequence(F.lit(1), F.greatest(F.size(run), F.lit(1)), F.lit(step))
    return F.flatten(F.transform(starts, lambda i: F.slice(F.sort_array(F.array_distinct(F.slice(run, i, F.lit(length)))), 1, k)))


def _of_windows(run: Column, kind: Class) -> Column:
    return _signatures(run, kind.n, kind.words, kind.k)


def templates_table(spark: SparkSession, templates: dict[str, str]) -> DataFrame:
    """(name, own: distinct shingles, kind: class, signature) of templates with a shingle at least."""
    kinds = classes()
    rows = spark.createDataFrame(list(templates.items()), "name string, text string").select("name", words(F.col("text")).alias("w")).select("name", shingles(F.col("w")).alias("s")).where(F.size("s") > 0)
    kind, signature = F.lit(len(kinds) - 1), None
    for i, c in reversed(list(enumerate(kinds))):
        most = c.words - SHINGLE + 1
        # parts of the largest class overlap by half, and have no more shingles than a signature
        part = min(most, c.k)
        own = _signatures(F.col("s"), part, part // 2, c.k) if signature is None else F.sort_array(F.array_distinct("s"))
        signature = own if signature is None else F.when(F.size("s") <= most, own).otherwise(signature)
        kind = kind if i == len(kinds) - 1 else F.when(F.size("s") <= most, i).otherwise(kind)
    return rows.select("name", F.array_distinct("s").alias("own"), kind.cast("int").alias("kind"), F.array_distinct(signature).alias("signature"))


@dataclass(frozen=True)
class Index:
    """Distinct shingle hashes of each template, and the bands of the parts in each class."""

    templates: dict[str, list[int]]
    parts: dict[int, list[int]]


def index(table: DataFrame) -> Index:
    """The templates' hashes on the driver; their number is checked before."""
    rows = sorted(table.collect(), key=lambda r: r["name"])
    parts: dict[int, dict[int, None]] = {}
    for r in rows:
        parts.setdefault(r["kind"], {}).update(dict.fromkeys(r["signature"]))
    return Index({r["name"]: r["own"] for r in rows}, {i: list(hashes) for i, hashes in sorted(parts.items())})


def _known(hashes: list[int]) -> Callable[[Column], Column]:
    """Whether a hash is among these: its bucket's bit first, then the list."""
    bits = [0] * (BITS // 64)
    for h in hashes:
        bits[(h % BITS) >> 6] |= 1 << (h % BITS & 63)
    table, every = _literal([b - (1 << 64) if b >> 63 else b for b in bits]), _literal(hashes)

    def test(h: Column) -> Column:
        place = F.pmod(h, F.lit(BITS))
        return (F.getbit(F.get(table, F.shiftright(place, 6).cast("int")), (place % 64).cast("int")) == 1) & F.array_contains(every, h)

    return test


def _match(own: Column, run: Column) -> tuple[Column, Column]:
    """Containment of the template's shingles in the document's, and the place of the first of them."""
    held = F.array_intersect(own, run)
    return F.size(held) / F.size(own).cast("double"), F.array_min(F.transform(held, lambda h: F.array_position(run, h))) - 1


def _by_constants(rows: DataFrame, found: Index, containment: float) -> DataFrame:
    kinds = classes()
    hits = [F.filter(_of_windows(F.col("s"), kinds[i]), _known(hashes)) for i, hashes in found.parts.items()]
    rows = rows.select("doc_id", "s", F.array_distinct(F.concat(*hits)).alias("hits"))
    checks = []
    for name, hashes in found.templates.items():
        own = _literal(hashes)
        share, first = _match(own, F.col("s"))
        checks.append(F.when((F.size("hits") > 0) & F.arrays_overlap("hits", own), F.struct(F.lit(name).alias("template"), share.alias("containment"), first.alias("first_word"))))
    return rows.select("doc_id", F.inline(F.filter(F.array(*checks), lambda m: m.isNotNull() & (m.containment >= containment))))


def _by_join(rows: DataFrame, table: DataFrame, containment: float) -> DataFrame:
    """The same for templates of any number: bands meet in a shuffle, and only candidates are verified."""
    rows = common.stage(rows.withColumn("row", F.monotonically_increasing_id()), "shingles")
    table = common.stage(table, "templates")
    marked = F.concat(*[F.transform(F.array_distinct(_of_windows(F.col("s"), c)), _of_kind(i)) for i, c in enumerate(classes())])
    windows = rows.select("row", F.explode(marked).alias("e")).select("row", "e.kind", "e.band")
    bands_of = table.select("name", "kind", F.explode("signature").alias("band"))
    pairs = windows.join(bands_of, ["kind", "band"]).select("row", "name").distinct()
    share, first = _match(F.col("own"), F.col("s"))
    both = pairs.join(rows, "row").join(table.select("name", "own"), "name")
    return both.select("doc_id", F.col("name").alias("template"), share.alias("containment"), first.alias("first_word")).where(F.col("containment") >= containment)


def _of_kind(i: int) -> Callable[[Column], Column]:
    return lambda h: F.struct(F.lit(i).alias("kind"), h.alias("band"))


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] | None = None, containment: float = CONTAINMENT) -> DataFrame:
    """doc_id, template, containment (share of the template's shingles in the document), first_word (place of the first of them)."""
    table = templates_table(docs.sparkSession, TEMPLATES if templates is None else templates) if templates or templates is None else None
    src = common.only(docs, doc_id=id_col, text=F.coalesce(F.col(f"`{text_col}`"), F.lit("")))
    # no filter on what is computed here: pushed down, it would compute everything again
    rows = src.select("doc_id", words(F.col("text")).alias("w")).select("doc_id", shingles(F.col("w")).alias("s"))
    total = table.agg(F.coalesce(F.sum(F.size("own")), F.lit(0))).first()[0] if table is not None else 0
    if not total:
        return rows.select("doc_id", F.lit("").alias("template"), F.lit(0.0).alias("containment"), F.lit(0).cast("long").alias("first_word")).limit(0)
    return _by_constants(rows, index(table), containment) if total <= MOST_SHINGLES else _by_join(rows, table, containment)
