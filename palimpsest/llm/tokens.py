"""Token counts by field or section, from one encoding of the whole document.

A byte-level tokenizer loses no byte, so the running sum of its tokens' byte lengths gives every
token's span. Sections are character spans; where none are given, they are the lines, each with its
line feed, and tile the text. Of sections that overlap, the one that starts first (of ties, the one listed
first) has what they share, and the next begins behind it. A token inside one section counts there. One that crosses a boundary is allocated by the rule:

* ``first``: to the section of its first byte;
* ``most``: to the section that holds most of its bytes, the earlier one where they are equal;
* ``share``: to each section by its share of the bytes.

Bytes in no section go to none. Null and empty texts have one empty line with no tokens, or the
given sections with none. A null list of sections counts as no sections; a section that is null, has a
null bound or ends before it starts has no tokens; bounds beyond the text stop at it. Repeated rows are
counted each on its own. A long text is encoded as a whole, in a slice of its own. An empty table gives
an empty result. Other columns are ignored.
"""

from __future__ import annotations

import json
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from palimpsest.llm import common, shingles

RULES = ("first", "most", "share")


def byte_lengths(path: str) -> np.ndarray:
    """Bytes of each id of a byte-level tokenizer file, whose vocabulary spells every byte as one character."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    vocab = spec["model"]["vocab"]
    special = {x["id"]: len(x["content"].encode()) for x in spec.get("added_tokens", [])}
    out = np.zeros(max([*vocab.values(), *special]) + 1, np.int64)
    for token, i in vocab.items():
        out[i] = len(token)
    for i, n in special.items():
        out[i] = n
    return out


def line_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte spans of the lines; a text that ends with a line feed has no empty line behind it."""
    ends = np.flatnonzero(data == 10) + 1
    if not len(ends) or ends[-1] != len(data):
        ends = np.append(ends, len(data))
    return np.concatenate([[0], ends[:-1]]), ends


def attribute(token_ends: np.ndarray, starts: np.ndarray, ends: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each section by the rule, and how many tokens of it cross its boundary. All in bytes; tokens tile the text."""
    count, crossing = np.zeros(len(starts)), np.zeros(len(starts), np.int64)
    if not len(token_ends) or not len(starts):
        return count, crossing
    token_starts = np.concatenate([[0], token_ends[:-1]])
    low = np.searchsorted(ends, token_starts, "right")  # the first section that ends behind the token's start
    high = np.searchsorted(starts, token_ends, "left")  # one past the last that starts before its end
    touched = high > low
    inside = touched & (high == low + 1)
    at = np.minimum(low, len(starts) - 1)
    inside &= (starts[at] <= token_starts) & (token_ends <= ends[at])
    count += np.bincount(low[inside], minlength=len(starts))
    for i in np.flatnonzero(touched & ~inside).tolist():
        s, e = token_starts[i], token_ends[i]
        sections = np.arange(low[i], high[i])
        held = np.minimum(ends[sections], e) - np.maximum(starts[sections], s)
        crossing[sections[held > 0]] += 1
        if rule == "share":
            count[sections] += held / (e - s)
        elif rule == "most":
            count[sections[int(held.argmax())]] += 1 if held.max() * 2 >= (e - s) or held.max() >= (e - s) - held.sum() else 0
        elif starts[low[i]] <= s:
            count[low[i]] += 1
    return count, crossing


def disjoint(spans: np.ndarray) -> np.ndarray:
    """Spans (start, end) in place of overlapping ones: in the order of their starts, each begins where those before have ended."""
    order = np.argsort(spans[:, 0], kind="stable")
    out = spans.copy()
    upto = 0
    for i in order.tolist():
        out[i, 0] = max(out[i, 0], upto)
        out[i, 1] = max(out[i, 1], out[i, 0])
        upto = out[i, 1]
    return out


def count(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", sections_col: str | None = None, rule: str = "most", tokenizer: str | None = None) -> DataFrame:
    """A row for each section: doc_id, section (from 0), start, end (code points, end exclusive), n_tokens, n_crossing, and the document's doc_tokens.

    ``sections_col``: an array of structs whose first two fields are start and end in code points.
    """
    if rule not in RULES:
        raise ValueError(f"no such rule: {rule}")
    path = tokenizer or common.default_tokenizer()
    named = {"doc_id": id_col, "text": text_col} | ({"sections": sections_col} if sections_col else {})
    src = common.only(docs, **named)
    schema = T.StructType([T.StructField("doc_id", src.schema["doc_id"].dataType), T.StructField("section", T.LongType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("n_tokens", T.DoubleType()), T.StructField("n_crossing", T.LongType()), T.StructField("doc_tokens", T.LongType())])

    def make() -> Callable:
        encode, lengths = common.encoder(path), byte_lengths(path)

        def step(batch: pa.RecordBatch):
            for part in shingles.slices(batch, (1,)):
                data, at = common.utf8(part.column(1))
                texts = part.column(1)
                owner, section, first, last, tokens, crossing, total = [], [], [], [], [], [], []
                for i in range(part.num_rows):
                    own = data[at[i] : at[i + 1]]
                    token_ends = np.cumsum(lengths[encode(texts[i].as_py() or "")]) if len(own) else np.zeros(0, np.int64)
                    if len(token_ends) and token_ends[-1] != len(own):
                        raise ValueError("the tokenizer is not byte-level: its tokens don't add up to the text")
                    if sections_col:
                        given = [list((x or {}).values())[:2] or [None, None] for x in part.column(2)[i].as_py() or []]
                        chars = np.append(np.flatnonzero((own & 0xC0) != 0x80), len(own))
                        # a section without bounds stands empty at the start
                        spans = np.array([[0, 0] if None in x else x for x in given], np.int64).reshape(-1, 2)
                        inside = disjoint(np.clip(spans, 0, len(chars) - 1))
                        order = np.lexsort((inside[:, 1], inside[:, 0]))
                        n, cross = np.zeros(len(spans)), np.zeros(len(spans), np.int64)
                        n[order], cross[order] = attribute(token_ends, chars[inside[order, 0]], chars[inside[order, 1]], rule)
                    else:
                        starts, ends = line_spans(own)
                        before = np.concatenate([[0], np.cumsum((own & 0xC0) != 0x80)])
                        spans, given = np.column_stack([before[starts], before[ends]]), None
                        n, cross = attribute(token_ends, starts, ends, rule)
                    owner.append(np.full(len(n), i))
                    section.append(np.arange(len(n)))
                    first += spans[:, 0].tolist() if given is None else [x[0] for x in given]
                    last += spans[:, 1].tolist() if given is None else [x[1] for x in given]
                    tokens.append(n)
                    crossing.append(cross)
                    total.append(np.full(len(n), len(token_ends)))
                at_rows, section, tokens, crossing, total = (np.concatenate(x) for x in (owner, section, tokens, crossing, total))
                numbers = [pa.array(x, kind) for x, kind in ((section, pa.int64()), (first, pa.int64()), (last, pa.int64()), (tokens, pa.float64()), (crossing, pa.int64()), (total, pa.int64()))]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(at_rows, pa.int64())), *numbers], names=schema.names)

        return step

    return common.map_rows(src, make, schema)
