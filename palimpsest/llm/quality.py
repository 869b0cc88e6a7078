"""Document quality from a linear-chain conditional random field over lines.

Every line gets counts of byte classes, word lengths and repetitions, those of its neighbours, and
whether it equals them. The field labels lines good or bad with one transition matrix; in training
every line has its document's label. Forward-backward gives each line's marginal of being good, and
a document's quality is their mean weighted by length, mapped to a probability by a logistic fit.

Forward and backward messages are products of 2 x 2 matrices, so they are taken by a segmented scan
over all lines of a batch in log2(lines) steps, however long a document is.

Null and empty texts are one empty line. Labels that are null, and ids that repeat with the same
label, change nothing; of ids with both labels the lower counts. Without labels of both kinds every
text gets the mean label (a half without any). An empty table gives an empty result. Other columns
are ignored by ``score`` and kept by ``keep_good``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm import common, shingles

#: Labelled documents that the fit uses at most: those of the lowest hash. Only their lines' features reach the driver.
MOST_LABELLED = 4_000
#: And at most so many lines of them.
MOST_LINES = 400_000
THRESHOLD = 0.3
FOLDS = 5

_CLASSES = 10
_CLASS = np.full(256, 8, np.uint8)  # other punctuation and control bytes
_CLASS[65:91], _CLASS[97:123], _CLASS[48:58] = 0, 1, 2
_CLASS[[9, 11, 12, 13, 32]] = 3
_CLASS[ord("!")], _CLASS[ord("|")] = 4, 5
_CLASS[[ord(c) for c in "#$%&*@^~<>{}[]=+_\\/"]] = 6
_CLASS[128:] = 7
_CLASS[[ord(c) for c in ".,;:?'\"-()"]] = 9


def lines_of(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, document) of every line; a document has one more line than line feeds."""
    breaks = np.flatnonzero(data == 10)
    doc = np.searchsorted(at, breaks, "right") - 1
    per_doc = np.bincount(doc, minlength=len(at) - 1) + 1
    owner = np.repeat(np.arange(len(at) - 1), per_doc)
    order = np.argsort(np.concatenate([np.arange(len(at) - 1), doc]), kind="stable")
    starts = np.concatenate([at[:-1], breaks + 1])[order]
    last = np.cumsum(per_doc) - 1
    ends = np.empty_like(starts)
    ends[:-1] = starts[1:] - 1
    ends[last] = at[1:]
    return starts, ends, owner


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lines x features), the document of each line, and its length in bytes."""
    data, at = common.utf8(column)
    starts, ends, doc = lines_of(data, at)
    n, size = len(starts), ends - starts
    line_of = np.repeat(np.arange(n), size)
    inside = np.ones(len(data), bool)
    inside[data == 10] = False
    kept = data[inside]
    counts = np.bincount(line_of * _CLASSES + _CLASS[kept], minlength=n * _CLASSES).reshape(n, _CLASSES)
    share = counts / np.maximum(size, 1)[:, None]
    packed = np.concatenate([[0], np.cumsum(size)])
    words, word_at = shingles.word_hashes(kept, packed)
    n_words = np.diff(word_at)
    word_line = np.repeat(np.arange(n), n_words)

    def repeats(gap: int) -> np.ndarray:
        same = (words[gap:] == words[:-gap]) & (word_line[gap:] == word_line[:-gap]) if len(words) > gap else np.zeros(0, bool)
        return np.bincount(word_line[gap:][same], minlength=n) / np.maximum(n_words, 1) if len(words) > gap else np.zeros(n)

    sums = np.concatenate([[np.uint64(0)], np.cumsum(words, dtype=np.uint64)])
    whole = sums[word_at[1:]] - sums[word_at[:-1]]
    own = np.column_stack([np.log1p(size), share, np.log1p(n_words), (size / np.maximum(n_words, 1)) / 20, repeats(1), repeats(2), repeats(4), size == 0])
    up, down = np.zeros_like(own), np.zeros_like(own)
    joined = doc[1:] == doc[:-1]
    up[1:][joined], down[:-1][joined] = own[:-1][joined], own[1:][joined]
    equal = joined & (whole[1:] == whole[:-1]) & (size[1:] > 0)
    around = np.zeros((n, 4))
    around[1:, 0], around[:-1, 1] = equal, equal
    around[1:, 2], around[:-1, 3] = joined, joined
    return np.hstack([own, up, down, around]), doc, size


def _scan(m: np.ndarray, room: np.ndarray) -> np.ndarray:
    """Products m[first] ... m[i] inside segments, each scaled to a largest entry of 1; ``room``: i's place in its segment."""
    out, step = m / m.max((1, 2), keepdims=True), 1
    while step <= (room.max() if len(room) else 0):
        i = np.flatnonzero(room >= step)
        product = out[i - step] @ out[i]
        out[i] = product / product.max((1, 2), keepdims=True)
        step *= 2
    return out


def marginals(good: np.ndarray, transition: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each line's probability of label 1 and, summed, the expected transitions.

    ``good``: log-odds of label 1 by the line's features; ``transition``: logarithms, from x to.
    """
    n = len(good)
    first = np.searchsorted(doc, doc)
    place = np.arange(n) - first
    left = np.searchsorted(doc, doc, "right") - 1 - np.arange(n)
    own = np.exp(np.clip(np.column_stack([-good / 2, good / 2]), -30, 30))
    m = np.exp(transition)[None] * own[:, None, :]
    m[place == 0] = own[place == 0][:, None, :]
    forward = _scan(m, place)[:, 0, :]
    reverse = _scan(m[::-1].transpose(0, 2, 1), left[::-1])[::-1].transpose(0, 2, 1)
    backward = np.ones((n, 2))
    inner = np.flatnonzero(left > 0)
    backward[inner] = reverse[inner + 1].sum(2)
    both = forward * backward
    p = both[:, 1] / both.sum(1)
    at = np.flatnonzero(place > 0)
    pair = forward[at - 1][:, :, None] * m[at] * backward[at][:, None, :]
    pair /= pair.sum((1, 2), keepdims=True)
    return p, pair.sum(0)


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float
    transition: np.ndarray
    slope: float
    offset: float

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) / self.scale @ self.weights + self.bias

    def document(self, column: pa.Array) -> np.ndarray:
        x, doc, size = features(column)
        p, _ = marginals(self.log_odds(x), self.transition, doc)
        return _logistic(self.slope * quality(p, doc, size, len(column)) + self.offset)


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def quality(p: np.ndarray, doc: np.ndarray, size: np.ndarray, n: int) -> np.ndarray:
    """The lines' marginals weighted by length; an empty line weighs as one byte."""
    weight = np.maximum(size, 1)
    return np.bincount(doc, weights=p * weight, minlength=n) / np.bincount(doc, weights=weight, minlength=n)


def fit(x: np.ndarray, doc: np.ndarray, size: np.ndarray, label: np.ndarray, turns: int = 150, rate: float = 0.1, ridge: float = 1e-3) -> Model:
    """Maximum likelihood by Adam. ``doc`` ascending from 0, ``label`` by document."""
    n_docs = len(label)
    if len(np.unique(label)) < 2:
        share = float(label.mean()) if n_docs else 0.5
        k = x.shape[1] if x.ndim == 2 else 1
        return Model(np.zeros(k), np.ones(k), np.zeros(k), 0.0, np.zeros((2, 2)), 0.0, float(np.log((share + 1e-9) / (1 - share + 1e-9))))
    mean, scale = x.mean(0), x.std(0) + 1e-6
    z = (x - mean) / scale
    y = label[doc].astype(float)
    # lines of a document count as one document together, so that long ones don't outweigh the rest
    share = 1 / np.bincount(doc, minlength=n_docs)[doc]
    joined = np.flatnonzero(doc[1:] == doc[:-1])
    seen = np.zeros((2, 2))
    np.add.at(seen, (label[doc[joined]], label[doc[joined]]), 1)
    theta, first, second = np.zeros(z.shape[1] + 5), 0.0, 0.0
    for turn in range(1, turns + 1):
        weights, bias, transition = theta[:-5], theta[-5], theta[-4:].reshape(2, 2)
        p, expected = marginals(z @ weights + bias, transition, doc)
        miss = (p - y) * share
        slope = np.concatenate([z.T @ miss / n_docs + ridge * weights, [miss.sum() / n_docs], ((expected - seen) / max(1, len(joined))).ravel() + ridge * transition.ravel()])
        first, second = 0.9 * first + 0.1 * slope, 0.99 * second + 0.01 * slope**2
        theta = theta - rate * (first / (1 - 0.9**turn)) / (np.sqrt(second / (1 - 0.99**turn)) + 1e-8)
    weights, bias, transition = theta[:-5], float(theta[-5]), theta[-4:].reshape(2, 2)
    p, _ = marginals(z @ weights + bias, transition, doc)
    q = quality(p, doc, size, n_docs)
    ab = np.zeros(2)
    for _ in range(50):  # Newton steps of the logistic fit
        basis = np.column_stack([q, np.ones(n_docs)])
        s = _logistic(basis @ ab)
        ab = ab - np.linalg.solve((basis * (s * (1 - s))[:, None]).T @ basis + 1e-2 * np.eye(2), basis.T @ (s - label) + 1e-2 * ab)
    return Model(mean, scale, weights, bias, transition, float(ab[0]), float(ab[1]))


def held_out(doc_id: Column) -> Column:
    """Rows that no fit sees; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS == 0


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most: int = MOST_LABELLED, most_lines: int = MOST_LINES) -> Model:
    """Fit on labelled documents that are not held out, ``most`` at most; one that would pass ``most_lines`` is passed over, not those behind it."""
    known = common.only(labels, doc_id=id_col, label=label_col).where(F.col("label").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.min("label").cast("int").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    rows = common.only(docs, doc_id=id_col, text=text_col).join(F.broadcast(known), "doc_id").select("doc_id", "label", "text")

    def lines(batches):
        for batch in batches:
            for part in shingles.slices(batch, (2,)):
                x, doc, size = features(part.column(2))
                full = np.column_stack([x, size]).astype(np.float32)
                at = np.searchsorted(doc, np.arange(part.num_rows + 1))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([full[s:e].tobytes() for s, e in zip(at[:-1], at[1:], strict=True)], pa.binary())], names=["doc_id", "label", "lines"])

    schema = rows.select("doc_id", "label").schema.add("lines", "binary")
    width = 4 * (features(pa.array([""]))[0].shape[1] + 1)
    found = rows.mapInArrow(lines, schema).withColumn("n", F.expr(f"octet_length(lines) div {width}")).withColumn("row", F.monotonically_increasing_id())
    found = common.stage(found, "labelled")
    total, fit_in, x, label, doc = 0, [], [], [], []
    for row in found.orderBy(F.xxhash64("doc_id"), "doc_id", "row").select("row", "n").toLocalIterator():
        if total + row["n"] <= most_lines:
            total += row["n"]
            fit_in.append((row["row"],))
    chosen = F.broadcast(docs.sparkSession.createDataFrame(fit_in, "row long"))
    for row in found.join(chosen, "row").orderBy(F.xxhash64("doc_id"), "doc_id", "row").select("label", "n", "lines").toLocalIterator():
        n = row["n"]
        x.append(np.frombuffer(row["lines"], np.float32).reshape(n, -1).astype(float))
        doc.append(np.full(n, len(label)))
        label.append(row["label"])
    full = np.vstack(x) if x else np.zeros((0, width // 4))
    return fit(full[:, :-1], np.concatenate(doc) if doc else np.zeros(0, int), full[:, -1], np.array(label, int))


def scorer(model: Model):
    """A column function: text to quality."""

    @F.arrow_udf("double")
    def score(text: pa.Array) -> pa.Array:
        out = []
        for part in shingles.slices(pa.RecordBatch.from_arrays([text], names=["text"]), (0,)):
            out.append(model.document(part.column(0)))
        common.release()
        return pa.array(np.concatenate(out) if out else np.zeros(0), pa.float64())

    return score


def score(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    rows = common.only(docs, doc_id=id_col, score=scorer(model)(F.col(f"`{text_col}`")))
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, model: Model, *, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose text reaches the threshold."""
    return docs.where(scorer(model)(F.col(f"`{text_col}`")) >= threshold)
