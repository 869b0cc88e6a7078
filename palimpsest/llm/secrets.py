"""Secret scans: patterns, and a character convolutional network over candidates in context.

Three patterns give the base spans, which always stay. Candidates are the base spans and all long
runs of key-like characters that have a digit and a letter. The network reads every candidate with
the characters around it: an embedding of characters, one convolution, the maximum over places, and
a logistic layer, all in numpy. A candidate longer than the network's view is read in overlapping
windows to its end, and so is every long part of it between delimiters; the highest probability
counts. It is trained on labelled findings; on those kept back a temperature is fitted, and a
threshold that finds ``recall`` of their secrets with the fewest false findings. Candidates at or
above it are added as kind ``token``. Of runs that base spans touch, the parts beside them are
candidates; a key that a fixed pattern matches only in part is one as a whole.

Null and empty texts have no spans. Rows that repeat have the same spans each. A long text is read to
its end, in a slice of its own, and so is a long candidate, in windows taken a bounded number at a time.
An empty table gives an empty result. Other columns are ignored by ``scan`` and kept by ``redact``.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.llm import common, shingles

KINDS = ("assign", "access", "hex", "token")
RECALL = 0.98
BEFORE, BODY, AFTER = 24, 48, 12
WIDTH = BEFORE + BODY + AFTER
MARK = "[REDACTED]"

# The contract's patterns. The shortest lengths hold for the greedy match, so runs may ask for them at once;
# an assignment whose value is too short uses up its text, so there the length is tested after the match.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
#: What may stand between a key and its surroundings inside one candidate.
DELIMITER = re.compile(r"[/=]|(.)\1{3,}", re.DOTALL)
SHORTEST = 20
STRIDE = BODY // 2
#: Windows that are read at a time, however long a candidate is.
MOST_WINDOWS = 4096
_HINTS = ("passw", "secret", "token", "apikey", "api_key")


@dataclass(frozen=True)
class Span:
    start: int
    end: int
    kind: str
    value: int  # where the secret itself begins


def base_spans(text: str) -> list[Span]:
    """Spans of the patterns, by start, then kind as listed."""
    found = []
    low = text.lower()
    if any(h in low for h in _HINTS):
        found += [Span(m.start(), m.end(), "assign", m.start(2)) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [Span(m.start(), m.end(), "access", m.start()) for m in ACCESS.finditer(text)]
    found += [Span(m.start(), m.end(), "hex", m.start()) for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s.start, KINDS.index(s.kind)))


def _pieces(start: int, end: int, text: str, base: list[Span]) -> Iterator[tuple[int, int]]:
    """What base spans leave of a run. A fixed pattern (access, hex) may end inside a key: it is left with the key around it, up to delimiters."""
    cuts = []
    for s in base:
        if s.end <= start or s.start >= end:
            continue
        left, right = max(s.start, start), min(s.end, end)
        if s.kind != "assign":
            while left > start and text[left - 1] not in "/=":
                left -= 1
            while right < end and text[right] not in "/=":
                right += 1
        cuts.append((left, right, s.kind == "assign"))
    # an assignment reads its value to the end of the run: no piece reaches into one
    upto = min((left for left, _, whole in cuts if whole), default=end)
    at = start
    for left, right, whole in sorted(cuts):
        left, right = min(left, upto), min(right, upto)
        if left > at:
            yield at, left
        if not whole and right > max(at, left) and not any(s.start <= max(at, left) and right <= s.end for s in base):
            yield max(at, left), right
        at = max(at, right)
    if at < upto:
        yield at, upto


def more_candidates(text: str, base: list[Span]) -> list[Span]:
    """Key-like runs with a digit and a letter, and what base spans leave of such runs; none lies inside a base span."""
    out = []
    for m in CANDIDATE.finditer(text):
        for start, end in _pieces(m.start(), m.end(), text, base):
            part = text[start:end]
            if len(part) >= SHORTEST and any(c.isdigit() for c in part) and any(c.isalpha() for c in part):
                out.append(Span(start, end, "token", start))
    return out


def window(text: str, start: int, end: int) -> str:
    """The candidate (its start, if it is long) and its surroundings at fixed places."""
    return text[max(0, start - BEFORE) : start].rjust(BEFORE, "\0") + text[start : min(end, start + BODY)].ljust(BODY, "\0") + text[end : end + AFTER].ljust(AFTER, "\0")


def views(text: str, start: int, end: int) -> Iterator[str]:
    """Windows that together hold the whole candidate, and each key-like part of a long one between delimiters."""
    yield window(text, start, end)
    if end - start <= BODY:
        return
    for at in range(start + STRIDE, end - BODY + STRIDE, STRIDE):
        at = min(at, end - BODY)
        yield window(text, at, at + BODY)
    left = start
    for stop, after in chain((m.span() for m in DELIMITER.finditer(text, start, end)), [(end, end)]):
        part = text[left:stop]
        if SHORTEST <= len(part) < end - start and any(c.isdigit() for c in part) and any(c.isalpha() for c in part):
            yield window(text, left, stop)
            for at in range(left + STRIDE, stop - BODY + STRIDE, STRIDE):
                at = min(at, stop - BODY)
                yield window(text, at, at + BODY)
        left = after


def highest(net: Net, found: list[tuple[str, int, int]]) -> np.ndarray:
    """For each (text, start, end) the highest probability of its windows."""
    out = np.zeros(len(found))
    windows = ((i, w) for i, at in enumerate(found) for w in views(*at))
    while some := list(islice(windows, MOST_WINDOWS)):
        np.maximum.at(out, [i for i, _ in some], net.probability(codes([w for _, w in some])))
    return out


def codes(windows: list[str]) -> np.ndarray:
    """ASCII as it is, all else as 128: (windows x WIDTH)."""
    points = np.frombuffer("".join(windows).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(windows), WIDTH)
    return np.minimum(points, 128).astype(np.int64)


@dataclass
class Net:
    """Characters -> embedding -> convolution of ``taps`` characters -> maximum -> logistic. Places of the candidate have a bias of their own."""

    embedding: np.ndarray  # 129 x e
    kernel: np.ndarray  # taps * (e + 1) x filters
    bias: np.ndarray
    out: np.ndarray
    out_bias: float
    temperature: float = 1.0
    threshold: float = 0.5
    taps: int = 5

    def _patches(self, x: np.ndarray) -> np.ndarray:
        inside = np.zeros((*x.shape, 1), np.float32)
        inside[:, BEFORE : BEFORE + BODY] = 1
        e = np.concatenate([self.embedding[x], inside], 2)
        return np.lib.stride_tricks.sliding_window_view(e, self.taps, axis=1).transpose(0, 1, 3, 2).reshape(len(x), x.shape[1] - self.taps + 1, -1)

    def logits(self, x: np.ndarray) -> np.ndarray:
        hidden = np.maximum(self._patches(x) @ self.kernel + self.bias, 0).max(1)
        return hidden @ self.out + self.out_bias

    def probability(self, x: np.ndarray) -> np.ndarray:
        parts = [self.logits(x[i : i + 512]) for i in range(0, len(x), 512)]
        z = np.concatenate(parts) if parts else np.zeros(0)
        return 1 / (1 + np.exp(-np.clip(z / self.temperature, -40, 40)))


def train_net(x: np.ndarray, y: np.ndarray, *, seed: int = 3, epochs: int = 6, batch: int = 64, rate: float = 3e-3, size: int = 8, filters: int = 24, taps: int = 5) -> Net:
    """Adam on the logistic loss; gradients by hand."""
    rng = np.random.default_rng(seed)
    net = Net(rng.normal(0, 0.3, (129, size)).astype(np.float32), rng.normal(0, 0.2, (taps * (size + 1), filters)).astype(np.float32), np.zeros(filters, np.float32), rng.normal(0, 0.2, filters).astype(np.float32), 0.0, taps=taps)
    state = {k: [np.zeros_like(getattr(net, k)), np.zeros_like(getattr(net, k))] for k in ("embedding", "kernel", "bias", "out")} | {"out_bias": [0.0, 0.0]}
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for at in range(0, len(x), batch):
            rows = order[at : at + batch]
            xb, n = x[rows], len(rows)
            patches = net._patches(xb)
            before = patches @ net.kernel + net.bias
            best = before.argmax(1)
            top = np.take_along_axis(before, best[:, None], 1)[:, 0]
            hidden = np.maximum(top, 0)
            miss = (1 / (1 + np.exp(-np.clip(hidden @ net.out + net.out_bias, -40, 40))) - y[rows]).astype(np.float32) / n
            back = miss[:, None] * net.out * (top > 0)
            chosen = patches[np.arange(n)[:, None], best]  # n x filters x taps * (size + 1)
            slopes = {"out": hidden.T @ miss, "out_bias": float(miss.sum()), "kernel": np.einsum("nf,nfk->kf", back, chosen), "bias": back.sum(0)}
            into = (back[:, :, None] * net.kernel.T[None]).reshape(n, filters, taps, size + 1)[..., :size]
            spots = xb[np.arange(n)[:, None, None], best[:, :, None] + np.arange(taps)]
            slopes["embedding"] = np.zeros_like(net.embedding)
            np.add.at(slopes["embedding"], spots.ravel(), into.reshape(-1, size))
            step += 1
            for k, g in slopes.items():
                m, v = state[k]
                state[k] = m, v = [0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g]
                setattr(net, k, getattr(net, k) - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8))
    return net


def calibrate(net: Net, x: np.ndarray, y: np.ndarray, recall: float = RECALL) -> Net:
    """The temperature of least loss, and a threshold that finds ``recall`` of the secrets with the fewest false findings.

    That is the highest one allowed; where it lies above all harmless findings, halfway down to them.
    """
    z = np.concatenate([net.logits(x[i : i + 512]) for i in range(0, len(x), 512)])

    def loss(t: float) -> float:
        return float(np.mean(np.logaddexp(0, z / t) - y * z / t))

    net.temperature = min(np.geomspace(0.25, 8, 41).tolist(), key=loss)
    p = net.probability(x)
    secret = np.sort(p[y == 1])
    highest = float(secret[int((1 - recall) * len(secret))]) if len(secret) else 0.5
    worst = float(p[(y == 0) & (p < highest)].max(initial=0.0))
    net.threshold = highest if (p[y == 0] >= highest).any() else (highest + worst) / 2
    return net


Finding = tuple[str, int, int, int]  # text, start, end, 1 if a secret

_SYLLABLES = "the and ing tion er re on an en ti es or ha was for eau ment que aux ier ung sch keit lich ver cion mente ado ar".split()


def labelled_findings(n: int = 6000, seed: int = 11) -> list[Finding]:
    """Made-up findings of both kinds: keys of common forms in prose and code, and long runs that are none."""
    rng = np.random.default_rng(seed)

    def pick(alphabet: str, k: int) -> str:
        return "".join(alphabet[i] for i in rng.integers(0, len(alphabet), k))

    lower, upper, digits = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    every = lower + upper + digits

    def word() -> str:
        return "".join(_SYLLABLES[i] for i in rng.integers(0, len(_SYLLABLES), rng.integers(1, 4)))

    def prose(k: int) -> str:
        return " ".join(word() for _ in range(k))

    def secret() -> tuple[str, str, str]:
        kind = rng.integers(0, 7)
        if kind == 0:
            return 'token = "', pick("0123456789abcdef", int(rng.choice([32, 40, 64]))), '"'
        if kind == 1:
            return " ", "AKIA" + pick(upper + digits, 16), " "
        if kind == 2:
            return "Bearer ", ".".join(base64.urlsafe_b64encode(rng.bytes(int(rng.integers(18, 40)))).decode().rstrip("=") for _ in range(1)), "\n"
        if kind == 3:
            return " ", str(rng.choice(["ghp_", "sk_live_", "xoxb-", "glpat-"])) + pick(every, int(rng.integers(24, 40))), " "
        if kind == 4:
            return "key: ", base64.b64encode(rng.bytes(int(rng.integers(18, 36)))).decode(), ","
        if kind == 5:
            return "password=", pick(every + "+/_-", int(rng.integers(20, 40))), " "
        return " ", pick("0123456789abcdef", int(rng.choice([32, 40]))), " "

    def harmless() -> tuple[str, str, str]:
        kind = rng.integers(0, 8)
        if kind == 0:
            return " ", "".join(word() for _ in range(5))[: int(rng.integers(20, 40))] + str(rng.integers(0, 100)), " "
        if kind == 1:
            return "https://", "/".join(word() for _ in range(4)) + "/" + str(rng.integers(0, 10_000)) + word(), " "
        if kind == 2:
            return " ", "-".join(str(rng.integers(1990, 2030)) if rng.random() < 0.4 else word() for _ in range(5)) + str(rng.integers(0, 9)), " "
        if kind == 3:
            return " ", "_".join(word() for _ in range(4)) + "_v" + str(rng.integers(1, 99)), " = "
        if kind == 4:
            return " ", pick(lower + upper, 1) * int(rng.integers(18, 30)) + pick(digits, 2), " "
        if kind == 5:
            return " ", f"{rng.integers(1990, 2030)}-{rng.integers(1, 12):02}-{rng.integers(1, 28):02}T{rng.integers(0, 23):02}-{rng.integers(0, 59):02}-{rng.integers(0, 59):02}Z", " "
        if kind == 6:
            return " ", "=" * int(rng.integers(8, 20)) + word() + str(rng.integers(0, 9)) + "=" * int(rng.integers(8, 20)), "\n"
        return "/", "/".join([word(), word(), word() + str(rng.integers(0, 99)), word()]) + "-" + word(), ".html"

    out = []
    for i in range(n):
        left, body, right = (harmless, secret)[i % 2]()
        while len(body) < SHORTEST:  # with more of the same kind: padding would be a mark of its own
            body += word()
        lead = prose(int(rng.integers(0, 6))) + left
        out.append((lead + body + right + prose(int(rng.integers(0, 5))), len(lead), len(lead) + len(body), i % 2))
    return out


def fit(findings: Iterable[Finding], *, recall: float = RECALL, seed: int = 3) -> Net:
    """Train on three quarters of the findings and calibrate on the rest."""
    rows = list(findings)
    x = codes([window(t, s, e) for t, s, e, _ in rows])
    y = np.array([r[3] for r in rows])
    kept = np.random.default_rng(seed).random(len(rows)) < 0.25
    return calibrate(train_net(x[~kept], y[~kept], seed=seed), x[kept], y[kept], recall)


@lru_cache(1)
def default_net() -> Net:
    return fit(labelled_findings())


def describe(spans: Iterable[Span]) -> str:
    return ",".join(f"{s.kind}:{s.start}:{s.end}" for s in spans)


def find(texts: list[str], net: Net) -> list[tuple[list[Span], list[Span], list[float]]]:
    """For each text its base spans, all spans, and the network's probability for each of these."""
    base = [base_spans(t) for t in texts]
    more = [more_candidates(t, b) for t, b in zip(texts, base, strict=True)]
    p = highest(net, [(t, s.value, s.end) for t, b, m in zip(texts, base, more, strict=True) for s in (*b, *m)])
    out, at = [], 0
    for b, m in zip(base, more, strict=True):
        scored = list(zip((*b, *m), p[at : at + len(b) + len(m)].tolist(), strict=True))
        at += len(b) + len(m)
        kept = sorted(((s, q) for s, q in scored if s.kind != "token" or q >= net.threshold), key=lambda x: (x[0].start, KINDS.index(x[0].kind)))
        out.append((b, [s for s, _ in kept], [q for _, q in kept]))
    return out


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", net: Net | None = None) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_token, base_sha256, spans, and found: array of (kind, start, end, probability)."""
    net = net or default_net()
    src = common.only(docs, doc_id=id_col, text=text_col)
    found = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("probability", T.DoubleType())]))
    schema = T.StructType([T.StructField("doc_id", src.schema["doc_id"].dataType), *(T.StructField(f"n_{k}", T.LongType()) for k in KINDS), T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType()), T.StructField("found", found)])
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("probability", pa.float64())]))

    def make() -> Callable:
        def step(batch: pa.RecordBatch):
            for part in shingles.slices(batch, (1,)):
                rows = find([t.as_py() or "" for t in part.column(1)], net)
                counts = [pa.array([sum(s.kind == k for s in every) for _, every, _ in rows], pa.int64()) for k in KINDS]
                digests = pa.array([hashlib.sha256(describe(base).encode()).hexdigest() for base, _, _ in rows], pa.string())
                details = pa.array([[{"kind": s.kind, "start": s.start, "end": s.end, "probability": q} for s, q in zip(every, p, strict=True)] for _, every, p in rows], kind)
                yield pa.RecordBatch.from_arrays([part.column(0), *counts, digests, pa.array([describe(every) for _, every, _ in rows], pa.string()), details], names=schema.names)

        return step

    return common.map_rows(src, make, schema)


def cut_out(text: str, spans: list[Span]) -> str:
    """The text with a mark for each run of overlapping secrets (of an assignment, its value)."""
    parts, at, upto = [], 0, -1
    for start, end in sorted((s.value, s.end) for s in spans):
        if start >= upto:
            parts += [text[at:start], MARK]
        upto = max(upto, end)
        at = upto
    return "".join([*parts, text[at:]])


def redact(docs: DataFrame, *, text_col: str = "text", net: Net | None = None) -> DataFrame:
    """``docs`` with secrets in the text replaced by a mark; null stays null."""
    net = net or default_net()

    @F.arrow_udf("string")
    def clean(text: pa.Array) -> pa.Array:
        out: list[str | None] = []
        for part in shingles.slices(pa.RecordBatch.from_arrays([text], names=["text"]), (0,)):
            texts = [t.as_py() for t in part.column(0)]
            out += [None if t is None else cut_out(t, every) for t, (_, every, _) in zip(texts, find([t or "" for t in texts], net), strict=True)]
        common.release()
        return pa.array(out, pa.string())

    return docs.withColumn(text_col, clean(F.col(f"`{text_col}`")))
