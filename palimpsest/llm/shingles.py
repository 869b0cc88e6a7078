"""Word shingles of whole Arrow columns at once, as 64-bit hashes."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

from palimpsest.llm import common

SHINGLE = 5
#: A slice holds fewer rows than this, so that a row's number and 50 bits of a hash share a word.
ROW_BITS = 14
SLICE_BYTES = 1 << 20
_P = 0x9E3779B97F4A7C15  # odd: it has an inverse modulo 2^64
_P_INVERSE = pow(_P, -1, 1 << 64)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


@lru_cache(1)
def _byte_values() -> np.ndarray:
    """A random value for each byte; ASCII capitals count as small letters."""
    values = np.random.default_rng(5).integers(1, 1 << 63, 256, np.uint64)
    values[65:91] = values[97:123]
    return values


def _power_series(n: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (_P, _P_INVERSE):
        x = np.full(n, base, np.uint64)
        x[0] = 1
        out.append(np.multiply.accumulate(x))
    return out[0], out[1]


@lru_cache(1)
def _slice_powers() -> tuple[np.ndarray, np.ndarray]:
    return _power_series(2 * SLICE_BYTES)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, n at least; only those of a slice are kept. More are wanted for a word that is longer than a slice."""
    return _slice_powers() if n <= 2 * SLICE_BYTES else _power_series(n)


def slices(batch: pa.RecordBatch, columns: tuple[int, ...]) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of bounded rows and bytes of these text columns; a row at least."""
    at = sum(common.utf8(batch.column(c))[1] for c in columns)
    first = 0
    while first < batch.num_rows:
        last = min(first + (1 << ROW_BITS), max(first + 1, int(np.searchsorted(at, at[first] + SLICE_BYTES)) - 1))
        yield batch.slice(first, last - first)
        first = last


def word_hashes(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each word (what ASCII white space divides), and the n + 1 offsets of the rows in them.

    Data longer than two slices (a row alone) is hashed in parts that end at white space.
    """
    if len(data) > 2 * SLICE_BYTES:
        parts, counts, first = [], np.zeros(len(at), np.int64), 0
        while first < len(data):
            last = first + SLICE_BYTES
            while last < len(data):
                if len(gaps := np.flatnonzero(_SPACE[data[last : last + SLICE_BYTES]])):
                    last += int(gaps[0])
                    break
                last += SLICE_BYTES
            last = min(last, len(data))
            words, places = _word_hashes(data[first:last], np.clip(at - first, 0, last - first))
            parts.append(words)
            counts += places
            first = last
        return np.concatenate(parts), counts
    return _word_hashes(data, at)


def _word_hashes(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(at), np.int64)
    inside = ~_SPACE[data]
    full = np.flatnonzero(at[1:] > at[:-1])
    before = np.empty_like(inside)
    before[0], before[1:] = False, inside[:-1]
    before[at[full]] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    after[-1], after[:-1] = False, inside[1:]
    after[at[full + 1] - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    power, inverse = _powers(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_byte_values()[data] * power[: len(data)], out=sums[1:])
    return common.mix64((sums[ends] - sums[starts]) * inverse[starts]), np.searchsorted(starts, at)


def shingle_hashes(words: np.ndarray, at: np.ndarray, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of each run of n words in order; a row of fewer words, but one at least, has one shingle of them all."""
    lengths = np.diff(at)
    row_of = np.repeat(np.arange(len(lengths)), np.maximum(lengths - n + 1, (lengths > 0).astype(np.int64)))
    if not len(row_of):
        return row_of, np.zeros(0, np.uint64)
    counts = np.maximum(lengths - n + 1, (lengths > 0).astype(np.int64))
    first = at[row_of] + np.arange(len(row_of)) - np.repeat(np.cumsum(counts) - counts, counts)
    out = np.zeros(len(row_of), np.uint64)
    padded = np.concatenate([words, np.zeros(n, np.uint64)])
    end = at[row_of + 1]
    for j in range(n):
        out *= np.uint64(_P)
        out += np.where(first + j < end, padded[first + j], np.uint64(0))
    return row_of, common.mix64(out)


def weighted(column: pa.Array, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, shingle, count) of the distinct shingles of each row, by row and shingle, and the n + 1 offsets of the rows."""
    data, at = common.utf8(column)
    row, hashed = shingle_hashes(*word_hashes(data, at), n)
    keys = np.sort(row.astype(np.uint64) << np.uint64(64 - ROW_BITS) | hashed >> np.uint64(ROW_BITS))
    new = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    counts = np.diff(np.append(new, len(keys)))
    keys = keys[new]
    rows = (keys >> np.uint64(64 - ROW_BITS)).astype(np.int64)
    return rows, keys & np.uint64((1 << 64 - ROW_BITS) - 1), counts, np.searchsorted(rows, np.arange(len(column) + 1))
