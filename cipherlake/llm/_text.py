"""Vectorised text kernels over Arrow buffers: UTF-8 bytes in, numpy arrays out. No per-word Python."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
#: Space, tab, line feed, vertical tab, form feed, carriage return.
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
#: A-Z to a-z; every other byte stays.
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_BYTE_VALUE = np.random.default_rng(0x5EED).integers(1, 2**63, 256, dtype=np.int64).astype(U64) | U64(1)
_BASE = U64(0x9E3779B97F4A7C15)
_BASE_INVERSE = U64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_powers: dict[str, np.ndarray] = {}


def _power(name: str, base: np.uint64, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64."""
    have = _powers.get(name)
    if have is None or len(have) < n:
        steps = np.full(max(n, 1 << 17), base, dtype=U64)
        steps[0] = 1
        _powers[name] = have = np.multiply.accumulate(steps)
    return have[:n]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the finaliser of SplitMix64)."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def utf8_buffers(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column, null as empty; offsets start at 0."""
    if pa.types.is_string(values.type) or pa.types.is_large_string(values.type):
        values = values.cast(pa.large_string()).cast(pa.large_binary())
    else:
        values = values.cast(pa.large_binary())
    values = pc.fill_null(values, b"")
    if not len(values):
        return np.zeros(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    offsets = np.frombuffer(values.buffers()[1], dtype=np.int64)[values.offset : values.offset + len(values) + 1]
    data = np.frombuffer(values.buffers()[2] or b"", dtype=np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def spans(offsets: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Row ranges [i, j) of at most `limit` bytes each, or of one row."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each maximal run of non-space bytes, and how many of them each row has. Runs end with rows."""
    n = len(data)
    if not n:
        empty = np.zeros(0, dtype=np.int64)
        return empty, empty, np.zeros(len(offsets) - 1, dtype=np.int64)
    is_word = ~_SPACE[data]
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets] = True
    before = np.empty(n, dtype=bool)
    before[0], before[1:] = True, ~is_word[:-1]
    starts = np.flatnonzero(is_word & (before | edge[:-1]))
    after = np.empty(n, dtype=bool)
    after[-1], after[:-1] = True, ~is_word[1:]
    ends = np.flatnonzero(is_word & (after | edge[1:])) + 1
    counts = np.diff(np.searchsorted(starts, offsets))
    return starts, ends, counts


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """A 64-bit hash of the bytes of each span, A-Z as a-z: a polynomial over random byte values, then scrambled."""
    n = len(data)
    sums = np.empty(n + 1, dtype=U64)
    sums[0] = 0
    table = _BYTE_VALUE[_LOWER] if lower else _BYTE_VALUE
    np.cumsum(table[data] * _power("base", _BASE, n), out=sums[1:])
    raw = (sums[ends] - sums[starts]) * _power("inverse", _BASE_INVERSE, n + 1)[starts]
    return mix64(raw ^ (ends - starts).astype(U64) * U64(0xD6E8FEB86659FD93))


def combine(parts: list[np.ndarray]) -> np.ndarray:
    """One hash for each position of equally long arrays; depends on order and on how many there are."""
    acc = np.full(len(parts[0]), 0xA0761D6478BD642F + len(parts), dtype=U64)
    for p in parts:
        acc = mix64(acc * U64(0xE7037ED1A0B428DB) + p)
    return acc


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> list[np.ndarray]:
    """For each row the sorted distinct hashes of its `width`-word shingles, A-Z as a-z.

    A row with fewer words has its whole word sequence as its only shingle; one without words has none.
    """
    starts, ends, counts = words(data, offsets)
    hashes = span_hashes(data, starts, ends)
    n = len(hashes) - width + 1
    grams = combine([hashes[k : k + n] for k in range(width)]) if n > 0 else hashes[:0]
    out, at = [], 0
    for c in counts.tolist():
        if c >= width:
            out.append(np.unique(grams[at : at + c - width + 1]))
        elif c:
            out.append(combine([hashes[at + k : at + k + 1] for k in range(c)]))
        else:
            out.append(hashes[:0])
        at += c
    return out
