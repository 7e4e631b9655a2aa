"""Numpy kernels over Arrow text columns: words and their hashes for many documents at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Separators of words: space and U+0009 to U+000D. All are single bytes in UTF-8.
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint64) + np.uint64(1)
_LOWER[65:91] = _LOWER[97:123]
_EXACT = np.arange(256, dtype=np.uint64) + np.uint64(1)
_R = 0x9E3779B97F4A7C15 | 1
_R_INV = pow(_R, -1, 1 << 64)
_powers: tuple[np.ndarray, np.ndarray] = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the hash's base and of its inverse, modulo 2**64."""
    global _powers
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        out = []
        for r in (_R, _R_INV):
            x = np.full(size, r, np.uint64)
            x[0] = 1
            out.append(np.multiply.accumulate(x))
        _powers = (out[0], out[1])
    return _powers


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_parts(batch: pa.RecordBatch, column: str = "text", most: int = 1 << 18) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about `most` bytes of text, a document at least; every row is in one slice."""
    n = batch.num_rows
    if not n:
        return
    size = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
    total = np.cumsum(size)
    at = 0
    while at < n:
        before = total[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(total, before + most, "right")))
        yield batch.slice(at, to - at)
        at = to


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a text column, one after another, and the offset of each row; null counts as empty."""
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data and len(offsets) else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def span_hashes(data: np.ndarray, lower: bool = True):
    """A function of arrays (starts, ends) that gives the hash of each stretch of bytes."""
    power, inverse = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((_LOWER if lower else _EXACT)[data] * power[: len(data)], out=sums[1:])
    return lambda starts, ends: mix((sums[ends] - sums[starts]) * inverse[starts])


def runs(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first run of each row and the end, byte start, byte end) of the runs of bytes that `inside` marks."""
    n = len(data)
    first = np.zeros(n + 1, bool)
    first[offsets[offsets < n]] = True
    first[n] = True
    before, after = np.ones(n, bool), np.ones(n, bool)
    before[1:], after[:-1] = ~inside[:-1], ~inside[1:]
    starts = np.flatnonzero(inside & (before | first[:n]))
    ends = np.flatnonzero(inside & (after | first[1:])) + 1
    return np.searchsorted(starts, offsets), starts, ends


def words(column: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each word, first word of each row and the end, byte start, byte end) of a text column."""
    data, offsets = raw(column)
    first, starts, ends = runs(data, offsets, ~_SPACE[data])
    return span_hashes(data, lower)(starts, ends), first, starts, ends


def shingles(hashes: np.ndarray, firsts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of the distinct k-word shingles, sorted by row and hash; a shorter row is one shingle."""
    counts = np.diff(firsts)
    rows = np.repeat(np.arange(len(counts)), counts)
    n = len(hashes)
    out_h, out_r = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    if n >= k:
        h = np.full(n - k + 1, k, np.uint64)
        for i in range(k):
            h = mix(h + hashes[i : n - k + 1 + i], i)
        same = rows[: n - k + 1] == rows[k - 1 :]
        out_h.append(h[same])
        out_r.append(rows[: n - k + 1][same])
    for size in range(1, k):
        short = np.flatnonzero(counts == size)
        if len(short):
            h = np.full(len(short), size, np.uint64)
            for i in range(size):
                h = mix(h + hashes[firsts[short] + i], i)
            out_h.append(h)
            out_r.append(short)
    h, r = np.concatenate(out_h), np.concatenate(out_r)
    order = np.lexsort((h, r))
    h, r = h[order], r[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
    return h[new], r[new]
