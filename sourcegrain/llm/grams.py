"""Hashes of words and word n-grams over whole Arrow columns of texts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from .common import mix64

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

#: A 64-bit value for each byte; FOLDED gives A-Z those of a-z.
PLAIN = mix64(np.arange(256, dtype=np.uint64) + np.uint64(0x51ED2701))
FOLDED = PLAIN.copy()
FOLDED[65:91] = PLAIN[97:123]
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse, modulo 2^64."""
    if len(_powers[0]) < n:
        size = max(n, 1 << 16)
        for i, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(size, np.uint64(base))
            steps[0] = 1
            _powers[i] = np.multiply.accumulate(steps)
    return _powers[0][:n], _powers[1][:n]


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts in turn and where each text starts; a null text is empty."""
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def prefix_hashes(data: np.ndarray, table: np.ndarray = PLAIN) -> np.ndarray:
    """P[i]: the polynomial hash of data[:i], as a sum of byte values times powers of the base."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(table[data] * powers(len(data))[0], out=out[1:])
    return out


def word_hashes(data: np.ndarray, offsets: np.ndarray, table: np.ndarray = PLAIN):
    """(hash, start, end) of every word and the number of the first word of each text."""
    solid = ~_SPACE[data]
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1]
    last[:-1] &= ~solid[1:]
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    first[inner] |= solid[inner]
    last[inner - 1] |= solid[inner - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    sums = prefix_hashes(data, table)
    h = mix64((sums[end] - sums[start]) * powers(len(data) + 1)[1][start] + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    return h, start, end, np.searchsorted(start, offsets)


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of words[i : i + k] for every i, whatever text they lie in."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    g = np.full(n, np.uint64(k))
    for j in range(k):
        g = g * np.uint64(_BASE) + words[j : j + n]
    return mix64(g)


def window_minima(values: np.ndarray, w: int) -> np.ndarray:
    """Index of the smallest of values[i : i + w] for every i; of equal ones the leftmost."""
    n = len(values) - w + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    # Blocks of w: the minimum over a window is that of a block's suffix and the next one's prefix.
    size = -(-len(values) // w) * w
    padded = np.full(size, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(values)] = values
    grid, place = padded.reshape(-1, w), np.arange(size).reshape(-1, w)

    def running(grid: np.ndarray, place: np.ndarray, strict: bool):
        low = np.minimum.accumulate(grid, axis=1)
        fresh = np.ones(grid.shape, bool)
        fresh[:, 1:] = grid[:, 1:] < low[:, :-1] if strict else grid[:, 1:] <= low[:, :-1]
        at = np.maximum.accumulate(np.where(fresh, np.arange(w), 0), axis=1)
        return low.ravel(), np.take_along_axis(place, at, axis=1).ravel()

    head, head_at = running(grid, place, True)
    tail, tail_at = running(grid[:, ::-1], place[:, ::-1], False)
    tail, tail_at = tail.reshape(-1, w)[:, ::-1].ravel(), tail_at.reshape(-1, w)[:, ::-1].ravel()
    i = np.arange(n)
    return np.where(tail[i] <= head[i + w - 1], tail_at[i], head_at[i + w - 1])
