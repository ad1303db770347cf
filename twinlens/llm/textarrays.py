"""Numpy views of Arrow text batches: words, lines and their 64-bit hashes, for whole batches at once.

Everything works on UTF-8 bytes. A null text is an empty one. Equality of words, lines and windows is equality of
64-bit hashes (position-independent polynomial modulo 2**64 over random byte values, then mixed).
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(0, 2**64, 256, np.uint64)
_BASE = 0x9E3779B97F4A7C15 | 1
_POWERS: dict[int, np.ndarray] = {}

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
NEWLINE = np.zeros(256, bool)
NEWLINE[0x0A] = True


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column end to end, and where each text begins (one entry more than texts)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = pc.fill_null(column, b"")
    bounds = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    return data[bounds[0] : bounds[-1]], bounds - bounds[0]


def spans(bounds: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``most`` bytes; a longer text stands alone and stays whole."""
    first, n = 0, len(bounds) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(bounds, bounds[first] + most, side="right")) - 1)
        yield first, min(last, n)
        first = min(last, n)


def per_span(fn: Callable, column: pa.Array, most: int = 1 << 20) -> list:
    """``fn(bytes, bounds)`` over ranges of texts of bounded size, results in order."""
    data, bounds = utf8(column)
    return [fn(data[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a]) for a, b in spans(bounds, most)]


def pieces(data: np.ndarray, bounds: np.ndarray, gap: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs without ``gap`` bytes: first byte, byte after the last, index of the text."""
    inside = ~gap[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    full = bounds[:-1] < bounds[1:]
    heads, tails = bounds[:-1][full], bounds[1:][full] - 1
    first[heads], last[tails] = inside[heads], inside[tails]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(bounds, starts, side="right") - 1


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def powers(base: int, n: int) -> np.ndarray:
    """base**0 ... base**(n-1) modulo 2**64; kept for the next call unless it is very long."""
    held = _POWERS.get(base)
    if held is None or len(held) < n:
        size = 1 << max(10, (n - 1).bit_length())
        held, filled = np.ones(size, np.uint64), 1
        while filled < size:
            held[filled : 2 * filled] = held[:filled] * np.uint64(pow(base, filled, 2**64))
            filled *= 2
        if size <= 1 << 22:
            _POWERS[base] = held
    return held[:n]


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte range."""
    n = len(data)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[data] * powers(_BASE, n), out=sums[1:])
    back = powers(pow(_BASE, -1, 2**64), n + 1)
    return mix((sums[ends] - sums[starts]) * back[starts] + (ends - starts).astype(np.uint64))


def windows(words: np.ndarray, doc: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every ``size`` consecutive words of one text, and the index of its first word."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    acc = words[:n].copy()
    for k in range(1, size):
        acc = acc * np.uint64(0xD6E8FEB86659FD93) + words[k : k + n]
    at = np.flatnonzero(doc[:n] == doc[size - 1 :])
    return mix(acc[at]), at


def totals(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of per-byte values over each text."""
    run = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return run[bounds[1:]] - run[bounds[:-1]]


def later_copies(key: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For entries sorted by text: is it equal to an earlier one of its text; does its value occur twice or more there."""
    order = np.lexsort((np.arange(len(key)), key, doc))
    k, d = key[order], doc[order]
    same = np.zeros(len(k), bool)
    same[1:] = (k[1:] == k[:-1]) & (d[1:] == d[:-1])
    often = same.copy()
    often[:-1] |= same[1:]
    later, twice = np.zeros(len(k), bool), np.zeros(len(k), bool)
    later[order], twice[order] = same, often
    return later, twice


def rows(batches: Iterable[pa.RecordBatch], most: int = 2048) -> Iterator[pa.RecordBatch]:
    """Batches of at most ``most`` rows."""
    for batch in batches:
        for a in range(0, batch.num_rows, most):
            yield batch.slice(a, most)
