"""Vectorised word and shingle hashing over Arrow string buffers.

Everything here works on the UTF-8 bytes of whole texts.  A batch is walked in
runs of documents of about ``CHUNK`` bytes, so that memory stays bounded by the
longest single text, and no per-word Python object is ever made.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK = 1 << 19
#: The characters that end a word: space, tab, newline, vertical tab, form feed, carriage return.
WHITESPACE = b" \t\n\x0b\x0c\r"

_SPACE = np.zeros(256, bool)
_SPACE[list(WHITESPACE)] = True
_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[65:91] += 32
_LOWER += 1
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_UNBASE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}


def _power(base: np.uint64, n: int, name: str) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        size = max(n, 2 * CHUNK)
        have = np.full(size, base, np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if size <= 4 * CHUNK:
            _powers[name] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(32)
    return h


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null has an empty span."""
    if column.null_count:
        column = column.fill_null("")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), ends


def chunks(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row, bytes, offsets from 0) of runs of rows of about CHUNK bytes."""
    data, ends = string_buffers(column)
    first, n = 0, len(ends) - 1
    while first < n:
        last = int(np.searchsorted(ends, ends[first] + CHUNK, "right")) - 1
        last = min(n, max(last, first + 1))
        yield first, last, data[ends[first] : ends[last]], ends[first : last + 1] - ends[first]
        first = last


def word_spans(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for each row the index of its first word (one more entry at the end)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(ends), np.int64)
    solid = ~_SPACE[data]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    cut = ends[:-1][ends[:-1] < len(data)]
    first[cut] = solid[cut]
    last = solid.copy()
    last[:-1] &= ~solid[1:]
    cut = ends[1:][ends[1:] > 0] - 1
    last[cut] = solid[cut]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, ends)


def span_hashes(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span, A-Z lower-cased: polynomial prefix sums modulo 2**64, then a finaliser."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_LOWER[data] * _power(_BASE, len(data), "up"), out=sums[1:])
    return mix((sums[stops] - sums[starts]) * _power(_UNBASE, len(data) + 1, "down")[starts])


def shingle_sets(data: np.ndarray, ends: np.ndarray, width: int = 5) -> list[np.ndarray]:
    """For each row the sorted distinct hashes of its word shingles: the whole sequence as one below ``width`` words, none without words."""
    starts, stops, words = word_spans(data, ends)
    h = span_hashes(data, starts, stops)
    total = np.zeros(max(0, len(h) - width + 1), np.uint64)
    for k in range(width):
        total = total * np.uint64(0xD6E8FEB86659FD93) + h[k : len(h) - width + 1 + k] if len(total) else total
    total = mix(total)
    out = []
    for a, b in zip(words[:-1].tolist(), words[1:].tolist(), strict=True):
        if b - a >= width:
            s = np.sort(total[a : b - width + 1])
            out.append(s[np.concatenate(([True], s[1:] != s[:-1]))])
        elif b > a:
            x = np.uint64(b - a)
            for y in h[a:b]:
                x = np.uint64((int(x) * 0xA0761D6478BD642F + int(y)) & 0xFFFFFFFFFFFFFFFF)
            out.append(mix(np.array([x], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
