"""Word shingles of whole texts as arrays of 64-bit hashes, for a batch of texts at once."""

from __future__ import annotations

import numpy as np

WIDTH = 5
_MUL = np.uint64(0x9E3779B97F4A7C15)
_ODD = [np.uint64(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)]
_BASE = 0x5851F42D4C957F2D


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit words."""
    x = x ^ (x >> np.uint64(30))
    x = x * _ODD[0]
    x = x ^ (x >> np.uint64(27))
    x = x * _ODD[1]
    return x ^ (x >> np.uint64(31))


_POWERS = np.ones(1, dtype=np.uint64)


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        size = max(n, 2 * len(_POWERS))
        with np.errstate(over="ignore"):
            steps = np.full(size, _BASE, dtype=np.uint64)
            steps[0] = 1
            _POWERS = np.cumprod(steps, dtype=np.uint64)
    return _POWERS


def word_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of each word of a text given as UTF-8 bytes; A-Z count as a-z."""
    if not len(data):
        return np.empty(0, np.uint64)
    low = np.where((data >= 65) & (data <= 90), data + 32, data)
    gap = (data == 32) | ((data >= 9) & (data <= 13))
    edge = np.flatnonzero(np.diff(np.concatenate(([True], gap, [True])).astype(np.int8)))
    start, end = edge[::2], edge[1::2]
    if not len(start):
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        # sum of byte * base ** (place in the word)
        length = (end - start).astype(np.int64)
        place = np.flatnonzero(~gap)
        first = np.concatenate(([0], np.cumsum(length)[:-1]))
        within = np.arange(len(place)) - np.repeat(first, length)
        total = np.add.reduceat((low[place].astype(np.uint64) + np.uint64(1)) * _powers(int(length.max()))[within], first)
        return mix(total ^ (length.astype(np.uint64) * _MUL))


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of a text's five-word shingles; with fewer words, of the whole sequence; empty without words."""
    if not text:
        return np.empty(0, np.uint64)
    words = word_hashes(np.frombuffer(text.encode("utf-8", "replace"), np.uint8))
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    width = min(n, WIDTH)
    with np.errstate(over="ignore"):
        acc = np.full(n - width + 1, np.uint64(width) * _MUL, np.uint64)
        for k in range(width):
            acc = mix(acc * _ODD[k] + words[k : n - width + 1 + k])
    return np.unique(acc)
