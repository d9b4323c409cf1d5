"""Enhanced suffix array of a few strings and its tree of common-prefix intervals."""

from __future__ import annotations

import numpy as np

#: Symbols of nine bits in one key.
WIDE = 7


def _ranked(keys: np.ndarray) -> np.ndarray:
    """Dense ranks of keys, from 1."""
    order = np.argsort(keys)
    step = np.empty(len(keys), np.int64)
    step[0] = 1
    step[1:] = keys[order[1:]] != keys[order[:-1]]
    out = np.empty(len(keys), np.int64)
    out[order] = np.cumsum(step)
    return out


def maximal_repeats(strings: list[bytes], least: int, most: int) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(length, string, start) arrays of each maximal repeat of at least ``least`` bytes: all its places.

    Suffixes are sorted by doubling, up to ``most`` bytes, the longest string.
    Neighbours with ``least`` bytes in common form runs; a stack-scan of their
    common prefixes gives the intervals of the tree, and an interval counts if
    its suffixes are preceded by different bytes (or by a string's start). A run
    whose suffixes all have the same byte before them holds no such interval
    and isn't scanned: its repeats are part of longer ones.
    """
    lengths = np.array([len(x) for x in strings], np.int64)
    if not len(lengths) or least < WIDE or lengths.max() < least:
        return []
    begin = np.concatenate(([0], np.cumsum(lengths + 1)[:-1]))
    # symbols 1 to 256 are bytes; 0 ends each string and comes before all of them
    data = np.concatenate((np.frombuffer(b"\0".join(strings), np.uint8).astype(np.int64) + 1, np.zeros(2 * most + 16, np.int64)))
    data[begin[1:] - 1] = 0
    n = len(data)
    key = np.zeros(n, np.int64)
    for j in range(WIDE):
        key[: n - j] |= data[j:] << 9 * (WIDE - 1 - j)
    levels = {WIDE: _ranked(key)}
    h = WIDE

    def joined(r: np.ndarray, shift: int) -> np.ndarray:
        both = r << 32
        both[: n - shift] |= r[shift:]
        return _ranked(both)

    while 2 * h <= least:
        levels[2 * h] = joined(levels[h], h)
        h *= 2
    whole = levels[h] if h == least else joined(levels[h], least - h)
    usable = lengths - least + 1
    some = np.flatnonzero(usable > 0)
    owner = np.repeat(some, usable[some])
    place = np.arange(len(owner)) - np.repeat(np.cumsum(usable[some]) - usable[some], usable[some])
    at = begin[owner] + place
    rest, keys = most - least, [whole[at]]
    for offset in range(least, least + rest, h):
        keys.append(levels[h][np.minimum(at + offset, n - 1)])
    order = np.lexsort(keys[::-1])
    at, owner, place = at[order], owner[order], place[order]
    same = whole[at[1:]] == whole[at[:-1]]
    a, b = at[:-1][same], at[1:][same]
    deep = np.full(len(a), least, np.int64)
    for step in sorted(levels, reverse=True) if rest else []:
        for _ in range(-(-rest // step) if step == h else 1):
            deep += step * (levels[step][np.minimum(a + deep, n - 1)] == levels[step][np.minimum(b + deep, n - 1)])
    for _ in range(WIDE - 1):
        deep += data[np.minimum(a + deep, n - 1)] == data[np.minimum(b + deep, n - 1)]
    left_over = lengths[owner] - place
    common = np.zeros(len(at), np.int64)
    common[1:][same] = np.minimum(deep, np.minimum(left_over[:-1], left_over[1:])[same])
    first = np.flatnonzero(common == 0)
    size = np.diff(np.append(first, len(at)))
    before = np.where(place > 0, data[np.maximum(at - 1, 0)], 257 + owner)
    mixed = (size > 1) & (np.minimum.reduceat(before, first) != np.maximum.reduceat(before, first))
    out = []
    for lo, m in zip(first[mixed].tolist(), size[mixed].tolist()):
        prefix, byte = common[lo : lo + m].tolist(), before[lo : lo + m].tolist()
        # open intervals: common prefix, first suffix, the one byte before all of them or None
        stack = [[0, lo, byte[0]]]
        leaf = byte[0]
        for i in range(1, m + 1):
            value = prefix[i] if i < m else 0
            start, seen = lo + i - 1, leaf
            while stack and stack[-1][0] > value:
                depth, start, one = stack.pop()
                one = one if one == seen else None
                if one is None:
                    out.append((depth, owner[start : lo + i], place[start : lo + i]))
                seen = one
            if value:
                if stack[-1][0] == value:
                    if stack[-1][2] != seen:
                        stack[-1][2] = None
                else:
                    stack.append([value, start, seen])
                leaf = byte[i]
    return out
