"""Content-defined anchors: every string of WINDOW bytes names one place in it, the same wherever the string stands."""

from __future__ import annotations

import numpy as np
import xxhash

WINDOW = 400
#: Bytes whose hash decides; a window holds WINDOW - GRAM + 1 of them and its anchor is the leftmost least.
GRAM = 128
_BASE = 0x5851F42D4C957F2D
_INVERSE = pow(_BASE, -1, 1 << 64)
_PLACE_BITS = 22
#: Windows handled at once; texts beyond that go piece by piece.
PIECE = 1 << 20


class _Powers:
    up = np.ones(1, np.uint64)
    down = np.ones(1, np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_Powers.up) < n:
        size = max(n, 2 * len(_Powers.up))
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            setattr(_Powers, name, np.cumprod(steps, dtype=np.uint64))
    return _Powers.up[:n], _Powers.down[:n]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _piece(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    n = len(data)
    with np.errstate(over="ignore"):
        up, down = _powers(n + 1)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:n], out=total[1:])
        grams = _mix((total[GRAM:] - total[:-GRAM]) * down[: n - GRAM + 1])
    wide = WINDOW - GRAM + 1
    low = np.uint64((1 << _PLACE_BITS) - 1)
    key = (grams & ~low) | np.arange(len(grams), dtype=np.uint64)
    blocks = -(-len(key) // wide)
    padded = np.full(blocks * wide, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(key)] = key
    grid = padded.reshape(blocks, wide)
    before = np.minimum.accumulate(grid, axis=1).ravel()
    after = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    windows = n - WINDOW + 1
    place = (np.minimum(after[:windows], before[wide - 1 : wide - 1 + windows]) & low).astype(np.int64)
    start = np.concatenate(([0], np.flatnonzero(np.diff(place)) + 1))
    return grams[place[start]], start, np.diff(np.append(start, windows)), place[start] - start


def anchors(text: bytes) -> list[tuple[int, ...]]:
    """(gram, s, t, start, n, times, lead) of each anchor of a text, in order.

    The n windows from byte ``start`` on share the anchor, ``lead`` bytes later; (s, t) are 128 bits
    of the string they cover. Neighbours that cover the same string (periodic
    text) are one entry: ``times`` of them, n windows together.
    """
    out: list[list[int]] = []
    whole = memoryview(text)
    for at in range(0, max(len(text) - WINDOW + 1, 0), PIECE):
        part = np.frombuffer(text, np.uint8, count=min(PIECE + WINDOW - 1, len(text) - at), offset=at)
        gram, start, n, lead = _piece(part)
        for g, s, c, d in zip(gram.view(np.int64).tolist(), (start + at).tolist(), n.tolist(), lead.tolist()):
            digest = xxhash.xxh3_128_intdigest(whole[s : s + c + WINDOW - 1])
            a, b = (digest >> 64) - (1 << 63), (digest & ((1 << 64) - 1)) - (1 << 63)
            last = out[-1] if out else None
            if last and last[0] == g and last[1] == a and last[2] == b and last[3] + last[4] == s:
                last[4] += c
                last[5] += 1
            else:
                out.append([g, a, b, s, c, 1, d])
    return [tuple(x) for x in out]
