"""Keyed hashes composed from built-in SHA-256, whole in the JVM.

The padded key halves are literals of the plan and as secret as the key: keep
event logs private and set ``spark.sql.redaction.string.regex``.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, functions as F


def pads(key: bytes) -> tuple[bytes, bytes]:
    if len(key) > 64:
        key = hashlib.sha256(key).digest()
    key = key.ljust(64, b"\0")
    return bytes(b ^ 0x36 for b in key), bytes(b ^ 0x5C for b in key)


def hmac_sha256(body: Column, key: bytes, binary: bool = False) -> Column:
    """Hex HMAC-SHA256 of text (or of bytes with ``binary``)."""
    inner, outer = pads(key)
    data = body if binary else F.encode(body, "UTF-8")
    first = F.unhex(F.sha2(F.concat(F.lit(bytearray(inner)), data), 256))
    return F.sha2(F.concat(F.lit(bytearray(outer)), first), 256)


def fingerprint(secret: Column, length: int = 16) -> Column:
    return F.substring(F.sha2(secret, 256), 1, length)


def draw_text(*parts: Column) -> Column:
    """What a row's draws are hashed from."""
    return F.concat_ws("|", *[p.cast("string") for p in parts])


def hashed_draws(texts: list[str], draws: int) -> np.ndarray:
    """(rows, draws) uniform numbers in [0, 1), for use in a task on the :func:`draw_text` of its rows.

    One SHA-256 over the text and b // 5 yields five draws of 48 bits: same on every engine.
    """
    sha, ends = hashlib.sha256, [b"|%d" % g for g in range((draws + 4) // 5)]
    raw = b"".join([sha(t + e).digest() for t in map(str.encode, texts) for e in ends])
    pieces = np.frombuffer(raw, np.uint8).reshape(-1, 32)[:, :30].reshape(-1, 6)
    wide = np.zeros((len(pieces), 8), np.uint8)
    wide[:, 2:] = pieces
    return (wide.view(">u8").astype(np.float64) / float(1 << 48)).reshape(len(texts), -1)[:, :draws]


def unit_hash(*parts: Column) -> Column:
    """A reproducible uniform number in [0, 1) from the given parts.

    48 bits of SHA-256 over the parts joined with '|': same on every engine
    and in any partitioning.
    """
    text = F.concat_ws("|", *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.sha2(text, 256), 1, 12), 16, 10).cast("double") / float(1 << 48)
