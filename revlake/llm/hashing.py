"""Vectorised word and shingle hashing over UTF-8 bytes (numpy, no per-word Python)."""

from __future__ import annotations

import numpy as np

_RNG = np.random.default_rng(0x5EED)
#: One random 64-bit value per byte; ASCII capitals share their small letter's value (case folding).
GEAR = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
GEAR[65:91] = GEAR[97:123]
#: Word separators: space, tab, newline, vertical tab, form feed, carriage return.
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Word separators where punctuation must not matter: every ASCII byte but letters and digits.
MARKS = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
#: Texts are hashed in blocks of about this many bytes, cut at a separator.
BLOCK = 1 << 22


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        m = max(4096, 1 << (n - 1).bit_length())
        with np.errstate(over="ignore"):
            for i, base in enumerate((_BASE, _INVERSE)):
                p = np.full(m, np.uint64(base))
                p[0] = 1
                _POWERS[i] = np.cumprod(p, dtype=np.uint64)
    return _POWERS[0][:n], _POWERS[1]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every output bit depends on every input bit."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def _words(raw: np.ndarray, gap: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = len(raw)
    inside = np.zeros(n + 2, np.int8)
    inside[1:-1] = ~gap[raw]
    step = np.diff(inside)
    starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    powers, inverse = _powers(n)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(GEAR[raw] * powers, out=total[1:])
    return mix((total[ends] - total[starts]) * inverse[starts]), starts, ends


def words(data: bytes, gap: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first byte and end byte of every word between the separators in gap."""
    if len(data) <= 2 * BLOCK:
        return _words(np.frombuffer(data, np.uint8), gap)
    out, at = [], 0
    while at < len(data):
        end = min(len(data), at + BLOCK)
        while end < len(data) and not gap[data[end]]:
            end += 1
        h, s, e = _words(np.frombuffer(data[at:end], np.uint8), gap)
        out.append((h, s + at, e + at))
        at = end
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def shingles(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of size words; a shorter, non-empty text is one shingle of all its words."""
    n = len(hashes)
    if n == 0:
        return hashes
    size = min(size, n)
    total = np.zeros(n - size + 1, np.uint64)
    for i in range(size):
        total = total * np.uint64(_BASE) + hashes[i : n - size + 1 + i]
    return mix(total + np.uint64(size))
