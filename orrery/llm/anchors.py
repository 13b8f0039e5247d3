"""Winnowed anchors of byte strings, and equal 200-byte windows around them, in numpy."""

from __future__ import annotations

import numpy as np

WIDTH = 200
GRAM = 32
_REACH = WIDTH - GRAM + 1  # grams in a window
_CHUNK = 1 << 22
_M = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _M[1]
    return x ^ (x >> np.uint64(29))


def grams(data: np.ndarray, width: int, salt: int = 0) -> np.ndarray:
    """A 64-bit hash of every ``width`` bytes, built from halves (the last pair may overlap)."""
    h = (data.astype(np.uint64) + np.uint64(salt + 1)) * _M[0]
    have = 1
    while have < width:
        step = min(have, width - have)
        n = len(h) - step
        h = _mixed(h[:n] * _M[2] + (h[step:] ^ (h[step:] >> np.uint64(32))) * _M[3])
        have += step
    return h


def winnow(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first, last, at, hash): runs of window starts whose smallest gram is the one at ``at`` (the first, of equals).

    Where a window's anchor lies within it depends on its bytes alone, so equal
    windows have anchors of equal hash at equal offsets. Every window is in one run.
    """
    parts = []
    for base in range(0, max(len(data) - WIDTH + 1, 0), _CHUNK):
        piece = data[base : base + _CHUNK + WIDTH - 1]
        h = grams(piece, GRAM)
        low = np.uint64((1 << 23) - 1)
        m = (h & ~low) | np.arange(len(h), dtype=np.uint64)
        have = 1
        while have < _REACH:
            step = min(have, _REACH - have)
            m = np.minimum(m[: len(m) - step], m[step:])
            have += step
        at = (m & low).astype(np.int64)
        first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
        last = np.append(first[1:], len(at)) - 1
        parts.append((first + base, last + base, at[first] + base, h[at[first]]))
    if not parts:
        z = np.zeros(0, np.int64)
        return z, z, z, np.zeros(0, np.uint64)
    return tuple(np.concatenate([p[i] for p in parts]) for i in range(4))  # type: ignore[return-value]
