"""Words of many texts at once: where they begin and end in one flat byte array, and a 64-bit hash of each."""

from __future__ import annotations

import numpy as np

#: An odd multiplier, and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
#: Bytes hashed at a time.
BLOCK = 1 << 20

_UP = np.arange(256, dtype=np.uint8)
_UP[ord("A") : ord("Z") + 1] += 32
#: Each byte, A-Z as a-z.
LOWER = _UP


def powers(n: int, of: int) -> np.ndarray:
    out = np.full(n, np.uint64(of), np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


_POWERS: dict[int, np.ndarray] = {}


def kept_powers(n: int, of: int) -> np.ndarray:
    if len(_POWERS.get(of, ())) < n:
        _POWERS[of] = powers(max(n, BLOCK + 4096), of)
    return _POWERS[of][:n]


def spans(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of each maximal run of True that stays within one text. offsets: where the texts begin, and the end of the last."""
    if not len(inside):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    held = offsets[:-1] < offsets[1:]
    begin, end = offsets[:-1][held], offsets[1:][held] - 1
    first[begin], last[end] = inside[begin], inside[end]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def mix(h: np.ndarray) -> np.ndarray:
    """Spread all bits over all bits."""
    h = h ^ (h >> np.uint64(32))
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of data[begin:end] for each pair; equal bytes have equal hashes. begin ascends, and so does end."""
    out = np.empty(len(begin), np.uint64)
    at = 0
    while at < len(begin):
        low = int(begin[at])
        stop = max(at + 1, int(np.searchsorted(end, low + BLOCK, "right")))
        n = int(end[stop - 1]) - low
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((data[low : low + n].astype(np.uint64) + np.uint64(1)) * kept_powers(n, BASE), out=sums[1:])
        b, e = begin[at:stop] - low, end[at:stop] - low
        out[at:stop] = (sums[e] - sums[b]) * kept_powers(n + 1, INVERSE)[b]
        at = stop
    return mix(out)


def member(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The place of each value in the sorted table, or -1."""
    if not len(table) or not len(values):
        return np.full(len(values), -1, np.int64)
    at = np.minimum(np.searchsorted(table, values), len(table) - 1)
    return np.where(table[at] == values, at, -1)


def expand(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1 ... (size[0] of them), start[1], ..."""
    ends = np.cumsum(size)
    return np.repeat(start - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)
