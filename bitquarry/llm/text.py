"""Words of whole batches of texts, cut and hashed with numpy on their UTF-8 bytes."""

from __future__ import annotations

import numpy as np

_RNG = np.random.Generator(np.random.PCG64(20240229))
_R = np.uint64(0x9E3779B97F4A7C15)
_R_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[65:91] = _BYTE[97:123]
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

#: Bytes that are part of a word: all but white space; or ASCII letters, digits and all beyond ASCII.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[9, 10, 11, 12, 13, 32]] = False
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = ALNUM[128:] = True


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        for k, r in enumerate((_R, _R_INV)):
            p = np.full(1 << (n - 1).bit_length(), r, np.uint64)
            p[0] = 1
            _POWERS[k] = np.multiply.accumulate(p)
    return _POWERS[0][:n], _POWERS[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash."""
    h = h ^ (h >> np.uint64(33))
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def words(flat: np.ndarray, offsets: np.ndarray, part_of: np.ndarray, most: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words, A-Z taken as a-z, and each row's bounds in them (rows + 1).

    With ``most``, each word is followed by another hash: that of its first ``most`` bytes.
    """
    n = len(flat)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    inside = part_of[flat]
    first = np.empty(n, bool)
    first[0] = True
    np.logical_not(inside[:-1], out=first[1:])
    first[offsets[:-1][offsets[:-1] < n]] = True
    last = np.empty(n, bool)
    last[-1] = True
    np.logical_not(inside[1:], out=last[:-1])
    ends = offsets[1:] - 1
    last[ends[ends >= 0]] = True
    starts = np.flatnonzero(first & inside)
    stops = np.flatnonzero(last & inside) + 1
    power, inverse = _powers(n)
    sums = np.empty(n + 1, np.uint64)
    sums[0] = 0
    np.cumsum(np.where(part_of, _BYTE, np.uint64(0))[flat] * power, out=sums[1:])
    h = (sums[stops] - sums[starts]) * inverse[starts] + (stops - starts).astype(np.uint64)
    bounds = np.searchsorted(starts, offsets)
    if not most:
        return mix(h), bounds
    cut = np.minimum(stops, starts + most)
    head = (sums[cut] - sums[starts]) * inverse[starts] + np.uint64(1 << 40)
    return mix(np.column_stack([h, head]).reshape(-1)), 2 * bounds


def shingles(hashes: np.ndarray, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of k words of a row, and the rows' bounds in them; a row of fewer words, but not none, is one run."""
    counts = np.diff(bounds)
    n = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    out = np.concatenate([[0], np.cumsum(n)])
    short = np.flatnonzero((counts > 0) & (counts < k))
    at = np.arange(out[-1]) + np.repeat(bounds[:-1] - out[:-1], n)
    got = np.zeros(len(at), np.uint64)
    padded = np.concatenate([hashes, np.zeros(k, np.uint64)])
    for i in range(k):
        got = (got ^ padded[at + i]) * _R
        got ^= got >> np.uint64(31)
    for r in short:
        h = np.uint64(int(counts[r]))
        with np.errstate(over="ignore"):
            for x in hashes[bounds[r] : bounds[r + 1]]:
                h = (h ^ x) * _R
                h ^= h >> np.uint64(31)
        got[out[r]] = h
    return mix(got), out


def distinct_by_row(values: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's distinct values in ascending order, and the rows' bounds in them."""
    rows = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    order = np.lexsort((values, rows)) if len(bounds) > 2 else np.argsort(values)
    v, r = values[order], rows[order]
    keep = np.ones(len(v), bool)
    keep[1:] = (v[1:] != v[:-1]) | (r[1:] != r[:-1])
    return v[keep], np.searchsorted(r[keep], np.arange(len(bounds)))
