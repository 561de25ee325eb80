"""Word shingles of many texts at once, as sorted arrays of 64-bit hashes."""

from __future__ import annotations

import numpy as np

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BYTE = np.random.default_rng(20240501).integers(0, 1 << 64, 256, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_PLACE = np.random.default_rng(20240502).integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def _powers(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse; kept up to a few million, and made anew for a longer text."""
    if len(_POWERS[0]) >= n:
        return _POWERS
    found = []
    for base in (_BASE, _INVERSE):
        p = np.full(n if n > 1 << 22 else 1 << (n - 1).bit_length(), base, np.uint64)
        p[0] = 1
        found.append(np.multiply.accumulate(p))
    if n <= 1 << 22:
        _POWERS[:] = found
    return found


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word (A-Z lower-cased, parted by ASCII white space) and where each text's words begin (n + 1)."""
    data = np.frombuffer(b" ".join([*texts, b""]).lower(), np.uint8)
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    space = _SPACE[data]
    begin = np.flatnonzero(~space & np.concatenate([[True], space[:-1]]))
    end = np.flatnonzero(~space & np.concatenate([space[1:], [True]])) + 1
    up, down = _powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[: len(data)], out=total[1:])
    words = mixed((total[end] - total[begin]) * down[begin])
    at = np.cumsum([0, *(len(t) + 1 for t in texts)])
    return words, np.searchsorted(begin, at)


def shingle_sets(texts: list[bytes], width: int = 5) -> list[np.ndarray]:
    """The sorted distinct shingles of ``width`` words of each text.

    A text of fewer words has one shingle of all its words; a text without words has none.
    """
    words, first = word_hashes(texts)
    n = len(words)
    full = np.zeros(max(0, n - width + 1), np.uint64)
    for k in range(width):
        full += words[k : k + len(full)] * _PLACE[k]
    full = mixed(full)
    out = []
    for lo, hi in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if hi - lo >= width:
            s = np.sort(full[lo : hi - width + 1])
            out.append(s[np.concatenate([[True], s[1:] != s[:-1]])])
        elif hi > lo:
            short = (words[lo:hi] * _PLACE[width + 1 : width + 1 + hi - lo]).sum(dtype=np.uint64)
            out.append(mixed(np.array([short ^ np.uint64(hi - lo)], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def set_key(s: np.ndarray) -> tuple[int, int]:
    """Two 64-bit sums that stand for a set of shingles."""
    return int(s.sum(dtype=np.uint64).view(np.int64)), int(mixed(s ^ _PLACE[0]).sum(dtype=np.uint64).view(np.int64))


def minhashes(sets: list[np.ndarray], count: int, seed: int = 5) -> np.ndarray:
    """MinHash values (sets x count, 16 bits of each) of non-empty sets."""
    rng = np.random.default_rng(seed)
    odd = (rng.integers(0, 1 << 31, count, dtype=np.uint32) * np.uint32(2)) + np.uint32(1)
    add = rng.integers(0, 1 << 32, count, dtype=np.uint32)
    out = np.empty((len(sets), count), np.uint16)
    lo = 0
    while lo < len(sets):
        hi, size = lo, 0
        while hi < len(sets) and (hi == lo or size + len(sets[hi]) <= 1 << 16):
            size += len(sets[hi])
            hi += 1
        h = (np.concatenate(sets[lo:hi]) >> np.uint64(32)).astype(np.uint32)
        first = np.cumsum([0, *(len(s) for s in sets[lo : hi - 1])])
        v, w = np.empty_like(h), np.empty_like(h)
        for k in range(count):
            np.multiply(h, odd[k], out=v)
            v += add[k]
            np.right_shift(v, 15, out=w)
            v ^= w
            v *= np.uint32(0x2C1B3C6D)
            np.right_shift(v, 13, out=w)
            v ^= w
            out[lo:hi, k] = np.minimum.reduceat(v, first)
        lo = hi
    return out
