"""Context-tree weighting over bytes: the tree in numpy, for the keys of one shard."""

from __future__ import annotations

import math

import numpy as np

#: Context bytes. A key holds them, the latest first, above the byte that follows: 8 * (DEPTH + 1) bits, and 64 is all there are.
DEPTH = 7
#: Neither is part of UTF-8: it stands before a text's first byte, DEPTH times, and after its last.
EDGE = 0xFF
#: Context bytes that tell which shard a key is of. Nodes of fewer context bytes are summed over shards.
SHARED = 3
SHARD_BITS = 8 * (DEPTH + 1 - SHARED)
_HALF = np.log(0.5)
#: Log gamma of n + 1/2 (less that of 1/2) and of n + 1, for the small counts that most nodes have.
_HALVES = np.array([math.lgamma(n + 0.5) - math.lgamma(0.5) for n in range(1 << 12)])
_WHOLES = np.array([math.lgamma(n + 1.0) for n in range(1 << 12)])


def keys_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The key of every byte and of the end of each text, and where each text's keys begin (n + 1)."""
    pad = bytes([EDGE]) * DEPTH
    data = np.frombuffer(b"".join(pad + t + pad[:1] for t in texts), np.uint8)
    at = np.cumsum([0, *(len(t) + 1 for t in texts)])
    if not texts:
        return np.zeros(0, np.uint64), at
    n = len(data) - DEPTH
    wide = data.astype(np.uint64)
    key = wide[DEPTH : DEPTH + n].copy()
    for back in range(1, DEPTH + 1):
        key |= wide[DEPTH - back : DEPTH - back + n] << np.uint64(8 * (DEPTH + 1 - back))
    wanted = np.ones(n, bool)
    ends = at[1:-1] + DEPTH * np.arange(len(texts) - 1)
    for k in range(DEPTH):
        wanted[ends + k] = False
    return key[wanted], at


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Of positive numbers, by Stirling's series eight places further on."""
    z = x + 8.0
    out = (z - 0.5) * np.log(z) - z + 0.5 * np.log(2 * np.pi) + 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5)
    for k in range(8):
        out -= np.log(x + k)
    return out


def log_kt(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Krichevsky-Trofimov block probability (natural log) of a zeros and b ones, whole numbers."""
    few = a + b < len(_HALVES)
    i, j = (np.where(few, x, 0).astype(np.int32) for x in (a, b))
    out = _HALVES[i] + _HALVES[j] - _WHOLES[i + j]
    many = np.flatnonzero(~few)
    if len(many):
        a, b = a[many], b[many]
        out[many] = log_gamma(a + 0.5) + log_gamma(b + 0.5) - 2 * math.lgamma(0.5) - log_gamma(a + b + 1.0)
    return out


def _summed(new: np.ndarray, values: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, new) if len(new) else values


def _runs(sorted_: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([[True], sorted_[1:] != sorted_[:-1]])) if len(sorted_) else np.zeros(0, np.int64)


def _places(sorted_: np.ndarray) -> np.ndarray:
    """Of each value the number of its run."""
    return np.cumsum(np.concatenate([[0], sorted_[1:] != sorted_[:-1]]), dtype=np.int32) if len(sorted_) else np.zeros(0, np.int32)


def ones(key: np.ndarray, bit: int) -> np.ndarray:
    """Whether bit number ``bit`` of each key's byte is set."""
    return ((key >> np.uint64(7 - bit)) & np.uint64(1)).astype(bool)


def counted(key: np.ndarray, count: np.ndarray, bit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Nodes of bit number ``bit`` and where their keys begin, with zeros and ones, from sorted keys (context, byte) and their counts."""
    node = key >> np.uint64(8 - bit)
    new, one = _runs(node), ones(key, bit)
    return node[new], new, _summed(new, np.where(one, 0.0, count)), _summed(new, np.where(one, count, 0.0))


def shallower(key: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys with the farthest context byte dropped, sorted, their counts, and which of them each key became."""
    key = ((key >> np.uint64(16)) << np.uint64(8)) | (key & np.uint64(255))
    order = np.argsort(key, kind="stable")
    key, count = key[order], count[order]
    new, up = _runs(key), np.empty(len(key), np.int32)
    up[order] = _places(key)
    return key[new], _summed(new, count), up


def settled(a: np.ndarray, b: np.ndarray, below: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(weighted log probability, estimate of a one, posterior weight of stopping here) of nodes with a zeros and b ones.

    ``below`` is the sum of the children's weighted log probabilities; None at the greatest depth, where all stop. Nodes that training
    hasn't seen have counts of zero, which says nothing of either bit.
    """
    own = log_kt(a, b)
    estimate = (b + 0.5) / (a + b + 1.0)
    if below is None:
        return own, estimate, np.ones(len(a))
    weighted = _HALF + np.logaddexp(own, below)
    return weighted, estimate, np.exp(_HALF + own - weighted)


class Tree:
    """Levels ``least`` to DEPTH of sorted distinct keys with their training counts (0 for keys that are only asked for), whose
    contexts share no node of those levels with other trees."""

    def __init__(self, key: np.ndarray, count: np.ndarray, least: int = SHARED):
        count = count.astype(np.float64)
        self.least, self.keys, self.up, self.levels = least, {}, {}, {}
        for depth in range(DEPTH, least - 1, -1):
            if depth < DEPTH:
                key, count, self.up[depth] = shallower(key, count)
            self.keys[depth], made = key, []
            for bit in range(8):
                _, new, a, b = counted(key, count, bit)
                below = None if depth == DEPTH else self._below(depth, bit, deeper[bit], len(new))
                weighted, *self.levels[depth, bit] = settled(a, b, below)
                made.append((new, weighted))
            deeper = made
        self.count, self.deeper = count, made

    def _below(self, depth: int, bit: int, child: tuple[np.ndarray, np.ndarray], nodes: int) -> np.ndarray:
        """For each node of ``depth`` the sum of its children's weighted log probabilities."""
        new, weighted = child
        place = _places(self.keys[depth] >> np.uint64(8 - bit))
        return np.bincount(place[self.up[depth][new]], weighted, nodes)

    def parts(self) -> tuple[np.ndarray, ...]:
        """What the tree adds to the nodes one context byte above it: (bit and node in one number, zeros, ones, children's sum)."""
        depth = self.least - 1
        self.keys[depth], count, self.up[depth] = shallower(self.keys[self.least], self.count)
        out = []
        for bit in range(8):
            node, new, a, b = counted(self.keys[depth], count, bit)
            out.append((node | np.uint64(bit << 24), a, b, self._below(depth, bit, self.deeper[bit], len(new))))
        return tuple(np.concatenate(c) for c in zip(*out, strict=True))

    def log10(self, top: dict | None = None) -> np.ndarray:
        """Log probability of each key's byte in its context, mixed over all depths; ``top`` has the levels above.

        From the root on, ``left`` is the weight that has not stopped yet. Each key of a depth takes it over from the key it has
        one context byte above.
        """
        out = np.zeros(len(self.keys[DEPTH]))
        for bit in range(8):
            p, left = self._above(top or {}, bit)
            for depth in range(self.least, DEPTH + 1):
                key, (estimate, stop) = self.keys[depth], self.levels[depth, bit]
                if depth > self.least:
                    up = self.up[depth - 1]
                    p, left = p[up], left[up]
                p, left = _step(p, left, key, bit, estimate, stop, _places(key >> np.uint64(8 - bit)))
            out += np.log10(p)
        return out

    def _above(self, top: dict, bit: int) -> tuple[np.ndarray, np.ndarray]:
        key = self.keys[self.least]
        p, left, prefix = np.zeros(len(key)), np.ones(len(key)), (key & np.uint64(255)) >> np.uint64(8 - bit)
        for depth in range(self.least) if top else ():
            node, estimate, stop = top[depth, bit]
            context = key >> np.uint64(8 * (self.least + 1 - depth))
            p, left = _step(p, left, key, bit, estimate, stop, np.searchsorted(node, (context << np.uint64(bit)) | prefix))
        return p, left


def _step(p: np.ndarray, left: np.ndarray, key: np.ndarray, bit: int, estimate: np.ndarray, stop: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    one = estimate[place]
    here = left * stop[place]
    return p + here * np.where(ones(key, bit), one, 1.0 - one), left - here


def top_levels(code: np.ndarray, a: np.ndarray, b: np.ndarray, below: np.ndarray) -> dict:
    """Levels SHARED - 1 to 0, each (nodes, estimates, stop weights), from the trees' parts, summed by code.

    Valid UTF-8 has some 33,000 contexts of two bytes, and some 5.6 million such nodes at the most; texts have far fewer.
    """
    out, codes = {}, code.astype(np.uint64)
    for bit in range(8):
        own = np.flatnonzero(codes >> np.uint64(24) == bit)
        own = own[np.argsort(codes[own])]
        node, zeros, ones_, sums = codes[own] & np.uint64(0xFFFFFF), a[own], b[own], below[own]
        for depth in range(SHARED - 1, -1, -1):
            weighted, estimate, stop = settled(zeros, ones_, sums)
            out[depth, bit] = node, estimate, stop
            low = np.uint64((1 << bit) - 1)
            parent = ((node >> np.uint64(8 + bit)) << np.uint64(bit)) | (node & low)
            node, place = np.unique(parent, return_inverse=True)
            zeros, ones_, sums = (np.bincount(place, v, len(node)) for v in (zeros, ones_, weighted))
    return out
