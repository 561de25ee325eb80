"""Plain versions of the operators, to compare with."""

from __future__ import annotations

import hashlib
import math
import zlib
from collections import Counter, defaultdict

SPACE = b" \t\n\r\x0b\x0c"


def words(text):
    return bytes((text or "").encode().lower()).split()


def shingles(text, width=5):
    w = words(text)
    if not w:
        return frozenset()
    return frozenset([tuple(w)] if len(w) < width else [tuple(w[i : i + width]) for i in range(len(w) - width + 1)])


def jaccard_groups(rows, threshold=0.8):
    """{doc_id: (set_id, class_id, n_links)} for (doc_id, text) of different ids."""
    sets = {i: shingles(t) for i, t in rows}
    link = {i: [j for j in sets if j != i and sets[i] and sets[j] and len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j]) - 1e-9] for i in sets}
    out = {}
    for i in sets:
        seen, todo = {i}, [i]
        while todo:
            for j in link[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        same = min(j for j in sets if sets[j] == sets[i]) if sets[i] else i
        out[i] = (same, min(seen), len(link[i]))
    return out


def without_repeats(rows, length):
    """[(doc_id, n_bytes, n_removed, n_spans, kept)] in order of the rows."""
    data = [(t or "").encode() for _, t in rows]
    count = Counter(b[k : k + length] for b in data for k in range(len(b) - length + 1))
    out = []
    for (i, _), b in zip(rows, data, strict=True):
        gone = [False] * len(b)
        for k in range(len(b) - length + 1):
            if count[b[k : k + length]] > 1:
                gone[k : k + length] = [True] * length
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(g and not (n and gone[n - 1]) for n, g in enumerate(gone))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest(), kept))
    return out


def log_kt(a, b):
    return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - 2 * math.lgamma(0.5) - math.lgamma(a + b + 1)


class ContextTree:
    """Context-tree weighting of the bits of bytes, each under the bits before it and up to ``depth`` bytes of context."""

    def __init__(self, texts, depth):
        self.depth = depth
        self.counts = defaultdict(lambda: [0, 0])
        self.children = defaultdict(set)
        for t in texts:
            for context, x in self.steps(t):
                for bit in range(8):
                    prefix = (bit, x >> (8 - bit))
                    for d in range(depth + 1):
                        self.counts[context[:d], prefix][(x >> (7 - bit)) & 1] += 1
                        if d:
                            self.children[context[: d - 1], prefix].add(context[:d])
        self.memo = {}

    def steps(self, text):
        data = bytes([255]) * self.depth + text + bytes([255])
        for k in range(self.depth, len(data)):
            yield data[k - self.depth : k][::-1], data[k]

    def weighted(self, context, prefix):
        key = context, prefix
        if key not in self.memo:
            own = log_kt(*self.counts[key])
            if len(context) < self.depth:
                below = sum(self.weighted(c, prefix) for c in self.children[key])
                top = max(own, below)
                own = top + math.log(0.5 * math.exp(own - top) + 0.5 * math.exp(below - top))
            self.memo[key] = own
        return self.memo[key]

    def log10(self, text):
        total = 0.0
        for context, x in self.steps(text):
            for bit in range(8):
                prefix, one, p = (bit, x >> (8 - bit)), (x >> (7 - bit)) & 1, 0.5
                for d in range(self.depth, -1, -1):
                    key = context[:d], prefix
                    if key in self.counts:
                        n = self.counts[key]
                        stop = 1.0 if d == self.depth else math.exp(math.log(0.5) + log_kt(*n) - self.weighted(*key))
                        p = stop * (n[one] + 0.5) / (sum(n) + 1) + (1 - stop) * p
                total += math.log10(p)
        return total


def held_out(i):
    return i is not None and zlib.crc32(str(i).encode()) % 5 == 1


def unigram(rows):
    """{(doc_id, text): (n_tokens, n_known, train_tokens, base_score)}."""
    count = Counter()
    for i, t in rows:
        if not held_out(i):
            count.update([*words(t), None])
    n, v = sum(count.values()), len(count)
    out = {}
    for i, t in rows:
        w = [*words(t), None]
        out[i, t] = (len(w), sum(count[x] > 0 for x in w), n, sum(math.log10((count[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w))
    return out


def mix(h):
    """The 64-bit bijection that noise is made with."""
    mask = (1 << 64) - 1
    h ^= h >> 30
    h = h * 0xBF58476D1CE4E5B9 & mask
    h ^= h >> 27
    h = h * 0x94D049BB133111EB & mask
    return h ^ h >> 31


def resampled(rows, labels, sample, grams, smoothing=10.0, seed=3):
    """{doc_id: (log ratio, n-grams, kept)} by importance resampling; rows of one id have one text."""
    own = [(i, Counter(grams(t))) for i, t in rows]
    raw, target = Counter(), Counter()
    for i, c in own:
        raw.update(c)
        if labels.get(i) == 1:
            target.update(c)
    share = sum(target.values()) / sum(raw.values())
    found = []
    for i, c in own:
        ratio = sum(n * math.log((target[g] - n * (labels.get(i) == 1) + smoothing * share) / ((raw[g] - n + smoothing) * share)) for g, n in c.items())
        uniform = ((mix((mix(i % (1 << 64)) + seed) % (1 << 64)) >> 12) + 0.5) / (1 << 52)
        found.append((i, ratio, sum(c.values()), ratio - math.log(-math.log(uniform)) if c else -math.inf))
    if sample is None:
        ratios = {i: r for i, r, n, _ in found if n}
        marked = sorted((ratios[i], q) for i, q in labels.items() if i in ratios)
        places = [(marked[k][0] + marked[min(k + 1, len(marked) - 1)][0]) / 2 for k in range(len(marked))]
        errors = [sum((x > marked[k][0]) != q for x, q in marked) for k in range(len(marked))]
        cut = places[max(k for k in range(len(marked)) if errors[k] == min(errors))]
        sample = sum(r > cut for _, r, n, _ in found if n)
    keys = sorted((key for *_, key in found), reverse=True)
    least = math.inf if sample <= 0 else keys[sample - 1] if sample <= len(keys) else -math.inf
    return {i: (r, n, key >= least) for i, r, n, key in found}
