"""Sorted runs of suffixes: sampling by content, front coding, and merging that never compares a known prefix again."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import zstandard

from tessera.llm.shingles import _BYTE, _powers, mixed

#: Bytes that a suffix is sampled by.
SEED = 16
#: What ASCII white space sets apart.
WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def prefix_hash(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What ``hash_of`` needs: running sums of byte values by place, and the inverse powers."""
    up, down = _powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[: len(data)], out=total[1:])
    return total, down


def hash_of(prefix: tuple[np.ndarray, np.ndarray], begin: np.ndarray, length: int | np.ndarray) -> np.ndarray:
    """64-bit hashes of the strings of one length, or of a length each, that begin at ``begin``."""
    total, down = prefix
    return mixed((total[begin + length] - total[begin]) * down[begin])


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` consecutive values, by running minima inside blocks from both ends."""
    n = len(values) - width + 1
    if n <= 0:
        return values[:0]
    blocks = -(-len(values) // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(values)] = values
    grid = padded.reshape(blocks, width)
    forward = np.minimum.accumulate(grid, axis=1).ravel()
    backward = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(backward[:n], forward[width - 1 : width - 1 + n])


class Anchors:
    """Sampled suffixes of texts: for each text of at least ``length`` bytes, the places that some string of that
    length is known by.

    Each string of ``length`` bytes has one anchor: where the hash of SEED bytes is least (the last such place). It is chosen
    by the string's bytes alone, so equal strings have it at the same offset. ``first`` and ``last`` are the
    first and last string that has the anchor; between them every string has it.
    """

    def __init__(self, texts: list[bytes], length: int):
        if length < 2 * SEED:
            raise ValueError(f"strings must have {2 * SEED} bytes or more")
        self.length = length
        self.data = np.frombuffer(b"".join(texts), np.uint8)
        ends = np.cumsum([len(t) for t in texts], dtype=np.int64)
        self.begin = ends - np.array([len(t) for t in texts], np.int64)
        self.prefix = prefix_hash(self.data)
        n = len(self.data) - length + 1
        empty = np.zeros(0, np.int64)
        self.at, self.first, self.last, self.text = empty, empty, empty, empty
        if n <= 0:
            return
        seeds = np.arange(len(self.data) - SEED + 1)
        total, down = self.prefix
        rolling = ((total[SEED:] - total[:-SEED]) * down[: len(seeds)]) * np.uint64(0x9FB21C651E98DF25)
        keyed = (rolling & np.uint64(0xFFFFFFFF00000000)) | (np.uint64(0xFFFFFFFF) - seeds.astype(np.uint64))
        anchor = (np.uint64(0xFFFFFFFF) - (sliding_min(keyed, length - SEED + 1) & np.uint64(0xFFFFFFFF))).astype(np.int64)
        # strings that would run over the end of a text are none
        step = np.zeros(len(self.data) + 1, np.int32)
        whole = ends - self.begin >= length
        np.add.at(step, self.begin[whole], 1)
        np.add.at(step, ends[whole] - length + 1, -1)
        inside = np.cumsum(step[:n]) > 0
        new = inside.copy()
        new[1:] &= ~inside[:-1] | (anchor[1:] != anchor[:-1])
        stop = inside.copy()
        stop[:-1] &= ~inside[1:] | (anchor[1:] != anchor[:-1])
        # neighbouring texts are told apart as well
        edge = self.begin[1:][self.begin[1:] < n]
        new[edge] |= inside[edge]
        before = edge[edge > 0] - 1
        stop[before] |= inside[before]
        self.first, self.last = np.flatnonzero(new), np.flatnonzero(stop)
        self.at = anchor[self.first]
        self.text = np.searchsorted(ends, self.first, side="right")

    def classes(self) -> Classes:
        """The strings of each anchor in two classes: those that hold half a string's bytes from the anchor on, and the others,
        which hold as many before it."""
        half = self.length // 2
        edge = self.at - (self.length - half)
        r, lft = np.flatnonzero(self.last >= edge), np.flatnonzero(self.first < edge)
        window = np.concatenate([self.at[r], self.at[lft] - half])
        key = hash_of(self.prefix, window, half)
        key[len(r) :] = ~key[len(r) :]
        first = np.concatenate([np.maximum(self.first[r], edge[r]), self.first[lft]])
        last = np.concatenate([self.last[r], np.minimum(self.last[lft], edge[lft] - 1)])
        return Classes(np.concatenate([self.text[r], self.text[lft]]), self.begin, window, first, last + self.length, key)

    def strings(self, context: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hash, begin and end of each string of a context."""
        data = np.frombuffer(context, np.uint8)
        begin = np.arange(len(data) - self.length + 1)
        return hash_of(prefix_hash(data), begin, self.length), begin, begin + self.length


class Classes:
    """Classes of strings that share a window: in each text (of those that begin at ``begin``) where the window starts, where the class's first
    string begins and its last one ends, and a hash of the window. A string is in one class, told by its bytes alone."""

    def __init__(self, text: np.ndarray, begin: np.ndarray, window: np.ndarray, first: np.ndarray, end: np.ndarray, key: np.ndarray):
        self.text, self.begin, self.window, self.first, self.end, self.key = text, begin, window, first, end, key

    def contexts(self, use: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """(text, and in it where the class's strings begin, the window, and where they end) of some classes."""
        text = self.text[use]
        begin = self.begin[text]
        return zip(text.tolist(), *((x[use] - begin).tolist() for x in (self.first, self.window, self.end)), strict=True)


def words_in(data: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the words (what ASCII white space sets apart) of texts that begin at ``begin`` start and end."""
    solid = (data != 32) & ((data < 9) | (data > 13))
    edge = np.zeros(len(data) + 1, bool)
    edge[begin] = edge[-1] = True
    start, stop = solid.copy(), solid.copy()
    start[1:] &= ~solid[:-1] | edge[1:-1]
    stop[:-1] &= ~solid[1:] | edge[1:-1]
    return np.flatnonzero(start), np.flatnonzero(stop) + 1


class WordAnchors:
    """Sampled suffixes as in ``Anchors``, for the strings that are ``words`` whole words.

    An anchor is the start of a word. It has SEED bytes of the string after it, as SEED / 2 words and the bytes between
    them are never fewer. ``first`` and ``last`` are the words that the first and last string of the anchor start with.
    """

    def __init__(self, anchors: Anchors, words: int):
        if words <= SEED // 2:
            raise ValueError(f"strings must have {SEED // 2 + 1} words or more")
        self.words, self.data, self.begin, self.prefix = words, anchors.data, anchors.begin, anchors.prefix
        self.start, self.stop = words_in(self.data, self.begin)
        self.at, self.word, self.first, self.last, self.text = (np.zeros(0, np.int64) for _ in range(5))
        n = len(self.start) - words + 1
        if n <= 0:
            return
        text = np.searchsorted(self.begin, self.start, side="right") - 1
        reach = words - SEED // 2
        seeds = np.arange(n + reach - 1)
        # the last seeds may run over the end if texts are short; no string has them
        hashed = hash_of(self.prefix, np.minimum(self.start[: len(seeds)], len(self.data) - SEED), SEED)
        keyed = (hashed & np.uint64(0xFFFFFFFF00000000)) | (np.uint64(0xFFFFFFFF) - seeds.astype(np.uint64))
        word = (np.uint64(0xFFFFFFFF) - (sliding_min(keyed, reach) & np.uint64(0xFFFFFFFF))).astype(np.int64)
        whole = np.flatnonzero(text[:n] == text[words - 1 :])
        if not len(whole):
            return
        word = word[whole]
        # an anchor is in one text, so neighbouring texts are told apart by it
        new = np.flatnonzero(np.diff(word, prepend=-1))
        self.first, self.last = whole[new], whole[np.append(new[1:], len(whole)) - 1]
        self.word = word[new]
        self.at, self.text = self.start[self.word], text[self.word]

    def classes(self) -> Classes:
        """As in ``Anchors``; windows are half a string's words, from the anchor's on or before it."""
        half = self.words // 2
        edge = self.word + half - self.words
        r, lft = np.flatnonzero(self.last >= edge), np.flatnonzero(self.first < edge)
        word = np.concatenate([self.word[r], self.word[lft] - half])
        window = self.start[word]
        key = hash_of(self.prefix, window, self.stop[word + half - 1] - window)
        key[len(r) :] = ~key[len(r) :]
        first = np.concatenate([np.maximum(self.first[r], edge[r]), self.first[lft]])
        last = np.concatenate([self.last[r], np.minimum(self.last[lft], edge[lft] - 1)])
        # a hash of words isn't that of bytes
        return Classes(np.concatenate([self.text[r], self.text[lft]]), self.begin, window, self.start[first], self.stop[last + self.words - 1], mixed(key))

    def strings(self, context: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        data = np.frombuffer(context, np.uint8)
        start, stop = words_in(data, np.zeros(1, np.int64))
        begin, end = start[: len(start) - self.words + 1], stop[self.words - 1 :]
        return mixed(hash_of(prefix_hash(data), begin, end - begin)), begin, end


def common(a: bytes, b: bytes, known: int = 0) -> int:
    """Length of the common prefix, of which ``known`` bytes are known already."""
    n = min(len(a), len(b))
    x = int.from_bytes(a[known:n], "big") ^ int.from_bytes(b[known:n], "big")
    return n - (x.bit_length() + 7) // 8


#: (suffix from the anchor, what stands before it, number in the block, occurrences)
Item = tuple[bytes, bytes, int, int]


def encode_run(items: list[Item]) -> bytes:
    """A run sorted by suffix, front-coded: of each suffix only what differs from the one before."""
    shared, parts, before = [], [], b""
    for suffix, left, _, _ in items:
        h = common(before, suffix)
        shared.append(h)
        parts += (suffix[h:], left)
        before = suffix
    head = np.array([shared, [len(i[0]) for i in items], [len(i[1]) for i in items], [i[2] for i in items], [i[3] for i in items]], np.int64)
    return zstandard.compress(len(items).to_bytes(8, "little") + head.tobytes() + b"".join(parts), 3)


def decode_run(data: bytes) -> Iterator[tuple[int, Item]]:
    """(length shared with the suffix before, item) in order."""
    raw = zstandard.decompress(data)
    n = int.from_bytes(raw[:8], "little")
    head = np.frombuffer(raw, np.int64, 5 * n, 8).reshape(5, n).T.tolist()
    at, before = 8 + 40 * n, b""
    for shared, size, left, number, times in head:
        tail = size - shared
        before = before[:shared] + raw[at : at + tail]
        at += tail
        yield shared, (before, raw[at : at + left], number, times)
        at += left


def merge_runs(runs: list[Iterator[tuple[int, Item]]]) -> Iterator[tuple[int, int, Item]]:
    """Merge sorted runs with a loser tree; yields (length shared with the suffix before, run, item).

    A node keeps the loser of its match and how much that shares with the winner. The next item of the
    run that won shares a known length with what was put out last, as each loser on its way up does:
    if the lengths differ, the longer one is smaller; only if they are equal are bytes compared, from there on.
    """
    k = 1 << max(0, (len(runs) - 1).bit_length())
    runs = [*runs, *(iter(()) for _ in range(k - len(runs)))]
    heads: list[Item | None] = [None] * k
    loser, shared_by = [0] * k, [0] * k

    def load(run: int) -> int:
        shared, heads[run] = next(runs[run], (-1, None))
        return shared

    def play(run: int, shared: int, node: int) -> tuple[int, int]:
        """Of ``run`` and the node's loser the winner, with what it shares with the last output."""
        other, theirs = loser[node], shared_by[node]
        if shared == theirs:
            a, b = heads[run], heads[other]
            if a is None or b is None:
                win = a is not None or b is None
                mine = -1
            else:
                mine = common(a[0], b[0], max(shared, 0))
                win = a[0][mine : mine + 1] <= b[0][mine : mine + 1] if mine < max(len(a[0]), len(b[0])) else run < other
            if win:
                shared_by[node] = mine
                return run, shared
            loser[node], shared_by[node] = run, mine
            return other, theirs
        if shared > theirs:
            return run, shared
        loser[node], shared_by[node] = run, shared
        return other, theirs

    def build(node: int) -> tuple[int, int]:
        if node >= k:
            return node - k, min(load(node - k), 0)
        (a, sa), (b, sb) = build(2 * node), build(2 * node + 1)
        loser[node], shared_by[node] = b, sb
        return play(a, sa, node)

    run, shared = build(1)
    while heads[run] is not None:
        yield shared, run, heads[run]
        shared = load(run)
        node = (run + k) // 2
        while node:
            run, shared = play(run, shared, node)
            node //= 2


#: Items of a group up to which every two are compared; larger groups are parted by sorting.
FEW = 6


class Group:
    """Suffixes in merged order that begin with the same window, and what stands before their windows.

    ``shared`` has the lengths that the merge found neighbours to share. Two items hold the same string around their windows if
    they share enough to the right, which is the least of ``shared`` between them, and to the left, for which what
    stands before the windows is sorted from there backwards. Bytes are compared, not hashes.
    """

    def __init__(self, items: list[tuple[bytes, bytes]], shared: list[int], times: list[int]):
        self.items, self.shared, self.times = items, shared, times

    def pairs(self) -> Iterator[tuple[int, int, int, int]]:
        """(item, later item, bytes shared to the right, and to the left) of all pairs of a small group."""
        back = [left[::-1] for _, left in self.items]
        for i in range(len(back)):
            right = len(self.items[i][0])
            for j in range(i + 1, len(back)):
                right = min(right, self.shared[j])
                yield i, j, right, common(back[i], back[j])

    def parted(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Shared lengths in merged order; the order by what stands before, and the shared lengths in that order."""
        back = [left[::-1] for _, left in self.items]
        order = sorted(range(len(back)), key=back.__getitem__)
        left = [0, *(common(back[a], back[b]) for a, b in zip(order, order[1:], strict=False))]
        return np.array([0, *self.shared[1:]]), np.array(order), np.array(left)

    def strings(self, length: int) -> list[tuple[int, int] | None]:
        """Of each item where, in bytes from the start of the window, its first string of ``length`` bytes that occurs twice begins (a number
        up to 0) and its last one ends; None without any. All strings hold the window, so those between are covered as well."""
        found: list[list[int] | None] = [None] * len(self.items)

        def note(i: int, least: int, most: int) -> None:
            """Strings that begin from ``most`` to ``least`` bytes before the window occur twice."""
            at = found[i]
            found[i] = [min(least, at[0]), max(most, at[1])] if at else [least, most]

        for i, ((suffix, left), n) in enumerate(zip(self.items, self.times, strict=True)):
            if n > 1:
                note(i, max(0, length - len(suffix)), len(left))
        if len(self.items) <= FEW:
            for i, j, right, left in self.pairs():
                if right + left >= length:
                    note(i, max(0, length - right), min(left, length))
                    note(j, max(0, length - right), min(left, length))
        else:
            self._strings_of_many(length, note)
        return [None if f is None else (-f[1], length - f[0]) for f in found]

    def _strings_of_many(self, length: int, note) -> None:
        right, order, left = self.parted()
        # who shares enough with whom changes only at these distances from the window
        low, high = max(0, length - int(right.max())), int(left.max())
        edges = np.unique(np.concatenate([length - right, left + 1, [low, high + 1]]))
        edges = edges[(edges >= low) & (edges <= high + 1)].tolist()
        before = np.empty(len(order), np.int64)
        for begin, end in zip(edges, edges[1:], strict=False):
            before[order] = np.cumsum(left < begin)
            for i in np.flatnonzero(twice(np.cumsum(right < length - begin) * (len(order) + 1) + before)).tolist():
                note(i, begin, end - 1)

    def words(self, words: int) -> list[tuple[int, int] | None]:
        """As ``strings``, for strings of ``words`` whole words; windows begin words."""
        found: list[tuple[int, int] | None] = [None] * len(self.items)
        slots = [self._slots(suffix, left, words) for suffix, left in self.items]

        def note(i: int, before: int, after: int) -> None:
            at = found[i]
            found[i] = (min(-before, at[0]), max(after, at[1])) if at else (-before, after)

        for i, n in enumerate(self.times):
            if n > 1:
                for s in slots[i]:
                    note(i, *s)
        if len(self.items) <= FEW:
            for i, j, right, left in self.pairs():
                for before, after in set(slots[i]) & set(slots[j]):
                    if before <= left and after <= right:
                        note(i, before, after)
                        note(j, before, after)
            return found
        right, order, left = self.parted()
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        # by length of the part before the anchor and of the part after it: items whose parts of that length are the same
        holders: dict[tuple[int, int], list[int]] = {}
        for i, own in enumerate(slots):
            for s in own:
                holders.setdefault(s, []).append(i)
        for (before, after), who in holders.items():
            if len(who) > 1:
                own = np.array(who)
                same = np.cumsum(right < after)[own] * (len(order) + 1) + np.cumsum(left < before)[place[own]]
                for i in own[twice(same)].tolist():
                    note(i, before, after)
        return found

    @staticmethod
    def _slots(suffix: bytes, left: bytes, words: int) -> list[tuple[int, int]]:
        """(bytes before the window, bytes from it on) of each string of ``words`` words."""
        starts = [len(left) - m.start() for m in WORD.finditer(left)][::-1]
        ends = [m.end() for m in WORD.finditer(suffix)]
        return [(n and starts[n - 1], ends[words - n - 1]) for n in range(max(0, words - len(ends)), min(len(starts), words - 1) + 1)]


def twice(keys: np.ndarray) -> np.ndarray:
    """Which keys occur more than once."""
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    out = np.zeros(len(keys), bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out
