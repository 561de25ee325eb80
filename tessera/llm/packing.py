"""Packing of token sequences into windows by Karmarkar-Karp multiway differencing."""

from __future__ import annotations

import heapq
import itertools
import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.llm.common import Memory, give_back, text_slices

_TOKENIZERS: dict[str, Words] = {}
#: Bytes that the words a worker remembers may take.
REMEMBERED = 256 << 20


class Words:
    """Words (bytes, A-Z lower-cased, without white space) and their ids as little-endian bytes; short words are remembered."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.known = Memory(REMEMBERED)
        self.tokenizer = Tokenizer.from_file(path)
        self.closes = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.closes[[i for piece, i in self.tokenizer.get_vocab().items() if piece.endswith("</w>")]] = True

    def encoded(self, words: list[bytes]) -> list[bytes]:
        done = self.tokenizer.encode_batch_fast([w.decode("utf-8", "replace") for w in words], add_special_tokens=False)
        return [struct.pack(f"<{len(ids)}I", *ids) for ids in (e.ids for e in done)]

    def spelled(self, words: list[bytes]) -> list[bytes]:
        """As encoded(), for words of letters only: each ends at the one id that closes a word, so many
        go to the tokenizer as one text."""
        ids = np.array(self.tokenizer.encode_batch_fast([b" ".join(words).decode()], add_special_tokens=False)[0].ids, "<u4")
        cuts = [0, *(4 * (np.flatnonzero(self.closes[ids]) + 1)).tolist()]
        if len(cuts) != len(words) + 1:
            return self.encoded(words)
        data = ids.tobytes()
        return [data[i:j] for i, j in itertools.pairwise(cuts)]

    def learn(self, words: set[bytes]) -> dict[bytes, bytes]:
        """Ids of new words. A comma or full stop after a letter is a token of its own, so most
        words with one follow from the word without."""
        letters = lambda w: w.decode("utf-8", "replace").isalpha()
        ends = {w: w[:-1] for w in words if w[-1:] in (b",", b".") and letters(w[:-1])}
        parts = {ends.get(w, w) for w in words} | {b",", b"."}
        out = {w: self.known[w] for w in parts if w in self.known}
        new = [w for w in parts if w not in out]
        for made, part in ((self.spelled, [w for w in new if letters(w)]), (self.encoded, [w for w in new if not letters(w)])):
            for i in range(0, len(part), 512):
                out.update(zip(part[i : i + 512], made(part[i : i + 512]), strict=True))
        out.update({w: out[base] + out[w[-1:]] for w, base in ends.items()})
        for w in (*new, *ends):
            self.known.keep(w, out[w])
        return out

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Ids (as bytes) of UTF-8 texts, as the tokenizer file says.

        The tokenizer lower-cases, never joins what ASCII white space parts, and drops it; so each
        such word is encoded once and its ids are remembered.
        """
        get = self.known.get
        words = [text.lower().split() for text in texts]
        found = [list(map(get, ws)) for ws in words]
        lack = [(ws, ids, [k for k, v in enumerate(ids) if v is None]) for ws, ids in zip(words, found, strict=True) if None in ids]
        fresh = self.learn({ws[k] for ws, _, places in lack for k in places}) if lack else {}
        for ws, ids, places in lack:
            for k in places:
                ids[k] = fresh[ws[k]]
        return [b"".join(ids) for ids in found]


def encoder(path: str) -> Words:
    """The encoder for the tokenizer file at ``path``, one for each worker."""
    return _TOKENIZERS.get(path) or _TOKENIZERS.setdefault(path, Words(path))


def karmarkar_karp(sizes: list[int], k: int) -> list[list[int]]:
    """Deal items into k sets of near-equal sums; returns the item numbers of each set.

    Each partial partition is a list of its non-empty sets, largest first, as (sum less the
    smallest sum, tree of items). The two partitions with the largest imbalance are merged again
    and again, the largest set of one with the smallest of the other.
    """
    heap = [(-s, i, [(s, i)]) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    tick = len(heap)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        over = len(a) + len(b) - k
        if over <= 0:
            merged = a + b
        else:
            alone = len(a) - over  # the largest of a stay alone, the rest meet b from its smallest on
            merged = a[:alone] + b[: len(b) - over]
            merged += [(x[0] + y[0], (x[1], y[1])) for x, y in zip(a[alone:], reversed(b[len(b) - over :]), strict=True)]
        merged.sort(key=lambda x: -x[0])
        low = merged[-1][0] if len(merged) == k else 0
        if low:
            merged = [(s - low, t) for s, t in merged]
        heapq.heappush(heap, (-(merged[0][0] - (merged[-1][0] if len(merged) == k else 0)), tick, merged))
        tick += 1
    sets = []
    for _, tree in heap[0][2] if heap else []:
        stack, items = [tree], []
        while stack:
            x = stack.pop()
            stack.extend(x) if isinstance(x, tuple) else items.append(x)
        sets.append(items)
    return sets


def windows(sizes: list[int], capacity: int) -> list[list[int]]:
    """As few windows as differencing can fill: their count rises while any exceeds the capacity."""
    k = max(1, -(-sum(sizes) // capacity))
    step = 1
    while sizes:
        found = karmarkar_karp(sizes, k)
        if max(sum(sizes[i] for i in s) for s in found) <= capacity:
            return found
        k += step
        step = min(step + 1, 1 + k // 50)
    return []


SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_ARROW = pa.schema([(c.split()[0], pa.int64()) for c in SCHEMA.split(", ")])


def pack(docs: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2, capacity: int = 4096, block_windows: int = 96) -> DataFrame:
    """Tokenize texts, end each with ``end_id`` and pack them into sequences of at most ``capacity`` ids.

    What a document has in whole windows fills sequences of its own. The remainders of a partition
    are gathered into blocks of about ``block_windows`` windows, and each block is dealt into
    near-equal windows by ``windows``. There is no shuffle: a sequence holds documents of one scan
    partition, memory is bounded by a block, and a lost task is done again on its own.

    Rows: one for each piece, as in SCHEMA; pieces of a sequence are gapless from offset 0.
    Null or empty text: a document of the end id alone. Repeated rows and ties: every row is packed as
    a document of its own, under its own id. A null id stays null. Empty table: no rows. Other columns
    are ignored, whatever their names.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode = encoder(tokenizer).encode
        end = struct.pack("<I", end_id)
        sequence = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 32
        out: list[tuple] = []
        rest: list[tuple] = []
        waiting = 0

        def flush() -> None:
            nonlocal sequence, waiting
            for members in windows([r[2] for r in rest], capacity):
                at = 0
                for m in sorted(members):
                    doc, start, length, crc, total = rest[m]
                    out.append((doc, start, length, crc, total, sequence, at))
                    at += length
                sequence += 1
            rest.clear()
            waiting = 0

        def emit() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], schema=_ARROW)
            out.clear()
            return batch

        for batch in batches:
            for part in text_slices(batch, 1):
                raw = [(t or "").encode("utf-8", "surrogatepass") for t in part.column(1).to_pylist()]
                for doc, ids in zip(part.column(0).to_pylist(), encode(raw), strict=True):
                    ids += end
                    total, start = len(ids) // 4, 0
                    while total - start >= capacity:
                        out.append((doc, start, capacity, zlib.crc32(ids[4 * start : 4 * (start + capacity)]), total, sequence, 0))
                        sequence += 1
                        start += capacity
                    if start < total:
                        rest.append((doc, start, total - start, zlib.crc32(ids[4 * start :]), total))
                        waiting += total - start
                    if waiting >= capacity * block_windows:
                        flush()
            if len(out) > 20_000:
                yield emit()
        flush()
        if out:
            yield emit()
        give_back()

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")).mapInArrow(run, SCHEMA)
