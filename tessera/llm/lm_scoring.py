"""Distributed scoring of texts by a context-tree-weighting model and by a unigram baseline."""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import ctw
from tessera.llm.common import array_to_numpy, give_back, save
from tessera.llm.shingles import mixed, word_hashes

#: Bytes of text in a block, and in a piece of it that is worked on at once.
BLOCK, PIECE = 32 << 20, 1 << 20
#: Hash that stands for the end of a text among the tokens.
END = np.uint64(0x5851F42D4C957F2D)
GRAMS, WORDS, TEXT = 0, 1, 2
#: Number that the totals of the baseline travel under, among those of nodes.
TOTALS = 1 << 30


def squeeze(numbers: np.ndarray, sorted_: bool = False) -> bytes:
    """Numbers of eight or four bytes as bytes by place, compressed.

    Sorted ones (of eight) are front-coded: of each only the bytes from the first that differs from the number before.
    """
    v = np.ascontiguousarray(numbers)
    if not sorted_:
        return zstandard.compress(v.view(np.uint8).reshape(-1, v.itemsize).T.tobytes(), 1)
    byte = v.astype(">u8").view(np.uint8).reshape(-1, 8)
    other = np.ones((len(byte), 8), bool)
    other[1:] = byte[1:] != byte[:-1]
    shared = other.argmax(axis=1).astype(np.uint8)
    return zstandard.compress(len(v).to_bytes(8, "little") + shared.tobytes() + b"".join(byte[shared <= k, k].tobytes() for k in range(8)), 1)


def unsqueeze(data: bytes, sorted_: bool = False, kind: type = np.uint64) -> np.ndarray:
    raw = np.frombuffer(zstandard.decompress(data), np.uint8)
    if not sorted_:
        return np.ascontiguousarray(raw.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()
    n = int.from_bytes(raw[:8].tobytes(), "little")
    shared, at = raw[8 : 8 + n], 8 + n
    out = np.zeros(n, np.uint64)
    for k in range(8):
        new = shared <= k
        last = np.cumsum(new)  # each number has the byte of the last one that brought a new one
        out = (out << np.uint64(8)) | raw[at - 1 + last].astype(np.uint64)
        at += int(last[-1]) if n else 0
    return out


class Distinct:
    """Sorted distinct keys, gathered piece by piece."""

    def __init__(self) -> None:
        self.key = np.zeros(0, np.uint64)
        self.waiting: list[np.ndarray] = []
        self.size = 0

    def add_all(self, keys: np.ndarray) -> None:
        keys = np.sort(keys)
        self.waiting.append(keys[ctw._runs(keys)])
        self.size += len(self.waiting[-1])
        if self.size > max(1 << 20, len(self.key) // 2):
            self.settle()

    def settle(self) -> np.ndarray:
        if self.waiting:
            key = np.concatenate([self.key, *self.waiting])
            self.waiting, self.size = [], 0
            key.sort(kind="stable")
            self.key = key[ctw._runs(key)]
        return self.key


class Counts:
    """Distinct keys with the sum of their counts, gathered piece by piece."""

    def __init__(self, kind: type = np.uint64) -> None:
        self.key, self.count = np.zeros(0, np.uint64), np.zeros(0, kind)
        self.waiting: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, key: np.ndarray, count: np.ndarray) -> None:
        """Keys that are sorted and distinct."""
        self.waiting.append((key, count))
        self.size += len(key)
        if self.size > max(1 << 20, len(self.key) // 3):
            self.settle()

    def add_all(self, keys: np.ndarray, learn: bool) -> None:
        keys = np.sort(keys)
        new = ctw._runs(keys)
        n = np.diff(np.append(new, len(keys))).astype(self.count.dtype)
        self.add(keys[new], n if learn else np.zeros_like(n))

    def settle(self) -> tuple[np.ndarray, np.ndarray]:
        if self.waiting:
            key = np.concatenate([self.key, *(k for k, _ in self.waiting)])
            count = np.concatenate([self.count, *(c for _, c in self.waiting)])
            # what isn't needed any more goes at once: a block has millions of keys
            self.key = self.count = key[:0]
            self.waiting, self.size = [], 0
            order = np.argsort(key, kind="stable")
            key = key[order]
            count = count[order]
            del order
            new = ctw._runs(key)
            self.key = key[new]
            del key
            self.count = np.add.reduceat(count, new, dtype=count.dtype) if len(new) else count
        return self.key, self.count


def held_out(doc_id: int | None, parts: int = 5, part: int = 1) -> bool:
    """Whether a document is left out of training: crc32 of its id as text, modulo ``parts``."""
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % parts == part


def prepared(text: str | None) -> bytes:
    """UTF-8 with A-Z lower-cased; null is empty."""
    return (text or "").encode("utf-8", "surrogatepass").lower()


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words and the end of each text, and where each text's tokens begin (n + 1)."""
    words, first = word_hashes(texts)
    at = first + np.arange(len(first))
    out = np.full(len(words) + len(texts), END, np.uint64)
    is_word = np.ones(len(out), bool)
    is_word[at[1:] - 1] = False
    out[is_word] = words
    return out, at


def shard_of(kind: int, key: np.ndarray, shards: int) -> np.ndarray:
    """Keys of one subtree at depth SHARED share a shard; words are dealt by their hash."""
    top = key >> np.uint64(ctw.SHARD_BITS) if kind == GRAMS else key
    return (mixed(top) % np.uint64(shards)).astype(np.int32)


def dealt(pieces: Iterable[list[tuple]], shards: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(kind, keys, training counts, shards) of a block's pieces, distinct keys in order of shard and key."""
    found = {GRAMS: Counts(np.uint32), WORDS: Counts(np.uint32)}
    for piece in pieces:
        for learn in (True, False):
            texts = [t for i, t in piece if held_out(i) != learn]
            if texts:
                found[GRAMS].add_all(ctw.keys_of(texts)[0], learn)
                found[WORDS].add_all(tokens(texts)[0], learn)
    for kind in (GRAMS, WORDS):
        key, count = found.pop(kind).settle()
        shard = shard_of(kind, key, shards)
        order = np.argsort(shard, kind="stable")
        shard, key, count = shard[order], key[order], count[order]
        del order
        yield kind, key, count, shard


def answered(packed: list[bytes], got: dict[int, list[bytes]], shards: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Of each kind a block's sorted keys, found again from its pieces, and their answers, which come in the order of ``dealt``."""
    found = {GRAMS: Distinct(), WORDS: Distinct()}
    for p in packed:
        texts = [t for _, t in pickle.loads(zstandard.decompress(p))]
        found[GRAMS].add_all(ctw.keys_of(texts)[0])
        found[WORDS].add_all(tokens(texts)[0])
    out = {}
    for kind, distinct in found.items():
        key = distinct.settle()
        value = np.concatenate([unsqueeze(p, kind=np.float32 if kind == GRAMS else np.uint64) for p in got.pop(kind)])
        if len(value) != len(key):
            raise RuntimeError("a block's answers don't fit its texts")
        own = np.empty_like(value)
        own[np.argsort(shard_of(kind, key, shards), kind="stable")] = value
        out[kind] = key, own
    return out


def lookup(table: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """``values`` of the keys ``wanted``, all of which are in the sorted ``table``."""
    order = np.argsort(wanted)
    out = np.empty(len(wanted), values.dtype)
    out[order] = values[np.searchsorted(table, wanted[order])]
    return out


_ROWS = "block long, kind int, shard int, keys binary, data binary"


def by_block(docs: DataFrame) -> int:
    """Partitions for rows that are dealt by block: some for each block, so that few tasks get more blocks than others."""
    return max(8, min(8192, 4 * docs.rdd.getNumPartitions()))


def trees(key: np.ndarray, count: np.ndarray, most: int = 1 << 17) -> Iterator[tuple[ctw.Tree, slice]]:
    """Trees over consecutive parts of a shard's keys, of about ``most`` keys or one subtree, so that memory is bounded by it."""
    first = ctw._runs(key >> np.uint64(ctw.SHARD_BITS))
    begin = 0
    for end in [*first[1:].tolist(), len(key)]:
        if end - begin >= most or end == len(key):
            if end > begin:
                yield ctw.Tree(key[begin:end], count[begin:end]), slice(begin, end)
            begin = end


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["block", "kind", "shard", "keys", "data"])


def _pieces(docs: list[tuple]) -> Iterator[list[tuple]]:
    piece, size = [], 0
    for d in docs:
        piece.append(d)
        size += len(d[1]) + 8
        if size > PIECE:
            yield piece
            piece, size = [], 0
    if piece:
        yield piece


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for n in range(len(batch)):  # one by one: the rows are few and long
            yield tuple(c[n].as_py() for c in batch.columns)


def score(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shards: int | None = None) -> DataFrame:
    """Score every text with a context-tree-weighting model and a unigram baseline learnt from the training part.

    A byte is eight binary decisions, each under the bits before it and 0 to DEPTH bytes of context. Every such node
    holds Krichevsky-Trofimov counts of the training texts; a node's weighted probability is half its own estimate and
    half the product of its children's, and a prediction mixes the estimates of all depths with the posterior weights
    that follow. The counts are of all training bytes, at every depth; scoring leaves them as they are.

    1. Blocks of texts yield their distinct (context, byte) keys and token hashes with training counts.
    2. These are summed by shard, where a shard owns whole subtrees below three bytes of context. What shards
       add to the nodes above them is summed by aggregation and sent to all.
    3. Each block's keys get their log probabilities from the shards, in the order in which it sent them, and the block's texts are
       scored with them.

    No model is broadcast or held by one task: a task sees a shard, or a block with its own keys.

    Rows, one for each input row: doc_id, held_out, n_tokens, n_known (tokens seen in training), train_tokens, base_score,
    score, n_bytes, bits_per_byte. ``score`` is the log10 probability of the lower-cased text's bytes and its end. Null
    and empty texts have their end alone. A null id counts as training. Repeated rows are scored and learnt from each.
    Without any training text the counts are zero and all probabilities those of an empty model. Empty table:
    no rows. Other columns are ignored.
    """
    base = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    # enough for a shard to fit a task, few enough for a block's rows to be long
    shards = shards or max(256, min(16_384, docs.rdd.getNumPartitions()))

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        waiting: list[tuple] = []
        size = 0

        def close() -> Iterator[pa.RecordBatch]:
            nonlocal number, waiting, size
            pieces = list(_pieces(waiting))
            for piece in pieces:
                yield _batch([(number, TEXT, 0, None, zstandard.compress(pickle.dumps(piece), 6))])
            for kind, key, count, shard in dealt(pieces, shards):
                new = np.append(ctw._runs(shard), len(shard)).tolist()
                yield _batch([(number, kind, int(shard[i]), squeeze(key[i:j], True), squeeze(count[i:j])) for i, j in zip(new, new[1:], strict=False)])
            number, waiting, size = number + 1, [], 0

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = prepared(text.as_py())
                waiting.append((doc, raw))
                size += len(raw) + 8
                if size > BLOCK:
                    yield from close()
        if waiting:
            yield from close()
        give_back()

    made = save(base.mapInArrow(blocks, _ROWS))
    lists = made.filter(F.col("kind") != TEXT)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, counts = None, Counts()
        for _, kind, shard, keys, data in _rows(batches):
            if at is not None and at != (kind, shard):
                key, count = counts.settle()
                yield _batch([(-1, *at, squeeze(key, True), squeeze(count))])
                counts = Counts()
            at = (kind, shard)
            counts.add(unsqueeze(keys, True), unsqueeze(data, kind=np.uint32).astype(np.uint64))
        if at is not None:
            key, count = counts.settle()
            yield _batch([(-1, *at, squeeze(key, True), squeeze(count))])

    by_shard = lambda df: df.repartition("kind", "shard").sortWithinPartitions("kind", "shard", "block")
    merged = save(by_shard(lists).mapInArrow(merge, _ROWS))

    def above(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, kind, _, keys, data in _rows(batches):
            count = unsqueeze(data)
            if kind == WORDS:
                parts = [(np.array([TOTALS]), np.array([float(count.sum())]), np.array([float((count > 0).sum())]), np.zeros(1))]
            else:
                parts = (tree.parts() for tree, _ in trees(unsqueeze(keys, True), count))
            for code, *sums in parts:
                yield pa.RecordBatch.from_arrays([pa.array(code.astype(np.int64)), *(pa.array(p, pa.float64()) for p in sums)], ["code", "a", "b", "below"])

    sums = merged.mapInArrow(above, "code long, a double, b double, below double").groupBy("code").agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.sum("below").alias("below")).toArrow()
    code, *values = (array_to_numpy(c) for c in sums.columns)
    n_train, n_distinct = (int(v[code == TOTALS].sum()) for v in values[:2])
    node = code < TOTALS
    top = docs.sparkSession.sparkContext.broadcast(ctw.top_levels(code[node], *(v[node] for v in values)))

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = value = np.zeros(0)
        for block, kind, shard, keys, data in _rows(batches):
            if block < 0:
                key, count = unsqueeze(keys, True), unsqueeze(data)
                value = count
                if kind == GRAMS:
                    value = np.empty(len(key), np.float32)
                    for tree, part in trees(key, count):
                        value[part] = tree.log10(top.value)
                continue
            yield _batch([(block, kind, shard, None, squeeze(value[np.searchsorted(key, unsqueeze(keys, True))]))])

    asked = merged.unionByName(lists.withColumn("data", F.lit(None).cast("binary")))
    answers = by_shard(asked).mapInArrow(answer, _ROWS)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(got: dict[int, list[bytes]]) -> Iterator[pa.RecordBatch]:
            texts = got.pop(TEXT)
            tables = answered(texts, got, shards)
            for packed in texts:
                yield evaluated(pickle.loads(zstandard.decompress(packed)), tables)

        at, got = None, {}
        for block, kind, _, _, data in _rows(batches):
            if block != at:
                if at is not None:
                    yield from flush(got)
                at, got = block, {GRAMS: [], WORDS: [], TEXT: []}
            got[kind].append(data)
        if at is not None:
            yield from flush(got)
        give_back()

    def evaluated(docs: list[tuple], tables: dict[int, tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        ids, texts = zip(*docs, strict=True)
        key, begin = ctw.keys_of(list(texts))
        total = np.add.reduceat(lookup(*tables[GRAMS], key).astype(np.float64), begin[:-1])
        word, first = tokens(list(texts))
        c = lookup(*tables[WORDS], word).astype(np.float64)
        unigram = np.add.reduceat(np.log10((c + 0.5) / (n_train + 0.5 * (n_distinct + 1))), first[:-1])
        known = np.add.reduceat((c > 0).astype(np.int64), first[:-1])
        size = np.array([len(t) for t in texts], np.int64)
        bits = -total / np.log10(2) / (size + 1)
        columns = [pa.array(ids, pa.int64()), pa.array([held_out(i) for i in ids]), pa.array(np.diff(first)), pa.array(known), pa.array(np.full(len(ids), n_train)), *map(pa.array, (unigram, total, size, bits))]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "n_bytes", "bits_per_byte"])

    parts = answers.unionByName(made.filter(F.col("kind") == TEXT)).repartition(by_block(docs), "block").sortWithinPartitions("block", "kind", "shard")
    return parts.mapInArrow(scored, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, n_bytes long, bits_per_byte double")
