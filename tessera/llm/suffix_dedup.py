"""Removal of long repeated byte strings by a distributed, common-prefix-aware merge sort of sampled suffixes."""

from __future__ import annotations

import hashlib
import pickle
import re
from collections import defaultdict
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import Saved, give_back, save
from tessera.llm.lm_scoring import _ROWS, Counts, _batch, _pieces, _rows, by_block, squeeze, unsqueeze
from tessera.llm.shingles import mixed
from tessera.llm.suffix_runs import Anchors, Group, Item, WordAnchors, common, decode_run, encode_run, merge_runs

#: A byte that isn't ASCII white space.
SOLID = rb"[^\x20\x09-\x0D]"
#: Bytes of text in a block; items in a piece of a run.
BLOCK, PIECE = 16 << 20, 8192
HALVES, HOT, SAMPLE, RUN, MAP, STRINGS, REPLY, REPEATED, TEXT = range(9)


def _spans(intervals: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs covered by intervals [a, b)."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(intervals):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def outermost(strings: np.ndarray, repeated: np.ndarray) -> np.ndarray:
    """(context, where its first repeated string begins, where its last one ends), of contexts that have any, from rows (key, context, begin, end)."""
    key, context, begin, end = strings[:, np.isin(strings[0].view(np.uint64), repeated)]
    new = np.flatnonzero(np.diff(context, prepend=-1))
    if not len(new):
        return np.zeros((0, 3), np.int64)
    return np.stack([context[new], np.minimum.reduceat(begin, new), np.maximum.reduceat(end, new)], axis=1)


def order_key(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The eight bytes from ``at`` on as a number that sorts as they do."""
    out = np.zeros(len(at), np.uint64)
    for k in range(8):
        out = (out << np.uint64(8)) | data[at + k].astype(np.uint64)
    return out


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = 400, words: int | None = None, remove_words: bool = True, carry: Sequence[str] = (), as_text: bool = False, run_piece: int = PIECE, hot: int = 50_000) -> DataFrame:
    """Remove each byte covered by a string of ``length`` bytes that also starts anywhere else in the table, or, if
    ``words`` is given, by that many whole words (set apart by ASCII white space) whose bytes stand as whole words elsewhere. Without
    ``remove_words`` the latter are only counted.

    A suffix array of every position would be many times the text. Suffixes are therefore sampled by content: each string
    of ``length`` bytes has one anchor, and equal strings have it at the same offset (``Anchors``), so it is enough
    to sort the suffixes at anchors, each with the bytes before it that its strings reach.

    1. The strings of an anchor are of two classes, by which half of their bytes, before the anchor or from it on, all of a class hold: its
       window. Blocks exchange a hash of each window; one that occurs once is in no repeated string.
    2. A block sorts the suffixes that begin at the windows left, equal contexts once with their count, front-codes the run and
       sends a piece of it to each range of suffixes. Ranges are cut at quantiles of the suffixes' first bytes.
    3. A range merges its runs with a loser tree that knows common prefixes (``merge_runs``). The lengths that neighbours share
       come out with the suffixes, and tell which strings occur twice (``Group``).
    4. Each block gets back which strings of its contexts are repeated, and cuts its texts.

    Suffixes that begin with the same window are judged together, so no window may be too frequent: of one that occurs more than ``hot``
    times, hashes of the single strings are added up instead, in each block first, and no task gathers its contexts. All copies of a
    string have the same window, so they go the same way.

    Strings of words go the same way with anchors of their own (``WordAnchors``), in ranges numbered after the others.

    Equal contexts travel once a block, so a group of copies costs a row for each block. Tasks hold a block of 16 MB of text
    or the compressed runs of a range.

    Rows, one for each input row: doc_id, the columns named in ``carry`` as carried_0, carried_1 and so on, n_bytes, n_removed, n_spans (maximal removed runs),
    kept_sha256, n_repeated (bytes in strings of either kind that occur twice), kept (the remaining bytes; with ``as_text`` a
    string, without bytes of characters that were cut in two). Strings never cross texts. Null text counts as empty. Repeated rows repeat
    each other's strings. A null id is kept. Empty table: no rows. Other columns are ignored.
    """
    base = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"), *(docs[c].alias(f"carried_{n}") for n, c in enumerate(carry)))
    # more for larger inputs, but few enough for the rows that blocks send them to be long
    partitions = docs.rdd.getNumPartitions()
    shards, ranges = max(64, min(16_384, 2 * partitions)), max(32, min(65_536, 2 * partitions))

    def sampled(texts: list[bytes]) -> list[Anchors | WordAnchors]:
        anchors = Anchors(texts, length)
        return [anchors] if words is None else [anchors, WordAnchors(anchors, words)]

    def to_shards(number: int, kind: int, key: np.ndarray, count: np.ndarray) -> Iterator[pa.RecordBatch]:
        """A block's keys, which are sorted, with their counts, a row for each shard that they go to."""
        shard = (mixed(key) % np.uint64(shards)).astype(np.int32)
        order = np.argsort(shard, kind="stable")
        key, count, shard = key[order], count[order], shard[order]
        cut = np.append(np.flatnonzero(np.diff(shard, prepend=-1)), len(shard)).tolist()
        if len(key):
            yield _batch([(number, kind, int(shard[i]), squeeze(key[i:j], True), squeeze(count[i:j])) for i, j in zip(cut, cut[1:], strict=False)])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        waiting: list[tuple] = []
        size = 0

        def close() -> Iterator[pa.RecordBatch]:
            nonlocal number, waiting, size
            counts = Counts()
            for part, piece in enumerate(_pieces(waiting)):
                yield _batch([(number, TEXT, part, None, zstandard.compress(pickle.dumps(piece), 6))])
                for anchors in sampled([d[1] for d in piece]):
                    classes = anchors.classes()
                    if len(classes.key):
                        counts.add_all(classes.key, True)
                        yield _batch([(number, SAMPLE, part, None, order_key(anchors.data, classes.window[part % 64 :: 64]).tobytes())])
            yield from to_shards(number, HALVES, *counts.settle())
            number, waiting, size = number + 1, [], 0

        for batch in batches:
            extra = [c.to_pylist() for c in batch.columns[2:]]
            for row, (doc, text) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1), strict=True)):
                raw = (text.as_py() or "").encode("utf-8", "surrogatepass")
                waiting.append((doc, raw, tuple(c[row] for c in extra)))
                size += len(raw) + 8
                if size > BLOCK:
                    yield from close()
        if waiting:
            yield from close()
        give_back()

    held = Saved(base.mapInArrow(blocks, _ROWS), by="kind")
    made = held.df
    texts = made.filter(F.col("kind") == TEXT)

    def frequent(kinds: list[tuple[int, int, float]]):
        """Of each block's keys those that occur more than ``least`` and at most ``most`` times in all blocks, for each (kind, least, most)."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at, held, counts = None, [], Counts()

            def flush() -> Iterator[pa.RecordBatch]:
                key, count = counts.settle()
                for kind, least, most in kinds:
                    wanted = key[(count > least) & (count <= most)]
                    for block, packed in held if len(wanted) else ():
                        own = unsqueeze(packed, True)
                        own = own[np.isin(own, wanted, assume_unique=True)]
                        if len(own):
                            yield _batch([(block, kind, at, squeeze(own, True), None)])

            for block, _, shard, keys, data in _rows(batches):
                if at is not None and shard != at:
                    yield from flush()
                    held, counts = [], Counts()
                at = shard
                held.append((block, keys))
                counts.add(unsqueeze(keys, True), unsqueeze(data))
            if at is not None:
                yield from flush()

        return run

    by_shard = lambda df: df.repartition("shard").sortWithinPartitions("shard", "block")
    halves = by_shard(made.filter(F.col("kind") == HALVES)).mapInArrow(frequent([(HALVES, 1, hot), (HOT, hot, float("inf"))]), _ROWS)

    def as_numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array((v ^ np.uint64(1 << 63)).view(np.int64))], ["v"])

    shares = [i / ranges for i in range(1, ranges)]
    quantiles = made.filter(F.col("kind") == SAMPLE).select("data").mapInArrow(as_numbers, "v long").agg(F.percentile_approx("v", shares, min(1_000_000, 20 * ranges))).first()[0]
    cuts = sorted({v + (1 << 63) for v in quantiles or ()})

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, keys, found = None, {}, {}

        def flush() -> Iterator[pa.RecordBatch]:
            rows: list[tuple] = []
            base = 0
            hashed, cutters = Counts(), sampled([])
            for (kind, of), contexts in found.items():
                items = sorted((suffix, left, places) for (suffix, left), places in contexts.items())
                if of == HALVES:
                    first = [int.from_bytes(i[0][:8], "big") for i in items]
                    edges = [0, *np.searchsorted(np.array(first, np.uint64), np.array(cuts, np.uint64)).tolist(), len(items)]
                    for r, (i, j) in enumerate(zip(edges, edges[1:], strict=False)):
                        for lo in range(i, j, run_piece):  # pieces of a run, in order
                            yield _batch([(at, RUN, kind * ranges + r, lo.to_bytes(8, "big"), encode_run([(*items[n][:2], base + n, len(items[n][2])) for n in range(lo, min(j, lo + run_piece))]))])
                else:
                    for lo in range(0, len(items), 1024):
                        strings = []
                        for n, (suffix, left, places) in enumerate(items[lo : lo + 1024], base + lo):
                            key, begin, end = cutters[kind].strings(left + suffix)
                            strings.append(np.stack([key.view(np.int64), np.full(len(key), n), begin, end]))
                            order = np.argsort(key)
                            new = np.flatnonzero(np.diff(key[order].view(np.int64), prepend=~key[order[:1]].view(np.int64)))
                            hashed.add(key[order][new], np.diff(np.append(new, len(key))).astype(np.uint64) * np.uint64(len(places)))
                        yield _batch([(at, STRINGS, lo, None, zstandard.compress(np.concatenate(strings, axis=1).tobytes(), 1))])
                rows += [(base + n, kind, *p) for n, i in enumerate(items) for p in i[2]]
                base += len(items)
            if rows:
                yield _batch([(at, MAP, 0, None, zstandard.compress(np.array(rows, np.int64).tobytes(), 1))])
            yield from to_shards(at, HOT, *hashed.settle())

        for block, kind, part, packed, data in _rows(batches):
            if block != at:
                if at is not None:
                    yield from flush()
                at, keys, found = block, {HALVES: [], HOT: []}, defaultdict(lambda: defaultdict(list))
            if kind in (HALVES, HOT):
                keys[kind].append(unsqueeze(packed, True))
                continue
            known = {of: np.sort(np.concatenate(k)) for of, k in keys.items() if k}
            if not known:
                continue
            piece = [d[1] for d in pickle.loads(zstandard.decompress(data))]
            for number, anchors in enumerate(sampled(piece)):
                classes = anchors.classes()
                for of, own in known.items():
                    use = np.flatnonzero(own[np.minimum(np.searchsorted(own, classes.key), len(own) - 1)] == classes.key)
                    for text, first, mid, last in classes.contexts(use):
                        t = piece[text]
                        found[number, of][t[mid:last], t[first:mid]].append((part, text, first))
        if at is not None:
            yield from flush()
        give_back()

    with_text = lambda df: df.unionByName(texts).repartition(by_block(docs), "block").sortWithinPartitions("block", "kind", "shard")
    sorted_runs = save(with_text(halves).mapInArrow(runs, _ROWS))
    for kind in (HALVES, SAMPLE):  # of what was made only the texts are still needed
        held.drop(f"kind={kind}")

    def chained(pieces: list[bytes]) -> Iterator[tuple[int, Item]]:
        before = b""
        for p in pieces:
            for n, (shared, item) in enumerate(decode_run(p)):
                yield (shared if n else common(before, item[0])), item
                before = item[0]

    half_words = re.compile(b"(?:%b+[\\x20\\x09-\\x0D]+){%d}%b+" % (SOLID, (words or 2) // 2 - 1, SOLID))

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(part: int, held: dict[int, list[bytes]]) -> Iterator[pa.RecordBatch]:
            names = list(held)
            out: dict[int, list] = defaultdict(list)
            items: list[tuple[bytes, bytes]] = []
            shared, times = [], []
            owners: list[list[tuple[int, int]]] = []
            seen: dict[tuple[bytes, bytes], int] = {}

            def judge() -> None:
                if len(items) == 1 and times[0] == 1:
                    return
                group = Group(items, shared, times)
                for own, span, (_, left) in zip(owners, group.strings(length) if part < ranges else group.words(words), items, strict=True):
                    if span:
                        for run, number in own:
                            out[run].append((number, len(left) + span[0], len(left) + span[1]))

            least, least_window = 0, 1 << 62
            for same, run, (suffix, left, number, n) in merge_runs([chained(p) for p in held.values()]):
                least = min(least, same)
                window = length // 2 if part < ranges else half_words.match(suffix).end()
                if same < min(window, least_window) and items:
                    judge()
                    items, shared, times, owners = [], [], [], []
                    seen.clear()
                    least_window = window
                least_window = min(window, least_window)
                place = seen.get((suffix, left))
                if place is None:
                    place = seen[suffix, left] = len(items)
                    items.append((suffix, left))
                    shared.append(least)
                    owners.append([])
                    times.append(0)
                    least = len(suffix)
                owners[place].append((run, number))
                times[place] += n
            if items:
                judge()
            for run, rows in out.items():
                yield _batch([(names[run], REPLY, 0, None, zstandard.compress(np.array(rows, np.int64).tobytes(), 1))])

        at, held = None, {}
        for block, _, part, _, data in _rows(batches):
            if at is not None and part != at:
                yield from flush(at, held)
                held = {}
            at = part
            held.setdefault(block, []).append(data)
        if at is not None:
            yield from flush(at, held)
        give_back()

    by_range = sorted_runs.filter(F.col("kind") == RUN).repartition("shard").sortWithinPartitions("shard", "block", "keys")
    replies = by_range.mapInArrow(merged, _ROWS).unionByName(by_shard(sorted_runs.filter(F.col("kind") == HOT)).mapInArrow(frequent([(REPEATED, 1, float("inf"))]), _ROWS))

    out_schema = T.StructType([
        T.StructField("doc_id", T.LongType()), *(T.StructField(f"carried_{n}", docs.schema[c].dataType) for n, c in enumerate(carry)),
        T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("n_spans", T.LongType()), T.StructField("kept_sha256", T.StringType()), T.StructField("n_repeated", T.LongType()), T.StructField("kept", T.StringType() if as_text else T.BinaryType()),
    ])
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(out_schema)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, got, gone, seen = None, {}, None, None
        for block, kind, part, packed, data in _rows(batches):
            if block != at:
                at, got, gone, seen = block, {MAP: [], STRINGS: [], REPLY: [], REPEATED: []}, None, None
            if kind == REPEATED:
                got[kind].append(unsqueeze(packed, True))
                continue
            if kind != TEXT:
                numbers = np.frombuffer(zstandard.decompress(data), np.int64)
                got[kind].append(numbers.reshape(4, -1) if kind == STRINGS else numbers.reshape(-1, 5 if kind == MAP else 3))
                continue
            if gone is None:
                gone, seen = defaultdict(list), defaultdict(list)
                reply = got[REPLY] + [outermost(s, np.concatenate(got[REPEATED])) for s in got[STRINGS] if got[REPEATED]]
                if got[MAP] and reply:
                    reply = np.concatenate(reply)
                    reply = reply[np.argsort(reply[:, 0])]
                    known = np.concatenate(got[MAP])
                    i = np.minimum(np.searchsorted(reply[:, 0], known[:, 0]), max(0, len(reply) - 1))
                    hit = reply[i, 0] == known[:, 0] if len(reply) else np.zeros(len(known), bool)
                    for (_, of_words, p, text, first), (_, a, b) in zip(known[hit].tolist(), reply[i[hit]].tolist(), strict=True):
                        seen[p, text].append((first + a, first + b))
                        if remove_words or not of_words:
                            gone[p, text].append((first + a, first + b))
            out = []
            for n, (doc, raw, extra) in enumerate(pickle.loads(zstandard.decompress(data))):
                spans = _spans(gone.get((part, n), []))
                edges = [0, *(x for s in spans for x in s), len(raw)]
                kept = b"".join([raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)])
                out.append((doc, *extra, len(raw), len(raw) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), sum(b - a for a, b in _spans(seen.get((part, n), []))), kept.decode("utf-8", "ignore") if as_text else kept))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), arrow, strict=True)], schema=arrow)
        give_back()

    back = sorted_runs.filter(F.col("kind").isin(MAP, STRINGS)).unionByName(replies)
    return with_text(back).mapInArrow(cut, out_schema)
