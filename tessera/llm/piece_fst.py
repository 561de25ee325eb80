"""SentencePiece encoding and decoding as a weighted finite-state transducer and its shortest path."""

from __future__ import annotations

import math
import re
import struct
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.llm.common import Memory

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: State of the pair acceptor before the first piece.
START = -1
#: Bytes that each memory of a worker may take.
REMEMBERED = 160 << 20
#: Pairs that the acceptor remembers.
PAIRS = 500_000


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and values of a protocol-buffer message."""

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = data[at]
            at += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    at = 0
    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(kind) or varint()
            yield key >> 3, data[at : at + size]
            at += size


#: Key of a lexicon state under which the piece stands that is spelt there.
PIECE = ""


def lexicon(pieces: dict[str, int]) -> dict:
    """The pieces as an automaton over symbols: a state is the arcs by symbol, and under PIECE the piece that is spelt there."""
    start: dict = {}
    for spelling, number in pieces.items():
        state = start
        for c in spelling:
            state = state.setdefault(c, {})
        state[PIECE] = number
    return start


class Model:
    """The transducer that a model file stands for, the composition of

    - the normaliser, which writes a space as the space symbol and puts one in front (where the file says so);
    - the lexicon, whose paths spell pieces, each with weight -score;
    - byte fallback: a symbol that is no piece may be read as the pieces of its UTF-8 bytes, or as the unknown piece, with
      a weight above that of any piece;
    - an acceptor of pairs of pieces. For a merge model (BPE) a path is an encoding only if every two pieces in a row are
      what merging makes of the two together; other pairs have infinite weight. For other models all pairs weigh nothing.

    A text is composed with it and the tropical shortest path is its encoding. Of a merge model just one path has finite weight.
    """

    def __init__(self, path: str):
        with open(path, "rb") as f:
            message = list(_fields(f.read()))
        pieces = [dict(_fields(v)) for n, v in message if n == 1]
        trainer = dict(_fields(next((v for n, v in message if n == 2), b"")))
        rules = dict(_fields(next((v for n, v in message if n == 3), b"")))
        if rules.get(2):
            raise ValueError("normalisers with character maps aren't supported")
        if rules.get(4, 1):
            raise ValueError("normalisers that remove white space aren't supported")
        self.prefix = bool(rules.get(3, 1))
        names, self.kinds = [p[1].decode() for p in pieces], [p.get(3, NORMAL) for p in pieces]
        scores = [struct.unpack("<f", p[2])[0] if 2 in p else 0.0 for p in pieces]
        spelt = [bytes([int(p[3:5], 16)]) if k == BYTE else b"" if k == CONTROL else p.replace(SPACE, " ").encode() for p, k in zip(names, self.kinds, strict=True)]
        self.spelt = np.frombuffer(b"".join(spelt), np.uint8)
        self.size = np.array([len(s) for s in spelt], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.compile(names, self.kinds, scores, trainer.get(3, 1) == 2)

    def compile(self, names: list[str], kinds: list[int], scores: list[float], merging: bool) -> None:
        self.names, self.merging = names, merging
        self.ids = {p: i for i, (p, k) in enumerate(zip(names, kinds, strict=True)) if k in (NORMAL, USER)}
        self.lexicon = lexicon(self.ids)
        self.weight = [-s for s in scores]
        self.heaviest = max((self.weight[i] for i in self.ids.values()), default=0.0) + 10.0
        self.unknown = kinds.index(UNKNOWN)
        self.bytes = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(names, kinds, strict=True)) if k == BYTE}
        #: Neighbours that stand together in some piece; elsewhere every path has a cut.
        self.joined = {p[n : n + 2] for p in self.ids for n in range(len(p) - 1)}
        self.pairs: dict[int, dict[int, float]] = defaultdict(dict)
        self.known_pairs = 0
        self.parts, self.words, self.chunks = Memory(REMEMBERED), Memory(REMEMBERED), Memory(REMEMBERED)

    def merged(self, text: str) -> list[str]:
        """The pieces that merging makes of a text: again and again the neighbours whose joint piece weighs least."""
        out = list(text)
        while True:
            best, at = math.inf, -1
            for i in range(len(out) - 1):
                n = self.ids.get(out[i] + out[i + 1])
                if n is not None and self.weight[n] < best:
                    best, at = self.weight[n], i
            if at < 0:
                return out
            out[at : at + 2] = [out[at] + out[at + 1]]

    def pair(self, a: int, b: int) -> float:
        """Weight that the pair acceptor gives piece b after piece a (START: b is the first). Symbols that are no piece have numbers below START."""
        known = self.pairs[a].get(b)
        if known is None:
            self.known_pairs += 1
            if self.known_pairs > PAIRS:
                for row in self.pairs.values():  # rows that are in use stay
                    row.clear()
                self.known_pairs = 1
            parts = [self.names[n] if n >= 0 else chr(START - 1 - n) for n in (a, b) if n != START]
            known = self.pairs[a][b] = 0.0 if not self.merging or self.merged("".join(parts)) == parts else math.inf
        return known

    def shortest(self, symbols: str) -> list[int]:
        """Pieces on the path of least weight that reads ``symbols``; of symbols that are no piece numbers as in ``pair``.

        Nodes of the composition are (place, state of the pair acceptor). The beginning of a text up to a place has one merge result, so
        of a merge model one node of a place has finite weight; the acceptor of others has one state. So a place has one
        node. Places are in topological order, and every arc is relaxed once.
        """
        size, weights, merging = len(symbols), self.weight, self.merging
        total, last, back = [0.0] + [math.inf] * size, [START] * (size + 1), [0] * (size + 1)
        for at in range(size):
            before = total[at]
            if before == math.inf:
                continue
            row = self.pairs[last[at]]
            state, end, alone = self.lexicon, at, False
            while end < size:
                state = state.get(symbols[end])
                if state is None:
                    break
                end += 1
                n = state.get(PIECE)
                if n is None:
                    continue
                alone |= end == at + 1
                weight = before + weights[n]
                if merging:
                    pair = row.get(n)
                    weight += self.pair(last[at], n) if pair is None else pair
                if weight < total[end]:
                    total[end], last[end], back[end] = weight, n, at
            if not alone:  # the fallback's arc
                n = START - 1 - ord(symbols[at])
                weight = before + self.heaviest + self.pair(last[at], n)
                if weight < total[at + 1]:
                    total[at + 1], last[at + 1], back[at + 1] = weight, n, at
        out, at = [], size
        while at:
            out.append(last[at])
            at = back[at]
        return out[::-1]

    def part_ids(self, part: str) -> bytes:
        """Ids of a stretch of symbols that no piece reaches beyond."""
        ids = []
        for n in self.shortest(part):
            if n >= 0:
                ids.append(n)
            elif self.bytes:
                ids += [self.bytes[b] for b in chr(START - 1 - n).encode("utf-8", "surrogatepass")]
            else:
                ids.append(self.unknown)
        return struct.pack(f"<{len(ids)}I", *ids)

    def chunk_ids(self, chunk: str) -> bytes:
        """Ids of normalised text, cut wherever two neighbours are in no piece together."""
        out, begin = [], 0
        for at in range(1, len(chunk) + 1):
            if at == len(chunk) or chunk[at - 1 : at + 1] not in self.joined:
                part = chunk[begin:at]
                ids = self.parts.get(part)
                out.append(self.parts.keep(part, self.part_ids(part)) if ids is None else ids)
                begin = at
        return b"".join(out)

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian 32-bit numbers.

        Words of the usual kind, with one space before each and line breaks between lines, are looked up as they stand.
        """
        if not text:
            return b""
        text = text.replace(SPACE, " ")
        plain = self.prefix and "  " not in text and " \n" not in text and text[0] not in " \n" and text[-1] != " "
        if plain:
            pieces = text.replace("\n", " \n").split(" ")
            known = self.words
        else:
            pieces = re.findall(" *[^ \n]+|\n| +", " " * self.prefix + text)
            known = self.chunks
        found = list(map(known.get, pieces))
        if None in found:
            for i, ids in enumerate(found):
                if ids is None:
                    p = pieces[i]
                    chunk = p.replace(" ", SPACE) if not plain or p[:1] == "\n" else SPACE + p.replace(" ", SPACE)
                    ids = known.get(p)
                    found[i] = known.keep(p, self.chunk_ids(chunk)) if ids is None else ids
        return b"".join(found)

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes that ids spell, without the space that normalising put in front."""
        size = self.size[ids]
        total = int(size.sum())
        place = np.arange(total) + np.repeat(self.start[ids] - (np.cumsum(size) - size), size)
        out = self.spelt[place].tobytes()
        return out[1:] if self.prefix and out[:1] == b" " else out


@lru_cache(maxsize=2)
def load(path: str) -> Model:
    return Model(path)


SCHEMA = "doc_id long, n_ids long, ids_crc32 long, n_fallback long, round_trip boolean"


def encode(docs: DataFrame, model: str, *, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Encode each text with the model file at ``model`` and decode it again.

    Rows, one for each input row: doc_id, n_ids, ids_crc32 (of the ids as little-endian 32-bit numbers), n_fallback
    (ids of single bytes), round_trip (decoding gives the text, space symbols as spaces), and the ids if
    ``with_ids``. Nothing is shuffled; a worker compiles the model once. Null and empty texts have no ids. Repeated rows
    are encoded each. Empty table: no rows. Other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = load(model)
        fallback = np.array([k == BYTE for k in m.kinds])
        for whole in batches:
            for lo in range(0, len(whole), 512):
                batch, out = whole.slice(lo, 512), []
                for doc, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    packed = m.encode(text or "")
                    ids = np.frombuffer(packed, "<u4")
                    back = m.decode(ids) == (text or "").replace(SPACE, " ").encode("utf-8", "surrogatepass")
                    out.append((doc, len(ids), zlib.crc32(packed), int(fallback[ids].sum()), back, *((ids.astype(np.int32),) if with_ids else ())))
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.list_(pa.int32())]
                names = ["doc_id", "n_ids", "ids_crc32", "n_fallback", "round_trip", "ids"]
                columns = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=False)], names[: len(columns)])

    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    return rows.mapInArrow(run, SCHEMA + (", ids array<int>" if with_ids else ""))
