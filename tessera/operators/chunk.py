"""Cutting texts into chunks of bounded size."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.text import token_count, trim

#: Where texts are cut, outermost first; a piece keeps the separator that ends it.
PATTERNS: tuple[tuple[str, ...], ...] = (("<SENT>",), ("\n\n",), ("\n",), (". ", "! ", "? ", ", ", "; "))
_WORD = re.compile(r"[^ \t\n\r]+")


class Words:
    """Counts words, parted by white space."""

    def count(self, text: str) -> int:
        return len(_WORD.findall(text))

    def cuts(self, text: str, most: int) -> list[int]:
        """Where to cut a text so that parts have at most ``most``."""
        return [m.start() for m in _WORD.finditer(text)][most::most]


class Tokens:
    """Counts the tokens of a tokenizer file, without special ones."""

    def __init__(self, path: str):
        self.path = path

    def _encoded(self, text: str):
        return _tokenizer(self.path).encode(text, add_special_tokens=False)

    def count(self, text: str) -> int:
        return len(self._encoded(text).ids)

    def cuts(self, text: str, most: int) -> list[int]:
        """Between tokens; a part alone may be cut into other tokens than in the whole, so parts are tried and made shorter as needed."""
        out, begin = [], 0
        while True:
            ends = [b for _, b in self._encoded(text[begin:]).offsets]
            if len(ends) <= most:
                return out
            n = most
            while n > 1 and self.count(text[begin : begin + ends[n - 1]]) > most:
                n -= 1
            begin += max(1, ends[n - 1])
            if begin >= len(text):
                return out
            out.append(begin)


@lru_cache(maxsize=4)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def count_words(text: str) -> int:
    return Words().count(text)


@lru_cache
def _separator(separators: tuple[str, ...]) -> re.Pattern:
    return re.compile("|".join(map(re.escape, separators)))


def pieces(text: str, separators: Sequence[str]) -> list[str]:
    """The text cut after each separator."""
    cuts = [m.end() for m in _separator(tuple(separators)).finditer(text)]
    edges = [0, *cuts, len(text)]
    return [text[a:b] for a, b in zip(edges, edges[1:], strict=False) if a < b]


def chunks(text: str, max_tokens: int, patterns: Sequence[Sequence[str]] = PATTERNS, merge: bool = True, unit: Words | Tokens | None = None) -> list[str]:
    """Chunks of at most ``max_tokens`` of a unit, words unless another is given.

    A text over the budget is cut at the outermost pattern; its parts over the budget at the next, and at the end between words or tokens.
    Neighbours are then merged as long as they fit. Without merging every pattern cuts, whatever the size.
    """
    unit = unit or Words()

    def cut(part: str, size: int, level: int) -> list[tuple[str, int]]:
        if merge and size <= max_tokens:
            return [(part, size)]
        if level == len(patterns):
            if size <= max_tokens:
                return [(part, size)]
            ends = unit.cuts(part, max_tokens)
            return [(p, unit.count(p)) for p in (part[a:b] for a, b in zip([0, *ends], [*ends, len(part)], strict=True))]
        found = pieces(part, patterns[level])
        if len(found) == 1:
            return cut(part, size, level + 1)
        return [c for p in found for c in cut(p, unit.count(p), level + 1)]

    joined: list[list[str]] = []
    total = 0
    for part, size in cut(text, unit.count(text), 0):
        if merge and joined and total + size <= max_tokens:
            joined[-1].append(part)
            total += size
        else:
            joined.append([part])
            total = size
    return [t for t in ("".join(j).strip(" \t\n\r") for j in joined) if t]


#: Bytes that a Python worker gets at once, and works on at once; what is longer comes alone.
BATCH_BYTES, SLICE_BYTES = 4 << 20, 1 << 20


def bound_batches(spark: SparkSession) -> None:
    """Rows hold texts of any length, so batches for Python end at a size, not only at a number of rows."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key)) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def text_slices(batches: Iterator[pa.RecordBatch], column: int, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut so that no part has over ``most`` bytes in a text column, unless in one row."""
    for batch in batches:
        begin, total = 0, 0
        for n, size in enumerate(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()):
            if n > begin and total + size > most:
                yield batch.slice(begin, n - begin)
                begin, total = n, 0
            total += size
        yield batch.slice(begin)


def chunk(docs: DataFrame, text_col: str, max_tokens: int, *, merge: bool = True, patterns: Sequence[Sequence[str]] = PATTERNS, tokenizer: str | None = None) -> DataFrame:
    """All columns but the text, with seq_id (from 0), text and token_len of each chunk. Null or blank texts have none.

    The budget counts words, or with ``tokenizer`` the tokens of that file, which every worker must be able to open.
    """
    unit = Tokens(tokenizer) if tokenizer else Words()
    kept = [f for f in docs.schema.fields if f.name != text_col]
    names = [f.name for f in kept]
    schema = T.StructType([*kept, T.StructField("seq_id", T.IntegerType()), T.StructField("text", T.StringType()), T.StructField("token_len", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, len(names)):
            rows, seq, out = [], [], []
            for n, text in enumerate(batch.column(len(names)).to_pylist()):
                for k, c in enumerate(chunks(text or "", max_tokens, patterns, merge, unit)):
                    rows.append(n)
                    seq.append(k)
                    out.append(c)
            take = pa.array(rows, pa.int32())
            arrays = [batch.column(i).take(take) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(seq, pa.int32()), pa.array(out, pa.string()), pa.array([unit.count(c) for c in out], pa.int64())], [*names, "seq_id", "text", "token_len"])

    bound_batches(docs.sparkSession)
    return docs.select(*names, text_col).mapInArrow(run, schema)


def chunk_lines(docs: DataFrame, keys: Sequence[str], text_col: str, max_tokens: int) -> DataFrame:
    """Lines gathered by running word count, in engine expressions alone: a line goes to chunk floor(words before it / budget)."""
    lines = docs.select(*keys, F.posexplode(F.split(text_col, "\n")).alias("line", "text")).withColumn("text", trim(F.col("text"))).filter("text <> ''")
    lines = lines.withColumn("tokens", token_count(F.col("text")))
    before = F.coalesce(F.sum("tokens").over(Window.partitionBy(*keys).orderBy("line").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    lines = lines.withColumn("seq_id", F.floor(before / F.lit(max_tokens)).cast("long"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda x: x["text"]), "\n")
    return lines.groupBy(*keys, "seq_id").agg(text.alias("text"), F.sum("tokens").cast("long").alias("token_len"), F.count("*").alias("n_lines"))
