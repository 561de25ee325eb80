"""Approximate nearest neighbours by cross-polytope hashing with multiprobe tables and exact reranking."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import array_to_numpy, save, starts, whole_groups
from tessera.llm.vectors import matrix, unit, usable

#: Rows of the index in one tile, and queries in one tile, at most on average.
INDEX_TILE, QUERY_TILE = 4096, 2048
#: Most rows of a table of buckets that is sent to all.
SMALL = 200_000


def hadamard(rows: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of each row (width a power of two), orthonormal."""
    n, width = rows.shape
    out, h = rows, 1
    while h < width:
        x = out.reshape(n, width // (2 * h), 2, h)
        out = np.stack((x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]), axis=2).reshape(n, width)
        h *= 2
    return out / np.sqrt(width)


def rotate(rows: np.ndarray, table: int, seed: int) -> np.ndarray:
    """Pseudo-random rotation H D3 H D2 H D1 of table number ``table``; rows are padded to a power of two."""
    width = 1 << max(0, int(rows.shape[1] - 1).bit_length())
    out = np.zeros((len(rows), width))
    out[:, : rows.shape[1]] = rows
    signs = np.random.default_rng([seed, table, width]).choice([-1.0, 1.0], (3, width))
    for s in signs:
        out = hadamard(out * s)
    return out


def axes(rotated: np.ndarray, probes: int) -> np.ndarray:
    """The ``probes`` nearest signed axes of each row, nearest first; axis i is 2i (negative) or 2i + 1."""
    width = rotated.shape[1]
    probes = min(probes, 2 * width)
    both = np.concatenate([-rotated, rotated], axis=1)
    top = np.argpartition(-both, probes - 1, axis=1)[:, :probes] if probes < 2 * width else np.tile(np.arange(2 * width), (len(both), 1))
    order = np.take_along_axis(top, np.argsort(-np.take_along_axis(both, top, 1), axis=1, kind="stable"), 1)
    return np.where(order < width, 2 * order, 2 * (order - width) + 1)


def _hashed(df: DataFrame, tables: int, probes: int, seed: int, only_table: int | None = None) -> DataFrame:
    """Rows (id, vec, width, bucket) for each table and probe; bucket = table, axis in one number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, len(whole), 1024):
                batch = whole.slice(lo, 1024)
                widths = array_to_numpy(batch.column("width"))
                for w in np.unique(widths):
                    part = batch.filter(pa.array(widths == w))
                    rows = unit(matrix(part.column("vec")))
                    for t in range(tables) if only_table is None else (only_table,):
                        found = axes(rotate(rows, t, seed), probes) + (t << 32)
                        take = pa.array(np.repeat(np.arange(len(rows)), found.shape[1]))
                        yield pa.RecordBatch.from_arrays([*(part.column(c).take(take) for c in ("id", "vec", "width")), pa.array(found.ravel(), pa.int64())], ["id", "vec", "width", "bucket"])

    return df.mapInArrow(run, f"id long, vec {df.schema['vec'].dataType.simpleString()}, width int, bucket long")


def _counted(df: DataFrame, tables: int, probes: int, seed: int, only_table: int | None = None) -> DataFrame:
    """(width, bucket, rows of it): counted where the rows are, then added up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            widths = array_to_numpy(batch.column("width"))
            for w in np.unique(widths):
                rows = unit(matrix(batch.filter(pa.array(widths == w)).column("vec")))
                for t in range(tables) if only_table is None else (only_table,):
                    for lo in range(0, len(rows), 1024):
                        axis, n = np.unique(axes(rotate(rows[lo : lo + 1024], t, seed), probes), return_counts=True)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(axis), w, np.int32)), pa.array(axis + (t << 32)), pa.array(n)], ["width", "bucket", "n"])

    return df.mapInArrow(run, "width int, bucket long, n long").groupBy("width", "bucket").agg(F.sum("n").alias("n"))


def _dealt(rows: DataFrame, queries: DataFrame, tables: int, probes: int, seed: int, only_table: int | None = None) -> DataFrame:
    """Index rows and probes of a bucket meet in tiles of bounded size: each row goes to every block of
    the other kind, so hot buckets become many tasks. A vector travels once for each table, as stored."""
    key = ["width", "bucket"]
    n = _counted(rows, tables, 1, seed, only_table)
    m = _counted(queries, tables, probes, seed, only_table).withColumnRenamed("n", "m")
    shape = save(n.join(m, key).select(*key, F.ceil(F.col("n") / INDEX_TILE).cast("int").alias("a"), F.ceil(F.col("m") / QUERY_TILE).cast("int").alias("b")))
    # a width has at most 4 * width buckets in a table; only many widths could make this large
    if shape.count() <= SMALL:
        shape = F.broadcast(shape)

    def deal(df: DataFrame, own: str, other: str, kind: int) -> DataFrame:
        out = df.join(shape, key).withColumn(own, F.pmod(F.xxhash64(F.lit(5), "id"), F.col(own)).cast("int"))
        return out.withColumn(other, F.explode(F.sequence(F.lit(0), F.col(other) - 1))).select(*key, "a", "b", F.lit(kind).alias("kind"), "id", "vec")

    return deal(_hashed(rows, tables, 1, seed, only_table), "a", "b", 0).unionByName(deal(_hashed(queries, tables, probes, seed, only_table), "b", "a", 1))


def _nearest_in_tiles(dealt: DataFrame, k: int) -> DataFrame:
    """Up to k nearest rows of each tile for each query: (query_id, vec_id, score)."""
    keys = ["width", "bucket", "a", "b"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, keys):
            first = starts([array_to_numpy(table[c]) for c in keys])
            ids, kind = array_to_numpy(table["id"]), array_to_numpy(table["kind"])
            for lo, hi in zip(first, np.append(first[1:], len(ids)), strict=True):
                cut = lo + int(np.searchsorted(kind[lo:hi], 1))
                if cut in (lo, hi):
                    continue
                rows, queries = unit(matrix(table["vec"].slice(lo, cut - lo))), unit(matrix(table["vec"].slice(cut, hi - cut)))
                for at in range(0, len(queries), 512):
                    score = queries[at : at + 512] @ rows.T
                    own = ids[cut + at : min(hi, cut + at + 512)]
                    score[own[:, None] == ids[None, lo:cut]] = -np.inf
                    # one more than asked, and a little slack, so that rounding here decides nothing
                    least = np.partition(score, -k, axis=1)[:, -k] if score.shape[1] > k else np.full(len(score), -2.0)
                    q, r = np.nonzero((score >= least[:, None] - 1e-12) & (score > -2))
                    yield pa.RecordBatch.from_arrays([pa.array(own[q]), pa.array(ids[lo + r])], ["query_id", "vec_id"])

    sorted_ = dealt.repartition(*keys).sortWithinPartitions(*keys, "kind", "id")
    return sorted_.mapInArrow(run, "query_id long, vec_id long").distinct()


def _scaled(df: DataFrame) -> DataFrame:
    """Vectors times the power of two that brings the largest component near one: no digit of a cosine changes, and
    squares stay in range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column, n = batch.column("vec"), array_to_numpy(batch.column("width"))
            if not len(n):
                continue
            values = array_to_numpy(column.flatten())
            wide, begin = values.astype(np.float64), np.cumsum(n) - n
            exponent = np.frexp(np.maximum.reduceat(np.abs(wide), begin))[1]
            near_one = np.ldexp(wide, -np.repeat(exponent, n)).astype(values.dtype)
            lists = pa.ListArray.from_arrays(pa.array(np.append(begin, len(values)).astype(np.int32)), pa.array(near_one))
            yield pa.RecordBatch.from_arrays([batch.column("id"), lists, batch.column("width")], ["id", "vec", "width"])

    return df.mapInArrow(run, df.schema)


def exact_cosine(a: F.Column, b: F.Column) -> F.Column:
    """Cosine of two array columns, in doubles, from left to right."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def search(vectors: DataFrame, queries: DataFrame, *, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 5, tables: int = 8, probes: int = 16, seed: int = 11) -> DataFrame:
    """The k nearest rows of ``vectors`` by cosine for each row of ``queries``, itself left out.

    Every vector is indexed in ``tables`` hash tables under the signed axis nearest to it after a
    pseudo-random rotation (fast Hadamard transforms with random signs). A query looks into the
    ``probes`` nearest axes of each table; all it finds there is scored, and the k best are scored
    again from the original vectors in doubles. A query that found fewer than k looks at all axes
    of the first table, which is every row of its width.

    Rows: query_id, rank from 1, vec_id, score; ties go to the smaller vec_id. Vectors that are null,
    zero or hold null or non-finite components take no part; those of another width are never
    compared. Components may be of any size. Repeated ids: one of the rows (least vector) counts. Null ids take no part. Empty
    tables: no rows. Other columns are ignored.
    """

    def clean(df: DataFrame) -> DataFrame:
        kind = df.schema[vec_col].dataType
        own = kind if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType) else T.ArrayType(T.DoubleType())
        out = df.select(df[id_col].cast("long").alias("id"), df[vec_col].cast(own).alias("vec"))
        out = out.filter(F.col("id").isNotNull() & usable(F.col("vec")))
        return _scaled(out.groupBy("id").agg(F.min("vec").alias("vec")).withColumn("width", F.size("vec")))

    asked = save(clean(queries))
    # of equal vectors only the k + 1 of smallest id can be among a query's k nearest
    copy = F.row_number().over(Window.partitionBy("vec").orderBy("id"))
    rows = save(clean(vectors).withColumn("copy", copy).filter(F.col("copy") <= k + 1).drop("copy"))
    found = save(_nearest_in_tiles(_dealt(rows, asked, tables, probes, seed), k))
    enough = found.groupBy("query_id").count().filter(F.col("count") >= k).select(F.col("query_id").alias("id"))
    short = save(asked.join(enough, "id", "left_anti"))
    pairs = found
    if short.limit(1).count():
        every = 1 << 30  # more probes than axes
        pairs = found.unionByName(_nearest_in_tiles(_dealt(rows, short, 1, every, seed, 0), k)).distinct()
    q = asked.select(F.col("id").alias("query_id"), F.col("vec").alias("query_vec"))
    v = rows.select(F.col("id").alias("vec_id"), F.col("vec"))
    double = lambda c: F.col(c).cast("array<double>")
    scored = pairs.join(q, "query_id").join(v, "vec_id").select("query_id", "vec_id", exact_cosine(double("query_vec"), double("vec")).alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id"))
    ranked = scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
