"""Shared plumbing of the training-data operators: scratch tables, grouped Arrow streams, tiles, components."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def scratch(spark: SparkSession) -> str:
    """A new folder name below the folder that driver and executors share.

    The folder is the session's ``spark.checkpoint.dir``; only where that is unset and all runs in one process, a
    temporary folder is set. What lies there is deleted when the driver ends, if it hasn't been before.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/tessera-{uuid.uuid4().hex}"
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(p)  # what doesn't exist yet can't be marked
    fs.deleteOnExit(p)
    return path


def give_back() -> None:
    """Return freed memory to the system: workers live on between tasks, and the allocators would keep it."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


class Memory(dict):
    """What was worked out for short keys (text or bytes), up to about ``most`` bytes; then it starts anew."""

    #: What an entry takes besides its key and value, and the longest key.
    ENTRY, LONGEST = 200, 64

    def __init__(self, most: int):
        super().__init__()
        self.most, self.used = most, 0

    def keep(self, key: str | bytes, value: bytes) -> bytes:
        if len(key) <= self.LONGEST:
            size = self.ENTRY + len(key) + len(value)
            if self.used + size > self.most:
                self.clear()
                self.used = 0
            self.used += size
            self[key] = value
        return value


def drop(spark: SparkSession, path: str) -> None:
    """Delete a scratch folder, in whatever file system it is."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


#: Lets Spark delete the shuffle files of a write when it ends; what was written replaces them.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Saved:
    """A DataFrame written to the shared folder, so that a lost executor costs only the tasks it ran."""

    def __init__(self, df: DataFrame, by: str | None = None, **figures: Column):
        """``figures`` are aggregates over the rows, found while they are written. Rows are kept apart ``by`` a column, if one is named, so
        that those of one value can be dropped."""
        self.spark, self.path = df.sparkSession, scratch(df.sparkSession)
        seen = Observation()
        if figures:
            df = df.observe(seen, *(c.alias(n) for n, c in figures.items()))
        before = self.spark.conf.get(CLEANUP, "false")
        self.spark.conf.set(CLEANUP, "true")
        try:
            df.write.mode("append").option("compression", "zstd").parquet(self.path, partitionBy=by)
        finally:
            self.spark.conf.set(CLEANUP, before)
        self.figures = seen.get if figures else {}
        self.df = self.spark.read.schema(df.schema).parquet(self.path).select(*df.columns)

    def drop(self, part: str = "") -> None:
        """Delete the rows, or those of a part ``column=value``, which must not be read again."""
        drop(self.spark, f"{self.path}/{part}")


def save(df: DataFrame) -> DataFrame:
    return Saved(df).df


def slices(sizes: Sequence[int], most: int = 1 << 20, rows: int = 256) -> Iterator[slice]:
    """Consecutive slices of at most ``rows`` items and ``most`` bytes; an item that is larger is a slice of its own."""
    begin, total = 0, 0
    for n, size in enumerate(sizes):
        if n > begin and (total + size > most or n - begin >= rows):
            yield slice(begin, n)
            begin, total = n, 0
        total += size
    if len(sizes) > begin:
        yield slice(begin, len(sizes))


def text_slices(batch: pa.RecordBatch, column: str | int, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """A batch cut so that no part has much text at once."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    for s in slices(sizes, most):
        yield batch.slice(s.start, s.stop - s.start)


def array_to_numpy(col: pa.ChunkedArray | pa.Array) -> np.ndarray:
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    return col.to_numpy(zero_copy_only=False)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: Sequence[str]) -> Iterator[pa.Table]:
    """Cut a stream that is sorted by ``keys`` (integers) into tables that never split a group."""
    kept: list[pa.Table] = []
    for batch in batches:
        if not len(batch):
            continue
        table = pa.concat_tables([*kept, pa.Table.from_batches([batch])])
        same = np.ones(len(table), bool)
        for k in keys:
            v = array_to_numpy(table[k])
            same &= v == v[-1]
        start = 0 if same.all() else len(same) - int(np.argmin(same[::-1]))
        if start:
            yield table.slice(0, start)
        kept = [table.slice(start)]
    if kept:
        yield kept[0]


def starts(columns: Sequence[np.ndarray]) -> np.ndarray:
    """Where each group begins in columns that are sorted together."""
    n = len(columns[0])
    new = np.zeros(n, bool)
    if n:
        new[0] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def pair_chunks(first: np.ndarray, n: int, limit: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs (i < j) inside the groups that begin at ``first``, about ``limit`` at a time.

    Groups are tiles of bounded size, so the pairs of one call are bounded as well.
    """
    ends = np.append(first[1:], n)
    partner_end = np.repeat(ends, ends - first)
    index = np.arange(n)
    count = partner_end - index - 1
    total = np.cumsum(count)
    begin = 0
    while begin < n:
        before = total[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(total, before + limit, side="right")))
        c = count[begin:end]
        if c.sum():
            i = np.repeat(index[begin:end], c)
            offset = np.arange(len(i)) - np.repeat(np.cumsum(c) - c, c)
            yield i, i + 1 + offset
        begin = end


def local_components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index that each of n nodes reaches over the links (a, b)."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        np.minimum.at(label, before, label)
        label = label[label]
        if (label == before).all():
            break
    return label


def tiles(df: DataFrame, keys: Sequence[str], member: str, size: int, counted: bool = False) -> DataFrame:
    """Deal each group of two rows or more into square tiles of about ``2 * size`` rows.

    Adds ``tile_a <= tile_b`` and ``side``, and the group's number of ``blocks`` if ``counted``. Rows of a group are dealt by the hash of ``member`` to
    ceil(count / size) blocks, and each block goes to the tiles it forms with every block, so each
    pair of rows of the group meets in a tile: pairs inside a block in the tile (a, a), others in
    (a, b). A hot group becomes many tasks, a small one stays a single tile. Counts are partially
    aggregated, and the join that carries them back is one that the engine can split on skew.
    """
    sizes = df.groupBy(*keys).agg(F.count("*").alias("group_rows")).filter("group_rows > 1")
    blocks = F.ceil(F.col("group_rows") / F.lit(size)).cast("int")
    out = df.join(sizes, list(keys)).withColumn("blocks", blocks)
    out = out.withColumn("block", F.pmod(F.xxhash64(F.lit(17), F.col(member)), F.col("blocks")).cast("int"))
    out = out.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return out.select(
        *[c for c in df.columns],
        F.least("block", "other").cast("int").alias("tile_a"),
        F.greatest("block", "other").cast("int").alias("tile_b"),
        (F.col("block") > F.col("other")).cast("int").alias("side"),
        *(["blocks"] if counted else []),
    )


def pairs_of_tiles(table: pa.Table, keys: Sequence[str], limit: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows to compare in a table of whole tiles: all pairs of (a, a), across sides of (a, b)."""
    cols = [array_to_numpy(table[k]) for k in (*keys, "tile_a", "tile_b")]
    side = array_to_numpy(table["side"])
    cross = cols[-1] != cols[-2]
    for i, j in pair_chunks(starts(cols), len(table), limit):
        keep = ~cross[i] | (side[i] != side[j])
        yield i[keep], j[keep]


def components(edges: DataFrame, most: int = 60) -> DataFrame:
    """Connected components: for edges (u, v) of integers, rows (node, component = smallest node).

    Alternates the large-star and small-star steps with aggregations and joins only; the links of
    a hub are never gathered, and every round is written to the shared folder. Nodes that occur
    in no edge do not appear. Self links keep a node alone.
    """
    ids = edges.select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v")).filter("u is not null and v is not null")
    mark = {"rows": F.count(F.lit(1)), "sum": F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))}
    now = Saved(ids.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), **mark)
    seen: list[Saved] = []

    def star(frame: DataFrame, large: bool) -> DataFrame:
        links = frame.unionByName(frame.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else frame
        # written, so that the join is one of two plain exchanges, of which the engine can split the one that has a hub
        held = Saved(links.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")))
        seen.append(held)
        least = held.df
        both = links.join(least.withColumnRenamed("u", "centre"), F.col("u") == F.col("centre"))
        if large:
            out = both.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        else:
            out = both.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            out = out.unionByName(least.filter("u <> m").select("u", F.col("m").alias("v")))
        return out.filter("u <> v").distinct()

    for _ in range(most):
        after = Saved(star(star(now.df, True), False), **mark)
        now.drop()
        while seen:
            seen.pop().drop()
        now, same = after, after.figures == now.figures
        if same:
            break
    else:
        raise RuntimeError("components did not settle")
    roots = now.df.select(F.col("v").alias("node")).distinct()
    return now.df.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots.select("node", F.col("node").alias("component")))
