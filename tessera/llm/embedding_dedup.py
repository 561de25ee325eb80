"""Near-duplicate vectors by random-hyperplane sign hashing, exact verification and components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import array_to_numpy, components, local_components, pairs_of_tiles, save, tiles, whole_groups
from tessera.llm.vectors import matrix, unit, usable


def signs(rows: np.ndarray, tables: int, bits: int, seed: int) -> np.ndarray:
    """Sign codes (rows x tables, int32) against random hyperplanes through the origin."""
    planes = np.random.default_rng([seed, rows.shape[1]]).standard_normal((rows.shape[1], tables * bits))
    side = (rows @ planes > 0).reshape(len(rows), tables, bits)
    return (side * (1 << np.arange(bits))).sum(axis=2).astype(np.int32)


def first_met(codes: np.ndarray, at: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of pairs that share the code of table ``at``, those that share none of an earlier table; few codes are compared of most others."""
    for t in range(int(at.max(initial=0))):
        keep = (at[i] <= t) | (codes[i, t] != codes[j, t])
        if not keep.all():
            i, j = i[keep], j[keep]
    return i, j


def near_duplicates(vectors: DataFrame, *, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str | None = "label", least: float = 0.98, tables: int = 40, bits: int = 20, seed: int = 23, tile: int = 1024) -> DataFrame:
    """Link vectors of one label whose cosine is ``least`` or more, and join what links connect.

    Equal vectors of a label form one class, found by an aggregation. The classes' first vectors are
    hashed to ``bits`` signs in each of ``tables`` tables; those that share a bucket meet in tiles
    of bounded size. A pair is compared, by its cosine in doubles, only in the first table
    in which its codes agree, so links are counted once without listing the pairs; of each tile only sums
    and a spanning star of its linked groups are kept, both linear in the rows of the tile. At
    the given defaults a pair at the threshold is missed with probability 4e-6.

    Rows: vec_id, n_links (other vectors linked directly), component_id (smallest id reached), kept.
    Vectors that are null, zero or hold null or non-finite components, or whose label is null, link with
    nothing. Other widths never link. There is one row for each input row. Repeated ids: one of the rows (least label and vector) is
    compared, and all of them get its result. A null id links with nothing, and has no component. Empty table: no rows. Other
    columns are ignored.
    """
    label = F.col("raw_label").cast("string")
    all_rows = vectors.select(vectors[id_col].cast("long").alias("id"), vectors[vec_col].cast("array<double>").alias("vec"), (vectors[label_col] if label_col else F.lit("")).alias("raw_label"))
    all_rows = save(all_rows.filter("id is not null").withColumn("label", label).groupBy("id").agg(F.min(F.struct("label", "vec")).alias("r")).select("id", "r.label", "r.vec"))
    good = all_rows.filter(F.col("label").isNotNull() & usable(F.col("vec")))
    classes = good.groupBy("label", "vec").agg(F.min("id").alias("rep"), F.count("*").alias("n"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            widths = array_to_numpy(batch.column("width"))
            for w in np.unique(widths):
                part = batch.filter(pa.array(widths == w))
                codes = signs(unit(matrix(part.column("vec"))), tables, bits, seed)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("rep", "n", "label_key", "vec")), pa.array([c.tobytes() for c in codes], pa.binary())], ["rep", "n", "label_key", "vec", "codes"])

    keyed = classes.select("rep", "n", F.xxhash64("label", F.size("vec")).alias("label_key"), "vec", F.size("vec").alias("width"))
    reps = save(keyed.mapInArrow(hashed, "rep long, n long, label_key long, vec array<double>, codes binary"))

    def buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = np.frombuffer(b"".join(batch.column("codes").to_pylist()), np.int32).reshape(len(batch), tables)
            for t in range(tables):
                yield pa.RecordBatch.from_arrays([batch.column("rep"), batch.column("label_key"), pa.array(codes[:, t].astype(np.int64) + (t << 32))], ["rep", "label_key", "bucket"])

    small = reps.select("rep", "label_key", "codes").mapInArrow(buckets, "rep long, label_key long, bucket long")
    dealt = tiles(small, ["label_key", "bucket"], "rep", tile).join(reps.select("rep", "n", "vec", "codes"), "rep")
    keys = ["label_key", "bucket"]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, [*keys, "tile_a", "tile_b"]):
            rows = unit(matrix(table["vec"]))
            codes = np.frombuffer(b"".join(table["codes"].to_pylist()), np.int32).reshape(len(rows), tables)
            at = array_to_numpy(table["bucket"]) >> 32
            rep, n = array_to_numpy(table["rep"]), array_to_numpy(table["n"])
            add, links = np.zeros(len(rows), np.int64), []
            for i, j in pairs_of_tiles(table, keys, 1 << 18):
                i, j = first_met(codes, at, i, j)
                close = np.einsum("ij,ij->i", rows[i], rows[j]) >= least
                i, j = i[close], j[close]
                links.append((i, j))
                np.add.at(add, i, n[j])
                np.add.at(add, j, n[i])
            if sum(len(i) for i, _ in links):
                i, j = (np.concatenate(x) for x in zip(*links, strict=True))
                order = np.argsort(rep, kind="stable")
                place = np.empty(len(rep), np.int64)
                place[order] = np.arange(len(rep))
                low = order[local_components(len(rep), place[i], place[j])][place]
                use = np.zeros(len(rep), bool)
                use[i] = use[j] = True
                yield pa.RecordBatch.from_arrays([pa.array(rep[use]), pa.array(add[use]), pa.array(rep[low[use]])], ["rep", "add", "low"])

    sorted_ = dealt.repartition(*keys, "tile_a", "tile_b").sortWithinPartitions(*keys, "tile_a", "tile_b", "side")
    linked = save(sorted_.mapInArrow(compare, "rep long, add long, low long"))
    group = components(linked.select(F.col("rep").alias("u"), F.col("low").alias("v")).distinct())
    counts = linked.groupBy("rep").agg(F.sum("add").alias("add"))
    of_class = reps.select("rep", "n").join(counts, "rep", "left").join(group.withColumnRenamed("node", "rep"), "rep", "left")
    of_class = of_class.select("rep", (F.col("n") - 1 + F.coalesce("add", F.lit(0))).alias("links"), F.coalesce("component", "rep").alias("component"))
    member = good.join(classes.select("label", "vec", "rep"), ["label", "vec"]).select("id", "rep")
    of_id = member.join(of_class, "rep")
    every = vectors.select(vectors[id_col].cast("long").alias("id"))
    component = F.coalesce("component", "id")
    return every.join(of_id, "id", "left").select(F.col("id").alias("vec_id"), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))
