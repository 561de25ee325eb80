"""N-gram Jaccard self-join with Bayesian pruning of candidates on MinHash values."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import array_to_numpy, components, give_back, local_components, pairs_of_tiles, save, starts, text_slices, tiles, whole_groups
from tessera.llm.shingles import minhashes, mixed, set_key, shingle_sets


#: If a tile's surviving pairs are fewer than this part of all, they are intersected one by one.
FEW = 64


def least_matches(threshold: float, tolerance: float, steps: list[int]) -> list[int]:
    """For each number of compared values, the fewest matches that keep a pair.

    With a uniform prior on the similarity, the posterior after s matches of m is Beta(s + 1, m - s + 1), and the
    probability that it reaches ``threshold`` is that of at most s successes in m + 1 trials.
    """
    out = []
    for m in steps:
        total, s = 0.0, 0
        while s < m:
            total += math.comb(m + 1, s) * threshold**s * (1 - threshold) ** (m + 1 - s)
            if total >= tolerance:
                break
            s += 1
        out.append(s)
    return out


def prune(a: np.ndarray, b: np.ndarray, left: np.ndarray, right: np.ndarray, steps: list[int], least: list[int]) -> np.ndarray:
    """Numbers of the pairs (left, right) that survive all steps; values are compared step by step."""
    alive, matches, done = np.arange(len(left)), np.zeros(len(left), np.int32), 0
    for m, need in zip(steps, least, strict=True):
        matches += (a[left[alive], done:m] == b[right[alive], done:m]).sum(axis=1, dtype=np.int32)
        keep = matches >= need
        alive, matches, done = alive[keep], matches[keep], m
    return alive


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections, over shingles that two sets or more hold."""
    sizes = [len(s) for s in sets]
    values, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = np.flatnonzero(count > 1)
    place = np.full(len(values), -1, np.int64)
    place[shared] = np.arange(len(shared))
    row, column = np.repeat(np.arange(len(sets)), sizes), place[column]
    row, column = row[column >= 0], column[column >= 0]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    out = np.zeros((len(sets), len(sets)), np.float32)
    for lo in range(0, len(shared), 4096):
        part = slice(*np.searchsorted(column, [lo, lo + 4096]))
        held = np.zeros((len(sets), min(4096, len(shared) - lo)), np.float32)
        held[row[part], column[part] - lo] = 1
        out += held @ held.T
    return out.astype(np.int64)


def _texts(column: pa.Array) -> list[bytes]:
    return [(t or "").encode("utf-8", "surrogatepass") for t in column.to_pylist()]


def join(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8, width: int = 5, tolerance: float = 1e-5, bands: int = 24, rows: int = 5, tile: int = 256) -> DataFrame:
    """Link documents whose sets of word shingles have a Jaccard similarity of ``threshold`` or more.

    1. Each text gives the MinHash values of its shingle set and a key of the set; equal sets form a class, found by
       aggregation, and only the class's smallest document goes on.
    2. Classes that agree in a band of MinHash values meet in tiles of bounded size. Their values are compared
       step by step, and a pair is dropped as soon as the posterior probability of reaching the threshold
       falls below ``tolerance``. Of what survives only a spanning star of each linked group is kept.
    3. The stars' components are clusters. Of a cluster of several tiles, signatures meet first, and shingles go only to tiles where
       a pair of theirs survives. In a tile the pairs that survive the same pruning are verified exactly on the
       shingles. Links are counted without listing pairs; the components of exact links are the result's groups.

    No step lists the pairs of a group, and hot buckets and clusters are dealt to many tasks. At the defaults a pair at
    the threshold shares a band with probability 0.9999.

    Rows, one for each input row: doc_id, set_id (smallest document of the same shingle set), class_id (smallest
    document of the linked group), n_links (other rows linked directly, copies included). Words are parted by ASCII
    white space, A-Z lower-cased. Null, empty and blank texts link with nothing; a text of fewer than ``width`` words is
    one shingle. Repeated rows count as rows and are copies of each other; different
    texts under one id should not occur, and if they do the id stands for both. A null id links with nothing. Empty
    table: no rows. Other columns are ignored.
    """
    base = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    count = bands * rows

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in text_slices(whole, 1):
                sets = shingle_sets(_texts(batch.column(1)), width)
                full = [s for s in sets if len(s)]
                values = iter(minhashes(full, count)) if full else iter(())
                k1, k2 = zip(*(set_key(s) for s in sets), strict=True)
                sig = [next(values).tobytes() if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(sig, pa.binary())], ["doc_id", "k1", "k2", "size", "sig"])
        give_back()

    signatures = save(base.mapInArrow(signed, "doc_id long, k1 long, k2 long, size long, sig binary"))
    key = ["k1", "k2", "size"]
    usable = signatures.filter("size > 0 and doc_id is not null")
    classes = save(usable.groupBy(*key).agg(F.min(F.struct("doc_id", "sig")).alias("f"), F.count("*").alias("n")).select(*key, F.col("f.doc_id").alias("rep"), "n", F.col("f.sig").alias("sig")))

    def banded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight = np.random.default_rng(9).integers(0, 1 << 63, (bands, rows), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        for batch in batches:
            sig = np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint16).reshape(len(batch), bands, rows)
            for b in range(bands):
                h = mixed((sig[:, b].astype(np.uint64) * weight[b]).sum(axis=1, dtype=np.uint64) + np.uint64(b))
                yield pa.RecordBatch.from_arrays([batch.column("rep"), pa.array(h.view(np.int64))], ["rep", "bucket"])

    buckets = classes.select("rep", "sig").mapInArrow(banded, "rep long, bucket long")
    dealt = tiles(buckets, ["bucket"], "rep", tile).join(classes.select("rep", "sig"), "rep")
    steps = list(range(16, count + 1, 16)) + ([count] if count % 16 else [])
    least = least_matches(threshold, tolerance, steps)

    def stars(rep: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Linked rows, and the place of the smallest representative that each reaches."""
        order = np.argsort(rep, kind="stable")
        place = np.empty(len(rep), np.int64)
        place[order] = np.arange(len(rep))
        low = order[local_components(len(rep), place[i], place[j])][place]
        use = np.zeros(len(rep), bool)
        use[i] = use[j] = True
        return np.flatnonzero(use), low

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, ["bucket", "tile_a", "tile_b"]):
            rep = array_to_numpy(table["rep"])
            sig = np.frombuffer(b"".join(table["sig"].to_pylist()), np.uint16).reshape(len(rep), count)
            found = []
            for i, j in pairs_of_tiles(table, ["bucket"], 1 << 18):
                kept = prune(sig, sig, i, j, steps, least)
                found.append((i[kept], j[kept]))
            if sum(len(i) for i, _ in found):
                i, j = (np.concatenate(x) for x in zip(*found, strict=True))
                use, low = stars(rep, i, j)
                yield pa.RecordBatch.from_arrays([pa.array(rep[use]), pa.array(rep[low[use]])], ["u", "v"])

    sorted_ = dealt.repartition("bucket", "tile_a", "tile_b").sortWithinPartitions("bucket", "tile_a", "tile_b", "side")
    clusters = save(components(sorted_.mapInArrow(candidates, "u long, v long").distinct()))

    wanted = clusters.withColumnRenamed("node", "rep").join(classes.select("rep", "k1", "n", "sig"), "rep").select("rep", "k1", "n", "sig", F.col("component").alias("cluster"))
    chosen = base.join(wanted, base["doc_id"] == wanted["rep"]).select("rep", "k1", "n", "sig", "text")

    def spelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in text_slices(whole, "text"):
                sets = shingle_sets(_texts(batch.column("text")), width)
                own = pa.array([len(s) > 0 and set_key(s)[0] == k for s, k in zip(sets, batch.column("k1").to_pylist(), strict=True)])
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("rep", "n", "sig")), pa.array([s.tobytes() for s in sets], pa.binary())], ["rep", "n", "sig", "shingles"]).filter(own)

    sets_ = chosen.mapInArrow(spelled, "rep long, n long, sig binary, shingles binary")
    spots = tiles(wanted.select("rep", "cluster"), ["cluster"], "rep", tile, counted=True)
    in_tiles = lambda df: df.repartition("cluster", "tile_a", "tile_b").sortWithinPartitions("cluster", "tile_a", "tile_b", "side", "rep")

    def survivors(batches: Iterator[pa.RecordBatch], other: str) -> Iterator[tuple[pa.Table, np.ndarray, np.ndarray]]:
        """Each tile without repeated rows, and its pairs that the pruning leaves; ``other`` is one more column that is kept."""
        columns = ["cluster", "tile_a", "tile_b", "side", "rep", "sig", *other.split()]
        for table in whole_groups(batches, columns[:3]):
            edges = [*starts([array_to_numpy(table[c]) for c in columns[:3]]).tolist(), len(table)]
            rep = array_to_numpy(table["rep"])
            for lo, hi in zip(edges, edges[1:], strict=False):
                own = table.select(columns).take(pa.array(lo + np.unique(rep[lo:hi], return_index=True)[1]))
                sig = np.frombuffer(b"".join(own["sig"].to_pylist()), np.uint16).reshape(len(own), count)
                found = []
                for i, j in pairs_of_tiles(own, ["cluster"], 1 << 18):
                    kept = prune(sig, sig, i, j, steps, least)
                    found.append((i[kept], j[kept]))
                if sum(len(i) for i, _ in found):
                    yield own, *(np.concatenate(x) for x in zip(*found, strict=True))

    def occupied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own, i, j in survivors(batches, ""):
            use = np.unique(np.concatenate([i, j]))
            yield from own.select(["rep", "cluster", "tile_a", "tile_b", "side"]).take(pa.array(use)).combine_chunks().to_batches()

    large = in_tiles(spots.filter("blocks > 1").drop("blocks").join(wanted.select("rep", "sig"), "rep")).mapInArrow(occupied, "rep long, cluster long, tile_a int, tile_b int, side int")
    small = spots.filter("blocks = 1").select("rep", "cluster", "tile_a", "tile_b", "side")
    placed = small.unionByName(large).join(sets_, "rep")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own, i, j in survivors(batches, "n shingles"):
            rep, n = array_to_numpy(own["rep"]), array_to_numpy(own["n"])
            sets = [np.frombuffer(s, np.uint64) for s in own["shingles"].to_pylist()]
            size = np.array([len(s) for s in sets])
            if len(i) * FEW > len(rep) ** 2:
                both = intersections(sets)[i, j]
            else:
                both = np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in zip(i.tolist(), j.tolist(), strict=True)], np.int64)
            close = both >= threshold * (size[i] + size[j] - both) - 1e-9
            i, j = i[close], j[close]
            if len(i):
                add = np.zeros(len(rep), np.int64)
                np.add.at(add, i, n[j])
                np.add.at(add, j, n[i])
                use, low = stars(rep, i, j)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (rep[use], add[use], rep[low[use]])], ["rep", "add", "low"])

    tiled = in_tiles(placed)
    linked = save(tiled.mapInArrow(verify, "rep long, add long, low long"))
    group = components(linked.select(F.col("rep").alias("u"), F.col("low").alias("v")).distinct()).withColumnRenamed("node", "rep")
    counts = linked.groupBy("rep").agg(F.sum("add").alias("add"))
    of_class = classes.select(*key, "rep", "n").join(counts, "rep", "left").join(group, "rep", "left")
    of_class = of_class.select(*key, "rep", F.coalesce("component", "rep").alias("class_id"), (F.col("n") - 1 + F.coalesce("add", F.lit(0))).alias("n_links"))
    out = signatures.select("doc_id", *key).join(of_class, key, "left")
    lone = F.col("size").isNull() | (F.col("size") == 0) | F.col("doc_id").isNull()
    own = lambda c: F.when(lone, F.col("doc_id")).otherwise(F.col(c))
    return out.select("doc_id", own("rep").alias("set_id"), own("class_id").alias("class_id"), F.when(lone, 0).otherwise(F.col("n_links")).cast("long").alias("n_links"))
