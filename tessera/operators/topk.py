"""Exact nearest-vector search: scored scans with top-k pushed into the plan."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from tessera.functions.vectors import EPSILON, distance

#: Most query rows that are sent to every task; more are dealt to tiles.
BROADCAST_QUERIES = 4096


def check_k(k: int) -> int:
    if k < 0:
        raise ValueError("top_k must not be negative")
    return k


def literal(vector: Sequence[float]) -> Column:
    """A query vector in the plan itself, so that nothing is joined."""
    return F.array(*[F.lit(float(x)) for x in vector])


def comparable(vector: Column, width: Column | int) -> Column:
    """Whether a vector can be compared with queries of a width: it is there, is as wide, and has no null components."""
    wide = F.size(vector) == (F.lit(width) if isinstance(width, int) else width)
    return F.coalesce(wide & ~F.exists(vector, lambda x: x.isNull()), F.lit(False))


def scored(vectors: DataFrame, query: Sequence[float] | DataFrame, metric: str, vec_col: str = "embedding") -> DataFrame:
    """``vectors`` with their ``distance`` to one query: a list, or a DataFrame whose only row has ``query_vector``.

    Rows without a vector, or with one that isn't ``comparable``, are left out, as they would be from an index.
    """
    if isinstance(query, DataFrame):
        one = query.select(F.col("query_vector")).limit(1)
        both = vectors.crossJoin(F.broadcast(one)).filter(comparable(F.col(vec_col), F.size("query_vector")))
        return both.withColumn("distance", distance(metric, F.col(vec_col), F.col("query_vector"))).drop("query_vector")
    return vectors.filter(comparable(F.col(vec_col), len(query))).withColumn("distance", distance(metric, F.col(vec_col), literal(query)))


def restrict(vectors: DataFrame, *, workspaces: Sequence | None = None, doc_ids: Sequence[int] | DataFrame | None = None) -> DataFrame:
    """Rows of the listed workspaces and documents. None doesn't restrict; an empty list leaves nothing."""
    if workspaces is not None:
        vectors = vectors.filter(F.col("workspace_id").isin(list(dict.fromkeys(workspaces)))) if len(workspaces) else vectors.limit(0)
    if isinstance(doc_ids, DataFrame):
        vectors = vectors.join(doc_ids.select("doc_id").distinct(), "doc_id", "left_semi")
    elif doc_ids is not None:
        vectors = vectors.filter(F.col("doc_id").isin(list(doc_ids))) if len(doc_ids) else vectors.limit(0)
    return vectors


def topk(rows: DataFrame, k: int, id_col: str, *order: Column) -> DataFrame:
    """The k rows of least ``distance``, ties by ``order`` and id, with their ``rank`` from 1."""
    by = [F.col("distance"), *order, F.col(id_col)]
    best = rows.orderBy(*by).limit(check_k(k))
    return best.withColumn("rank", F.row_number().over(Window.orderBy(*by)).cast("long"))


def topk_by(rows: DataFrame, groups: Sequence[str], k: int, id_col: str) -> DataFrame:
    """The k nearest rows of each group; the limit is applied before and after the shuffle."""
    order = Window.partitionBy(*groups).orderBy("distance", id_col)
    return rows.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= check_k(k))


def keep_nearest(hits: DataFrame, k: int, id_col: str, place: str = "workspace_id") -> DataFrame:
    """Global cut over lists of hits: the k nearest of all, ties by place and id; each list keeps its order."""
    return topk(hits.drop("rank"), k, id_col, F.col(place))


def search(rows: DataFrame, query: Sequence[float] | DataFrame, k: int, id_col: str, metric: str = "Cos", *, workspaces: Sequence | None = None, doc_ids: Sequence[int] | DataFrame | None = None) -> DataFrame:
    """Nearest k rows over all listed workspaces: per workspace first, then the global cut."""
    near = scored(restrict(rows, workspaces=workspaces, doc_ids=doc_ids), query, metric)
    return keep_nearest(topk_by(near, ["workspace_id"], k, id_col), k, id_col)


def search_many(vectors: DataFrame, queries: DataFrame, k: int, id_col: str, metric: str = "Cos", *, vec_col: str = "embedding", tile: int = BROADCAST_QUERIES) -> DataFrame:
    """Nearest k rows for each row (query_id, query_vector) of ``queries``: (query_id, rank, id, distance).

    A query set of checked size is sent to every task, which scores a batch of vectors against all of it at once and passes on
    at most the k nearest of the batch for each query. A larger set is cut into blocks of about ``tile`` rows, and every
    vector meets every block through an equi-join on the block's number, so no task holds more than a block. Both give the same
    hits: queries are of one width, and vectors that aren't ``comparable`` are left out. Queries without a vector have no hits.
    """
    check_k(k)
    asked = queries.select(F.col("query_id"), F.col("query_vector").cast("array<double>").alias("query_vector")).filter("query_vector is not null")
    count, least, width = asked.agg(F.count("*"), F.min(F.size("query_vector")), F.max(F.size("query_vector"))).first()
    if least != width:
        raise ValueError(f"the queries have vectors of different widths, {least} to {width}")
    known = vectors.select(id_col, F.col(vec_col).alias("vector")).filter(comparable(F.col("vector"), width or 0))
    if count <= tile:
        near = _scored_in_batches(known, asked.collect(), width or 0, asked.schema["query_id"].dataType, k, id_col, metric)
        return topk_by(near, ["query_id"], k, id_col)
    blocks = -(-count // tile)
    asked = asked.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)))
    pairs = known.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))).join(asked, "block")
    near = pairs.select("query_id", id_col, distance(metric, F.col("vector"), F.col("query_vector")).alias("distance"))
    return topk_by(near, ["query_id"], k, id_col)


def _distances(metric: str, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, as ``distance`` has them."""
    if metric == "L2sq":
        return ((a - b) ** 2).sum(axis=1)
    dot = (a * b).sum(axis=1)
    if metric == "IP":
        return 1.0 - dot
    if metric == "Cos":
        size = np.sqrt((a * a).sum(axis=1) * (b * b).sum(axis=1))
        return np.where(size <= EPSILON, 1.0, 1.0 - dot / np.where(size > 0, size, 1.0))
    return np.full(len(a), np.inf)


def _scored_in_batches(known: DataFrame, asked: list, width: int, query_type: T.DataType, k: int, id_col: str, metric: str) -> DataFrame:
    """(query_id, id, distance) of the k nearest of each batch of vectors, ties by id."""
    ids = [r.query_id for r in asked]
    matrix = np.array([r.query_vector for r in asked], float).reshape(len(asked), width)
    own = (matrix * matrix).sum(axis=1)
    kind = to_arrow_type(query_type)

    def roughly(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray | float]:
        """Distances by one product of matrices, and how far off they may be."""
        if metric not in ("IP", "L2sq", "Cos"):
            return np.zeros((len(ids), len(rows))), 0.0
        dot, norm = matrix @ rows.T, (rows * rows).sum(axis=1)
        if metric == "IP":
            return -dot, 1e-12 * np.sqrt(own[:, None] * norm[None, :]).max(axis=1, keepdims=True)
        if metric == "L2sq":
            return own[:, None] - 2 * dot + norm[None, :], 1e-12 * (own[:, None] + norm.max())
        size = np.sqrt(own[:, None] * norm[None, :])
        return np.where(size <= EPSILON, 1.0, 1.0 - dot / np.where(size > 0, size, 1.0)), 1e-12

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, len(whole), 1024):
                batch = whole.slice(lo, 1024)
                if not len(ids) or not k:
                    continue
                rows = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(batch), width)
                place = np.empty(len(rows), np.int64)
                place[pc.sort_indices(batch.column(0)).to_numpy()] = np.arange(len(rows))
                rough, off = roughly(rows)
                least = np.partition(rough, k - 1, axis=1)[:, k - 1 : k] if len(rows) > k else np.full((len(ids), 1), np.inf)
                q, r = np.nonzero(~(rough > least + 2 * off))
                d = np.empty(len(q))
                for part in range(0, len(q), 1 << 16):
                    s = slice(part, part + (1 << 16))
                    d[s] = _distances(metric, matrix[q[s]], rows[r[s]])
                order = np.lexsort((place[r], d, q))
                q, r, d = q[order], r[order], d[order]
                use = np.arange(len(q)) - np.searchsorted(q, q) < k
                yield pa.RecordBatch.from_arrays([pa.array(ids, kind).take(pa.array(q[use])), batch.column(0).take(pa.array(r[use])), pa.array(d[use])], ["query_id", id_col, "distance"])

    return known.mapInArrow(run, T.StructType([T.StructField("query_id", query_type), known.schema[id_col], T.StructField("distance", T.DoubleType())]))
