"""Sentence centrality (LexRank) inside small groups."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.vectors import distance


def similarities(vectors: np.ndarray, threshold: float | None = None) -> np.ndarray:
    """Cosines with negative ones as 0 and 1 on the diagonal; with a threshold 1 for similar pairs and 0 for others."""
    size = np.sqrt((vectors * vectors).sum(axis=1))
    unit = vectors * np.divide(1.0, size, out=np.zeros(len(vectors)), where=size > 0)[:, None]
    sim = np.clip(unit @ unit.T, 0, None)
    np.fill_diagonal(sim, 1.0)
    return sim if threshold is None else (sim >= threshold).astype(float)


def power_scores(vectors: np.ndarray, threshold: float | None = None, max_iter: int = 10_000, tolerance: float = 1e-12) -> np.ndarray:
    """Stationary distribution of the row-normalised cosine matrix; with a threshold, of the graph of similar pairs.

    Negative similarities count as none.
    """
    n = len(vectors)
    if n == 0:
        return np.zeros(0)
    sim = similarities(vectors, threshold)
    step = sim / sim.sum(axis=1, keepdims=True)
    p = np.full(n, 1.0 / n)
    for _ in range(max_iter):
        after = p @ step
        done = np.abs(after - p).max() < tolerance
        p = after
        if done:
            break
    return p


def stationary_scores(vectors: np.ndarray, threshold: float | None = None) -> np.ndarray:
    """The limit of ``power_scores`` without iterating.

    The matrix is symmetric, so in a connected part the limit is in proportion to a row's sum; each part keeps the share of the
    sentences that it started with.
    """
    n = len(vectors)
    if n == 0:
        return np.zeros(0)
    sim = similarities(vectors, threshold)
    degree, linked = sim.sum(axis=1), sim > 0
    part = np.zeros(n, np.int64)
    if not linked.all():
        part = np.arange(n)
        while True:
            low = np.where(linked, part[None, :], n).min(axis=1)
            if (low == part).all():
                break
            part = low
    size, weight = np.bincount(part, minlength=n), np.bincount(part, degree, n)
    return degree / weight[part] * size[part] / n


def lexrank_power(rows: DataFrame, groups: Sequence[str], id_col: str, vec_col: str = "embedding", *, threshold: float | None = None, top: int = 2, max_iter: int = 10_000) -> DataFrame:
    """The ``top`` most central rows of each group by power iteration; ties go to the smaller id. Groups are small: a split's sentences."""
    fields = [rows.schema[g] for g in groups]
    schema = T.StructType([*fields, rows.schema[id_col], T.StructField("centrality", T.DoubleType()), T.StructField("rank", T.LongType())])

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(id_col)
        p = power_scores(np.array(group[vec_col].tolist(), float), threshold, max_iter)
        best = np.argsort(-np.round(p, 12), kind="stable")[:top]
        out = group.iloc[best][[*groups, id_col]].copy()
        out["centrality"], out["rank"] = p[best], np.arange(1, len(best) + 1)
        return out

    return rows.select(*groups, id_col, vec_col).groupBy(*groups).applyInPandas(run, schema)


def lexrank_degree(rows: DataFrame, groups: Sequence[str], id_col: str, vec_col: str = "embedding", *, threshold: float | None = 0.1, top: int = 2) -> DataFrame:
    """The same in engine expressions: without damping the stationary probability is a row's share of all similarity."""
    a = rows.select(*groups, F.col(id_col), F.col(vec_col).alias("a"))
    b = rows.select(*groups, F.col(id_col).alias("other_id"), F.col(vec_col).alias("b"))
    sim = F.greatest(F.lit(1.0) - distance("Cos", F.col("a"), F.col("b")), F.lit(0.0))
    sim = F.when(F.col(id_col) == F.col("other_id"), 1.0).otherwise(sim)
    weight = sim if threshold is None else F.when(sim >= threshold, 1.0).otherwise(0.0)
    degree = a.join(b, list(groups)).groupBy(*groups, id_col).agg(F.sum(weight).alias("degree"))
    share = degree.withColumn("centrality", F.col("degree") / F.sum("degree").over(Window.partitionBy(*groups)))
    order = Window.partitionBy(*groups).orderBy(F.round("centrality", 12).desc(), id_col)
    return share.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= top).select(*groups, id_col, "centrality", "rank")
