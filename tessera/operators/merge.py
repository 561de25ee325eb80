"""Merging of split and summary hits into ranked documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.vectors import min_or_infinity


def summary_minimum(summary_hits: DataFrame) -> DataFrame:
    """Least distance of each split's summary hits."""
    return summary_hits.groupBy("workspace_id", "doc_id", "split_id").agg(min_or_infinity(F.col("distance")).alias("derived_distance"), F.count("*").alias("n_summaries"))


def merge_hits(split_hits: DataFrame, summary_hits: DataFrame) -> DataFrame:
    """Full outer merge of direct split hits and those found through summaries.

    A direct distance replaces the derived one even where it is larger. Rows: workspace_id, doc_id, split_id, query_distance (null
    where only summaries hit), sort_distance, n_summaries. Both sides are bounded by the k of the search.
    """
    direct = split_hits.select("workspace_id", "doc_id", "split_id", F.col("distance").alias("query_distance"))
    both = direct.join(summary_minimum(summary_hits), ["workspace_id", "doc_id", "split_id"], "full_outer")
    return both.select(
        "workspace_id", "doc_id", "split_id", "query_distance",
        F.coalesce("query_distance", "derived_distance").alias("sort_distance"), F.coalesce("n_summaries", F.lit(0)).cast("long").alias("n_summaries"),
    )


def rank_documents(merged: DataFrame) -> DataFrame:
    """Adds each document's distance, that of its nearest split, and the ranks of splits in it and of documents over all."""
    of_doc = Window.partitionBy("workspace_id", "doc_id")
    out = merged.withColumn("doc_distance", F.min("sort_distance").over(of_doc))
    out = out.withColumn("split_rank", F.row_number().over(of_doc.orderBy("sort_distance", "split_id")).cast("long"))
    # the hits are at most 2k rows, which the search has bounded
    return out.withColumn("doc_rank", F.dense_rank().over(Window.orderBy("doc_distance", "workspace_id", "doc_id")).cast("long"))


def documents_by_best_split(merged: DataFrame) -> DataFrame:
    """One row for each document: distance of its nearest split, number of splits, rank."""
    best = merged.groupBy("workspace_id", "doc_id").agg(F.min("sort_distance").alias("distance"), F.count("*").alias("n_splits"))
    return best.withColumn("rank", F.row_number().over(Window.orderBy("distance", "workspace_id", "doc_id")).cast("long"))


def nested(ranked: DataFrame, docs: DataFrame, splits: DataFrame, summaries: DataFrame, summary_hits: DataFrame, verbose: bool = False, full_ranks: DataFrame | None = None) -> DataFrame:
    """Documents with their hit splits (in order of distance), those splits' hit summaries, and the full summary list.

    Documents that have vanished are left out. Embeddings are returned only if ``verbose``. With ``full_ranks`` (workspace_id, summary_id, rank,
    score) the full list carries them, and summaries that weren't ranked are left out of it.
    """
    vector = lambda df: df["embedding"] if verbose else F.lit(None).cast("array<float>")
    key = ["workspace_id", "split_id"]
    extra = [c for c in ("rank", "score") if c in summary_hits.columns]
    hit = summary_hits.select("workspace_id", "split_id", "summary_id", "distance", *extra).join(summaries.select("workspace_id", "summary_id", "text", "centrality", vector(summaries).alias("embedding")), ["workspace_id", "summary_id"])
    hit = hit.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("distance", "summary_id", "text", "centrality", "embedding", *extra))).alias("summaries"))
    body = splits.select(*key, "seq_id", "text", "token_len", vector(splits).alias("embedding"))
    rows = ranked.join(body, key).join(hit, key, "left")
    rows = rows.withColumn("summaries", F.coalesce("summaries", F.array().cast(hit.schema["summaries"].dataType)))
    rows = rows.groupBy("workspace_id", "doc_id", "doc_distance", "doc_rank").agg(F.array_sort(F.collect_list(F.struct("split_rank", "split_id", "seq_id", "query_distance", "text", "token_len", "embedding", "summaries"))).alias("splits"))
    wanted = rows.select("workspace_id", "doc_id")
    full = summaries.join(wanted, ["workspace_id", "doc_id"], "left_semi")
    marks = []
    if full_ranks is not None:
        full, marks = full.join(full_ranks.select("workspace_id", "summary_id", "rank", "score"), ["workspace_id", "summary_id"]), ["rank", "score"]
    full = full.groupBy("workspace_id", "doc_id").agg(F.array_sort(F.collect_list(F.struct("split_seq_id", "summary_id", "text", "centrality", *marks))).alias("summaries"))
    return rows.join(docs.select("workspace_id", "doc_id", "url"), ["workspace_id", "doc_id"]).join(full, ["workspace_id", "doc_id"], "left")
