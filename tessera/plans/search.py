"""The whole document query: hits, merge, rerank, nesting."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.models import Reranker, score_column
from tessera.operators import merge, rerank
from tessera.operators.topk import search
from tessera.schemas import SEARCH_MODE


def ranked_splits(splits: DataFrame, summaries: DataFrame, query, *, k: int = 5, mode: int = SEARCH_MODE["both"], metric: str = "Cos", workspaces: Sequence | None = None, doc_ids=None, query_text: str | None = None, reranker: Reranker | None = None, pin: bool = False) -> tuple[DataFrame, DataFrame]:
    """(ranked split hits, summary hits). Only the legs that the mode asks for are planned; each is cut to k on its own.

    With a reranker summary hits carry rank and score, and those it skipped disappear; the order stays that of distance. With ``pin`` the
    searches run at once, and once only; hits then are without texts, except for those of summaries that a reranker gets, and without vectors.
    """
    if mode not in SEARCH_MODE.values():
        raise ValueError(f"unknown search mode {mode}")
    leg = lambda df, id_col, on: search(df if on else df.limit(0), query, k, id_col, metric, workspaces=workspaces, doc_ids=doc_ids)
    split_hits = leg(splits, "split_id", mode != SEARCH_MODE["summary"])
    summary_hits = leg(summaries, "summary_id", mode != SEARCH_MODE["split"])
    if pin:
        split_hits = pinned(split_hits.select("workspace_id", "doc_id", "split_id", "distance", "rank"))
        summary_hits = pinned(summary_hits.select("workspace_id", "doc_id", "split_id", "summary_id", "distance", "rank", *([] if reranker is None else ["text"])))
    if reranker is not None:
        scores = summary_hits.select("summary_id", "workspace_id", "text", F.col("rank").alias("index"))
        scores = scores.withColumn("score", score_column(query_text or "", F.col("text"), reranker)).filter("score is not null")
        summary_hits = rerank.attach(summary_hits.drop("rank"), rerank.rank_scores(scores), ["workspace_id", "summary_id"])
    return merge.rank_documents(merge.merge_hits(split_hits, summary_hits)), summary_hits


def pinned(hits: DataFrame) -> DataFrame:
    """Hits, without vectors, as rows of the plan itself. A search has at most k of them for each kind, so they fit the driver,
    and what follows neither searches again nor shuffles the tables it looks them up in."""
    return hits.sparkSession.createDataFrame(hits.collect(), hits.schema)


def search_documents(docs: DataFrame, splits: DataFrame, summaries: DataFrame, query, *, verbose: bool = False, **options) -> DataFrame:
    """Ranked documents, nested: splits with their hit summaries, and the document's full summary list.

    With a reranker each document's full list is ranked too, on its own.
    """
    ranked, hits = ranked_splits(splits, summaries, query, pin=True, **options)
    ranked = pinned(ranked)
    hits = pinned(hits.select("workspace_id", "split_id", "summary_id", "distance", *(c for c in ("rank", "score") if c in hits.columns)))
    ranks = None
    if (reranker := options.get("reranker")) is not None:
        own = summaries.join(ranked.select("workspace_id", "doc_id").distinct(), ["workspace_id", "doc_id"], "left_semi").select("workspace_id", "doc_id", "summary_id", "text", F.col("summary_id").alias("index"))
        scored = own.withColumn("score", score_column(options.get("query_text") or "", F.col("text"), reranker)).filter("score is not null")
        ranks = rerank.rank_scores(scored, ["workspace_id", "doc_id"])
    return merge.nested(ranked, docs, splits, summaries, hits, verbose, ranks)
