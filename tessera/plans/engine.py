"""The request interface: insert, query, retrieve, delete, rerank, health."""

from __future__ import annotations

import logging
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.config import EngineConfig
from tessera.functions import ids
from tessera.models import Embedder, Reranker, score_column
from tessera.operators import rerank as ranks
from tessera.operators.topk import search_many
from tessera.plans.ingest import check_supported, process_documents
from tessera.plans.search import search_documents
from tessera.schemas import SEARCH_MODE
from tessera.sources.store import Store

log = logging.getLogger(__name__)


class Engine:
    """A store with its models. Every method takes and returns DataFrames; ``model`` of a request is passed through only."""

    def __init__(self, spark: SparkSession, root: str, config: EngineConfig, embedder: Embedder, reranker: Reranker | None = None):
        check_supported(config)
        self.spark, self.config, self.embedder, self.reranker = spark, config, embedder, reranker
        model = spark.range(1).select(ids.model_id(embedder.path, embedder.n_embd)).first()[0]
        self.store = Store(spark, root, model_id=model, n_embd=embedder.n_embd, scalar_kind=config.index.scalar_kind, segment_bytes=config.storage.segment_max_bytes)

    def insert(self, docs: DataFrame, verbose: bool = False) -> DataFrame:
        """Insert or replace documents (workspace_id, url, text). Rows: status of each; with ``verbose`` the stored document too."""
        status = self.store.append(process_documents(docs, self.config, self.embedder))
        return status.join(self.store.table("docs"), ["workspace_id", "doc_id"], "left") if verbose else status

    def query(self, text: str, *, workspaces: Sequence[str], doc_ids: Sequence[int] = (), top_k: int | None = None, mode: int = SEARCH_MODE["both"], rerank: bool = False, verbose: bool = False) -> DataFrame:
        """Nested ranked documents for one query text. An empty ``doc_ids`` of a request doesn't restrict."""
        if rerank and self.reranker is None:
            raise ValueError("no reranker is configured")
        vector = self.embedder.embed([text])[0]
        if vector is None:
            raise ValueError("the query has no vector")
        tables = [self.store.table(t) for t in ("docs", "splits", "summaries")]
        out = search_documents(
            *tables, vector, k=self.config.top_k if top_k is None else top_k, mode=mode, metric=self.config.index.metric_kind, workspaces=workspaces, doc_ids=list(doc_ids) or None,
            query_text=text, reranker=self.reranker if rerank else None, verbose=verbose,
        )
        return out.withColumn("query_embedding", F.array(*map(F.lit, vector))) if verbose else out

    def query_many(self, queries: DataFrame, top_k: int | None = None) -> DataFrame:
        """Nearest splits for many queries (query_id, query_vector) at once."""
        k = self.config.top_k if top_k is None else top_k
        splits = self.store.table("splits")
        return search_many(splits, queries, k, "split_id", self.config.index.metric_kind).join(splits.drop("embedding"), "split_id")

    def retrieve(self, workspace: str, doc_id: int | None = None, url: str | None = None, verbose: bool = False) -> DataFrame:
        """One document, nested, in the order it was recorded; an id of 0 counts as none. Status Error and nulls if unknown."""
        if not workspace:
            raise ValueError("a workspace is needed")
        if not doc_id and not url:
            raise ValueError("a document id or url is needed")
        wanted = self.spark.range(1).select(F.lit(workspace).alias("workspace_id"), (F.lit(doc_id).cast("long") if doc_id else ids.doc_id(F.lit(url))).alias("doc_id"))
        key = ["workspace_id", "doc_id"]
        vector = F.col("embedding") if verbose else F.lit(None).cast("array<float>")
        only = lambda t: self.store.table(t).filter(F.col("workspace_id") == workspace).join(wanted, key, "left_semi")
        splits = only("splits").groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("seq_id", "split_id", "text", "token_len", "summary_ids", vector.alias("embedding")))).alias("splits"))
        summaries = only("summaries").groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("split_seq_id", "summary_id", "split_id", "text", "token_len", "centrality", vector.alias("embedding")))).alias("summaries"))
        out = wanted.join(only("docs"), key, "left").join(splits, key, "left").join(summaries, key, "left")
        return out.withColumn("status", F.when(F.col("url").isNull(), "Error").otherwise("Success"))

    def delete(self, workspace: str, doc_ids: Sequence[int]) -> DataFrame:
        if not workspace:
            raise ValueError("a workspace is needed")
        return self.store.delete(self.spark.createDataFrame([(workspace, d) for d in doc_ids], "workspace_id string, doc_id long"))

    def rerank(self, query: str, texts: DataFrame, return_text: bool = False) -> DataFrame:
        """Ranks of texts (index, text): descending score, NaN last, from 0; texts that can't be scored are left out."""
        if self.reranker is None:
            raise ValueError("no reranker is configured")
        scored = texts.withColumn("score", score_column(query, F.col("text"), self.reranker)).filter("score is not null").select("index", "score")
        return ranks.return_text(ranks.rank_scores(scored), texts, return_text)

    def health(self) -> DataFrame:
        """One row: status, version, parallelism; storage isn't touched."""
        sc = self.spark.sparkContext
        return self.spark.range(1).select(F.lit("OK").alias("status"), F.lit(self.spark.version).alias("version"), F.lit(sc.defaultParallelism).alias("worker_count"))

    def maintain(self) -> bool:
        """A maintenance pass: compaction where it is due, then removal of what no manifest names. A step that fails is logged, and the pass goes on;
        whether anything was compacted."""
        done = False
        try:
            done = self.store.compact(self.config.storage.compact_ratio)
        except Exception:
            log.exception("compaction of %s failed", self.store.root)
        try:
            self.store.clean()
        except Exception:
            log.exception("cleaning of %s failed", self.store.root)
        return done
