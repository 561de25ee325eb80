"""Moving the tables of an older layout into workspaces."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import stats


@dataclass
class Legacy:
    """Five tables: documents, splits, summaries, embeddings, and which user has which vector."""

    documents: DataFrame
    splits: DataFrame
    summaries: DataFrame
    embeddings: DataFrame
    filter_rows: DataFrame


def read(spark: SparkSession, folder: str) -> Legacy:
    """The five tables as Parquet below one folder."""
    return Legacy(*(spark.read.parquet(f"{folder}/{name}") for name in ("documents", "splits", "summaries", "embeddings", "embedding_filter_info")))


@dataclass
class Migration:
    docs: DataFrame
    splits: DataFrame
    summaries: DataFrame
    failures: DataFrame
    report: DataFrame
    shared: DataFrame
    orphans: DataFrame


def migrate(old: Legacy, n_embd: int, model_id: int | None = None) -> Migration:
    """Entities by workspace. A document that several workspaces have goes to each; one without a filter row to none.

    A document that lacks a split, a summary or a vector, or whose vectors are of another width or model, is a failure of its own and the
    others go on.
    """
    places = old.filter_rows.select(F.col("user_uuid").alias("workspace_id"), "doc_id").distinct()
    good = F.size("embedding") == n_embd
    if model_id is not None:
        good &= F.col("model_id") == model_id
    vectors = old.embeddings.filter(F.col("embedding").isNotNull() & good).select("embedding_id", "embedding", "model_id")
    with_vector = lambda df, id_col: df.join(vectors, df[id_col] == vectors["embedding_id"], "left").drop("embedding_id")
    splits, summaries = with_vector(old.splits, "split_id"), with_vector(old.summaries, "summary_id")

    def lacking(rows: DataFrame, id_col: str, list_col: str, what: str) -> DataFrame:
        """Documents that name an id which isn't there or has no vector."""
        named = old.documents.select("doc_id", F.explode(list_col).alias(id_col))
        there = rows.filter("embedding is not null").select(id_col)
        return named.join(there, id_col, "left_anti").select("doc_id", F.lit(what).alias("reason"))

    failures = lacking(splits, "split_id", "split_ids", "split").unionByName(lacking(summaries, "summary_id", "summary_ids", "summary")).distinct()
    placed = old.documents.join(places, "doc_id").join(failures.select("doc_id").distinct(), "doc_id", "left_anti")
    keys = placed.select("workspace_id", "doc_id")
    docs = placed.select("workspace_id", "doc_id", "url", "split_ids", "summary_ids")
    own = lambda df: df.join(keys, "doc_id")
    failed = failures.join(places, "doc_id")
    read = places.groupBy("workspace_id").agg(F.count("*").alias("n_read"))
    written = docs.groupBy("workspace_id").agg(F.count("*").alias("n_written"), F.sum(F.size("split_ids")).cast("long").alias("n_splits"))
    report = stats.totals(read.join(written, "workspace_id", "left").na.fill(0), "n_read", "n_written", "n_splits")
    filter_rows = old.filter_rows.withColumnRenamed("user_uuid", "workspace_id")
    return Migration(docs, own(splits), own(summaries), failed, report, stats.shared_documents(filter_rows), stats.orphan_documents(old.documents, filter_rows))
