"""Counts and figures over the entity tables and legacy tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def shard_stats(docs: DataFrame, splits: DataFrame, summaries: DataFrame) -> DataFrame:
    """Documents, splits and summaries of each workspace."""
    tagged = [df.groupBy("workspace_id").agg(F.count("*").alias("n")).withColumn("what", F.lit(what)) for df, what in ((docs, "docs"), (splits, "splits"), (summaries, "summaries"))]
    rows = tagged[0].unionByName(tagged[1]).unionByName(tagged[2])
    count = lambda what: F.coalesce(F.sum(F.when(F.col("what") == what, F.col("n"))), F.lit(0)).cast("long").alias(f"n_{what}")
    return rows.groupBy("workspace_id").agg(count("docs"), count("splits"), count("summaries"))


def pool_stats(shards: DataFrame) -> DataFrame:
    """Totals over all workspaces."""
    return shards.agg(F.count("*").alias("n_workspaces"), *[F.sum(c).cast("long").alias(c) for c in ("n_docs", "n_splits", "n_summaries")])


def needs_compaction(segments: DataFrame, ratio: float) -> DataFrame:
    """Per workspace: bytes of sealed segments, dead bytes, and whether their share is over ``ratio`` (never without bytes)."""
    out = segments.groupBy("workspace_id").agg(F.sum("bytes").cast("long").alias("sealed_bytes"), F.sum("dead_bytes").cast("long").alias("dead_bytes"))
    share = F.try_divide(F.col("dead_bytes"), F.col("sealed_bytes"))
    return out.withColumn("dead_ratio", F.coalesce(share, F.lit(0.0))).withColumn("needs_compaction", F.coalesce(share > ratio, F.lit(False)))


def totals(rows: DataFrame, *columns: str) -> DataFrame:
    """Sums per workspace and over all (null workspace)."""
    return rows.rollup("workspace_id").agg(*[F.sum(c).cast("long").alias(c) for c in columns])


def docs_per_workspace(filter_rows: DataFrame) -> DataFrame:
    """Different documents of each workspace."""
    return filter_rows.select("workspace_id", "doc_id").distinct().groupBy("workspace_id").agg(F.count("*").alias("n_docs"), F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"))


def doc_sets(filter_rows: DataFrame) -> DataFrame:
    """Sorted set of each workspace's documents."""
    return filter_rows.groupBy("workspace_id").agg(F.array_sort(F.collect_set("doc_id")).alias("doc_ids"))


def shared_documents(filter_rows: DataFrame) -> DataFrame:
    """Documents in more than one workspace."""
    pairs = filter_rows.select("workspace_id", "doc_id").distinct()
    return pairs.groupBy("doc_id").agg(F.count("*").alias("n_workspaces")).filter("n_workspaces > 1")


def orphan_documents(docs: DataFrame, filter_rows: DataFrame) -> DataFrame:
    """Documents that no filter row names."""
    return docs.join(filter_rows.select("doc_id"), "doc_id", "left_anti")


def distinct_documents(filter_rows: DataFrame) -> DataFrame:
    return filter_rows.agg(F.count_distinct("doc_id").alias("n_docs"), F.count("*").alias("n_rows"))


def latency(rows: DataFrame, value_col: str, groups: list[str], most: int = 20_000) -> DataFrame:
    """Median and 99th percentile by nearest rank, mean and count of each group. Null values count as rows but have no rank.

    Approximate quantiles, which are added up in each task, bound where the two values are. Only rows between the bounds are
    put in order; those below are counted. Groups of up to ``most`` values are put in order as a whole.
    """
    value = F.col(value_col)
    near, slack = (0.5, 0.99), 0.001
    bounds = F.percentile_approx(value, [min(1.0, max(0.0, p + s)) for p in near for s in (-slack, slack)], 10_000)
    figures = rows.groupBy(*groups).agg(F.count("*").alias("n"), F.count(value).alias("known"), F.avg(value).alias("mean"), bounds.alias("bounds"))
    both = rows.filter(value.isNotNull()).join(figures.select(*groups, "known", "bounds"), groups)
    out = figures
    for k, (p, name) in enumerate(zip(near, ("p50", "p99"), strict=True)):
        low, high = (F.col("bounds")[2 * k + n] for n in (0, 1))
        small = F.col("known") <= most
        inside = both.filter(small | value.between(low, high))
        below = both.filter(~small & (value < low)).groupBy(*groups).agg(F.count("*").alias("below"))
        at = F.row_number().over(Window.partitionBy(*groups).orderBy(value_col)) - 1
        found = inside.withColumn("at", at).join(below, groups, "left").withColumn("at", F.col("at") + F.coalesce("below", F.lit(0)))
        found = found.filter(F.col("at") == F.floor(F.lit(p) * (F.col("known") - 1) + 0.5)).select(*groups, value.alias(name))
        out = out.join(found, groups, "left")
    return out.select(*groups, "p50", "p99", "mean", "n")
