"""Command line: move the tables of an older layout into a store.

    python -m tessera.sources.migrate SOURCE TARGET --model PATH --width N [--model-id ID] [--report-only]

SOURCE holds documents, splits, summaries, embeddings and embedding_filter_info as Parquet. The report goes to the standard output; the
exit code is 1 if any document failed.
"""

from __future__ import annotations

import argparse
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import ids
from tessera.plans.ingest import Processed
from tessera.sources import legacy
from tessera.sources.store import TABLES, Store


def conformed(df: DataFrame, name: str) -> DataFrame:
    """The columns that a store's table has; those that the older layout lacks are null."""
    return df.select(*((F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in TABLES[name].fields))


def run(spark: SparkSession, source: str, target: str, *, model: str, width: int, old_model: int | None = None, report_only: bool = False) -> tuple[legacy.Migration, bool]:
    """The migration, and whether all documents passed. Vectors are stored under the model's new id."""
    found = legacy.migrate(legacy.read(spark, source), width, old_model)
    if not report_only:
        model_id = spark.range(1).select(ids.model_id(model, width)).first()[0]
        renamed = lambda df: df.withColumn("model_id", F.lit(model_id).cast("long"))
        store = Store(spark, target, model_id=model_id, n_embd=width)
        store.append(Processed(conformed(found.docs, "docs"), conformed(renamed(found.splits), "splits"), conformed(renamed(found.summaries), "summaries"), found.failures))
        store.clean()
    return found, found.failures.limit(1).count() == 0


def main(args: Sequence[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(description="Move the tables of an older layout into a store.")
    parser.add_argument("source")
    parser.add_argument("target")
    parser.add_argument("--model", required=True, help="name of the model that made the vectors")
    parser.add_argument("--width", type=int, required=True, help="width of the vectors")
    parser.add_argument("--model-id", type=int, help="take only vectors of this id of the older layout")
    parser.add_argument("--report-only", action="store_true", help="write nothing")
    a = parser.parse_args(args)
    spark = spark or SparkSession.builder.appName("migrate").getOrCreate()
    found, good = run(spark, a.source, a.target, model=a.model, width=a.width, old_model=a.model_id, report_only=a.report_only)
    for r in found.report.orderBy(F.col("workspace_id").asc_nulls_last()).collect():
        print(f"{r.workspace_id or 'all'}: {r.n_written} of {r.n_read} documents, {r.n_splits} splits")
    print(f"in several workspaces: {found.shared.count()}, in none: {found.orphans.count()}")
    for r in found.failures.groupBy("reason").agg(F.count_distinct("doc_id").alias("n")).orderBy("reason").collect():
        print(f"failed for want of a {r.reason}: {r.n}")
    return 0 if good else 1


if __name__ == "__main__":
    raise SystemExit(main())
