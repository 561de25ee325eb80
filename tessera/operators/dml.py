"""Replacing, deleting and validating documents as set operations on the entity tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = ["workspace_id", "doc_id"]


def upsert(current: DataFrame, incoming: DataFrame, replaced: DataFrame | None = None) -> DataFrame:
    """``current`` without any row of the replaced documents (by default those of ``incoming``), and ``incoming``."""
    gone = (incoming if replaced is None else replaced).select(*KEY).distinct()
    return current.join(gone, KEY, "left_anti").unionByName(incoming, allowMissingColumns=True)


def delete(current: DataFrame, doc_ids: DataFrame) -> DataFrame:
    return current.join(doc_ids.select(*KEY).distinct(), KEY, "left_anti")


def delete_status(docs: DataFrame, doc_ids: DataFrame) -> DataFrame:
    """Success for documents that are there, NotFound for others."""
    there = docs.select(*KEY, F.lit(True).alias("there"))
    out = doc_ids.select(*KEY).distinct().join(there, KEY, "left")
    return out.select(*KEY, F.when(F.col("there"), "Success").otherwise("NotFound").alias("status"))


def replaced_ids(current: DataFrame, incoming: DataFrame, id_col: str) -> DataFrame:
    """Ids that the incoming documents owned before and don't any more."""
    before = current.join(incoming.select(*KEY).distinct(), KEY, "left_semi").select(*KEY, id_col)
    return before.join(incoming.select(*KEY, id_col), [*KEY, id_col], "left_anti")


def first_by_id(rows: DataFrame, id_cols: Sequence[str], *order: Column) -> DataFrame:
    """Of rows with one id the first in ``order``."""
    n = F.row_number().over(Window.partitionBy(*id_cols).orderBy(*order))
    return rows.withColumn("place", n).filter("place = 1").drop("place")


def extra_summary_ids(doc_list: Column, split_lists: Column) -> Column:
    """Ids in the splits' lists and not in the document's, each once, in order. A null document list is empty here."""
    return F.array_except(F.array_distinct(F.flatten(split_lists)), F.coalesce(doc_list, F.array().cast("array<bigint>")))


def owned_summary_ids(doc_list: Column, split_lists: Column) -> Column:
    """The document's list followed by the extra ids."""
    return F.concat(F.coalesce(doc_list, F.array().cast("array<bigint>")), extra_summary_ids(doc_list, split_lists))


def distinct_summaries(doc_list: Column, split_lists: Column) -> Column:
    """Number of different summaries in both lists."""
    return F.size(F.array_distinct(F.concat(F.coalesce(doc_list, F.array().cast("array<bigint>")), F.flatten(split_lists)))).cast("long")


def empty_as_null(ids: Column) -> Column:
    return F.when(F.size(ids) > 0, ids)


def invalid(rows: DataFrame, width: int, model: int | Column, id_col: str) -> DataFrame:
    """Rows whose vector is missing, of another width or of another model, with the reason."""
    model = F.lit(model) if not isinstance(model, Column) else model
    reason = F.when(F.col("embedding").isNull(), "missing embedding").when(F.size("embedding") != width, "wrong width").when(~F.col("model_id").eqNullSafe(model), "other model")
    return rows.select(*KEY, id_col, reason.alias("reason")).filter("reason is not null")


def reject(docs: DataFrame, *bad: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) documents: one bad row rejects the whole document."""
    keys = bad[0].select(*KEY)
    for b in bad[1:]:
        keys = keys.unionByName(b.select(*KEY))
    keys = keys.distinct()
    return docs.join(keys, KEY, "left_anti"), docs.join(keys, KEY, "left_semi")


def in_requested_order(rows: DataFrame, wanted: DataFrame, keys: Sequence[str], position: str = "position") -> DataFrame:
    """Rows of a list of ids, each with its place in the list; sort by ``position`` for the order. Ids that aren't there are skipped.

    The list is that of a request, so the rows are found by a join that the engine broadcasts it in when it is small.
    """
    return wanted.join(rows, list(keys)).select(position, *rows.columns)
