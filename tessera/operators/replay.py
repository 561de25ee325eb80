"""Replay of a change log: what the last committed version of each document holds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.schemas import KIND


def committed(log: DataFrame, keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Rows of the log that are live: the last commit of each document, and the entities it names.

    Entities wait for the document row that follows them. A delete drops the document and what waits; so does the end of the
    log for what has no document row. Only entities named by the committing row count, so that rows left over from
    a torn insert don't come back with a later one; a row that names none takes all that wait.
    """
    by = Window.partitionBy(*keys).orderBy("seq")
    mark = F.col("kind").isin(KIND["doc"], KIND["delete"])
    # how many commits and deletes stand before a row: rows of one epoch end with the mark that closes it
    epoch = F.coalesce(F.sum(mark.cast("int")).over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    last = F.max(F.when(mark, F.struct("seq", "kind", "split_ids", "summary_ids"))).over(Window.partitionBy(*keys))
    rows = log.withColumn("epoch", epoch).withColumn("last", last)
    closing = F.max(F.when(mark & (F.col("seq") == F.col("last.seq")), F.col("epoch"))).over(Window.partitionBy(*keys))
    live = rows.withColumn("closing", closing).filter((F.col("last.kind") == KIND["doc"]) & (F.col("epoch") == F.col("closing")) & (F.col("seq") <= F.col("last.seq")))
    named = F.when(F.col("kind") == KIND["split"], F.col("last.split_ids")).when(F.col("kind") == KIND["summary"], F.col("last.summary_ids"))
    return live.filter(named.isNull() | F.array_contains(named, F.col("entity_id"))).drop("epoch", "last", "closing")


def after(log: DataFrame, seq: int) -> DataFrame:
    """The tail of a log; the filter reaches the scan, where files of older rows are skipped by their statistics."""
    return log.filter(F.col("seq") > seq)


def snapshot_and_tail(log: DataFrame, seq: int, keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Replay from a snapshot at ``seq`` and the tail: the same rows as a full replay of complete inserts."""
    return committed(committed(log.filter(F.col("seq") <= seq), keys).unionByName(after(log, seq)), keys)


#: What a checksum covers, as far as a log has it: the frame, and what it holds.
_COVERED = ("seq", "kind", "doc_id", "entity_id", "split_ids", "summary_ids", "text", "embedding", "model_id")


def checksum(columns: Sequence[str]) -> Column:
    """Of a log's columns those that count, with their names, so that nulls and neighbouring values can't be taken for others."""
    return F.crc32(F.to_json(F.struct(*(c for c in _COVERED if c in columns))).cast("binary"))


def frame_error(columns: Sequence[str], width: int | None = None, crc_col: str = "crc") -> Column:
    """What is wrong with a row, or null: cut off, of a kind that doesn't exist, a vector that isn't ``width`` wide, or another checksum."""
    error = F.when(F.col("seq").isNull() | F.col("kind").isNull() | F.col(crc_col).isNull(), "truncated")
    error = error.when(~F.col("kind").isin(*KIND.values()), "unknown kind")
    if width is not None and "embedding" in columns:
        error = error.when(F.size("embedding") != width, "wrong length")
    return error.when(F.col(crc_col) != checksum(columns), "wrong checksum")


def verified(log: DataFrame, active: int, segment_col: str = "segment", crc_col: str = "crc", width: int | None = None) -> DataFrame:
    """Rows without a ``frame_error``. In the active segment the log ends before the first bad row (a torn tail); in a sealed one a bad row is
    an error. The first bad row of each segment is found by an aggregation, so no segment is gathered."""
    error = frame_error(log.columns, width, crc_col)
    bad = log.withColumn("what", error).filter("what is not null").groupBy(F.col(segment_col).alias("bad_segment")).agg(F.min(F.struct(F.coalesce("seq", F.lit(-1)).alias("seq"), "what")).alias("bad"))
    rows = log.join(bad, F.col(segment_col).eqNullSafe(F.col("bad_segment")), "left")
    message = F.concat(F.lit("corrupt record in sealed segment "), F.col(segment_col).cast("string"), F.lit(" from seq "), F.col("bad.seq").cast("string"), F.lit(": "), F.col("bad.what"))
    keep = F.when(F.col("bad").isNull(), F.lit(True)).when(F.col(segment_col) == active, F.col("seq") < F.col("bad.seq")).otherwise(F.raise_error(message).cast("boolean"))
    return rows.filter(keep).drop("bad_segment", "bad")


def snapshot_is_usable(snapshot_seq: int | None, manifest_seq: int, last_seq: int) -> bool:
    """A snapshot stands for the log if the manifest names it and nothing was written after it."""
    return snapshot_seq is not None and snapshot_seq == manifest_seq and last_seq <= snapshot_seq


def sequence_range(log: DataFrame, groups: Sequence[str] = ("segment",)) -> DataFrame:
    return log.groupBy(*groups).agg(F.min("seq").alias("min_seq"), F.max("seq").alias("max_seq"))
