"""Ranking by scores, and joins of ranks back to what was ranked."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


#: Ranges that scores without groups are dealt to.
RANGES = 64


def rank_scores(scores: DataFrame, groups: Sequence[str] = (), index_col: str = "index", score_col: str = "score") -> DataFrame:
    """0-based ranks by descending score; null and then NaN come last, ties by index. Groups are ranked on their own.

    Without groups scores are dealt to ranges at their quantiles, ranked in each, and moved on by the sizes of the ranges before.
    """
    order = [F.isnan(score_col), F.col(score_col).desc(), F.col(index_col)]
    if groups:
        return scores.withColumn("rank", (F.row_number().over(Window.partitionBy(*groups).orderBy(*order)) - 1).cast("long"))
    score = F.col(score_col).cast("double")
    cuts = scores.filter(~F.isnan(score_col)).agg(F.percentile_approx(score, [n / RANGES for n in range(1, RANGES)], 10_000)).first()[0] or []
    cuts = sorted(set(cuts), reverse=True)
    place = F.when(score.isNull(), len(cuts) + 1).when(F.isnan(score), len(cuts) + 2)
    place = place.otherwise(F.size(F.filter(F.array(*map(F.lit, cuts)).cast("array<double>"), lambda c: c > score)))
    rows = scores.withColumn("range_", place)
    before = Window.orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)
    # a row for each range, so one task does for their sum
    sizes = rows.groupBy("range_").agg(F.count("*").alias("size_")).withColumn("start_", F.coalesce(F.sum("size_").over(before), F.lit(0))).drop("size_")
    own = F.row_number().over(Window.partitionBy("range_").orderBy(*order)) - 1
    return rows.withColumn("own_", own).join(F.broadcast(sizes), "range_").withColumn("rank", (F.col("start_") + F.col("own_")).cast("long")).drop("range_", "start_", "own_")


def attach(rows: DataFrame, ranks: DataFrame, keys: Sequence[str] = ("index",)) -> DataFrame:
    """Rows with their rank and score. Rows that weren't scored are dropped; nothing is put in another order."""
    return rows.join(ranks.select(*keys, "rank", "score"), list(keys))


def return_text(ranks: DataFrame, texts: DataFrame, wanted: bool = True, keys: Sequence[str] = ("index",)) -> DataFrame:
    """Ranks with the text they rank, or null where it isn't wanted."""
    if not wanted:
        return ranks.withColumn("text", F.lit(None).cast("string"))
    return ranks.join(texts.select(*keys, "text"), list(keys))


def nan_count(scores: DataFrame, score_col: str = "score") -> DataFrame:
    return scores.agg(F.count_if(F.isnan(score_col)).alias("n_nan"), F.count("*").alias("n_rows"))
