"""Readers of what the engine takes in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import trim


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header; fields may be quoted, hold doubled quotes and line breaks. Carriage returns are dropped."""
    df = spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').csv(path)
    return df.select(*[F.regexp_replace(F.col(f"`{c}`"), "\r", "").alias(c.replace("\r", "")) for c in df.columns])


def distinct_passages(rows: DataFrame, text_col: str, order_col: str, least_bytes: int = 32) -> DataFrame:
    """Trimmed passages of ``least_bytes`` or more, each once, with where it came first."""
    out = rows.select(trim(F.col(text_col)).alias("passage"), F.col(order_col).alias("first_at"))
    return out.filter(F.octet_length("passage") >= least_bytes).groupBy("passage").agg(F.min("first_at").alias("first_at"))


def load_passages(spark: SparkSession, path: str) -> DataFrame:
    """The passages of a CSV file's ``passage`` column, in file order."""
    df = read_csv(spark, path)
    if "passage" not in df.columns:
        raise ValueError("the file has no column passage")
    return distinct_passages(df.withColumn("row", F.monotonically_increasing_id()), "passage", "row")


def read_texts(spark: SparkSession, path: str, workspace: str) -> DataFrame:
    """Whole files as documents, by url."""
    df = spark.read.text(path, wholetext=True)
    return df.select(F.lit(workspace).alias("workspace_id"), F.col("_metadata.file_path").alias("url"), F.col("value").alias("text"))


def read_rerank_json(spark: SparkSession, path: str) -> DataFrame:
    """``{query, summaries[]}`` files as rows (query, index, text)."""
    df = spark.read.schema("query string, summaries array<string>").option("multiLine", True).json(path)
    return df.select("query", F.posexplode("summaries").alias("index", "text"))


def to_json(df: DataFrame) -> DataFrame:
    """Each row as JSON."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("value"))


def from_json(df: DataFrame, schema) -> DataFrame:
    """Rows of JSON by an explicit schema; a line that isn't of the schema is an error."""
    return df.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")
