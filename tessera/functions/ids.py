"""Deterministic ids: sixty bits of the MD5 of a text, the same in every SQL engine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def stable_id(text: Column) -> Column:
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def doc_id(url: Column) -> Column:
    """The same url is the same document."""
    return stable_id(url)


def split_id(doc: Column, seq: Column) -> Column:
    """Parts are set apart, so that (1, 23) and (12, 3) differ."""
    return stable_id(F.concat_ws("/", doc.cast("string"), seq.cast("string")))


def summary_id(split: Column, seq: Column, tokens: Column) -> Column:
    return stable_id(F.concat_ws("/", split.cast("string"), seq.cast("string"), tokens.cast("string")))


def model_id(path: str, n_embd: int) -> Column:
    return stable_id(F.lit(f"{path}/{n_embd}"))


def request_id() -> Column:
    return F.uuid()
