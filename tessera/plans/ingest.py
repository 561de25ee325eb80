"""From documents to splits with vectors and extractive summaries."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.config import EngineConfig
from tessera.functions import ids, vectors
from tessera.functions.text import sentences, token_count
from tessera.models import Embedder, Failure
from tessera.operators.chunk import PATTERNS, bound_batches, chunk
from tessera.operators.lexrank import stationary_scores


@dataclass
class Processed:
    """Documents, splits and summaries of one batch, and the splits that failed.

    They are views of ``rows``, embedded splits; ``staged`` writes those once, so that the model runs once.
    """

    docs: DataFrame
    splits: DataFrame
    summaries: DataFrame
    failures: DataFrame
    rows: DataFrame | None = None
    embedder: Embedder | None = None

    def staged(self, folder: str) -> Processed:
        """The same tables over what has been written to ``folder``."""
        if self.rows is None:
            names = ("docs", "splits", "summaries", "failures")
            return Processed(*(written(getattr(self, n), f"{folder}/{n}") for n in names))
        return derive(written(self.rows, f"{folder}/rows"), self.embedder)


def written(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def embed_and_summarize(splits: DataFrame, embedder: Embedder, top: int, vec_type: str = "array<float>") -> DataFrame:
    """Adds ``embedding``, ``error`` (why there is no embedding) and ``found`` (index, centrality, embedding of the ``top`` central sentences).

    A split and its sentences go to the model in one call, and a split's sentences are bounded by its size, so
    centrality is found where the vectors are made; nothing is shuffled.
    """
    names = splits.columns
    found = "array<struct<seq:int,centrality:double,embedding:array<float>>>"
    schema = T.StructType([*splits.schema.fields, *T.StructType.fromDDL(f"embedding {vec_type}, error string, found {found}").fields])
    kinds = [pa.list_(pa.float32()), pa.string(), pa.list_(pa.struct([("seq", pa.int32()), ("centrality", pa.float64()), ("embedding", pa.list_(pa.float32()))]))]

    def best(rows: np.ndarray, usable: Sequence[int]) -> list[tuple[int, float]]:
        p = stationary_scores(rows)
        return [(usable[k], float(p[k])) for k in np.argsort(-np.round(p, 12), kind="stable")[:top]]

    def from_lists(flat: list[str], inner: list[list[str] | None]) -> list[pa.Array]:
        made = iter(embedder.embed(flat))
        vectors, errors, found = [], [], []
        for s in inner:
            v = next(made)
            errors.append(str(v) if isinstance(v, Failure) else "no vector" if v is None else None)
            vectors.append(None if errors[-1] else v)
            own = [None if isinstance(v, Failure) else v for v in (next(made) for _ in s or ())]
            usable = [k for k, v in enumerate(own) if v is not None]
            found.append([{"seq": k, "centrality": c, "embedding": own[k]} for k, c in best(np.array([own[k] for k in usable], float), usable)])
        return [pa.array(c, k) for c, k in zip((vectors, errors, found), kinds, strict=True)]

    def from_arrays(flat: list[str], inner: list[list[str] | None]) -> list[pa.Array]:
        rows, good = embedder.arrays(flat)
        sizes = np.array([len(s or ()) for s in inner])
        at = np.cumsum(sizes + 1) - sizes - 1
        own, taken, ends = [], [], [0]
        for begin, size in zip(at.tolist(), sizes.tolist(), strict=True):
            usable = (np.flatnonzero(good[begin + 1 : begin + 1 + size])).tolist()
            part = rows[begin + 1 : begin + 1 + size]
            own += best(part if len(usable) == size else part[usable], usable)
            taken += [begin + 1 + k for k, _ in own[ends[-1] :]]
            ends.append(len(own))
        there = good[at]
        of = lambda m: pa.array(m.astype(np.float32).ravel())
        width = rows.shape[1]
        steps = np.concatenate([[0], np.cumsum(there * width)])
        vectors = pa.ListArray.from_arrays(pa.array(steps, pa.int32(), mask=np.append(~there, False)), of(rows[at[there]]))
        struct = [pa.array([k for k, _ in own], pa.int32()), pa.array([c for _, c in own], pa.float64()), pa.ListArray.from_arrays(pa.array(np.arange(len(own) + 1) * width, pa.int32()), of(rows[taken].reshape(-1, width)))]
        found = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(struct, ["seq", "centrality", "embedding"]))
        return [vectors.cast(kinds[0]), pa.array([None if t else "no vector" for t in there], pa.string()), found.cast(kinds[2])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, len(whole), 256):
                batch = whole.slice(lo, 256)
                texts, inner = batch.column(names.index("text")).to_pylist(), batch.column(names.index("sentences")).to_pylist()
                flat = [t for text, s in zip(texts, inner, strict=True) for t in (text, *(s or ()))]
                made = (from_arrays if hasattr(embedder, "arrays") else from_lists)(flat, inner)
                yield pa.RecordBatch.from_arrays([*batch.columns, *made], [*names, "embedding", "error", "found"])

    bound_batches(splits.sparkSession)
    return splits.mapInArrow(run, schema)


def check_supported(config: EngineConfig) -> None:
    """Raises on settings that an ingest can't carry out."""
    if config.index.scalar_kind in ("I8", "B1"):
        raise ValueError(f"[index] scalar_kind {config.index.scalar_kind} is of another scale than query vectors, and a store doesn't hold it")
    if config.splitter.merge_level not in (None, 0):
        raise ValueError("[splitter] merge_level must be 0 (nothing is merged) or absent (all levels are)")


def process_documents(docs: DataFrame, config: EngineConfig, embedder: Embedder) -> Processed:
    """Chunk, embed and summarise documents (workspace_id, url, text).

    Sequence numbers count chunks before failures are dropped. A split whose vector can't be made goes to ``failures`` and the
    document lives on without it. The budget of a chunk is in words, or in tokens of the file that ``hf_model_id`` names. Vectors are rounded as an index of the scalar kind holds them.
    """
    check_supported(config)
    base = docs.select("workspace_id", "url", "text").withColumn("doc_id", ids.doc_id(F.col("url")))
    own = config.splitter
    parts = chunk(base, "text", own.max_tokens, merge=own.merge_level is None, patterns=own.patterns or PATTERNS, tokenizer=own.hf_model_id)
    parts = parts.withColumn("split_id", ids.split_id(F.col("doc_id"), F.col("seq_id"))).withColumn("sentences", sentences(F.col("text"), config.min_sentence_tokens))
    rows = embed_and_summarize(parts, embedder, config.summaries_per_split)
    if config.index.scalar_kind in ("F16", "BF16"):  # a model's vectors are floats, so F32 and F64 hold them as they are
        held = lambda v: vectors.quantize(v, config.index.scalar_kind).cast("array<float>")
        rows = rows.withColumn("embedding", held(F.col("embedding")))
        rows = rows.withColumn("found", F.transform("found", lambda s: s.withField("embedding", held(s["embedding"]))))
    # each summary has its text and id from here on, so that they are found once and other sentences needn't be staged
    rows = rows.withColumn("found", F.transform("found", lambda s: s.withField("text", F.element_at("sentences", s["seq"] + 1))))
    rows = rows.withColumn("found", F.transform("found", lambda s: s.withField("token_len", token_count(s["text"]))))
    rows = rows.withColumn("found", F.transform("found", lambda s: s.withField("summary_id", ids.summary_id(F.col("split_id"), s["seq"], s["token_len"]))))
    return derive(rows.drop("sentences"), embedder)


def derive(rows: DataFrame, embedder: Embedder) -> Processed:
    """The entity tables of embedded splits."""
    model = ids.model_id(embedder.path, embedder.n_embd)
    good = rows.filter("embedding is not null")
    own = good.select("workspace_id", "doc_id", "split_id", "seq_id", F.explode("found").alias("s"))
    summaries = own.select(
        "workspace_id", "s.summary_id", "doc_id", "split_id", F.col("seq_id").alias("split_seq_id"),
        "s.text", "s.token_len", F.col("s.centrality").cast("float").alias("centrality"), "s.embedding", model.alias("model_id"),
    )
    list_ = F.col("found.summary_id")
    splits = good.select("workspace_id", "split_id", "doc_id", "seq_id", "text", "token_len", list_.alias("summary_ids"), "embedding", model.alias("model_id"))
    ordered = F.array_sort(F.collect_list(F.struct("seq_id", "split_id", list_.alias("summary_ids"))))
    out = good.groupBy("workspace_id", "doc_id", "url").agg(ordered.alias("s"))
    out = out.select("workspace_id", "doc_id", "url", F.col("s.split_id").alias("split_ids"), F.array_distinct(F.flatten("s.summary_ids")).alias("summary_ids"))
    failures = rows.filter("embedding is null").select("workspace_id", "doc_id", "url", "split_id", "seq_id", "error")
    return Processed(out, splits, summaries, failures, rows, embedder)


def first_sentences(docs: DataFrame, keys: list[str], text_col: str = "text", top: int = 2, least_words: int = 4) -> DataFrame:
    """A summariser without a model: the first ``top`` sentences, of centrality 1 / position."""
    rows = docs.select(*keys, F.posexplode(F.slice(sentences(F.col(text_col), least_words), 1, top)).alias("pos", "sentence"))
    return rows.withColumn("centrality", F.lit(1.0) / (F.col("pos") + 1))
