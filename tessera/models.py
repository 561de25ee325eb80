"""Pluggable batch models: embedders and rerankers, with deterministic ones that need no files."""

from __future__ import annotations

import hashlib
import json
import re
import time
import urllib.error
import urllib.request
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


class Embedder(Protocol):
    """One vector for each text, or on failure None or a ``Failure`` that says why; loaded once by each worker.

    One that makes matrices anyway may have ``arrays`` too, as ``HashingEmbedder`` does; an ingest then uses that.
    """

    path: str
    n_embd: int

    def embed(self, texts: list[str]) -> list[list[float] | Failure | None]: ...


class Failure(str):
    """Why a text has no vector."""


class Reranker(Protocol):
    """One raw score for each text; None for a text that can't be scored, which is then left out."""

    def score(self, query: str, texts: list[str]) -> list[float | None]: ...


def context_width(trained: int, most: int | None = None) -> int:
    """Tokens that a model is given: what it was trained with, or less if so set."""
    return trained if most is None else min(most, trained)


_WORD = re.compile(r"\w+")


def _words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


class _Places(dict):
    """Of a word twice its component, and one more if it counts as positive. Short words are remembered, up to ``MOST`` of them."""

    MOST, LONGEST = 1 << 16, 64

    def __init__(self, n_embd: int):
        super().__init__()
        self.n_embd = n_embd

    def __missing__(self, word: str) -> int:
        h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
        place = h % self.n_embd * 2 + (h >> 63)
        if len(word) <= self.LONGEST:
            if len(self) >= self.MOST:
                self.clear()
            self[word] = place
        return place


#: Of a worker, not of a model: each task gets a model of its own.
_places = lru_cache(maxsize=4)(_Places)


class HashingEmbedder:
    """Signed feature hashing of words, of length one; words whose signs cancel out to nothing are counted without signs. Only texts without
    words fail. ``n_ctx`` cuts long texts."""

    def __init__(self, n_embd: int = 64, n_ctx: int = 512, path: str = "hashing"):
        self.n_embd, self.n_ctx, self.path = n_embd, n_ctx, path

    def arrays(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """A row for each text, and which texts have a vector."""
        n, place = 2 * self.n_embd, _places(self.n_embd).__getitem__
        out, good = np.zeros((len(texts), self.n_embd)), np.zeros(len(texts), bool)
        for lo in range(0, len(texts), 1024):
            words = [_words(text)[: self.n_ctx] for text in texts[lo : lo + 1024]]
            sizes = np.array([len(w) for w in words])
            places = np.fromiter(map(place, chain.from_iterable(words)), np.int64, sizes.sum())
            counts = np.bincount(np.repeat(np.arange(len(words)) * n, sizes) + places, minlength=len(words) * n).reshape(len(words), -1, 2)
            v = counts[:, :, 1] - counts[:, :, 0]
            lost = ~v.any(axis=1)
            v[lost] = counts[lost].sum(axis=2)
            at = slice(lo, lo + len(words))
            good[at] = sizes > 0
            out[at] = v / np.sqrt(np.maximum((v * v).sum(axis=1), 1))[:, None]
        return out, good

    def embed(self, texts: list[str]) -> list[list[float] | None]:
        rows, good = self.arrays(texts)
        return [row if there else None for row, there in zip(rows.tolist(), good.tolist(), strict=True)]


class OverlapReranker:
    """Share of the query's words that a text holds. Empty queries, and queries that alone exceed the width, are errors."""

    def __init__(self, n_ctx: int = 512):
        self.n_ctx = n_ctx

    def score(self, query: str, texts: list[str]) -> list[float | None]:
        q = _words(query)
        if not q:
            raise ValueError("the query is empty")
        if len(q) + 2 > self.n_ctx:
            raise ValueError("the query is too long")
        out: list[float | None] = []
        for t in texts:
            words = _words(t)
            fits = words and len(q) + len(words) + 4 <= self.n_ctx
            out.append(len(set(q) & set(words)) / len(set(q)) if fits else None)
        return out


class HttpModel:
    """Calls a model server with JSON; waits at most ``timeout`` seconds for an answer and tries ``retries`` times more, waiting longer each time."""

    def __init__(self, url: str, *, timeout: float = 30.0, retries: int = 2, batch: int = 64, pause: float = 0.2):
        self.url, self.timeout, self.retries, self.batch, self.pause = url, timeout, retries, batch, pause

    def post(self, body: dict) -> dict:
        request = urllib.request.Request(self.url, json.dumps(body).encode(), {"Content-Type": "application/json"})
        for attempt in range(self.retries + 1):
            try:
                with urllib.request.urlopen(request, timeout=self.timeout) as answer:
                    return json.load(answer)
            except urllib.error.HTTPError as e:
                if e.code < 500 or attempt == self.retries:  # asking again won't help
                    raise
            except (OSError, ValueError):
                if attempt == self.retries:
                    raise
            time.sleep(self.pause * 2**attempt)
        raise AssertionError

    def batches(self, texts: list[str]) -> Iterator[list[str]]:
        for lo in range(0, len(texts), self.batch):
            yield texts[lo : lo + self.batch]


class HttpEmbedder(HttpModel):
    """Vectors from a server: ``{"input": [texts]}`` is answered by ``{"embeddings": [vector or null, ...]}``.

    A batch without a usable answer fails, text by text, with the reason; the others go on.
    """

    def __init__(self, url: str, n_embd: int, path: str | None = None, **options):
        super().__init__(url, **options)
        self.n_embd, self.path = n_embd, path or url

    def embed(self, texts: list[str]) -> list[list[float] | Failure | None]:
        out: list[list[float] | Failure | None] = []
        for part in self.batches(texts):
            try:
                found = self.post({"input": part})["embeddings"]
                if len(found) != len(part):
                    raise ValueError(f"{len(found)} vectors for {len(part)} texts")
                out += [v if v is None or len(v) == self.n_embd else Failure(f"a vector of width {len(v)}, not {self.n_embd}") for v in found]
            except (OSError, ValueError, KeyError, TypeError) as e:
                out += [Failure(f"{type(e).__name__}: {e}")] * len(part)
        return out


class HttpReranker(HttpModel):
    """Scores from a server: ``{"query": text, "texts": [texts]}`` is answered by ``{"scores": [number or null, ...]}``."""

    def score(self, query: str, texts: list[str]) -> list[float | None]:
        if not query.strip():
            raise ValueError("the query is empty")
        out: list[float | None] = []
        for part in self.batches(texts):
            try:
                found = self.post({"query": query, "texts": part})["scores"]
                out += found if len(found) == len(part) else [None] * len(part)
            except (OSError, ValueError, KeyError, TypeError):
                out += [None] * len(part)
        return out


def embed_column(text: Column, embedder: Embedder) -> Column:
    """Vectors of a text column, in Arrow batches; null where the model fails or the text is null."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            good = texts.notna().to_numpy()
            made = iter(embedder.embed(texts[good].tolist()))
            vectors = (next(made) if g else None for g in good)
            yield pd.Series([None if isinstance(v, Failure) else v for v in vectors], dtype=object)

    return run(text)


def score_column(query: str, text: Column, reranker: Reranker) -> Column:
    """Scores of texts against one query; null where a text was skipped.

    Declared as not deterministic, since the planner would else move filters on scores below joins, and so score rows that the join drops.
    """
    reranker.score(query, [])  # fails early for a query that can't be scored

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(reranker.score(query, texts.fillna("").tolist()), dtype="float64")

    return run.asNondeterministic()(text)
