"""Embedders: functions from a list of texts to vectors, applied in Arrow batches.

The built-in one needs no model: it hashes words and their letter trigrams into a fixed number of
dimensions, so texts that share words are near each other.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from lodestream.functions import text

DIMENSIONS, BATCH = 256, 100
QUERY_CACHE = 128


#: Words whose hashes a process keeps at most.
KEPT = 200_000


class _Hashes(dict):
    """By word, the places of its hash and its trigrams' as bytes of 32-bit numbers: one of four for (word or trigram, sign) a dimension."""

    def __init__(self, dimensions: int):
        super().__init__()
        self.dimensions = dimensions

    def __missing__(self, word: str) -> bytes:
        import xxhash

        if len(self) >= KEPT:
            self.clear()
        edged = f"^{word}$"
        hashes = [xxhash.xxh64_intdigest(x) for x in (word, *(edged[i : i + 3] for i in range(len(word))))]
        places = [h % self.dimensions + self.dimensions * ((0 if h >> 63 else 1) + (2 if i else 0)) for i, h in enumerate(hashes)]
        self[word] = out = np.array(places, np.uint32).tobytes()
        return out


_hashes = lru_cache(4)(_Hashes)


def hashing(texts: list[str], dimensions: int = DIMENSIONS) -> np.ndarray:
    """Unit vectors of signed word and trigram hashes; a text without words has a zero vector.

    Each distinct word is hashed once in a process, up to ``KEPT`` of them; a text's vector counts the places.
    """
    out, known = np.zeros((len(texts), dimensions), np.float32), _hashes(dimensions)
    for row, t in zip(out, texts, strict=True):
        places = np.frombuffer(b"".join([known[w] for w in text.tokens_of(t or "")]), np.uint32)
        word, no_word, part, no_part = np.bincount(places, minlength=4 * dimensions).reshape(4, dimensions)
        held = word - no_word + 0.3 * (part - no_part)
        length = np.linalg.norm(held)
        if length:
            row[:] = held / length
    return out


def embed(rows: DataFrame, text_col: str, vector_col: str = "embedding", embedder: Callable[[list[str]], np.ndarray] = hashing, batch: int = BATCH) -> DataFrame:
    """``rows`` with the vector of each text; the embedder sees ``batch`` texts at a time."""

    @F.pandas_udf("array<float>")
    def vectors(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            parts = [np.asarray(v, np.float32) for i in range(0, len(texts), batch) for v in embedder(texts.iloc[i : i + batch].fillna("").tolist())]
            yield pd.Series(parts)

    return rows.withColumn(vector_col, vectors(F.col(text_col)))


class QueryEmbedder:
    """Vectors of queries, the last ``QUERY_CACHE`` of them kept; embedders without a name aren't cached."""

    def __init__(self, embedder: Callable[[list[str]], np.ndarray] = hashing, name: str | None = "hashing"):
        self._embed = lambda q: [float(x) for x in embedder([q])[0]]
        self._cached = lru_cache(QUERY_CACHE)(self._embed) if name else self._embed

    def __call__(self, query: str) -> list[float]:
        return self._cached(query)


def benchmark(embedder: Callable[[list[str]], np.ndarray], texts: list[str], runs: int = 3) -> dict:
    """Mean seconds of ``runs`` timed embeddings after one to warm up, and texts a second."""
    embedder(texts)
    seconds = []
    for _ in range(runs):
        began = time.perf_counter()
        embedder(texts)
        seconds.append(time.perf_counter() - began)
    mean = sum(seconds) / runs
    return {"runs": runs, "texts": len(texts), "mean_seconds": mean, "texts_per_second": len(texts) / mean if mean else float("inf")}
