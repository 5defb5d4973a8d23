"""Embedders: vectors of chunks, in executors, and of queries, on the driver."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession

from ..errors import EmbeddingError, NoEmbedder

#: Texts of one call of a model.
BATCH = 64
CACHE = 1_024


class Embedder(Protocol):
    """`encode` takes texts and gives one row of `dim` numbers for each; `query_prefix` goes before queries only."""

    id: str
    dim: int
    query_prefix: str

    def encode(self, texts: list[str]) -> np.ndarray: ...


class HashEmbedder:
    """Words hashed to signed dimensions: no model, but texts with the same words are near each other."""

    query_prefix = ""

    def __init__(self, dim: int = 64) -> None:
        self.dim, self.id = dim, f"hash/{dim}"

    def encode(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim))
        for row, text in zip(out, texts, strict=True):
            for word in text.lower().split():
                h = xxhash.xxh64_intdigest(word)
                row[h % self.dim] += 1 if h >> 63 else -1
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


class RemoteEmbedder:
    """A place for a service; without a network there is none."""

    query_prefix, dim, id = "", 0, "remote"

    def encode(self, texts: list[str]) -> np.ndarray:
        raise NoEmbedder("remote embedding is not available")


class CachedEmbedder:
    """The vectors of the latest queries are remembered; documents go past the cache."""

    def __init__(self, inner: Embedder, size: int = CACHE) -> None:
        self.inner, self.size, self.hits = inner, size, 0
        self.id, self.dim, self.query_prefix = inner.id, inner.dim, inner.query_prefix
        self._kept: OrderedDict[str, np.ndarray] = OrderedDict()

    def encode(self, texts: list[str]) -> np.ndarray:
        new = [t for t in dict.fromkeys(texts) if t not in self._kept]
        self.hits += len(texts) - len(new)
        found = dict(zip(new, self.inner.encode(new), strict=True)) if new else {}
        out = [found[t] if t in found else self._kept[t] for t in texts]
        for text, vector in zip(texts, out, strict=True):
            self._kept[text] = vector
            self._kept.move_to_end(text)
        while len(self._kept) > self.size:
            self._kept.popitem(last=False)
        return np.array(out).reshape(len(texts), -1)


def _checked(vectors: np.ndarray, n: int, dim: int) -> np.ndarray:
    if vectors.shape != (n, dim):
        raise EmbeddingError(f"the embedder gave {vectors.shape}, not {(n, dim)}")
    return vectors


def embed_chunks(chunks: DataFrame, embedder: Embedder, batch: int = BATCH) -> DataFrame:
    """(chunk_id, vector), a batch of texts at a time."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), batch):
                part = frame.iloc[at : at + batch]
                vectors = _checked(embedder.encode(part["text"].fillna("").tolist()), len(part), embedder.dim)
                yield pd.DataFrame({"chunk_id": part["chunk_id"].to_numpy(), "vector": list(vectors)})

    return chunks.select("chunk_id", "text").mapInPandas(run, "chunk_id long, vector array<double>")


def embed_queries(spark: SparkSession, texts: dict, embedder: Embedder) -> DataFrame:
    """(qid, query, qvec) of query texts by id; blank ones have no vector."""
    wanted = {q: t for q, t in texts.items() if t.strip()}
    vectors = _checked(embedder.encode([embedder.query_prefix + t for t in wanted.values()]), len(wanted), embedder.dim) if wanted else []
    found = dict(zip(wanted, vectors, strict=True))
    rows = [(q, t, found[q].tolist() if q in found else None) for q, t in texts.items()]
    kind = "string" if any(isinstance(q, str) for q in texts) else "long"
    return spark.createDataFrame(rows, f"qid {kind}, query string, qvec array<double>")
