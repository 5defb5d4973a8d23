"""What can go wrong, by name."""

from __future__ import annotations


class HeronryError(Exception):
    """Base of all errors of this library."""


class InvalidInput(HeronryError, ValueError):
    """An argument or a row that no operator accepts."""


class DimensionMismatch(InvalidInput):
    """Vectors of another length than the index has."""


class ChunkNotFound(HeronryError, KeyError):
    """A chunk id that the index does not hold."""


class AnalyzeError(HeronryError):
    """The analyzer failed."""


class EmbeddingError(HeronryError):
    """The embedder failed."""


class NoEmbedder(EmbeddingError):
    """A vector query without query vectors or an embedder."""


class RerankError(HeronryError):
    """The reranker failed or gave a row it was not asked for."""


class StorageError(HeronryError, OSError):
    """A file could not be read or written."""


class DecodeError(StorageError):
    """A corpus, judgment or manifest file that cannot be parsed."""


class SnapshotVersionMismatch(StorageError):
    """A snapshot of another format version."""


class SnapshotCorrupted(StorageError):
    """A snapshot whose tables do not fit its manifest."""


class ConfigMismatch(HeronryError):
    """A snapshot that was built with another analyzer, chunker or embedder."""


class Busy(HeronryError):
    """Another writer has published since this one began."""


class GraphStale(HeronryError):
    """A derived vector index of another snapshot generation."""
