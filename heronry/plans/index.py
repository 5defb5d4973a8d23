"""An index as tables: documents, chunks, postings, lengths, vectors and tombstones."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import ChunkNotFound, ConfigMismatch, InvalidInput
from ..functions import filters
from ..functions.text import Analyzer, StandardAnalyzer
from ..operators import ingest
from ..sources.scratch import kept

DOCS = "doc_id long, source string, metadata string, content_hash long"
CHUNKS = "chunk_id long, doc_id long, ordinal int, text string, char_start int, char_end int"
POSTINGS = "chunk_id long, term string, tf long"
LENGTHS = "chunk_id long, dl long"
VECTORS = "chunk_id long, vector array<double>"
TOMBSTONES = "doc_id long"
TABLES = {"docs": DOCS, "chunks": CHUNKS, "postings": POSTINGS, "lengths": LENGTHS, "vectors": VECTORS}


@dataclass(frozen=True)
class Config:
    """What an index is built with; a snapshot of another configuration is refused."""

    analyzer: Analyzer = field(default_factory=StandardAnalyzer)
    chunk: int = ingest.CHUNK
    overlap: int = ingest.OVERLAP
    embedder: str | None = None
    dim: int | None = None

    @property
    def fingerprint(self) -> dict:
        return {"analyzer": self.analyzer.id, "chunker": f"{self.chunk}/{self.overlap}", "embedder": self.embedder, "dim": self.dim}

    def check(self, other: dict) -> None:
        """Raises ConfigMismatch; an index without vectors takes any embedder."""
        own = self.fingerprint
        keys = ["analyzer", "chunker"] + (["embedder", "dim"] if other.get("dim") is not None else [])
        wrong = {k: (own[k], other.get(k)) for k in keys if own[k] != other.get(k)}
        if wrong:
            raise ConfigMismatch(f"the snapshot was built otherwise: {wrong}")


@dataclass(frozen=True)
class Index:
    """Tables of TABLES. Lexical statistics count all rows, dead ones too, until they are merged away; what can be
    found is alive."""

    docs: DataFrame
    chunks: DataFrame
    postings: DataFrame
    lengths: DataFrame
    vectors: DataFrame | None = None
    tombstones: DataFrame | None = None
    config: Config = field(default_factory=Config)
    #: The table (chunk_id, dl, terms) that postings and lengths are read from, where there is one.
    forward: DataFrame | None = None

    @classmethod
    def of_tables(cls, docs: DataFrame, chunks: DataFrame, config: Config, vectors: DataFrame | None = None) -> Index:
        """With the terms of the chunks counted; texts are analyzed each time they are read, until `saved`."""
        return cls(docs, chunks, None, None, vectors, config=config)._over(ingest.analyzed(chunks, config.analyzer))

    def _over(self, forward: DataFrame) -> Index:
        return replace(self, postings=ingest.posted(forward), lengths=forward.select("chunk_id", "dl"), forward=forward)

    @classmethod
    def build(cls, docs: DataFrame, config: Config | None = None, first_doc: int = 0, first_chunk: int = 0, live: DataFrame | None = None, order: str = "doc_id") -> Index:
        """From documents (text, source, metadata and `order`, which says who comes first): duplicates go, ids are
        dense and follow `order`."""
        config = config or Config()
        if "text" not in docs.columns:
            raise InvalidInput("documents need a text column")
        columns = {c: F.col(c) if c in docs.columns else F.lit(None).cast("string") for c in ("source", "metadata", "dedup_key")}
        rows = docs.select(F.col(order).alias("__order"), "text", F.coalesce(columns["source"], F.lit("<unknown>")).alias("source"), F.coalesce(columns["metadata"], F.lit("{}")).alias("metadata"), columns["dedup_key"].alias("dedup_key"))
        new = ingest.upsert(ingest.content_hash(rows, dedup_key="dedup_key"), live, "__order")
        numbered = ingest.renumber(new, "__order", "doc_id").withColumn("doc_id", F.col("doc_id") + first_doc)
        cut = ingest.chunk(numbered, config.chunk, config.overlap)
        chunks = ingest.renumber(cut.withColumn("__place", F.struct("doc_id", "ordinal")), "__place", "chunk_id").withColumn("chunk_id", F.col("chunk_id") + first_chunk)
        chunks = chunks.select("chunk_id", "doc_id", "ordinal", "text", "char_start", "char_end")
        return cls.of_tables(numbered.select("doc_id", "source", "metadata", "content_hash"), chunks, config)

    @classmethod
    def of_texts(cls, docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: Column | None = None, metadata: Column | None = None, vectors: DataFrame | None = None, config: Config | None = None) -> Index:
        """One chunk per row, ids as they are and no duplicates looked for."""
        config = config or Config(chunk=ingest.SINGLE[0], overlap=ingest.SINGLE[1])
        ident = F.col(doc_id).cast("long")
        body = F.coalesce(F.col(text), F.lit(""))
        rows = docs.select(
            ident.alias("doc_id"), (ident.cast("string") if source is None else source).alias("source"), (F.lit("{}") if metadata is None else metadata).alias("metadata"),
            F.xxhash64(text).alias("content_hash"),
        )
        chunks = docs.select(ident.alias("chunk_id"), ident.alias("doc_id"), F.lit(0).alias("ordinal"), body.alias("text"), F.lit(0).alias("char_start"), F.length(body).alias("char_end"))
        return cls.of_tables(rows, chunks, config, vectors)

    def saved(self) -> Index:
        """The forward index and the postings written to the shared folder, so that texts are analyzed once for all
        queries, and postings lie flat for each of them."""
        if self.forward is None:
            return self
        over = self._over(kept(self.forward, "forward"))
        return replace(over, postings=kept(over.postings, "postings"))

    def candidates(self, where: filters.Filter | None = None, columns: dict[str, Column] | None = None) -> DataFrame | None:
        """(chunk_id) of live chunks whose document passes, or None if all do."""
        if where is None and self.tombstones is None:
            return None
        docs = self.docs
        if where is not None:
            docs = docs.filter(filters.predicate(where, F.col("metadata"), columns))
        if self.tombstones is not None:
            docs = ingest.alive(docs, self.tombstones)
        return self.chunks.select("chunk_id", "doc_id").join(docs.select("doc_id"), "doc_id", "left_semi").select("chunk_id")

    def allowed(self, where: filters.Filter | None = None) -> int:
        found = self.candidates(where)
        return (self.chunks if found is None else found).count()

    def degraded(self, field_name: str) -> bool:
        """Whether a metadata field has more than MAX_KEYS values."""
        values = self.docs.select(filters.json_text(F.col("metadata"), field_name).alias("v")).filter("v is not null").distinct()
        return values.limit(filters.MAX_KEYS + 1).count() > filters.MAX_KEYS

    def union(self, other: Index) -> Index:
        """Both as one; statistics are those of all rows together."""
        if self.config.fingerprint != other.config.fingerprint:
            raise ConfigMismatch("segments of different configurations")
        vectors = self.vectors if other.vectors is None else other.vectors if self.vectors is None else self.vectors.unionByName(other.vectors)
        dead = self.tombstones if other.tombstones is None else other.tombstones if self.tombstones is None else self.tombstones.unionByName(other.tombstones).distinct()
        return replace(
            self, forward=None, docs=self.docs.unionByName(other.docs), chunks=self.chunks.unionByName(other.chunks), postings=self.postings.unionByName(other.postings),
            lengths=self.lengths.unionByName(other.lengths), vectors=vectors, tombstones=dead,
        )

    def without(self, doc_ids: DataFrame) -> Index:
        """With tombstones for the given doc_id rows."""
        dead = doc_ids.select(F.col("doc_id").cast("long")).distinct()
        return replace(self, tombstones=dead if self.tombstones is None else self.tombstones.unionByName(dead).distinct())

    def merged(self) -> Index:
        """Dead rows are gone, from the statistics too."""
        if self.tombstones is None:
            return self
        docs, chunks = ingest.alive(self.docs, self.tombstones), ingest.alive(self.chunks, self.tombstones)
        keep = lambda t: None if t is None else t.join(chunks.select("chunk_id"), "chunk_id", "left_semi")
        return replace(self, forward=None, docs=docs, chunks=chunks, postings=keep(self.postings), lengths=keep(self.lengths), vectors=keep(self.vectors), tombstones=None)

    def compacted(self) -> Index:
        """Merged, with documents and chunks numbered 0, 1, 2, ... in their old order; without tombstones, itself."""
        if self.tombstones is None:
            return self
        m = self.merged()
        doc_ids = ingest.renumber(m.docs.select("doc_id"), "doc_id", "new_doc")
        chunk_ids = ingest.renumber(m.chunks.select("chunk_id"), "chunk_id", "new_chunk")

        def moved(t: DataFrame | None, ids: DataFrame, key: str, to: str) -> DataFrame | None:
            return None if t is None else t.join(ids, key).drop(key).withColumnRenamed(to, key).select(t.columns)

        chunk = lambda t: moved(t, chunk_ids, "chunk_id", "new_chunk")
        return replace(
            m, forward=None, docs=moved(m.docs, doc_ids, "doc_id", "new_doc"), chunks=chunk(moved(m.chunks, doc_ids, "doc_id", "new_doc")), postings=chunk(m.postings), lengths=chunk(m.lengths),
            vectors=chunk(m.vectors),
        )

    def counters(self) -> DataFrame:
        """One row: num_docs, num_chunks, total_len, avgdl."""
        docs = self.docs.agg(F.count("*").alias("num_docs"))
        stats = ingest.statistics(self.lengths).withColumnRenamed("n", "num_chunks")
        return docs.crossJoin(F.broadcast(stats))  # a row each

    def chunk(self, chunk_id: int) -> dict:
        found = self.chunks.filter(F.col("chunk_id") == chunk_id).limit(1).collect()
        if not found:
            raise ChunkNotFound(chunk_id)
        return found[0].asDict()

