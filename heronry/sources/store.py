"""A versioned index on disk: immutable segments, a manifest per generation, one writer at a time.

A reader opens the newest manifest and keeps its view. A writer collects changes against the generation it opened and
publishes them as the next one; if another was faster, its manifest exists and the commit raises Busy. Files that no
manifest names are never read.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import SnapshotCorrupted, SnapshotVersionMismatch, StorageError
from ..operators import ingest
from ..plans.index import TABLES, TOMBSTONES, Config, Index
from . import files

VERSION = 1


@dataclass(frozen=True)
class Manifest:
    generation: int = 0
    segments: tuple[dict, ...] = ()
    tombstones: str | None = None
    next_doc: int = 0
    next_chunk: int = 0
    fingerprint: dict = field(default_factory=dict)

    def encode(self) -> dict:
        return {"version": VERSION, **{k: list(v) if isinstance(v, tuple) else v for k, v in self.__dict__.items()}}

    @classmethod
    def decode(cls, value: dict) -> Manifest:
        if (version := value.pop("version", None)) != VERSION:
            raise SnapshotVersionMismatch(f"a snapshot of version {version}, not {VERSION}")
        try:
            return cls(**{**value, "segments": tuple(value["segments"])})
        except (KeyError, TypeError) as e:
            raise SnapshotCorrupted(f"a manifest without {e}") from e


class Store:
    def __init__(self, spark: SparkSession, root: str, config: Config | None = None) -> None:
        self.spark, self.root, self.config = spark, root.rstrip("/"), config or Config()

    def manifest(self) -> Manifest:
        """The newest one; an empty store has generation 0."""
        found = [n for n in files.names(self.spark, f"{self.root}/manifests") if n.endswith(".json")]
        if not found:
            return Manifest(fingerprint=self.config.fingerprint)
        m = Manifest.decode(files.read_json(self.spark, f"{self.root}/manifests/{found[-1]}"))
        self.config.check(m.fingerprint)
        return m

    def publish(self, manifest: Manifest) -> Manifest:
        files.write_new(self.spark, f"{self.root}/manifests/{manifest.generation:012d}.json", manifest.encode())
        return manifest

    def segment(self, entry: dict) -> Index:
        """One segment's tables, with their row counts held against the manifest's."""
        at = f"{self.root}/segments/{entry['id']}"
        tables = {name: self.spark.read.schema(schema).parquet(f"{at}/{name}") for name, schema in TABLES.items() if name in entry["rows"]}
        return Index(tables["docs"], tables["chunks"], tables["postings"], tables["lengths"], tables.get("vectors"), config=self.config)

    def verify(self, manifest: Manifest | None = None) -> None:
        """Counts every table; raises SnapshotCorrupted where one is missing or has other rows than it was written with."""
        for entry in (manifest or self.manifest()).segments:
            for name, rows in entry["rows"].items():
                try:
                    found = self.spark.read.schema(TABLES[name]).parquet(f"{self.root}/segments/{entry['id']}/{name}").count()
                except Exception as e:
                    raise SnapshotCorrupted(f"{name} of segment {entry['id']} cannot be read") from e
                if found != rows:
                    raise SnapshotCorrupted(f"{name} of segment {entry['id']} has {found} rows, not {rows}")

    def write_segment(self, index: Index) -> dict:
        entry = {"id": uuid.uuid4().hex, "rows": {}}
        for name in TABLES:
            table = getattr(index, name)
            if table is not None:
                path = f"{self.root}/segments/{entry['id']}/{name}"
                columns = [c.strip().split(" ", 1) for c in TABLES[name].split(", ")]
                table.select(*(F.col(c).cast(kind).alias(c) for c, kind in columns)).write.parquet(path)
                entry["rows"][name] = self.spark.read.schema(TABLES[name]).parquet(path).count()
        return entry

    def view(self, manifest: Manifest | None = None) -> Index:
        """All segments as one index, dead documents marked."""
        m = manifest or self.manifest()
        if not m.segments:
            raise StorageError(f"{self.root} has no segments")
        whole = reduce(Index.union, map(self.segment, m.segments))
        return whole if m.tombstones is None else replace(whole, tombstones=self.spark.read.schema(TOMBSTONES).parquet(f"{self.root}/{m.tombstones}"))

    def writer(self) -> Writer:
        return Writer(self, self.manifest())

    def _replaced(self, m: Manifest, segments: tuple[dict, ...], tombstones: DataFrame | None, **changes) -> Manifest:
        where = None
        if tombstones is not None and not tombstones.isEmpty():
            where = f"tombstones/{uuid.uuid4().hex}"
            tombstones.select(F.col("doc_id").cast("long").alias("doc_id")).distinct().write.parquet(f"{self.root}/{where}")
        return self.publish(replace(m, generation=m.generation + 1, segments=segments, tombstones=where, **changes))

    def merge(self, take: int | None = None) -> Manifest:
        """The oldest `take` deltas (all, if None) folded into the first segment, their dead rows dropped; tombstones of
        the other segments stay."""
        m = self.manifest()
        head, rest = (m.segments, ()) if take is None else (m.segments[: take + 1], m.segments[take + 1 :])
        if not head or (len(head) == 1 and m.tombstones is None):
            return m
        dead = None if m.tombstones is None else self.spark.read.schema(TOMBSTONES).parquet(f"{self.root}/{m.tombstones}")
        whole = reduce(Index.union, map(self.segment, head))
        entry = self.write_segment(replace(whole, tombstones=dead).merged())
        left = None if dead is None or not rest else dead.join(reduce(Index.union, map(self.segment, rest)).docs, "doc_id", "left_semi")
        return self._replaced(m, (entry, *rest), left)

    def compact(self) -> tuple[Manifest, bool]:
        """Everything in one segment with dense ids; (manifest, whether ids have changed)."""
        m = self.manifest()
        if m.tombstones is None:
            return self.merge(), False
        entry = self.write_segment(self.view(m).compacted())
        return self._replaced(m, (entry,), None, next_doc=entry["rows"]["docs"], next_chunk=entry["rows"]["chunks"]), True

    def tombstone_stats(self) -> DataFrame:
        view = self.view()
        dead = view.tombstones if view.tombstones is not None else self.spark.createDataFrame([], TOMBSTONES)
        return ingest.tombstone_stats(view.docs, view.chunks, dead)

    def vacuum(self) -> list[str]:
        """Removes segments, tombstones and scratch files that the newest manifest does not name; older views end."""
        m = self.manifest()
        named = {s["id"] for s in m.segments} | {str(m.tombstones).rpartition("/")[2]}
        gone = [f"{d}/{n}" for d in ("segments", "tombstones") for n in files.names(self.spark, f"{self.root}/{d}") if n not in named]
        gone += [f"manifests/{n}" for n in files.names(self.spark, f"{self.root}/manifests") if n.endswith(".tmp")]
        for path in gone:
            files.remove(self.spark, f"{self.root}/{path}")
        return gone


class Writer:
    """Changes against one generation. Documents whose hash a live document has are not added again; documents whose
    only holder was removed are."""

    def __init__(self, store: Store, base: Manifest) -> None:
        self.store, self.base = store, base
        self._adds: list[DataFrame] = []
        self._removed: list[DataFrame] = []
        self._vectors = None

    def add(self, docs: DataFrame) -> Writer:
        """Documents (text, and source, metadata, dedup_key, doc_order where there are)."""
        self._adds.append(docs)
        return self

    def embed(self, embedder) -> Writer:
        """A function from the new chunks to vectors (chunk_id, vector), for batches in executors."""
        self._vectors = embedder
        return self

    def remove(self, doc_ids: DataFrame) -> Writer:
        """Unknown ids do nothing."""
        self._removed.append(doc_ids.select(F.col("doc_id").cast("long").alias("doc_id")))
        return self

    def commit(self) -> Manifest:
        store, m = self.store, self.base
        view = store.view(m) if m.segments else None
        dead = None if view is None else view.tombstones
        if self._removed and view is not None:
            gone = reduce(DataFrame.union, self._removed).distinct().join(view.docs.select("doc_id"), "doc_id", "left_semi")
            dead = gone if dead is None else dead.union(gone).distinct()
        segments, next_doc, next_chunk = m.segments, m.next_doc, m.next_chunk
        if self._adds:
            live = None if view is None else view.docs if dead is None else ingest.alive(view.docs, dead)
            docs = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), self._adds)
            order = "doc_order" if "doc_order" in docs.columns else "__seq"
            docs = docs if order in docs.columns else docs.withColumn(order, F.monotonically_increasing_id())
            built = Index.build(docs, store.config, next_doc, next_chunk, live, order)
            if self._vectors is not None:
                built = replace(built, vectors=self._vectors(built.chunks))
            entry = store.write_segment(built)
            if entry["rows"]["docs"]:
                segments += (entry,)
                next_doc, next_chunk = next_doc + entry["rows"]["docs"], next_chunk + entry["rows"]["chunks"]
        return store._replaced(m, segments, dead, next_doc=next_doc, next_chunk=next_chunk)
