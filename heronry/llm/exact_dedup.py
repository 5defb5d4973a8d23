"""Exact duplicates by Patricia tries over whole normalised texts.

Each task first folds the equal texts among its own rows into one, so that a text which a third of all rows repeat
arrives once per task. Texts are dealt out by (length, content hash); every partition inserts the full byte strings
into a compressed radix trie whose terminal nodes hold the group's owner and size.
"""

from __future__ import annotations

import hashlib
import os
import pickle
import tempfile
from collections.abc import Iterator
from dataclasses import dataclass
from typing import IO

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WHITE, columns, fresh, map_batches, quoted, texts_of, with_owners, written

#: Bytes of text that one trie may hold before its largest subtree goes to disk.
TRIE_BYTES = 96 << 20
#: Bytes of distinct texts that a task folds before it hands them on.
FOLD_BYTES = 32 << 20


@dataclass(slots=True)
class Group:
    """Equal texts: the row that stays (most code points, then smallest identifier, null last, then smallest hash of the
    text as it was) and their number."""

    points: int
    owner: int | None
    size: int
    text: int = 0

    def add(self, other: Group) -> None:
        key = lambda g: (-g.points, g.owner is None, g.owner or 0, g.text)
        if key(other) < key(self):
            self.points, self.owner, self.text = other.points, other.owner, other.text
        self.size += other.size


def _mark(text: bytes) -> int:
    """What the engine's xxhash64 gives for the text."""
    h = xxhash.xxh64_intdigest(text, 42)
    return h - (h >> 63 << 64)


class _Node:
    __slots__ = ("edges", "group", "file")

    def __init__(self) -> None:
        self.edges: dict[int, tuple[bytes, _Node]] = {}
        self.group: Group | None = None
        self.file = None


def _common(a: bytes, b: bytes) -> int:
    """Length of the longest common prefix, by halving the interval in which the first difference lies."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n
    while high - low > 1:
        mid = (low + high) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid
    return low


class PatriciaTrie:
    """Byte strings with a `Group` each. Beyond `budget` bytes the heaviest subtree below the root is written to a
    temporary file of this task and is built again, alone, when the trie is read out; the files go with the reading."""

    def __init__(self, budget: int = TRIE_BYTES) -> None:
        self.budget, self.root, self.used, self.weight = budget, _Node(), 0, {}

    def insert(self, text: bytes, group: Group) -> None:
        node, rest = self.root, text
        if text and (spilled := self.root.edges.get(text[0])) and spilled[1].file:
            pickle.dump((text, group), spilled[1].file)
            return
        while rest:
            edge = node.edges.get(rest[0])
            if edge is None:
                leaf = _Node()
                node.edges[rest[0]] = (rest, leaf)
                node, added = leaf, len(rest) + 200
                break
            label, child = edge
            if (shared := len(label) if rest.startswith(label) else _common(label, rest)) < len(label):
                middle = _Node()
                middle.edges[label[shared]] = (label[shared:], child)
                node.edges[rest[0]] = (label[:shared], middle)
                child = middle
            node, rest = child, rest[shared:]
        else:
            added = 200
        if node.group is None:
            node.group = group
            self.used += added
            if text:
                self.weight[text[0]] = self.weight.get(text[0], 0) + added
            if self.used > self.budget and self.weight:
                self._spill(max(self.weight, key=self.weight.get))
        else:
            node.group.add(group)

    def _spill(self, first: int) -> None:
        file = tempfile.TemporaryFile()
        label, top = self.root.edges[first]
        for entry in self._walk(top, label):
            pickle.dump(entry, file)
        kept = _Node()
        kept.file = file
        self.root.edges[first] = (b"", kept)
        self.used -= self.weight.pop(first)

    def _walk(self, top: _Node, prefix: bytes) -> Iterator[tuple[bytes, Group]]:
        todo = [(prefix, top)]
        while todo:
            text, node = todo.pop()
            if node.group is not None:
                yield text, node.group
            todo += [(text + label, child) for label, child in node.edges.values()]

    def items(self) -> Iterator[tuple[bytes, Group]]:
        """Every distinct string with its group; the trie is used up."""
        todo = self._files(b"")
        yield from self._walk(self.root, b"")
        self.root = _Node()
        while todo:
            prefix, file = todo.pop()
            shared = self._shared(file)
            below = PatriciaTrie(self.budget)
            for text, group in self._entries(file):
                below.insert(text[len(shared) :], group)
            file.close()
            todo += below._files(prefix + shared)
            for text, group in below._walk(below.root, b""):
                yield prefix + shared + text, group

    def _files(self, prefix: bytes) -> list[tuple[bytes, IO[bytes]]]:
        """The spilled subtrees, which leave the trie."""
        found = [(k, e[1].file) for k, e in self.root.edges.items() if e[1].file]
        for k, _ in found:
            del self.root.edges[k]
        return [(prefix, file) for _, file in found]

    @staticmethod
    def _entries(file: IO[bytes]) -> Iterator[tuple[bytes, Group]]:
        size = file.seek(0, os.SEEK_END)
        file.seek(0)
        while file.tell() < size:
            yield pickle.load(file)  # noqa: S301 - written by this very task

    def _shared(self, file: IO[bytes]) -> bytes:
        """What all strings of a spilled subtree begin with, so that the tries built from it branch at once."""
        shared = None
        for text, _ in self._entries(file):
            shared = text if shared is None else shared[: _common(shared, text)]
        return shared or b""


def _fold(batches: Iterator[pa.RecordBatch], fold_bytes: int) -> Iterator[pa.RecordBatch]:
    """Distinct normalised texts of a task with their groups, in portions of `fold_bytes`."""
    held: dict[bytes, Group] = {}
    used = 0
    for batch in batches:
        ids = batch.column(0).to_pylist()
        for at in range(0, len(ids), 256):
            for doc_id, text in zip(ids[at : at + 256], batch.column(1).slice(at, 256).to_pylist(), strict=True):
                data = (text or "").encode()
                key, group = data.translate(None, WHITE), Group(len(text or ""), doc_id, 1, _mark(data))
                if key in held:
                    held[key].add(group)
                else:
                    held[key] = group
                    used += len(key) + 200
            if used > fold_bytes:
                yield from _portions(held)
                held, used = {}, 0
    yield from _portions(held)


def _portions(held: dict[bytes, Group]) -> Iterator[pa.RecordBatch]:
    items = list(held.items())
    for at in range(0, len(items), 512):
        part = items[at : at + 512]
        columns = [
            pa.array([len(t) for t, _ in part], pa.int64()),
            pa.array([xxhash.xxh64_intdigest(t) - (1 << 63) for t, _ in part], pa.int64()),
            pa.array([t for t, _ in part], pa.binary()),
            pa.array([g.points for _, g in part], pa.int64()),
            pa.array([g.owner for _, g in part], pa.int64()),
            pa.array([g.size for _, g in part], pa.int64()),
            pa.array([g.text for _, g in part], pa.int64()),
        ]
        yield pa.RecordBatch.from_arrays(columns, ["length", "hash", "content", "points", "owner", "size", "mark"])


def _own(batches: Iterator[pa.RecordBatch], trie_bytes: int) -> Iterator[pa.RecordBatch]:
    """One partition's trie, read out as a row per distinct text."""
    trie = PatriciaTrie(trie_bytes)
    for batch in batches:
        points, owners, sizes, marks = (batch.column(i).to_pylist() for i in range(1, 5))
        for at in range(0, batch.num_rows, 256):
            for i, text in enumerate(batch.column(0).slice(at, 256).to_pylist(), at):
                trie.insert(text, Group(points[i], owners[i], sizes[i], marks[i]))
    rows: list[tuple] = []

    def flush() -> pa.RecordBatch:
        types = (pa.string(), pa.int64(), pa.int64(), pa.int64())
        columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
        return pa.RecordBatch.from_arrays(columns, ["text_sha256", "keep_id", "group_size", "keep_mark"])

    for text, group in trie.items():
        rows.append((hashlib.sha256(text).hexdigest(), group.owner, group.size, group.text))
        if len(rows) == 8192:
            yield flush()
            rows = []
    if rows:
        yield flush()


def owners(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", fold_bytes: int = FOLD_BYTES, trie_bytes: int = TRIE_BYTES) -> DataFrame:
    """text_sha256, keep_id, group_size and keep_mark (xxhash64 of the kept row's text) of every distinct normalised text.

    Null counts as the empty text, a null doc_id comes after all others, of rows equal in all that decides the smallest
    hash of the original text stays. Texts of any length are whole in the tries, which spill beyond `trie_bytes`. An
    empty table gives no rows.
    """
    rows = docs.select(F.col(doc_id).cast("long"), F.col(text))
    folded = rows.mapInArrow(lambda batches: _fold(batches, fold_bytes), "length long, hash long, content binary, points long, owner long, size long, mark long")
    dealt = folded.repartition("length", "hash").select("content", "points", "owner", "size", "mark")
    return dealt.mapInArrow(lambda batches: _own(batches, trie_bytes), "text_sha256 string, keep_id long, group_size long, keep_mark long")


def _digests(batch: pa.RecordBatch) -> pa.RecordBatch:
    digests, marks = [], []
    for t in texts_of(batch, "text"):
        data = t.encode()
        digests.append(hashlib.sha256(data.translate(None, WHITE)).hexdigest())
        marks.append(_mark(data))
    return pa.RecordBatch.from_arrays([batch.column(0), pa.array(digests, pa.string()), pa.array(marks, pa.int64())], ["doc_id", "text_sha256", "mark"])


def exact_groups(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", **options) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row of `docs`.

    Texts are equal when they are identical after all ASCII white space is deleted; null counts as empty, and empty
    texts form one group. The row with the most code points before that stays, then the smallest doc_id (null last),
    then the smallest hash of the text as it was. Rows that repeat the owner's doc_id and text are all marked as kept;
    rows that share its doc_id alone are not. Texts of any length are compared whole; further columns are not looked
    at. An empty table gives no rows.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    marked = map_batches(rows, _digests, "doc_id long, text_sha256 string, mark long")
    joined = with_owners(marked, written(owners(docs, text, doc_id, **options), "owners"), "text_sha256", "group_size", "doc_id")
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("mark") == F.col("keep_mark"))
    return joined.select("doc_id", "keep_id", "group_size", kept.alias("kept"), "text_sha256")


def deduplicated(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The owner rows of `docs` (see `exact_groups`: nulls, ties and long texts are as there) with all their columns, of
    whatever names.

    Of rows that repeat doc_id and text one stays: that of the smallest hash over its columns (but maps). They become
    one in each task before they are shuffled. An empty table gives no rows.
    """
    ident, mark, order, whole = fresh(docs, "ident", "mark", "order", "whole")
    name = lambda c: F.coalesce(F.col(c).cast("long").cast("string"), F.lit("null")).alias(ident)
    keep = written(owners(docs, text, doc_id), "owners").select(name("keep_id"), F.col("keep_mark").alias(mark))
    plain = [F.col(quoted(f.name)) for f in docs.schema.fields if "map<" not in f.dataType.simpleString()]
    rows = docs.select(name(doc_id), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias(mark), F.xxhash64(*plain).alias(order), F.struct(*columns(docs)).alias(whole))
    one = rows.groupBy(ident, mark).agg(F.min_by(whole, order).alias(whole)).join(keep, [ident, mark])
    return one.select(*(F.col(whole)[c].alias(c) for c in docs.columns))
