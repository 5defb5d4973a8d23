"""Documents to chunks, postings and statistics; duplicates, deletions and renumbering."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..errors import InvalidInput
from ..functions.text import Analyzer, StandardAnalyzer
from ..sources.scratch import kept

CHUNK, OVERLAP = 512, 64
#: A document of fewer code points is one chunk in single-chunk mode.
SINGLE = (200_000, 0)


def boundaries(text: str) -> list[int]:
    """Where paragraphs start: after each run of two or more line feeds or carriage returns."""
    out, run = [], 0
    for i, c in enumerate(text):
        if c in "\r\n":
            run += 1
            continue
        if run > 1:
            out.append(i)
        run = 0
    if run > 1:
        out.append(len(text))
    return out


def windows(text: str, size: int = CHUNK, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """(start, end) of each chunk: `size` code points, cut back to the last paragraph start within, overlapping the
    next one by `overlap` unless that would not advance."""
    marks, out, start, n = np.array(boundaries(text), np.int64), [], 0, len(text)
    while start < n:
        cut = min(start + size, n)
        if cut < n and (k := int(np.searchsorted(marks, cut, side="right"))) and marks[k - 1] > start:
            cut = int(marks[k - 1])
        out.append((start, cut))
        if cut == n:
            break
        start = cut - overlap if cut - overlap > start else cut
    return out


def chunk(docs: DataFrame, size: int = CHUNK, overlap: int = OVERLAP, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ordinal, char_start, char_end, text) of every chunk, offsets in code points (`byte_offsets` has those in
    bytes); empty texts have none.

    Texts without a paragraph break are cut in closed form in the JVM; only the others go through Python.
    """
    if size <= 0 or not 0 <= overlap < size:
        raise InvalidInput("a chunk needs a size above 0 and an overlap below it")
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    broken = F.col("text").rlike(r"[\r\n]{2,}")
    n, step = F.length("text"), size - overlap
    last = F.greatest(F.ceil((n - size) / F.lit(step)), F.lit(0)).cast("int")
    plain = (
        rows.filter(~broken & (n > 0))
        .withColumn("ordinal", F.explode(F.sequence(F.lit(0), last)))
        .withColumn("char_start", F.col("ordinal") * step)
        .withColumn("char_end", F.least(F.col("char_start") + size, n))
        .select("doc_id", "ordinal", "char_start", "char_end", F.expr("substring(text, char_start + 1, char_end - char_start)").alias("text"))
    )

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [(i, k, a, b, t[a:b]) for i, t in zip(batch["doc_id"], batch["text"], strict=True) for k, (a, b) in enumerate(windows(t, size, overlap))]
            yield pd.DataFrame(found, columns=["doc_id", "ordinal", "char_start", "char_end", "text"])

    kind = dict(rows.dtypes)["doc_id"]
    return plain.unionByName(rows.filter(broken).mapInPandas(cut, f"doc_id {kind}, ordinal int, char_start int, char_end int, text string"))


def byte_offsets(chunks: DataFrame) -> DataFrame:
    """`chunks` (doc_id, ordinal, char_start, text) with byte_start and byte_end: where each stands in the UTF-8 of its
    document. Every chunk counts its bytes up to the next one's start; no text is measured more than once."""
    by = Window.partitionBy("doc_id").orderBy("ordinal")
    marked = chunks.withColumn("__ahead", F.lead("char_start").over(by) - F.col("char_start"))
    sized = marked.withColumn("__bytes", F.octet_length(F.expr("CASE WHEN __ahead IS NULL THEN text ELSE substring(text, 1, __ahead) END")))
    start = F.coalesce(F.sum("__bytes").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long")
    return sized.withColumn("byte_start", start).withColumn("byte_end", F.col("byte_start") + F.octet_length("text")).drop("__ahead", "__bytes")


def content_hash(docs: DataFrame, text: str = "text", dedup_key: str | None = None) -> DataFrame:
    """`docs` with content_hash, of the dedup key where there is one and of the text elsewhere; 0 is never a duplicate."""
    source = F.coalesce(F.col(dedup_key), F.col(text)) if dedup_key else F.col(text)
    return docs.withColumn("content_hash", F.xxhash64(source))


def upsert(incoming: DataFrame, live: DataFrame | None = None, order: str = "doc_id") -> DataFrame:
    """The rows of `incoming` (with content_hash) that are new: the first of each hash that no live row has.

    Least-by-order is a partial aggregate, so a hash that a third of all rows share stays cheap.
    """
    first = incoming.filter("content_hash <> 0").groupBy("content_hash").agg(F.min(order).alias(order))
    if live is not None:
        first = first.join(live.select("content_hash"), "content_hash", "left_anti")
    return incoming.join(first, ["content_hash", order], "left_semi").unionByName(incoming.filter("content_hash = 0"))


def terms(chunks: DataFrame, analyzer: Analyzer | None = None, chunk_id: str = "chunk_id", text: str = "text") -> DataFrame:
    """(chunk_id, term, position): positions count kept terms."""
    analyzed = (analyzer or StandardAnalyzer()).document(F.col(text))
    return chunks.select(F.col(chunk_id).cast("long").alias("chunk_id"), F.posexplode(analyzed).alias("position", "term"))


def analyzed(chunks: DataFrame, analyzer: Analyzer | None = None, positions: bool = False, chunk_id: str = "chunk_id", text: str = "text") -> DataFrame:
    """(chunk_id, dl, terms): the forward index, a row per chunk, with its distinct terms as (term, tf[, positions]).

    A chunk's terms all stand in its row, so they are counted there, in whole Arrow batches, and nothing is shuffled;
    postings and lengths are both read from this table. Texts without terms have an empty array.
    """
    kind = "array<struct<term: string, tf: long" + (", positions: array<int>>>" if positions else ">>")
    analyzer = analyzer or StandardAnalyzer()
    whole = hasattr(analyzer, "split")  # else the JVM has made the lists

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = analyzer.split(batch.column(1)) if whole else batch.column(1)
            sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
            coded = lists.flatten().dictionary_encode()
            codes, kinds = coded.indices.to_numpy(), max(len(coded.dictionary), 1)
            row = np.repeat(np.arange(len(sizes)), sizes)
            if whole:
                good = analyzer.keeps(coded.dictionary)[codes]
                codes, row = codes[good], row[good]
                sizes = np.bincount(row, minlength=len(sizes))
            key = row * kinds + codes
            order = np.argsort(key, kind="stable")
            key = key[order]
            starts = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)])
            tf = np.diff(np.append(starts, len(key)))
            fields = [coded.dictionary.take(pa.array(key[starts] % kinds)), pa.array(tf, pa.int64())]
            if positions:
                place = np.arange(len(key)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                fields.append(pa.ListArray.from_arrays(pa.array(np.append(starts, len(key)), pa.int32()), pa.array(place[order], pa.int32())))
            edges = np.searchsorted(key[starts] // kinds, np.arange(len(sizes) + 1))
            structs = pa.StructArray.from_arrays(fields, ["term", "tf", "positions"][: len(fields)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes), pa.ListArray.from_arrays(pa.array(edges, pa.int32()), structs)], ["chunk_id", "dl", "terms"])

    found = analyzer.body(F.col(text)) if whole else analyzer.document(F.col(text))
    return chunks.select(F.col(chunk_id).cast("long").alias("chunk_id"), found.alias("found")).mapInArrow(count, f"chunk_id long, dl long, terms {kind}")


def posted(forward: DataFrame) -> DataFrame:
    """(chunk_id, term, tf[, positions]) of a forward index."""
    return forward.select("chunk_id", F.inline("terms"))


def postings(chunks: DataFrame, analyzer: Analyzer | None = None, positions: bool = False, chunk_id: str = "chunk_id", text: str = "text") -> DataFrame:
    """(chunk_id, term, tf[, positions])."""
    return posted(analyzed(chunks, analyzer, positions, chunk_id, text))


def lengths(chunks: DataFrame, analyzer: Analyzer | None = None, chunk_id: str = "chunk_id", text: str = "text") -> DataFrame:
    """(chunk_id, dl) of every chunk, those without terms included."""
    return analyzed(chunks, analyzer, False, chunk_id, text).select("chunk_id", "dl")


def document_frequency(posted: DataFrame) -> DataFrame:
    return posted.groupBy("term").agg(F.count("*").alias("df"))


def statistics(chunk_lengths: DataFrame) -> DataFrame:
    """One row: n, total_len, avgdl (0 when empty)."""
    total = F.coalesce(F.sum("dl"), F.lit(0))
    return chunk_lengths.agg(F.count("*").alias("n"), total.alias("total_len"), F.when(F.count("*") > 0, total / F.count("*")).otherwise(0.0).alias("avgdl"))


def alive(rows: DataFrame, tombstones: DataFrame, key: str = "doc_id") -> DataFrame:
    return rows.join(tombstones.select(key), key, "left_anti")


def tombstone_stats(docs: DataFrame, chunks: DataFrame, tombstones: DataFrame) -> DataFrame:
    """One row: docs_total, docs_dead, docs_alive, chunks_total, chunks_dead, ratio of dead documents."""
    dead = tombstones.select("doc_id").distinct()
    d = docs.select("doc_id").join(dead.withColumn("gone", F.lit(1)), "doc_id", "left").agg(F.count("*").alias("docs_total"), F.count("gone").alias("docs_dead"))
    c = chunks.select("doc_id").join(dead.withColumn("gone", F.lit(1)), "doc_id", "left").agg(F.count("*").alias("chunks_total"), F.count("gone").alias("chunks_dead"))
    ratio = F.when(F.col("docs_total") > 0, F.col("docs_dead") / F.col("docs_total")).otherwise(0.0)
    # both sides are single rows
    return d.crossJoin(F.broadcast(c)).select("docs_total", "docs_dead", (F.col("docs_total") - F.col("docs_dead")).alias("docs_alive"), "chunks_total", "chunks_dead", ratio.alias("ratio"))


def should_compact(chunks_total: int, ratio: float) -> bool:
    """The hint that a save gives: at 1024 chunks and a fifth of dead documents."""
    return chunks_total >= 1024 and ratio >= 0.2


def renumber(rows: DataFrame, key: str, to: str) -> DataFrame:
    """`rows` with `to`: 0, 1, 2, ... in the order of `key`.

    Rows are sorted by range; each partition counts its own and starts where those before it end, so no task sees
    more than its share. The partition sizes are the one thing that goes to the driver.
    """
    ordered = rows.sort(key).withColumn("__part", F.spark_partition_id()).withColumn("__row", F.monotonically_increasing_id())
    ordered = kept(ordered, "ordered")  # sorted anew, rows could lie in other partitions
    first = ordered.groupBy("__part").agg(F.count("*").alias("n"), F.min("__row").alias("__first"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = first.select("__part", "__first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__offset"))
    placed = ordered.join(F.broadcast(offsets), "__part")  # a row per partition
    return placed.withColumn(to, F.col("__offset") + F.col("__row") - F.col("__first")).drop("__part", "__row", "__first", "__offset")
