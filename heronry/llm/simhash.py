"""SimHash fingerprints and near-duplicate groups found with Golay codes.

A 64-bit fingerprint has segments of 22, 21 and 21 bits. Two fingerprints that differ in 2 bits or fewer differ in at
most 1 bit over some two segments, so that one of these is equal and the other has 1 error at most. A segment, padded
to 23 bits, lies within 3 bits of exactly one word of the perfect binary Golay code. If each segment gives the indices
of all code words within 4 bits (one, or six), then segments at distance 1 share an index. The keys of a fingerprint
are, for each ordered pair of segments, the first one's bits with an index of the second.

Two bits in 64 are only the nearest of near copies. The pipeline's stage (`representatives`) goes out to a Jaccard
similarity of 0.8: links of fingerprints propose pairs, each is verified by its true similarity, and filters that lose
no pair find those that are further apart (see `resemblance`).
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, permutations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import _LOWER, fresh, map_batches, merged, quoted, removed_after, texts_of, written
from .graph import components
from .resemblance import alike

SHINGLE_WORDS = 3
SEED = 42
MAX_BITS = 2
#: Up to so many fingerprints with one key are compared with each other; those of larger groups meet at midpoints.
GROUP = 64

#: Shingles and similarity of near copies.
SIMILAR_WORDS, SIMILARITY = 5, 0.8

SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Generator polynomial of the binary Golay code (fixed value).
GOLAY = 0b101011100011


def _remainder(word: int) -> int:
    for at in range(22, 10, -1):
        if word >> at & 1:
            word ^= GOLAY << (at - 11)
    return word


def _tables() -> tuple[list[np.ndarray], np.ndarray]:
    """Syndromes of the three bytes of a word, and the error patterns of weight 4 or less by syndrome (-1: none)."""
    of_bit = [_remainder(1 << at) for at in range(23)]
    by_byte = []
    for byte in range(3):
        t = np.zeros(256, np.int64)
        for value in range(256):
            for bit in range(8):
                if value >> bit & 1 and byte * 8 + bit < 23:
                    t[value] ^= of_bit[byte * 8 + bit]
        by_byte.append(t)
    found: list[list[int]] = [[] for _ in range(2048)]
    for weight in range(5):
        for bits in combinations(range(23), weight):
            syndrome = 0
            for at in bits:
                syndrome ^= of_bit[at]
            found[syndrome].append(sum(1 << at for at in bits))
    patterns = np.full((2048, max(map(len, found))), -1, np.int64)
    for syndrome, errors in enumerate(found):
        patterns[syndrome, : len(errors)] = errors
    return by_byte, patterns


_BY_BYTE, _PATTERNS = _tables()


def code_indices(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For 23-bit words, the 12-bit indices of all code words within 4 bits, and a mask of those that exist."""
    syndrome = _BY_BYTE[0][words & 255] ^ _BY_BYTE[1][words >> 8 & 255] ^ _BY_BYTE[2][words >> 16]
    errors = _PATTERNS[syndrome]
    return (words[:, None] ^ errors) >> 11, errors >= 0


def keys_of(fingerprints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(keys, positions): every key of each fingerprint (int64, as stored) with its position in the input."""
    bits = fingerprints.view(np.uint64)
    segments = [((bits >> np.uint64(at)) & np.uint64((1 << n) - 1)).astype(np.int64) for at, n in SEGMENTS]
    indices = [code_indices(s) for s in segments]
    keys, rows = [], []
    for number, (i, j) in enumerate(permutations(range(3), 2)):
        index, real = indices[j]
        row, _ = np.nonzero(real)
        keys.append((number << 34) | (segments[i][row] << 12) | index[real])
        rows.append(row)
    return np.concatenate(keys), np.concatenate(rows)


def _shingle_hashes(text: str, shingle_words: int, seed: int) -> np.ndarray:
    words = text.encode().translate(_LOWER).split()
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle_words:
        return np.array([digest(b" ".join(words), seed)] if words else [], np.uint64)
    joined, n = b" ".join(words), len(words) - shingle_words + 1
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[:n].tolist()
    ends = ends[shingle_words - 1 :].tolist()
    return np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts, ends, strict=True)), np.uint64, n)


def _majority(hashes: np.ndarray) -> int:
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 15):
        part = hashes[at : at + (1 << 15)].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: str, shingle_words: int = SHINGLE_WORDS, seed: int = SEED) -> int:
    """A bit is 1 if it is set in over half the hashes of the text's shingles; no words: 0."""
    return _majority(_shingle_hashes(text, shingle_words, seed))


def fingerprints(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), **options) -> DataFrame:
    """`keep` columns and fp: the fingerprint as a signed long."""
    (body,) = fresh(docs, "content")
    kept = docs.select(*(F.col(quoted(c)) for c in keep), F.col(quoted(text)).alias(body))
    schema = StructType([*kept.schema.fields[:-1], StructField("fp", LongType())])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        n = batch.num_rows
        fp = np.fromiter((fingerprint(t, **options) for t in texts_of(batch, body)), np.uint64, n)
        return pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(fp.view(np.int64))], [*keep, "fp"])

    return map_batches(kept, run, schema)


def _expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fp = batch.column(0).to_numpy(zero_copy_only=False)
        keys, rows = keys_of(fp)
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(fp[rows])], ["key", "fp"])


def _verified(max_bits: int):
    """Within each group: an edge from every fingerprint to the first one that its verified links reach."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        lists = batch.column(0)
        flat, offsets = lists.flatten().to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
        offsets = offsets - offsets[0]
        u, v = [], []
        for a, b in zip(offsets[:-1], offsets[1:], strict=True):
            fps = np.sort(flat[a:b])
            near = np.bitwise_count((fps[:, None] ^ fps[None, :]).view(np.uint64)) <= max_bits
            owner = np.arange(len(fps))
            while True:
                lower = np.where(near, owner[None, :], len(fps)).min(1)
                if (lower == owner).all():
                    break
                owner = lower
            moved = owner != np.arange(len(fps))
            u.append(fps[moved])
            v.append(fps[owner[moved]])
        edges = [np.concatenate([np.zeros(0, np.int64), *x]) for x in (u, v)]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in edges], ["u", "v"])

    return run


def links(fps: DataFrame, group: int = GROUP) -> DataFrame:
    """Edges (u, v) whose components are those of all links at 2 or fewer differing bits, from distinct `fp`.

    Keys that more than `group` fingerprints share are not compared pair by pair: two fingerprints at distance 2 or
    less have a word within 1 bit of both, so each such fingerprint goes to the 65 words around it, where at most 65
    meet. That is exact as well, and in proportion to the number of fingerprints.
    """
    keys = fps.select("fp").mapInArrow(_expand, "key long, fp long")
    sizes = keys.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    together = written(keys.join(merged(sizes), "key"), "keys")
    few = together.filter(F.col("n") <= group).groupBy("key").agg(F.collect_list("fp").alias("fps"))
    near = map_batches(few.select("fps"), _verified(MAX_BITS), "u long, v long")
    around = F.array(F.lit(0).cast("long"), *(F.lit(m - (1 << 64) if m >> 63 else m).cast("long") for m in (1 << b for b in range(64))))
    many = together.filter(F.col("n") > group).select("fp").distinct()
    met = (
        many.select("fp", F.explode(around).alias("m"))
        .groupBy(F.col("fp").bitwiseXOR(F.col("m")).alias("word"))
        .agg(F.collect_list("fp").alias("fps"))
        .filter("size(fps) > 1")
        .select(F.explode("fps").alias("u"), F.array_min("fps").alias("v"))
    )
    return near.union(met.filter("u <> v"))


def _grouped(marked: DataFrame, first: Column) -> DataFrame:
    """fp, and first: the least of `first` over the component of the fingerprint."""
    groups = written(marked.groupBy("fp").agg(F.min(first).alias("first")), "groups")
    found = components(links(groups))
    placed = groups.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = placed.groupBy("component").agg(F.min("first").alias("first"))
    return placed.drop("first").join(least, "component").select("fp", "first")


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", **options) -> DataFrame:
    """doc_id, fp (signed long) and component_id: the smallest doc_id among documents that links can reach.

    Texts that are null, empty or white space have fingerprint 0 and are linked like any other. Repeated rows stay and
    share a component; a null doc_id is kept, and is a component's id only where no other exists. Texts of any length
    are read whole; further columns are not looked at. An empty table gives no rows.
    """
    named = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    with removed_after(docs.sparkSession) as keep:
        marked = written(fingerprints(named, **options), "fingerprints")
        ids = _grouped(marked, F.col("doc_id")).withColumnRenamed("first", "component_id")
        return keep(written(marked.join(ids, "fp").select("doc_id", "fp", "component_id"), "near-duplicates"))


def representatives(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", similarity: float = SIMILARITY) -> DataFrame:
    """One document of each group that pairs of the Jaccard similarity lead to (distinct shingles of SIMILAR_WORDS words),
    with all its columns, of whatever names: that of the smallest doc_id (null last), then of the smallest hash of the
    text. Rows that repeat its doc_id and text stay with it; null, empty and blank texts are one group. Texts of any
    length are read whole; an empty table gives no rows.

    Fingerprints of the distinct shingles that are linked at 2 bits propose pairs, which are verified by their true
    similarity. A distance alone would let through some pairs of any similarity near the wanted one, and miss some; so
    every further pair of the similarity is found by `resemblance`, and none below it is linked.
    """
    ident, digest = F.col(doc_id).cast("long"), F.xxhash64(F.coalesce(F.col(text), F.lit("")))
    named = docs.select(ident.alias("doc_id"), digest.alias("digest"), F.col(text).alias("text"))

    def sets(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        return (np.unique(_shingle_hashes(t, SIMILAR_WORDS, SEED)) for t in texts_of(batch))

    def name(members: np.ndarray) -> int:
        return xxhash.xxh64_intdigest(members.tobytes(), SEED)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = np.array([(name(s), len(s), _majority(s)) for s in sets(batch)], np.uint64).reshape(-1, 3).view(np.int64)
        return pa.RecordBatch.from_arrays([*batch.columns[:-1], *(pa.array(np.ascontiguousarray(c)) for c in found.T)], ["doc_id", "digest", "node", "n", "fp"])

    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest")
    mine, mark = fresh(docs, "ident", "mark")
    with removed_after(docs.sparkSession) as keep:
        marked = written(map_batches(named, run, "doc_id long, digest long, node long, n long, fp long"), "sets-named")
        groups = written(marked.groupBy("node").agg(F.min(first).alias("first"), F.min("fp").alias("fp")), "groups")
        leads = written(groups.groupBy("fp").agg(F.min("node").alias("lead")), "leads")
        lead = lambda side: merged(leads.select(F.col("fp").alias(side), F.col("lead").alias(f"{side}_lead")))
        across = links(leads).distinct().join(lead("u"), "u").join(lead("v"), "v").select(F.col("u_lead").alias("u"), F.col("v_lead").alias("v"))
        within = groups.join(merged(leads), "fp").filter("node <> lead").select(F.col("node").alias("u"), F.col("lead").alias("v"))
        found = alike(named.select("digest", "text"), marked.drop("fp"), sets, name, similarity, across.union(within))
        placed = groups.join(merged(components(found)), "node", "left")
        stays = placed.groupBy(F.coalesce("component", "node")).agg(F.min("first").alias("first"))
        stays = keep(written(stays.select(F.col("first.doc_id").alias(mine), F.col("first.digest").alias(mark)).distinct(), "representatives"))
    return docs.join(merged(stays), ident.eqNullSafe(F.col(mine)) & (digest == F.col(mark)), "left_semi")
