"""Pairs of sets whose Jaccard similarity is at least a given one: none is missed, and none is let through below it.

Sets are given as distinct 64-bit hashes. If a set of n has a partner of similarity s, then `_least` = s * n of its
members, rounded up, are in the partner too. From that follow two filters that lose no pair:

1. In the order of the hashes, the k smallest common members are among the first n - _least(n) + k of either set. So
   many are sent to buckets of the hash space, and a set of which fewer are met again elsewhere has no partner.
2. Of the sets that are left, members are put in order by how many of these sets have them, the rarest first: partners
   then share one of their first n - _least(n) + 1. A passage that many texts share comes last and links nothing.

Sets that share such a member are linked to the least of them, in proportion to the members. Within the components of
these links every pair is verified by its true similarity, a component's sets being cut into blocks, so that any two
blocks are a group of their own and a large component is spread over many tasks. Pairs that were proposed beforehand
are verified first, and sets that they link already are not compared with each other again.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, merged, written
from .graph import components

#: Members that a bucket is meant for, and that are dealt at once; sets and members of a block; members that a task
#: verifies at once.
BUCKET_MEMBERS, DEALT_MEMBERS, BLOCK_SETS, BLOCK_MEMBERS, TASK_MEMBERS = 1 << 18, 1 << 19, 256, 1 << 18, 1 << 20

#: An odd constant that spreads hashes over buckets (fixed value, 2**64 divided by the golden ratio).
_SPREAD = np.uint64(0x9E3779B97F4A7C15)

Sets = Callable[[pa.RecordBatch], Iterator[np.ndarray]]


def _least(n: np.ndarray, similarity: float) -> np.ndarray:
    """How many members of a set of n a partner has at least."""
    return np.maximum(np.ceil(similarity * n - 1e-9), 1).astype(np.int64)


def _further(n: np.ndarray) -> np.ndarray:
    """By how many members the first filter's prefix is longer."""
    return np.maximum(n // 8, 1)


def _dealt(bucket: np.ndarray, buckets: int, *columns: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A row for each bucket that occurs, with the bytes of its part of each column."""
    order = np.argsort(bucket.astype(np.uint32), kind="stable")
    edges = np.searchsorted(bucket[order], np.arange(buckets + 1, dtype=bucket.dtype))
    for b in np.flatnonzero(np.diff(edges)).tolist():
        own = order[edges[b] : edges[b + 1]]
        yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), *(pa.array([c[own].tobytes()], pa.binary()) for c in columns)], ["bucket", *(f"c{i}" for i in range(len(columns)))])


def _column(table: pa.Table, name: str, dtype: type) -> np.ndarray:
    return np.concatenate([np.frombuffer(b, dtype) for b in table[name].to_pylist()])


def _bucket_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return (hashes * _SPREAD >> np.uint64(32)) % np.uint64(buckets)


def _runs(values: np.ndarray) -> np.ndarray:
    """Of sorted values: how often each one's value occurs."""
    starts = np.flatnonzero(np.append(True, values[1:] != values[:-1]))
    sizes = np.diff(np.append(starts, len(values)))
    return np.repeat(sizes, sizes)


def _chunks(pairs: Iterator[tuple[int, np.ndarray]], members: int = DEALT_MEMBERS) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
    nodes, sets, held = [], [], 0
    for node, s in pairs:
        nodes.append(node)
        sets.append(s)
        held += len(s)
        if held >= members:
            yield np.array(nodes, np.uint64), sets
            nodes, sets, held = [], [], 0
    if sets:
        yield np.array(nodes, np.uint64), sets


def _prefixes(sets: Sets, name: Callable[[np.ndarray], int], similarity: float, buckets: int):
    """Filter 1: the first members of each set in the order of the hashes. Within a bucket 32 bits tell them apart: two
    that are taken for one can only let a set through."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray]]:
        for batch in batches:
            for s in sets(batch):
                if len(s):
                    yield name(s), s[: len(s) - int(_least(np.int64(len(s)), similarity)) + int(_further(np.int64(len(s))))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for nodes, parts in _chunks(cut(batches)):
            hashes = np.concatenate(parts)
            yield from _dealt(_bucket_of(hashes, buckets), buckets, hashes.astype(np.uint32), np.repeat(nodes, [len(p) for p in parts]))

    return run


def _met(table: pa.Table) -> pa.Table:
    """Of a bucket: how many members of each set are met in others."""
    hashes, nodes = _column(table, "c0", np.uint32), _column(table, "c1", np.uint64)
    order = np.lexsort((nodes, hashes))
    hashes, nodes = hashes[order], nodes[order]
    once = np.append(True, (hashes[1:] != hashes[:-1]) | (nodes[1:] != nodes[:-1]))  # equal sets are one
    hashes, nodes = hashes[once], nodes[once]
    found, counts = np.unique(nodes[_runs(hashes) > 1], return_counts=True)
    return pa.table({"node": pa.array(found.view(np.int64)), "met": pa.array(counts.astype(np.int64))})


def _members(buckets: int):
    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray]]:
        for batch in batches:
            for node, data in zip(batch.column("node").to_pylist(), batch.column("members"), strict=True):
                yield node & (1 << 64) - 1, np.frombuffer(data.as_py(), np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for nodes, parts in _chunks(pairs(batches)):
            sizes = np.array([len(p) for p in parts], np.uint64)
            hashes, times = np.concatenate(parts), sizes.astype(np.int64)
            yield from _dealt(_bucket_of(hashes, buckets), buckets, hashes, np.repeat(nodes, times), np.repeat(sizes, times))

    return run


def _counted(buckets: int):
    """Filter 2, by bucket of the members: those that several sets have, with how many do, dealt by set."""

    def run(table: pa.Table) -> pa.Table:
        hashes, nodes, sizes = (_column(table, f"c{i}", np.uint64) for i in range(3))
        order = np.argsort(hashes, kind="stable")
        many = _runs(hashes[order])
        order, many = order[many > 1], many[many > 1].astype(np.uint64)
        out = list(_dealt(_bucket_of(nodes[order], buckets), buckets, hashes[order], nodes[order], sizes[order], many))
        schema = pa.schema([("bucket", pa.int32()), *((f"c{i}", pa.binary()) for i in range(4))])
        return pa.Table.from_batches(out, schema)

    return run


def _rarest(similarity: float):
    """Filter 2, by bucket of the sets: the first members of each by how many sets have them, without those of its own."""

    def run(table: pa.Table) -> pa.Table:
        hashes, nodes, sizes, many = (_column(table, f"c{i}", np.uint64) for i in range(4))
        order = np.lexsort((hashes, many, nodes))
        hashes, nodes, sizes = hashes[order], nodes[order], sizes[order].astype(np.int64)
        here = _runs(nodes)
        starts = np.flatnonzero(np.append(True, nodes[1:] != nodes[:-1]))
        place = np.arange(len(nodes)) - np.repeat(starts, here[starts])
        first = place + sizes - here < sizes - _least(sizes, similarity) + 1
        return pa.table({"member": pa.array(hashes[first].view(np.int64)), "node": pa.array(nodes[first].view(np.int64))})

    return run


def _linked(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, known: np.ndarray, similarity: float) -> np.ndarray:
    """For each set, the first one that pairs of the similarity lead to; only pairs of one in left and one in right, and
    of different groups in `known`, whose members are linked from the start."""
    _, at, group = np.unique(known, return_index=True, return_inverse=True)
    owner = at[group]
    if (group == group[0]).all():
        return owner
    sizes = np.array([len(s) for s in sets])
    _, ids = np.unique(np.concatenate(sets), return_inverse=True)
    starts = np.cumsum(sizes) - sizes
    has = np.zeros(ids.max() + 1, np.int64)
    for i in np.flatnonzero(left):
        apart = right & (owner != owner[i])
        if not apart.any():
            continue
        own = ids[starts[i] : starts[i] + sizes[i]]
        has[own] = 1
        shared = np.add.reduceat(has[ids], starts)
        has[own] = 0
        near = owner[apart & (shared / (sizes + sizes[i] - shared) >= similarity)]
        joined = np.unique(np.append(near, owner[i]))
        if len(joined) > 1:
            owner[np.isin(owner, joined)] = joined[0]
    return owner


def _verified(similarity: float):
    def run(table: pa.Table) -> pa.Table:
        names = ["component", "low", "high", "block", "node", "known"]
        component, low, high, block, node, known = (table[n].to_numpy() for n in names)
        data = table["members"]
        order = np.lexsort((node, high, low, component))
        key = np.stack([component, low, high])[:, order]
        starts = np.flatnonzero(np.append(True, (key[:, 1:] != key[:, :-1]).any(0)))
        u, v = [], []
        for rows in np.split(order, starts[1:]):
            if len(rows) > 1:
                sets = [np.frombuffer(data[i].as_py(), np.uint64) for i in rows.tolist()]
                owner = _linked(sets, block[rows] == low[rows], block[rows] == high[rows], known[rows], similarity)
                moved = known[rows] != known[rows[owner]]
                u.append(node[rows[moved]])
                v.append(node[rows[owner[moved]]])
        edges = [np.concatenate([np.zeros(0, np.int64), *x]) for x in (u, v)]
        return pa.table({"u": pa.array(edges[0]), "v": pa.array(edges[1])})

    return run


def _sure(similarity: float):
    """Of proposed pairs, with their members: those of the similarity."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        kept = []
        for a, b in zip(batch.column("a"), batch.column("b"), strict=True):
            a, b = np.frombuffer(a.as_py(), np.uint64), np.frombuffer(b.as_py(), np.uint64)
            shared = len(np.intersect1d(a, b, assume_unique=True))
            kept.append(shared / (len(a) + len(b) - shared) >= similarity)
        return batch.select(["u", "v"]).filter(pa.array(kept, pa.bool_()))

    return run


def alike(rows: DataFrame, marked: DataFrame, sets: Sets, name: Callable[[np.ndarray], int], similarity: float, proposed: DataFrame) -> DataFrame:
    """Edges (u, v) whose components are those of all pairs of sets with the similarity.

    `sets` gives the sets of a batch of `rows` (which has a column `digest`) as rising hashes, `name` the name of a set,
    the same for equal ones; `marked` has digest, node (that name as a signed long) and n (size) of every row, `proposed`
    pairs (u, v) of nodes to be verified first. Sets without members are alike to none.
    """
    prefix = F.greatest(F.lit(1), F.col("n") * (1 - similarity + 0.125))
    total = marked.agg(F.sum(prefix)).first()[0] or 0
    buckets = max(1, math.ceil(total / BUCKET_MEMBERS))
    dealt = rows.mapInArrow(_prefixes(sets, name, similarity, buckets), "bucket int, c0 binary, c1 binary")
    met = dealt.groupBy("bucket").applyInArrow(_met, "node long, met long").groupBy("node").agg(F.sum("met").alias("met"))
    least = F.greatest(F.ceil(F.col("n") * similarity - 1e-9), F.lit(1))
    enough = F.col("met") >= F.greatest(F.floor(least / 8), F.lit(1))  # _further of the smallest partner
    left = marked.groupBy("node").agg(F.min("digest").alias("digest"), F.min("n").alias("n")).join(merged(met), "node").filter(enough)
    left = written(left.select("digest", "n"), "left")

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in sets(batch):
                node = pa.array([name(s)], pa.uint64()).view(pa.int64())
                yield pa.RecordBatch.from_arrays([node, pa.array([len(s)], pa.int64()), pa.array([s.tobytes()], pa.binary())], ["node", "n", "members"])

    taken = rows.join(merged(left.select("digest")), "digest", "left_semi").select(*rows.columns)
    kept = written(taken.mapInArrow(members, "node long, n long, members binary").dropDuplicates(["node"]), "sets")
    with_members = lambda node, data: merged(kept.select(F.col("node").alias(node), F.col("members").alias(data)))
    both = proposed.join(with_members("u", "a"), "u").join(with_members("v", "b"), "v").select("u", "v", "a", "b")
    sure = written(map_batches(both, _sure(similarity), "u long, v long"), "sure")
    known = components(sure).withColumnRenamed("component", "known")
    total = kept.agg(F.sum("n")).first()[0] or 0
    buckets = max(1, math.ceil(total / BUCKET_MEMBERS))
    binary = ", ".join(f"c{i} binary" for i in range(4))
    dealt = kept.mapInArrow(_members(buckets), "bucket int, c0 binary, c1 binary, c2 binary")
    counted = dealt.groupBy("bucket").applyInArrow(_counted(buckets), f"bucket int, {binary}")
    first = counted.groupBy("bucket").applyInArrow(_rarest(similarity), "member long, node long")
    shared = first.groupBy("member").agg(F.collect_list("node").alias("nodes")).filter("size(nodes) > 1")
    found = components(shared.select(F.explode("nodes").alias("u"), F.array_min("nodes").alias("v")))

    placed = kept.select("node", "n").join(merged(found), "node").join(merged(known), "node", "left").withColumn("known", F.coalesce("known", "node"))
    sizes = placed.groupBy("component").agg(F.greatest(F.ceil(F.count("*") / BLOCK_SETS), F.ceil(F.sum("n") / BLOCK_MEMBERS)).cast("int").alias("blocks"))
    dealt = written(placed.join(merged(sizes), "component").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).drop("n"), "blocks")
    rows_out = dealt.join(merged(kept), "node").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pairs = rows_out.select("component", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "node", "known", "members")
    tasks = max(1, math.ceil((dealt.join(merged(kept.select("node", "n")), "node").agg(F.sum(F.col("n") * F.col("blocks"))).first()[0] or 0) / TASK_MEMBERS))
    grouped = pairs.groupBy(F.pmod(F.xxhash64("component", "low", "high"), F.lit(max(tasks, 64))).alias("task"))
    return sure.union(grouped.applyInArrow(_verified(similarity), "u long, v long"))
