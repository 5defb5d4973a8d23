"""Connected components of a graph given as edges: tasks contract what they have to stars, then large and small stars
alternate over what is left.

A round is a dozen stages, and plans are what fills the driver's memory. What one task holds is therefore solved there.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_streams, merged, removed_after, written

#: Edges that one file of a round is meant for; edges that a task contracts at once, and up to which one task does it all.
FILE_EDGES, TASK_EDGES = 250_000, 1 << 20


def labels(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, rising; the smallest node that each can reach)."""
    nodes, ids = np.unique(np.concatenate([u, v]), return_inverse=True)
    root = np.arange(len(nodes))
    a, b = ids[: len(u)], ids[len(u) :]
    while len(a):
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while ((up := root[root]) != root).any():
            root = up
        a, b = root[a], root[b]
        apart = a != b
        a, b = a[apart], b[apart]
    return nodes, nodes[root]


def _parts(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The edges (u, v) of a task, at least `most` at once but for the last; all, if there are fewer."""
    held, n = [], 0
    for batch in batches:
        held.append(tuple(c.to_numpy(zero_copy_only=False) for c in batch.columns))
        n += batch.num_rows
        if n >= most:
            yield tuple(map(np.concatenate, zip(*held, strict=True)))
            held, n = [], 0
    if n:
        yield tuple(map(np.concatenate, zip(*held, strict=True)))


def _contracted(most: int):
    """A star for each component within a task's edges, which links the same nodes by the fewest edges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for u, v in _parts(batches, most):
            nodes, least = labels(u, v)
            moved = nodes != least
            yield pa.RecordBatch.from_arrays([pa.array(nodes[moved]), pa.array(least[moved])], ["u", "v"])

    return run


def _solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, component) of all nodes, by the one task that has all edges."""
    for u, v in _parts(batches, 1 << 62):
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in labels(u, v)], ["node", "component"])


def _distinct(edges: DataFrame) -> DataFrame:
    return edges.filter("u <> v").distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of u is linked to the smallest of u and its neighbours."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return _distinct(both.filter("v > u").join(merged(least), "u").select(F.col("v").alias("u"), F.col("m").alias("v")))


def _small_star(edges: DataFrame) -> DataFrame:
    """u and its smaller neighbours are linked to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(merged(least), "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return _distinct(moved.union(least.select("u", F.col("m").alias("v"))))


def components(edges: DataFrame, task_edges: int = TASK_EDGES) -> DataFrame:
    """(node, component) for every node of `edges` (u, v: long); component is the smallest node that can be reached.

    Up to `task_edges` contracted edges are one task's work. Beyond that, each round is written to the shared folder, so the
    plan stays short and a lost executor costs one round; all but the result is removed in the end. The rounds grow with
    the logarithm of the longest chain. No edges: no rows.
    """

    def mark(df: DataFrame) -> tuple:
        h = F.xxhash64("u", "v").cast("decimal(20,0)")
        return tuple(df.agg(F.count("*"), F.sum(h)).first())

    with removed_after(edges.sparkSession) as keep:
        given = edges.select(F.col("u").cast("long"), F.col("v").cast("long")).filter("u <> v")
        edges = written(map_streams(given, _contracted(task_edges), "u long, v long"), "edges")
        before = None
        while (now := mark(edges))[0] > task_edges and now != before:
            before = now
            stars = _small_star(_large_star(edges)).coalesce(math.ceil(now[0] / FILE_EDGES))
            edges = written(map_streams(stars, _contracted(task_edges), "u long, v long"), "edges")
        if now[0] <= task_edges:
            return keep(written(map_streams(edges.coalesce(1), _solved, "node long, component long"), "components"))
        roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
        return keep(written(edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots), "components"))
