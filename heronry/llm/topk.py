"""Exact top-k inner products by KD-trees.

Vectors are dealt into shards by a hash. Each shard becomes a KD-tree of median splits with tight bounding boxes, built
once and written. A query first searches the shard that it lies in itself, as that is built; the score and identifier
of its k-th result go with it to all others, where boxes that cannot hold anything better are never opened. Queries
stream past a tree in blocks, so a task holds one tree and one block.
"""

from __future__ import annotations

import heapq
import math
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import removed_after, written

K = 10
SCALE = 1024
LEAF = 64
#: Rows of a shard on average, and queries that are taken together at most.
SHARD_ROWS, BLOCK_QUERIES = 65_536, 1_024
#: A table this small is one shard; larger ones have at least as many shards as the cluster has cores.
SMALL = 4_096
_HITS = "query long, query_id long, vec_id long, score long"
_BUILT = "shard int, tree binary, query long, query_id long, vec_id long, score long"
_LONG = pa.int64()


def _exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T of whole numbers, in floats where all sums are exact in them."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if most < 2**53:
        return a @ b.T
    if most < 2**63:
        return a.astype(np.int64) @ b.astype(np.int64).T
    return np.array([[int(x) for x in r] for r in a], object) @ np.array([[int(x) for x in r] for r in b], object).T


class KDTree:
    """Median splits along the widest side until LEAF rows are left or all are equal."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, leaf: int = LEAF) -> None:
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[order], vectors[order]
        self.lows, self.highs, self.least, self.children, self.rows = [], [], [], [], []
        todo = [(np.arange(len(ids)), -1)]
        while todo:
            rows, parent = todo.pop()
            node, own = len(self.rows), self.vectors[rows]
            low, high = own.min(0), own.max(0)
            self.lows.append(low)
            self.highs.append(high)
            self.least.append(int(self.ids[rows].min()))
            self.children.append([])
            if parent >= 0:
                self.children[parent].append(node)
            wide = int(np.argmax(high - low))
            if len(rows) <= leaf or high[wide] == low[wide]:
                self.rows.append(np.sort(rows))
                continue
            self.rows.append(None)
            half = len(rows) // 2
            split = np.argpartition(own[:, wide], half)
            todo += [(rows[split[half:]], node), (rows[split[:half]], node)]
        self.lows, self.highs = np.array(self.lows), np.array(self.highs)

    def packed(self) -> bytes:
        """The tree as bytes; vectors as the narrowest whole numbers that hold them."""
        most = float(np.abs(self.vectors).max(initial=0))
        kind = next((t for t in (np.int16, np.int32) if most <= np.iinfo(t).max), np.float64)
        fields = self.__dict__ | {"vectors": self.vectors.astype(kind), "lows": self.lows.astype(kind), "highs": self.highs.astype(kind)}
        return pickle.dumps(fields, protocol=5)

    @classmethod
    def unpacked(cls, data: bytes) -> KDTree:
        """A tree of `packed`; the bytes come from the tasks that built it."""
        tree = cls.__new__(cls)
        tree.__dict__.update(pickle.loads(data))  # noqa: S301
        for name in ("vectors", "lows", "highs"):
            setattr(tree, name, getattr(tree, name).astype(np.float64))
        return tree

    def answers(self, queries: list[tuple[int, int, np.ndarray, tuple[int, int] | None]], k: int) -> list[tuple[int, int, int, int]]:
        """(query, its id, vec_id, score) of the k best for each of (query, its id, vector, floor)."""
        out: list[tuple[int, int, int, int]] = []
        width = self.vectors.shape[1]
        for at in range(0, len(queries), 128):
            part = queries[at : at + 128]
            wanted = _padded([q[2][:width] for q in part], width)  # beyond the tree's width its vectors are zero
            for (query, own, _, floor), vector, bounds in zip(part, wanted, self.bounds(wanted), strict=True):
                out += [(query, own, -n, s) for s, n in self.search(vector, own, bounds, k, floor)]
        return out

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """The largest inner product that each query can have within each node's box."""
        return _exact(np.maximum(queries, 0), self.highs) + _exact(np.minimum(queries, 0), self.lows)

    def search(self, query: np.ndarray, own: int, bounds: np.ndarray, k: int, floor: tuple[int, int] | None) -> list[tuple[int, int]]:
        """The k best (score, -id), none worse than `floor`, best-first; rows with the query's identifier are left out."""
        best: list[tuple[int, int]] = []
        todo = [(-bounds[0], 0)]
        worst = floor or (-math.inf, 0)
        while todo:
            bound, node = heapq.heappop(todo)
            if -bound < worst[0]:
                break
            if (-bound, -self.least[node]) < worst:
                continue
            if self.rows[node] is None:
                for child in self.children[node]:
                    heapq.heappush(todo, (-bounds[child], child))
                continue
            rows = self.rows[node]
            scores = _exact(query[None, :], self.vectors[rows])[0]
            good = np.flatnonzero((scores >= worst[0]) & (self.ids[rows] != own))
            if len(good) > k:
                good = good[np.argsort(-scores[good], kind="stable")[:k]]
            for at in good:
                hit = (int(scores[at]), -int(self.ids[rows[at]]))
                if hit < worst:
                    continue
                heapq.heappush(best, hit)
                if len(best) > k:
                    heapq.heappop(best)
                if len(best) == k:
                    worst = max(worst, best[0])
        return best


def _name(vec_id: int, vector: bytes) -> int:
    """Tells queries apart by id and vector."""
    return xxhash.xxh64_intdigest(vector, vec_id & (1 << 64) - 1) >> 1


def _whole(every: int):
    """Vectors times SCALE, rounded down, as bytes of float64, and the names of those that are queries; vectors with
    null or non-finite components go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            for i, v in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if i is None or v is None or None in v:
                    continue
                x = np.array(v, np.float64)
                if np.isfinite(x).all():
                    data = np.floor(SCALE * x).tobytes()
                    kept.append((i, data, _name(i, data) if i % every == 0 else None))
            yield _arrow(kept, ("vec_id", "v", "query"), (_LONG, pa.binary(), _LONG))

    return run


def _padded(rows: list[np.ndarray], width: int) -> np.ndarray:
    out = np.zeros((len(rows), width))
    for row, r in zip(out, rows, strict=True):
        row[: len(r)] = r
    return out


def _arrow(rows: list[tuple], names: tuple[str, ...], types: tuple[pa.DataType, ...]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else ((),) * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], list(names))


def _builder(k: int):
    """A shard's tree, and what the queries that lie in the shard find there."""

    def run(shard: pa.Table) -> pa.Table:
        ids = shard["vec_id"].to_numpy()
        vectors = [np.frombuffer(b, np.float64) for b in shard["v"].to_pylist()]
        tree = KDTree(ids, _padded(vectors, max(map(len, vectors))))
        number = shard["shard"][0].as_py()
        names, types = ("shard", "tree", "query", "query_id", "vec_id", "score"), (pa.int32(), pa.binary(), _LONG, _LONG, _LONG, _LONG)
        batches = [_arrow([(number, tree.packed(), None, None, None, None)], names, types)]
        own = {q: (i, v, None) for q, i, v in zip(shard["query"].to_pylist(), ids.tolist(), vectors, strict=True) if q is not None}
        queries = [(q, *rest) for q, rest in own.items()]
        for at in range(0, len(queries), BLOCK_QUERIES):
            hits = tree.answers(queries[at : at + BLOCK_QUERIES], k)
            batches.append(_arrow([(number, None, *h) for h in hits], names, types))
        return pa.Table.from_batches(batches)

    return run


def _searched(k: int):
    """Rows of (shard, tree) and of queries, by shard with the tree first: the hits of all queries in their shards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, at = None, None
        for batch in batches:
            for part in (batch.slice(i, BLOCK_QUERIES) for i in range(0, batch.num_rows, BLOCK_QUERIES)):
                shards, trees = part.column("shard").to_pylist(), part.column("tree")
                asked = list(zip(*(part.column(c).to_pylist() for c in ("query", "query_id", "v", "floor", "floor_id")), strict=True))
                edges = [i for i in range(len(shards)) if i == 0 or shards[i] != shards[i - 1] or trees[i].is_valid] + [len(shards)]
                for a, b in zip(edges, edges[1:], strict=False):
                    if trees[a].is_valid:
                        tree, at = KDTree.unpacked(trees[a].as_py()), shards[a]
                        a += 1
                    if a < b and at == shards[a]:  # queries of a shard without vectors find nothing
                        queries = [(q, i, np.frombuffer(v, np.float64), None if s is None else (s, -n)) for q, i, v, s, n in asked[a:b]]
                        yield _arrow(tree.answers(queries, k), ("query", "query_id", "vec_id", "score"), (_LONG,) * 4)

    return run


def top_k(vectors: DataFrame, k: int = K, every: int = 100, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose id is divisible by `every`, the k best other rows.

    Components become floor(1024 * x); the score is the whole-number inner product, ties go to the smaller vec_id.
    Rows with a null id, a null vector, or null or non-finite components take no part; shorter vectors end in zeros.
    Rows that share the query's id count as its own. Repeated candidates each take a rank; equal queries are asked
    once, and different vectors with one id are queries of their own. Fewer candidates than k: all of them; an empty
    table: no rows. Scores beyond the range of long raise an error. Further columns are not looked at.
    """
    with removed_after(vectors.sparkSession) as keep:
        return keep(written(_top_k(vectors, k, every, vec_id, embedding), "top-k"))


def _top_k(vectors: DataFrame, k: int, every: int, vec_id: str, embedding: str) -> DataFrame:
    spark = vectors.sparkSession
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("e"))
    rows = written(rows.mapInArrow(_whole(every), "vec_id long, v binary, query long"), "vectors", "none")
    n = rows.count()
    shards = 1 if n <= SMALL else max(math.ceil(n / SHARD_ROWS), min(spark.sparkContext.defaultParallelism, math.ceil(n / SMALL)))
    # repeated rows spread over the shards as well
    shard = F.pmod(F.xxhash64("vec_id", F.monotonically_increasing_id()), F.lit(shards)).cast("int").alias("shard")
    built = written(rows.select("vec_id", "v", "query", shard).groupBy("shard").applyInArrow(_builder(k), _BUILT), "trees", "none")
    hits = built.filter("tree is null").select("shard", "query", "query_id", "vec_id", "score")
    ranked = Window.partitionBy("query", "query_id").orderBy(F.col("score").desc(), "vec_id")
    # a query whose equals lie in several shards starts from one of them and is asked in the others again
    asked = rows.filter("query is not null").select("query", F.col("vec_id").alias("query_id"), "v").distinct()
    home = hits.groupBy("query", "query_id").agg(F.min("shard").alias("home"))
    first = hits.join(home, ["query", "query_id"]).filter("shard = home").select("query", "query_id", "vec_id", "score")
    if shards > 1:
        kth = first.withColumn("r", F.row_number().over(ranked)).filter(F.col("r") == k).select("query", "query_id", F.col("score").alias("floor"), F.col("vec_id").alias("floor_id"))
        others = asked.join(home, ["query", "query_id"], "left").join(kth, ["query", "query_id"], "left")
        others = others.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).filter("home is null or shard <> home")
        trees = built.filter("tree is not null").select("shard", "tree", *(F.lit(None).cast("long").alias(c) for c in ("query", "query_id")), F.lit(None).cast("binary").alias("v"), *(F.lit(None).cast("long").alias(c) for c in ("floor", "floor_id")))
        both = trees.union(others.select("shard", F.lit(None).cast("binary").alias("tree"), "query", "query_id", "v", "floor", "floor_id"))
        dealt = both.repartitionById(shards, "shard").sortWithinPartitions("shard", F.col("tree").isNull())
        first = first.union(dealt.mapInArrow(_searched(k), _HITS))
    ranks = first.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= k)
    return ranks.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
