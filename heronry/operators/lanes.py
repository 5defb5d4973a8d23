"""Recall lanes: BM25 over postings and vector search, for a table of queries at a time.

Every lane gives (qid, chunk_id, score, rank), best first, ties by chunk_id. Sums come in another order in every run,
so that ranks go by the score rounded to RANK_DIGITS digits.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..errors import DimensionMismatch, GraphStale, InvalidInput, SnapshotCorrupted
from ..functions.text import Analyzer, StandardAnalyzer
from ..functions.vectors import normalize

K1, B = 1.5, 0.75
RANK_DIGITS = 9
#: With a filter that leaves no more chunks than this, vectors are searched exactly.
EXACT_BELOW = 8_192
#: Vectors and queries of one block of the exact search.
VECTOR_BLOCK, QUERY_BLOCK = 8_192, 1_024
#: The recall at 10 that an approximate index reads as many lists for as its sample needs.
RECALL = 0.95


def ranked(scored: DataFrame, k: int | None, by: tuple[str, ...] = ("qid",), score: str = "score") -> DataFrame:
    """Ranks from 1 within each group, and the first k; Spark cuts each partition to k before it shuffles."""
    order = Window.partitionBy(*by).orderBy(F.round(score, RANK_DIGITS).desc(), "chunk_id")
    out = scored.withColumn("rank", F.row_number().over(order))
    return out if k is None else out.filter(F.col("rank") <= k)


def query_terms(queries: DataFrame, analyzer: Analyzer | None = None) -> DataFrame:
    """(qid, term, qtf): a term that a query repeats counts each time."""
    found = queries.select("qid", F.explode((analyzer or StandardAnalyzer()).query(F.col("query"))).alias("term"))
    return found.groupBy("qid", "term").agg(F.count("*").alias("qtf"))


def idf(n: Column, df: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def term_weight(tf: Column, dl: Column, avgdl: Column, k1: float | Column = K1, b: float | Column = B) -> Column:
    one = F.lit(1.0)
    k1, b = (F.lit(x) if isinstance(x, float | int) else x for x in (k1, b))
    return tf * (k1 + 1) / (tf + k1 * (one - b + b * dl / avgdl))


def matched(terms: DataFrame, posted: DataFrame, lengths: DataFrame, candidates: DataFrame | None = None) -> DataFrame:
    """(qid, chunk_id, term, qtf, tf, dl, df, n, avgdl): the postings that queries hit, with their statistics.

    n, df and avgdl are those of all chunks; `candidates` (chunk_id) only cuts what can be found. Postings are first
    reduced to the terms asked for, so that the joins after that see hits alone; the side with the queries is
    broadcast when its size at run time allows.
    """
    asked = terms.select("term").distinct()
    hits = posted.join(asked, "term", "left_semi")
    df = hits.groupBy("term").agg(F.count("*").alias("df"))
    stats = lengths.agg(F.count("*").alias("n"), (F.sum("dl") / F.count("*")).alias("avgdl"))
    found = hits if candidates is None else hits.join(candidates.select("chunk_id"), "chunk_id", "left_semi")
    # the statistics are a single row
    return found.join(terms.join(df, "term"), "term").join(lengths, "chunk_id").crossJoin(F.broadcast(stats))


def bm25(
    queries: DataFrame, posted: DataFrame, lengths: DataFrame, k: int | None = 10, candidates: DataFrame | None = None,
    analyzer: Analyzer | None = None, k1: float = K1, b: float = B,
) -> DataFrame:
    """Any term may match. Queries without terms, and k = 0, find nothing."""
    if k is not None and k < 0:
        raise InvalidInput("k is negative")
    hits = matched(query_terms(queries, analyzer), posted, lengths, candidates)
    part = F.col("qtf") * idf(F.col("n"), F.col("df")) * term_weight(F.col("tf"), F.col("dl"), F.col("avgdl"), k1, b)
    return ranked(hits.groupBy("qid", "chunk_id").agg(F.sum(part).alias("score")), k)


def term_hits(queries: DataFrame, posted: DataFrame, analyzer: Analyzer | None = None) -> DataFrame:
    """(qid, n_terms, n_hit, any_hit) of every query: how many of its distinct terms the index has."""
    known = query_terms(queries, analyzer).join(posted.select("term").distinct().withColumn("hit", F.lit(1)), "term", "left")
    counts = known.groupBy("qid").agg(F.count("*").alias("n_terms"), F.count("hit").alias("n_hit"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return queries.select("qid").join(counts, "qid", "left").select("qid", zero("n_terms"), zero("n_hit"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("any_hit"))


def _packed(rows: DataFrame, ident: str, vector: str, size: int) -> DataFrame:
    """Rows as blocks of at most `size`: (ids, values, dim), so that a pair of blocks is one matrix product."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                part = batch.slice(at, size)
                dims = set(pa.compute.list_value_length(part.column(1)).to_pylist())
                if len(dims) > 1:
                    raise InvalidInput(f"vectors of several lengths: {sorted(dims)}")
                values = part.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
                row = [pa.array([part.column(0).to_pylist()], pa.list_(part.schema.field(0).type)), pa.array([values.tobytes()], pa.binary()), pa.array([dims.pop()], pa.int32())]
                yield pa.RecordBatch.from_arrays(row, ["ids", "data", "dim"])

    kind = dict(rows.dtypes)[ident]
    unit = rows.filter(F.col(vector).isNotNull()).select(F.col(ident), normalize(F.col(vector)).alias("v"))
    return unit.mapInArrow(pack, f"ids array<{kind}>, data binary, dim int")


def exact_vectors(queries: DataFrame, vectors: DataFrame, k: int, candidates: DataFrame | None = None) -> DataFrame:
    """The k nearest by cosine: queries (qid, qvec) against vectors (chunk_id, vector).

    Blocks of queries meet blocks of vectors and each pair gives the best k of every query, so what is shuffled is k
    rows per query and block. A null query vector finds nothing.
    """
    if k < 0:
        raise InvalidInput("k is negative")
    rows = vectors if candidates is None else vectors.join(candidates.select("chunk_id"), "chunk_id", "left_semi")
    kind = dict(queries.dtypes)["qid"]
    asked = _packed(queries.select("qid", "qvec"), "qid", "qvec", QUERY_BLOCK).select(F.col("ids").alias("qids"), F.col("data").alias("qdata"), F.col("dim").alias("qdim"))
    held = _packed(rows.select(F.col("chunk_id").cast("long").alias("chunk_id"), "vector"), "chunk_id", "vector", VECTOR_BLOCK)

    pairs = held.crossJoin(asked)
    return ranked(pairs.mapInArrow(_multiplied(k), f"qid {kind}, chunk_id long, score double"), k)


def _multiplied(k: int):
    """Pairs of a block of vectors and a block of queries: the best k of each query."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                pair = batch.slice(row, 1).to_pylist()[0]
                if pair["dim"] != (asked := pair.get("qdim", pair["dim"])):
                    raise InvalidInput(f"queries have {asked} dimensions, vectors {pair['dim']}")
                q, v = (np.frombuffer(pair[c], np.float64).reshape(-1, pair["dim"]) for c in ("qdata", "data"))
                ids = np.array(pair["ids"])
                scores = q @ v.T
                top = np.stack([np.lexsort((ids, -np.round(s, RANK_DIGITS)))[:k] for s in scores])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(np.array(pair["qids"], object), top.shape[1])), pa.array(ids[top].ravel()), pa.array(np.take_along_axis(scores, top, 1).ravel())],
                    ["qid", "chunk_id", "score"],
                )

    return search


def route(filtered: bool, allowed: int, exact_below: int = EXACT_BELOW) -> str:
    """exact or ann: a filter that leaves few chunks is searched exactly."""
    return "exact" if filtered and allowed <= exact_below else "ann"


def overall_route(routes: list[str]) -> str:
    """Of several segments: none, exact, ann or mixed."""
    kinds = set(routes)
    return "none" if not kinds else kinds.pop() if len(kinds) == 1 else "mixed"


class IvfIndex:
    """Approximate search: vectors lie in lists by their nearest centroid, and of each query only the `probes` nearest
    lists are read, block against block, as matrix products.

    Centroids are fitted on a bounded sample (`sample` rows of the smallest hashes), every row is indexed. How many lists
    a query reads is measured on that sample: as many as it takes for a recall of `recall` at 10 among its own rows.
    Clustered vectors need a few lists, vectors without clusters most of them.
    """

    def __init__(self, vectors: DataFrame, lists: int | None = None, sample: int = 20_000, rounds: int = 8, recall: float = RECALL) -> None:
        unit = vectors.filter("vector is not null").select(F.col("chunk_id").cast("long").alias("chunk_id"), normalize(F.col("vector")).alias("vector"))
        rows = unit.orderBy(F.xxhash64("chunk_id"), "chunk_id").limit(sample).select("vector").collect()
        if not rows:
            raise InvalidInput("no vectors to index")
        if len({len(r[0]) for r in rows}) > 1:
            raise InvalidInput("vectors of several lengths")
        x = np.array([r[0] for r in rows])
        lists = min(len(x), lists or max(1, math.isqrt(len(x))))
        self.centroids = x[:lists].copy()
        for _ in range(rounds):
            own = (x @ self.centroids.T).argmax(1)
            for i in range(lists):
                if (mine := x[own == i]).size:
                    mean = mine.mean(0)
                    self.centroids[i] = mean / max(float(np.linalg.norm(mean)), 1e-12)
        self.probes = self._measured(x, recall)
        self.rows = self._assign(unit, "chunk_id", "vector", 1)

    def _measured(self, x: np.ndarray, recall: float, asked: int = 256, k: int = 10) -> int:
        """The least number of lists with that recall, for rows of the sample as queries."""
        own = (x @ self.centroids.T).argmax(1)
        queries = x[:asked]
        scores = queries @ x.T
        scores[np.arange(len(queries)), np.arange(len(queries))] = -np.inf  # a query does not find itself
        best = np.argsort(-scores, axis=1, kind="stable")[:, : min(k, len(x) - 1)]
        if not best.size:
            return len(self.centroids)
        place = np.argsort(np.argsort(-(queries @ self.centroids.T), axis=1, kind="stable"), axis=1)
        needed = np.sort(np.take_along_axis(place, own[best], 1).ravel())
        return int(needed[min(len(needed) - 1, math.ceil(recall * len(needed)) - 1)]) + 1

    def _check(self) -> tuple[int, int, str]:
        """Dimension, number of rows and a checksum over them."""
        total = self.rows.agg(F.count("*"), F.sum(F.xxhash64("chunk_id", "vector", "list").cast("decimal(38,0)"))).first()
        return self.centroids.shape[1], total[0], str(total[1])

    def save(self, path: str, generation: int) -> None:
        """As a table of a snapshot's generation: a cache that can be made again."""
        spark = self.rows.sparkSession
        self.rows.write.parquet(f"{path}/rows")
        dim, n, checksum = self._check()
        found = [(i, generation, self.probes, dim, n, checksum, c.tolist()) for i, c in enumerate(self.centroids)]
        spark.createDataFrame(found, "list int, generation long, probes int, dim int, n long, checksum string, centroid array<double>").coalesce(1).write.parquet(f"{path}/centroids")

    @classmethod
    def load(cls, spark: SparkSession, path: str, generation: int, dim: int | None = None) -> IvfIndex:
        """Raises GraphStale if it belongs to another generation or has another dimension, SnapshotCorrupted if its rows
        are not those that were saved."""
        found = spark.read.parquet(f"{path}/centroids").orderBy("list").collect()  # at most the square root of the sample
        if {r.generation for r in found} != {generation}:
            raise GraphStale(f"{path} is not of generation {generation}")
        if dim is not None and {r.dim for r in found} != {dim}:
            raise GraphStale(f"{path} has vectors of {found[0].dim} dimensions, not {dim}")
        made = cls.__new__(cls)
        made.centroids, made.probes, made.rows = np.array([r.centroid for r in found]), found[0].probes, spark.read.parquet(f"{path}/rows")
        if made._check() != (found[0].dim, found[0].n, found[0].checksum):
            raise SnapshotCorrupted(f"{path} does not have the rows that were saved")
        return made

    def _assign(self, rows: DataFrame, ident: str, vector: str, n: int) -> DataFrame:
        centroids = self.centroids

        def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                x = batch.column(1).flatten().to_numpy(zero_copy_only=False)
                if len(x) != batch.num_rows * centroids.shape[1]:
                    raise DimensionMismatch(f"the index has {centroids.shape[1]} dimensions")
                near = np.argsort(-(x.reshape(batch.num_rows, -1) @ centroids.T), axis=1, kind="stable")[:, :n].astype(np.int32)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(near), pa.list_(pa.int32()))], [ident, vector, "lists"])

        kind = dict(rows.dtypes)
        found = rows.mapInArrow(nearest, f"{ident} {kind[ident]}, {vector} array<double>, lists array<int>")
        return found.select(ident, vector, F.explode("lists").alias("list"))

    def search(self, queries: DataFrame, k: int, probes: int | None = None, candidates: DataFrame | None = None) -> DataFrame:
        """(qid, chunk_id, score, rank) of the k nearest in each query's `probes` nearest lists (as measured, if none are
        given). Lists larger than VECTOR_BLOCK are cut, so that a crowded one is the work of many tasks."""
        asked = queries.filter("qvec is not null").select("qid", normalize(F.col("qvec")).alias("qvec"))
        rows = self.rows if candidates is None else self.rows.join(candidates.select("chunk_id"), "chunk_id", "left_semi")
        placed = self._assign(asked, "qid", "qvec", min(probes or self.probes, len(self.centroids)))
        kind = dict(queries.dtypes)["qid"]
        held, wanted = _blocked(rows, "chunk_id", "vector", "long", VECTOR_BLOCK), _blocked(placed, "qid", "qvec", kind, QUERY_BLOCK)
        wanted = wanted.select("list", F.col("ids").alias("qids"), F.col("data").alias("qdata"))
        pairs = held.join(wanted, "list").select("ids", "data", "qids", "qdata", F.lit(self.centroids.shape[1]).alias("dim"))
        return ranked(pairs.mapInArrow(_multiplied(k), f"qid {kind}, chunk_id long, score double"), k)


def _blocked(rows: DataFrame, ident: str, vector: str, kind: str, size: int) -> DataFrame:
    """(list, ids, data): the rows of each list in blocks of about `size`."""
    counts = rows.groupBy("list").agg(F.ceil(F.count("*") / size).cast("int").alias("blocks"))
    dealt = rows.join(F.broadcast(counts), "list").withColumn("block", F.pmod(F.xxhash64(ident), F.col("blocks")))  # a row per list

    def pack(table: pa.Table) -> pa.Table:
        values = np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in table[vector].chunks])
        ids = pa.array([table[ident].to_pylist()], pa.list_(table.schema.field(ident).type))
        return pa.table({"list": pa.array(table["list"][:1].to_pylist(), pa.int32()), "ids": ids, "data": pa.array([values.tobytes()], pa.binary())})

    return dealt.groupBy("list", "block").applyInArrow(pack, f"list int, ids array<{kind}>, data binary")


def overlap_at_k(a: DataFrame, b: DataFrame, k: int) -> DataFrame:
    """(qid, overlap): the share of k that two lanes have in common; queries of either lane, 0 for none."""
    first, second = (lane.filter(F.col("rank") <= k).select("qid", "chunk_id") for lane in (a, b))
    both = first.join(second, ["qid", "chunk_id"], "left_semi").groupBy("qid").agg((F.count("*") / F.lit(k)).alias("overlap"))
    every = first.select("qid").union(second.select("qid")).distinct()
    return every.join(both, "qid", "left").select("qid", F.coalesce("overlap", F.lit(0.0)).alias("overlap"))
