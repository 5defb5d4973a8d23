"""Search over a table of queries: recall, fusion, post-processing, rerank and explanation as one plan."""

from __future__ import annotations

from dataclasses import dataclass
from enum import StrEnum
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import InvalidInput, NoEmbedder
from ..functions.filters import Filter, parse
from ..operators import explain, fusion, lanes, post
from .index import Index


class Mode(StrEnum):
    BM25 = "bm25"
    VECTOR = "vector"
    HYBRID = "hybrid"

    @classmethod
    def parse(cls, name: str) -> Mode:
        found = {"keyword": cls.BM25, "lexical": cls.BM25, "semantic": cls.VECTOR, "embedding": cls.VECTOR, "fusion": cls.HYBRID}.get(name.strip().lower())
        try:
            return found or cls(name.strip().lower())
        except ValueError as e:
            raise InvalidInput(f"no search mode: {name}") from e


@dataclass(frozen=True)
class Adaptive:
    """Which signal turns the lexical lane off, and below what value."""

    signal: str = "overlap"
    theta: float = 0.5
    top_k: int = 10


def candidate_budget(k: int, rerank_window: int = 0, post_window: int = 0) -> int:
    """How many candidates a lane gives."""
    return max(3 * k, rerank_window, post_window, 10)


def take_n(k: int, fused: int, rerank_window: int = 0, post_window: int = 0) -> int:
    """How many fused candidates get their text."""
    return 0 if k == 0 else min(max(k, rerank_window, post_window), fused)


class Search:
    """A search under construction: `Searcher.search(queries).mode("hybrid").top_n(5).filter("lang=en").exec()`."""

    def __init__(self, searcher: Searcher, queries: DataFrame) -> None:
        self.searcher, self.queries = searcher, queries
        self._mode: Mode | None = None
        self._k, self._where, self._groups = 10, None, None

    def mode(self, mode: str | Mode) -> Search:
        self._mode = mode if isinstance(mode, Mode) else Mode.parse(mode)
        return self

    def top_n(self, k: int) -> Search:
        if k < 0:
            raise InvalidInput("k is negative")
        self._k = k
        return self

    def filter(self, where: Filter | str | list[str]) -> Search:
        self._where = parse(where) if isinstance(where, str | list) else where
        return self

    def fused(self, groups: DataFrame) -> Search:
        """All queries of a group (qid, gid, position) give one result."""
        self._groups = groups
        return self

    def exec(self) -> DataFrame:
        return self.searcher.execute(self.queries, self._mode, self._k, self._where, self._groups)


class Searcher:
    """Runs tables of queries (qid, query, and qvec: array of numbers for vector search) against an index.

    All queries go through one plan. Texts and metadata are fetched for the final candidates only, and terms are
    matched for the final hits only.
    """

    def __init__(
        self, index: Index, *, weights: tuple[float, ...] = fusion.WEIGHTS, rrf_k: int = fusion.RRF_K, normalized: bool = False, adaptive: Adaptive | None = None,
        post: post.PostProcessor | None = None, reranker: post.Reranker | None = None, k1: float = lanes.K1, b: float = lanes.B, ann: lanes.IvfIndex | None = None,
        columns: dict[str, Column] | None = None, hit_columns: dict[str, Column] | None = None,
    ) -> None:
        self.index, self.weights, self.rrf_k, self.normalized, self.adaptive = index, weights, rrf_k, normalized, adaptive
        self.post, self.reranker, self.k1, self.b, self.ann, self.columns = post, reranker, k1, b, ann, columns
        self.hit_columns = hit_columns or {}

    def search(self, queries: DataFrame) -> Search:
        return Search(self, queries)

    def windows(self) -> tuple[int, int]:
        return (self.reranker.window if self.reranker else 0), 0

    def lanes(self, queries: DataFrame, mode: Mode, candidate_k: int, where: Filter | None = None) -> tuple[DataFrame | None, DataFrame | None]:
        """The lexical and the vector lane, where the mode has them."""
        index, allowed = self.index, self.index.candidates(where, self.columns)
        lexical = vector = None
        if mode != Mode.VECTOR:
            lexical = lanes.bm25(queries, index.postings, index.lengths, candidate_k, allowed, index.config.analyzer, self.k1, self.b)
        if mode != Mode.BM25:
            if index.vectors is None or "qvec" not in queries.columns:
                raise NoEmbedder("vector search takes an index with vectors and queries with qvec")
            asked = queries.filter(F.trim(F.coalesce("query", F.lit(""))) != "")
            if self.ann is not None and self.route(where, allowed) == "ann":
                vector = self.ann.search(asked, candidate_k, candidates=allowed)
            else:
                vector = lanes.exact_vectors(asked, index.vectors, candidate_k, allowed)
        return lexical, vector

    def route(self, where: Filter | None, allowed: DataFrame | None = None) -> str:
        """How vectors are searched; without an approximate index, exactly."""
        if self.ann is None:
            return "exact"
        if where is None:
            return "ann"
        allowed = self.index.candidates(where, self.columns) if allowed is None else allowed
        return lanes.route(True, allowed.limit(lanes.EXACT_BELOW + 1).count())

    def _fused(self, queries: DataFrame, lexical: DataFrame | None, vector: DataFrame | None, groups: DataFrame | None, n: int) -> DataFrame:
        """The fused hits, with what each lane gave them unless queries are grouped; every lane is read once."""
        found = [lane for lane in (lexical, vector) if lane is not None]
        if groups is None and len(found) == 1:
            return explain.of_one_lane(found[0].filter(F.col("rank") <= n), lexical is not None)  # it keeps its scores
        named = [(i, lane) for i, lane in enumerate((lexical, vector)) if lane is not None]
        every = reduce(DataFrame.unionByName, (lane.select("qid", F.lit(i).alias("lane_idx"), "chunk_id", "score", "rank") for i, lane in named))
        if groups is not None:
            return fusion.multi_query(every, groups, n, self.rrf_k, self.weights)
        if self.adaptive:
            return fusion.adaptive_rrf(every, self.signal(queries, every), self.adaptive.theta, n, self.rrf_k, self.weights, given=True)
        if self.normalized:
            return fusion.weighted(every, n, self.weights, given=True)
        return fusion.rrf(every, n, self.rrf_k, self.weights, given=True)

    def signal(self, queries: DataFrame, every: DataFrame) -> DataFrame:
        match self.adaptive.signal:
            case "overlap":
                return fusion.overlap_signal(every, self.adaptive.top_k)
            case "coverage":
                return fusion.coverage_signal(lanes.term_hits(queries, self.index.postings, self.index.config.analyzer))
            case "shape":
                return fusion.shape_signal(queries)
        raise InvalidInput(f"no signal: {self.adaptive.signal}")

    def execute(self, queries: DataFrame, mode: Mode | None = None, k: int = 10, where: Filter | None = None, groups: DataFrame | None = None) -> DataFrame:
        """(qid, rank, chunk_id, doc_id, source, text, metadata, score, matched_terms, bm25_*, vector_*, fused_score,
        and what the post-processor adds). With groups, qid is the group."""
        mode = mode or (Mode.HYBRID if self.index.vectors is not None and "qvec" in queries.columns else Mode.BM25)
        if groups is not None and self.adaptive and mode == Mode.HYBRID:
            raise InvalidInput("adaptive fusion takes one query at a time")
        rerank_window = self.reranker.window if self.reranker else 0
        post_window = self.post.candidate_window(k) if self.post else 0
        budget = candidate_budget(k, rerank_window, post_window)
        n = 0 if k == 0 else max(k, rerank_window, post_window)
        lexical, vector = self.lanes(queries, mode, budget, where)
        hits = self._fused(queries, lexical, vector, groups, n)
        hits = hits.withColumn("fused_score", F.col("score"))
        if groups is None:
            asked = queries.select("qid", "query")
        else:
            asked = groups.join(queries, "qid").groupBy("gid").agg(F.array_join(F.array_sort(F.collect_list(F.struct("position", "query")))["query"], " ").alias("query")).withColumnRenamed("gid", "qid")
        found = hits.join(self.index.chunks.select("chunk_id", "doc_id", "text"), "chunk_id").join(self.index.docs.select("doc_id", "source", "metadata"), "doc_id")
        for name, column in self.hit_columns.items():
            found = found.withColumn(name, column)
        if self.post:
            extra = [c for c in found.columns if c not in ("score", "rank")]
            done = self.post.process(found, n)
            added = [c for c in done.columns if c not in extra or c in ("qid", "chunk_id")]
            found = done.select(*added).join(found.select(*extra), ["qid", "chunk_id"]) if set(extra) - set(done.columns) else done
        found = found.join(asked, "qid")
        found = post.rerank(found, self.reranker.logits(found) if self.reranker else None, k)
        return found.withColumn("matched_terms", explain.matched_terms(F.col("query"), F.col("text"), self.index.config.analyzer)).drop("query")

    def compare(self, queries: DataFrame, k: int = 10, where: Filter | None = None) -> DataFrame:
        """(mode, qid, chunk_id, score, rank) of the same queries in all three modes."""
        lexical, vector = self.lanes(queries, Mode.HYBRID, candidate_budget(k), where)
        runs = {"bm25": (lexical, None), "vector": (None, vector), "hybrid": (lexical, vector)}
        parts = [self._fused(queries, *pair, None, k).select(F.lit(name).alias("mode"), "qid", "chunk_id", "score", "rank") for name, pair in runs.items()]
        return reduce(DataFrame.unionByName, parts)

    def metrics(self, queries: DataFrame, mode: Mode, k: int = 10, where: Filter | None = None) -> DataFrame:
        """(qid, n_bm25, n_vector, n_fused, allowed, shortfall): how many candidates each stage had."""
        lexical, vector = self.lanes(queries, mode, candidate_budget(k), where)
        out = queries.select("qid")
        every = []
        for name, lane in (("n_bm25", lexical), ("n_vector", vector)):
            counts = None if lane is None else lane.groupBy("qid").agg(F.count("*").alias(name))
            out = out.withColumn(name, F.lit(0).cast("long")) if counts is None else out.join(counts, "qid", "left").fillna(0, [name])
            every += [] if lane is None else [lane.select("qid", "chunk_id")]
        fused = reduce(DataFrame.union, every).distinct().groupBy("qid").agg(F.count("*").alias("n_fused"))
        live = self.index.candidates(where, self.columns)
        allowed = (self.index.chunks if live is None else live).agg(F.count("*").alias("allowed"))
        want = F.least(F.lit(candidate_budget(k)), F.col("allowed"))
        lengths = [F.col(c) for c, lane in (("n_bm25", lexical), ("n_vector", vector)) if lane is not None]
        short = F.greatest(F.lit(0), want - (F.least(*lengths) if len(lengths) > 1 else lengths[0]))
        return out.join(fused, "qid", "left").fillna(0, ["n_fused"]).crossJoin(F.broadcast(allowed)).withColumn("shortfall", short)

    def empty_reasons(self, queries: DataFrame, mode: Mode = Mode.BM25, k: int = 10, where: Filter | None = None) -> DataFrame:
        """(qid, n_hits, reason) of every query; reason is null where hits are left."""
        final = self.execute(queries, mode, k, where).groupBy("qid").agg(F.count("*").alias("n_final"))
        lexical, vector = self.lanes(queries, mode, candidate_budget(k), where)
        found = reduce(DataFrame.union, [x.select("qid") for x in (lexical, vector) if x is not None]).groupBy("qid").agg(F.count("*").alias("n_lane"))
        probe = lanes.term_hits(queries, self.index.postings, self.index.config.analyzer)
        live = self.index.candidates(where, self.columns)
        sizes = self.index.chunks.agg(F.count("*").alias("n_docs")).crossJoin(F.broadcast((self.index.chunks if live is None else live).agg(F.count("*").alias("n_allowed"))))
        rows = probe.join(final, "qid", "left").join(found, "qid", "left").fillna(0, ["n_final", "n_lane"]).crossJoin(F.broadcast(sizes))
        reason = explain.empty_reason(F.col("n_docs"), F.col("n_terms"), F.col("any_hit"), F.lit(where is not None), F.col("n_allowed"), F.col("n_lane"), F.col("n_final"))
        if k == 0:
            reason = F.when(F.col("n_lane") == 0, reason)
        return rows.select("qid", F.col("n_final").alias("n_hits"), reason.alias("reason"))
