"""Rank fusion. Lanes are one table (qid, lane_idx, chunk_id, score, rank); missing lanes simply have no rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import InvalidInput
from .lanes import overlap_at_k, ranked

RRF_K = 60
WEIGHTS = (1.0, 1.5)
#: A first score this near to 0 counts as 1.
TINY = 1.1920929e-07


def stacked(lanes: list[DataFrame]) -> DataFrame:
    """Lanes numbered in the order given."""
    named = [lane.select("qid", F.lit(i).alias("lane_idx"), "chunk_id", "score", "rank") for i, lane in enumerate(lanes)]
    return reduce(DataFrame.unionByName, named)


def cyclic_weight(weights: tuple[float, ...]) -> Column:
    """Weights repeat over the lanes; none are all 1."""
    if not weights:
        return F.lit(1.0)
    return F.element_at(F.array(*map(F.lit, map(float, weights))), (F.col("lane_idx") % len(weights) + 1).cast("int"))


def lane_columns() -> list[Column]:
    """The score and rank that lanes 0 (bm25) and 1 (vector) gave a chunk, from the aggregation that fuses them."""
    return [F.max(F.when(F.col("lane_idx") == i, F.col(c))).alias(f"{name}_{c}") for i, name in enumerate(("bm25", "vector")) for c in ("score", "rank")]


def rrf(lanes: DataFrame, k: int = 10, rrf_k: int = RRF_K, weights: tuple[float, ...] = WEIGHTS, weight: Column | None = None, given: bool = False) -> DataFrame:
    """Sum of weight / (rrf_k + rank) over the lanes that have the chunk; with `given`, what `lane_columns` tells."""
    share = (cyclic_weight(weights) if weight is None else weight) / (rrf_k + F.col("rank"))
    return ranked(lanes.groupBy("qid", "chunk_id").agg(F.sum(share).alias("score"), *(lane_columns() if given else ())), k)


def weighted(lanes: DataFrame, k: int = 10, weights: tuple[float, ...] = WEIGHTS, given: bool = False) -> DataFrame:
    """Scores divided by their lane's first one, weighted by lane; lanes beyond the weights count 1."""
    top = lanes.filter("rank = 1").select("qid", "lane_idx", F.when(F.abs("score") < TINY, 1.0).otherwise(F.col("score")).alias("top"))
    w = reduce(lambda c, iw: c.when(F.col("lane_idx") == iw[0], float(iw[1])), enumerate(weights[1:], 1), F.when(F.col("lane_idx") == 0, float(weights[0]))) if weights else F.lit(1.0)
    part = (F.coalesce(w, F.lit(1.0)) if weights else w) * F.col("score") / F.col("top")
    return ranked(lanes.join(top, ["qid", "lane_idx"]).groupBy("qid", "chunk_id").agg(F.sum(part).alias("score"), *(lane_columns() if given else ())), k)


def overlap_signal(lanes: DataFrame, top_k: int) -> DataFrame:
    """(qid, signal): what lanes 0 and 1 share of their first top_k; queries without two lanes have none."""
    if top_k <= 0:
        raise InvalidInput("the overlap of no results is undefined")
    both = lanes.groupBy("qid").agg(F.countDistinct("lane_idx").alias("n")).filter("n > 1").select("qid")
    shared = overlap_at_k(lanes.filter("lane_idx = 0"), lanes.filter("lane_idx = 1"), top_k)
    return shared.join(both, "qid", "left_semi").withColumnRenamed("overlap", "signal")


def coverage_signal(hits: DataFrame) -> DataFrame:
    """(qid, signal): the share of a query's distinct terms that the index has; 0 without terms."""
    return hits.select("qid", F.when(F.col("n_terms") > 0, F.col("n_hit") / F.col("n_terms")).otherwise(0.0).alias("signal"))


def shape_signal(queries: DataFrame) -> DataFrame:
    """(qid, signal): 1 if the query has an ASCII letter or digit."""
    return queries.select("qid", F.col("query").rlike("[A-Za-z0-9]").cast("double").alias("signal"))


def adaptive_rrf(lanes: DataFrame, signal: DataFrame, theta: float, k: int = 10, rrf_k: int = RRF_K, weights: tuple[float, ...] = WEIGHTS, given: bool = False) -> DataFrame:
    """RRF in which lane 0 counts nothing where the signal is below theta; what only it found stays, with score 0."""
    weight = F.when((F.col("lane_idx") == 0) & (F.col("signal") < theta), 0.0).otherwise(cyclic_weight(weights))
    return rrf(lanes.join(signal, "qid", "left"), k, rrf_k, weight=weight, given=given)


def multi_query(lanes: DataFrame, groups: DataFrame, k: int = 10, rrf_k: int = RRF_K, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """One result for each group of queries: groups (qid, gid, position). Lanes are numbered 2 * position + lane, so
    that weights go on by kind of lane."""
    every = lanes.join(groups, "qid").select(F.col("gid").alias("qid"), (2 * F.col("position") + F.col("lane_idx")).alias("lane_idx"), "chunk_id", "score", "rank")
    return rrf(every, k, rrf_k, weights)


def best_ranks(lanes: DataFrame, groups: DataFrame) -> DataFrame:
    """(gid, lane, chunk_id, rank, score): the best rank over a group's queries, and the best score at that rank."""
    every = lanes.join(groups, "qid").withColumn("lane", F.when(F.col("lane_idx") % 2 == 0, "bm25").otherwise("vector"))
    best = F.min(F.struct("rank", (-F.col("score")).alias("negative"))).alias("best")
    found = every.groupBy("gid", "lane", "chunk_id").agg(best)
    return found.select("gid", "lane", "chunk_id", F.col("best.rank").alias("rank"), (-F.col("best.negative")).alias("score"))
