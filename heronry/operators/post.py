"""What happens to fused hits (qid, chunk_id, score, rank, ...): decay, budget, diversity, rerank."""

from __future__ import annotations

import math
from collections.abc import Callable
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import InvalidInput, RerankError
from ..functions.text import jaccard
from .lanes import RANK_DIGITS, ranked

RERANK_WINDOW = 20
MMR_POOL = 50


class PostProcessor(Protocol):
    """Takes the hits of a window and gives those that stay, ranked anew."""

    def candidate_window(self, k: int) -> int: ...

    def process(self, hits: DataFrame, k: int) -> DataFrame: ...


class TimeDecay:
    """score * exp(-rate * age in seconds); ages below 0 count as 0, a rate may be negative.

    `timestamp` (milliseconds) must be there for every hit; a hit without it fails the query. Where no age is above
    0 the order stays as it was, which ranking by score gives as well.
    """

    def __init__(self, rate: float, now_ms: int, timestamp: str = "ts_ms") -> None:
        if not math.isfinite(rate):
            raise InvalidInput("the decay rate is not a finite number")
        self.rate, self.now_ms, self.timestamp = rate, now_ms, timestamp

    def candidate_window(self, k: int) -> int:
        return k

    def process(self, hits: DataFrame, k: int | None) -> DataFrame:
        stamp = F.col(self.timestamp)
        there = F.when(stamp.isNull(), F.raise_error(F.lit(f"a hit has no {self.timestamp}")).cast("long")).otherwise(stamp)
        factor = F.exp(-self.rate * F.greatest(F.lit(0), self.now_ms - there) / 1000)
        aged = hits.drop("rank").withColumn("decay_factor", F.when(factor != 1, factor)).withColumn("score", F.col("score") * factor)
        return ranked(aged, k)


class TokenBudget:
    """Hits in order up to the first that would exceed the budget, and k at most; an exact fit is in."""

    def __init__(self, budget: int, units: Column | None = None) -> None:
        self.budget, self.units = budget, F.length("text") if units is None else units

    def candidate_window(self, k: int) -> int:
        return k

    def process(self, hits: DataFrame, k: int | None) -> DataFrame:
        sofar = Window.partitionBy("qid").orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        spent = hits.withColumn("budget_units", self.units.cast("long")).withColumn("spent", F.sum("budget_units").over(sofar))
        kept = spent.filter(F.col("spent") <= self.budget)
        return kept if k is None else kept.filter(F.col("rank") <= k)


class Mmr:
    """Maximal marginal relevance: again and again the hit with the highest
    lambda * score - (1 - lambda) * (largest similarity to what is selected), ties by chunk_id.

    The similarities of a window are Jaccard of the hits' `terms`, or cosines of their `vector`, clamped to 0 and 1
    (nan counts as 0). Only a window of `pool` hits (or k, if that is more) is looked at, so a query's group is small.
    """

    def __init__(self, balance: float = 0.5, pool: int = MMR_POOL, by: str = "terms") -> None:
        if not 0 <= balance <= 1:
            raise InvalidInput("lambda is from 0 to 1")
        if by not in ("terms", "vector"):
            raise InvalidInput("similarity is by terms or by vector")
        self.balance, self.pool, self.by = balance, pool, by

    def candidate_window(self, k: int) -> int:
        return max(self.pool, k)

    def process(self, hits: DataFrame, k: int) -> DataFrame:
        balance, by, digits = self.balance, self.by, RANK_DIGITS

        def similarity(values: list) -> np.ndarray:
            if by == "vector":
                x = np.array(values, float)
                unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
                return np.clip(np.nan_to_num(unit @ unit.T), 0, 1)
            sets = [frozenset(v) for v in values]
            return np.array([[len(a & b) / len(a | b) if a and b else 0.0 for b in sets] for a in sets])

        def select(group: pd.DataFrame) -> pd.DataFrame:
            group = group.sort_values("chunk_id", ignore_index=True)
            sims, relevance = similarity(group[by].tolist()), group["score"].to_numpy(float)
            near, free, order = np.zeros(len(group)), np.ones(len(group), bool), []
            while len(order) < min(k, len(group)):
                gain = np.where(free, np.round(balance * relevance - (1 - balance) * near, digits), -np.inf)
                at = int(gain.argmax())
                order.append(at)
                free[at] = False
                near = np.maximum(near, sims[at])
            out = group.loc[order, ["qid", "chunk_id", "score"]]
            return out.assign(rank=np.arange(1, len(out) + 1), mmr_selected=True)

        window = hits.filter(F.col("rank") <= self.candidate_window(k)).select("qid", "chunk_id", "score", by)
        kind = dict(hits.dtypes)["qid"]
        return window.groupBy("qid").applyInPandas(select, f"qid {kind}, chunk_id long, score double, rank int, mmr_selected boolean")


def pair_similarities(hits: DataFrame) -> DataFrame:
    """(qid, a, b, jaccard) of all pairs of a query's hits with `terms`; for small windows."""
    left = hits.select("qid", F.col("chunk_id").alias("a"), F.col("terms").alias("ta"))
    right = hits.select("qid", F.col("chunk_id").alias("b"), F.col("terms").alias("tb"))
    return left.join(right, "qid").filter("a < b").select("qid", "a", "b", jaccard(F.col("ta"), F.col("tb")).alias("jaccard"))


class Reranker(Protocol):
    """Gives logits (qid, chunk_id, logit) for the hits of its window."""

    window: int

    def logits(self, hits: DataFrame) -> DataFrame: ...


class NoRerank:
    window = 0

    def logits(self, hits: DataFrame) -> None:
        return None


class FunctionReranker:
    """A scorer of (query, text) columns, as a column expression or a vectorized function."""

    def __init__(self, logit: Callable[[Column, Column], Column], window: int = RERANK_WINDOW) -> None:
        self.logit, self.window = logit, window

    def logits(self, hits: DataFrame) -> DataFrame:
        return hits.filter(F.col("rank") <= self.window).select("qid", "chunk_id", self.logit(F.col("query"), F.col("text")).cast("double").alias("logit"))


def rerank(hits: DataFrame, logits: DataFrame | None, k: int) -> DataFrame:
    """Hits scored by sigmoid(logit), others as they are; the raw logit is kept as rerank_score."""
    if logits is None:
        return hits.filter(F.col("rank") <= k)
    if not {"qid", "chunk_id", "logit"} <= set(logits.columns):
        raise RerankError("a reranker gives qid, chunk_id and logit")
    scored = hits.drop("rank").join(logits.select("qid", "chunk_id", F.col("logit").alias("rerank_score")), ["qid", "chunk_id"], "left")
    return ranked(scored.withColumn("score", F.coalesce(1 / (1 + F.exp(-F.col("rerank_score"))), F.col("score"))), k)
