"""Ranking quality: recall, MRR and NDCG per query, means, percentiles, sign tests, grids and sweeps."""

from __future__ import annotations

import math
import threading
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..errors import InvalidInput
from .lanes import idf, matched, query_terms, ranked, term_weight

#: Differences this small are ties.
DEAD_ZONE = 1e-12
THETAS = tuple(round(0.05 * i, 2) for i in range(21))
K1_GRID, B_GRID = (1.0, 1.2, 1.5, 2.0), (0.3, 0.5, 0.75, 0.9)
#: Of equally good cells the one nearest to these wins.
CENTRE = (1.2, 0.75)


def metrics(hits: DataFrame, judgments: DataFrame, k: int = 10, threshold: int = 1, by: tuple[str, ...] = ("qid",), cells: DataFrame | None = None) -> DataFrame:
    """(qid, recall, mrr, ndcg): hits (qid, source, rank) against judgments (qid, source, grade), for judged queries.

    A source that was found more than once counts by its best rank. `by` may name more columns of the hits, such as a
    grid cell; each is then evaluated for itself. `cells` lists them, so that they need not be looked for in the hits.
    """
    graded = judgments.groupBy("qid", "source").agg(F.max("grade").alias("grade"))
    gain = (F.pow(F.lit(2.0), F.col("grade")) - 1) / F.log2(F.col("place") + 1)
    order = Window.partitionBy("qid").orderBy(F.col("grade").desc(), "source")
    ideal = (
        graded.withColumn("place", F.row_number().over(order))
        .groupBy("qid")
        .agg(F.sum(F.when((F.col("place") <= k) & (F.col("grade") > 0), gain)).alias("ideal"), F.count(F.when(F.col("grade") >= threshold, 1)).alias("relevant"))
    )
    best = hits.groupBy(*by, "source").agg(F.min("rank").alias("place")).filter(F.col("place") <= k)
    found = (
        best.join(graded, ["qid", "source"])
        .groupBy(*by)
        .agg(
            F.count(F.when(F.col("grade") >= threshold, 1)).alias("found"),
            F.min(F.when(F.col("grade") >= threshold, F.col("place"))).alias("first"),
            F.sum(F.when(F.col("grade") > 0, gain).otherwise(0.0)).alias("dcg"),
        )
    )
    others = [c for c in by if c != "qid"]
    every = ideal.crossJoin(hits.select(*others).distinct() if cells is None else cells) if others else ideal
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return every.join(found, list(by), "left").select(
        *by,
        F.when(F.col("relevant") > 0, zero(F.col("found") / F.col("relevant"))).otherwise(0.0).alias("recall"),
        zero(1 / F.col("first")).alias("mrr"),
        F.when(F.col("ideal") > 0, zero(F.col("dcg") / F.col("ideal"))).otherwise(0.0).alias("ndcg"),
    )


def means(per_query: DataFrame, bucket: str = "type") -> DataFrame:
    """One row per bucket and one for all (bucket null): n and the mean of each metric."""
    return per_query.rollup(bucket).agg(F.count("*").alias("n"), *(F.avg(m).alias(m) for m in ("recall", "mrr", "ndcg")))


def percentile(rows: DataFrame, column: str, p: float, by: tuple[str, ...] = ()) -> DataFrame:
    """Nearest rank: the value at ceil(p / 100 * n)."""
    if not 0 < p <= 100:
        raise InvalidInput("a percentile is above 0 and at most 100")
    return rows.groupBy(*by).agg(F.expr(f"percentile_disc({p / 100}) WITHIN GROUP (ORDER BY {column})").alias(f"p{p:g}"))


def sign_counts(a: DataFrame, b: DataFrame, metric: str = "ndcg") -> DataFrame:
    """One row: for how many queries a is better, equal or worse than b."""
    d = F.col("x") - F.col("y")
    pairs = a.select("qid", F.col(metric).alias("x")).join(b.select("qid", F.col(metric).alias("y")), "qid")
    return pairs.agg(F.count(F.when(d > DEAD_ZONE, 1)).alias("better"), F.count(F.when(F.abs(d) <= DEAD_ZONE, 1)).alias("equal"), F.count(F.when(d < -DEAD_ZONE, 1)).alias("worse"))


def sign_test(better: int, worse: int) -> float:
    """The one-sided exact tail: the chance of at least `better` successes in fair coin tosses; 1 for none."""
    n = better + worse
    if n == 0:
        return 1.0
    logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) - n * math.log(2) for i in range(better, n + 1)]
    top = max(logs)
    return min(1.0, math.exp(top) * math.fsum(math.exp(x - top) for x in logs))


def bm25_grid(queries: DataFrame, posted: DataFrame, lengths: DataFrame, k: int = 10, k1s: tuple[float, ...] = K1_GRID, bs: tuple[float, ...] = B_GRID) -> DataFrame:
    """BM25 hits of every (k1, b) in one pass over the postings: (k1, b, qid, chunk_id, score, rank).

    Each cell is a sum of its own over the same rows; rows multiply only after these are added up.
    """
    cells = [(k1, b) for k1 in k1s for b in bs]
    share = F.col("qtf") * idf(F.col("n"), F.col("df"))
    sums = [F.sum(share * term_weight(F.col("tf"), F.col("dl"), F.col("avgdl"), k1, b)).alias(f"s{i}") for i, (k1, b) in enumerate(cells)]
    scored = matched(query_terms(queries), posted, lengths).groupBy("qid", "chunk_id").agg(*sums)
    each = F.explode(F.array(*(F.struct(F.lit(k1).alias("k1"), F.lit(b).alias("b"), F.col(f"s{i}").alias("score")) for i, (k1, b) in enumerate(cells))))
    return ranked(scored.select("qid", "chunk_id", each.alias("cell")).select("cell.k1", "cell.b", "qid", "chunk_id", "cell.score"), k, ("k1", "b", "qid"))


def best_cell(cells: DataFrame) -> DataFrame:
    """The row of (k1, b, ndcg) with the best mean; within 1e-9 the one nearest to CENTRE."""
    top = cells.agg(F.max("ndcg").alias("top"))
    away = F.pow(F.col("k1") - CENTRE[0], 2) + F.pow(F.col("b") - CENTRE[1], 2)
    return cells.crossJoin(F.broadcast(top)).filter(F.col("ndcg") >= F.col("top") - 1e-9).orderBy(away, "k1", "b").limit(1).drop("top")


def filter_quality(filtered: DataFrame, unfiltered: DataFrame, allowed: DataFrame, k: int = 10) -> DataFrame:
    """(qid, n_hits, n_oracle, recall, shortfall): filtered search against filtering the whole unfiltered ranking."""
    oracle = ranked(unfiltered.join(allowed.select("chunk_id"), "chunk_id", "left_semi").select("qid", "chunk_id", "score"), k)
    got = filtered.filter(F.col("rank") <= k).select("qid", "chunk_id").withColumn("got", F.lit(1))
    both = oracle.select("qid", "chunk_id").withColumn("want", F.lit(1)).join(got, ["qid", "chunk_id"], "full")
    counts = both.groupBy("qid").agg(F.count("got").alias("n_hits"), F.count("want").alias("n_oracle"), F.count(F.when((F.col("got") == 1) & (F.col("want") == 1), 1)).alias("n_both"))
    recall = F.when(F.col("n_oracle") > 0, F.col("n_both") / F.col("n_oracle")).otherwise(1.0)
    return counts.select("qid", "n_hits", "n_oracle", recall.alias("recall"), F.greatest(F.lit(0), k - F.col("n_hits")).alias("shortfall"))


def theta_sweep(full: DataFrame, without: DataFrame, signal: DataFrame, thetas: tuple[float, ...], metric: str = "mrr") -> DataFrame:
    """(theta, n_switched, delta): the mean change of a metric if queries whose signal is below theta take the second
    run. One pass for the whole grid."""
    pairs = full.select("qid", F.col(metric).alias("x")).join(without.select("qid", F.col(metric).alias("y")), "qid").join(signal, "qid")
    grid = pairs.withColumn("theta", F.explode(F.array(*map(F.lit, thetas))))
    switched = F.col("signal") < F.col("theta")
    return grid.groupBy("theta").agg(F.count(F.when(switched, 1)).alias("n_switched"), F.avg(F.when(switched, F.col("y") - F.col("x")).otherwise(0.0)).alias("delta"))


def bucket_sweep(full: DataFrame, without: DataFrame, signals: DataFrame, buckets: DataFrame, thetas: tuple[float, ...] = THETAS, metric: str = "mrr") -> DataFrame:
    """(signal, theta, type, n, delta): the mean change of a metric, by bucket of queries and (type null) for all, if
    queries whose signal is below theta take the second run.

    `signals` has (signal, qid, value), `buckets` (qid, type). Queries without a value keep the first run. One pass for
    all signals and the whole grid.
    """
    pairs = full.select("qid", F.col(metric).alias("x")).join(without.select("qid", F.col(metric).alias("y")), "qid").join(buckets.select("qid", "type"), "qid")
    names = signals.select("signal").distinct()
    cells = pairs.join(F.broadcast(names)).join(signals, ["signal", "qid"], "left")  # a row per kind of signal
    cells = cells.withColumn("theta", F.explode(F.array(*map(F.lit, thetas))))
    change = F.when(F.col("value") < F.col("theta"), F.col("y") - F.col("x")).otherwise(0.0)
    grouped = cells.withColumn("change", change).groupingSets([["signal", "theta", "type"], ["signal", "theta"]], "signal", "theta", "type")
    return grouped.agg(F.count("*").alias("n"), F.avg("change").alias("delta"))


def gates(swept: DataFrame, gain: str = "paraphrase", least_gain: float = 0.01, least_other: float = -0.0024, least_all: float = 0.0, points: int = 3) -> DataFrame:
    """(signal, theta, gain_ok, others_ok, all_ok, passed, run, adopt) from `bucket_sweep`.

    A cell passes if the bucket `gain` improves by `least_gain`, no other bucket falls below `least_other` and all
    queries together do not fall below `least_all`; a bucket without queries never passes. `run` is how many neighbours
    on the grid pass without a break, and a signal is to be adopted where that is `points` or more: a single good point
    does not count.
    """
    low = F.col("delta") + DEAD_ZONE
    least = lambda own, bound: F.coalesce(F.min(F.when(own, low >= bound)), F.lit(False))
    kind = F.col("type")
    cells = swept.groupBy("signal", "theta").agg(
        least(kind == gain, least_gain).alias("gain_ok"), least(kind != gain, least_other).alias("others_ok"), least(kind.isNull(), least_all).alias("all_ok"),
    )
    cells = cells.withColumn("passed", F.col("gain_ok") & F.col("others_ok") & F.col("all_ok"))
    by, same = Window.partitionBy("signal").orderBy("theta"), Window.partitionBy("signal", "passed").orderBy("theta")
    island = cells.withColumn("island", F.row_number().over(by) - F.row_number().over(same))
    run = F.count("*").over(Window.partitionBy("signal", "passed", "island"))
    island = island.withColumn("run", F.when(F.col("passed"), run).otherwise(0))
    return island.withColumn("adopt", F.max("run").over(Window.partitionBy("signal")) >= points).drop("island")


def check_sweep(swept: DataFrame, expected: int = 4) -> None:
    """Raises InvalidInput where a sweep proves nothing: fewer buckets than expected, buckets of different sizes, or a
    change at theta 0, at which no query is switched."""
    rows = swept.filter("theta = 0").collect()  # a row per signal and bucket
    for signal in {r.signal for r in rows}:
        own = [r for r in rows if r.signal == signal and r.type is not None]
        if len(own) != expected or len({r.n for r in own}) > 1:
            raise InvalidInput(f"{signal}: buckets are not {expected} of one size: {sorted((r.type, r.n) for r in own)}")
    if wrong := [r for r in rows if abs(r.delta) > DEAD_ZONE]:
        raise InvalidInput(f"a change without a switched query: {wrong[0]}")


def jitter(runs: DataFrame, metric: str = "ndcg") -> DataFrame:
    """One row: the spread (largest - smallest) of the mean metric over runs (run, metric)."""
    return runs.groupBy("run").agg(F.avg(metric).alias("m")).agg((F.max("m") - F.min("m")).alias("spread"))


def latency(run: Callable[[], object], warm_up: int = 3, reps: int = 20) -> dict[str, float]:
    """Seconds at the 50th and 99th percentile (nearest rank) after some calls that do not count."""
    for _ in range(warm_up):
        run()
    taken = []
    for _ in range(reps):
        began = time.perf_counter()
        run()
        taken.append(time.perf_counter() - began)
    taken.sort()
    return {f"p{p}": taken[max(0, math.ceil(p / 100 * len(taken)) - 1)] for p in (50, 99)}


def filter_costs(paths: dict[str, DataFrame], reps: int = 5) -> dict[str, dict[str, float]]:
    """Seconds of ways to evaluate the same filter, each a plan that keeps the rows that pass; all must keep as many."""
    kept = {name: df.count() for name, df in paths.items()}
    if len(set(kept.values())) > 1:
        raise InvalidInput(f"the filters differ: {kept}")
    return {name: latency(df.count, 1, reps) for name, df in paths.items()}


def throughput(run: Callable[[], object], threads: tuple[int, ...] = (1, 2, 4, 8), calls: int = 8) -> dict[int, float]:
    """Calls per second by number of threads on one session; every call must give the same result."""
    expected, out = run(), {}
    for n in threads:
        wrong: list[object] = []
        gate = threading.Barrier(n + 1)

        def work(gate: threading.Barrier = gate, wrong: list = wrong) -> None:
            gate.wait()
            for _ in range(calls):
                if run() != expected:
                    wrong.append(1)

        workers = [threading.Thread(target=work) for _ in range(n)]
        for w in workers:
            w.start()
        gate.wait()
        began = time.perf_counter()
        for w in workers:
            w.join()
        if wrong:
            raise InvalidInput("results differ between threads")
        out[n] = n * calls / (time.perf_counter() - began)
    return out
