import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from heronry.errors import InvalidInput, RerankError
from heronry.operators import evaluate, explain, fusion, ingest, lanes, post
from heronry.plans.index import Index

HITS = "qid long, chunk_id long, score double, rank int"
LANES = "qid long, lane_idx int, chunk_id long, score double, rank int"


def table(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def ids(df):
    return [r.chunk_id for r in df.orderBy("qid", "rank").collect()]


def corpus(spark):
    texts = ["rust search engine", "vector search", "rust rust rust", "", "engine room and engine oil"]
    return Index.of_texts(table(spark, list(enumerate(texts)), "doc_id long, text string"))


def queries(spark, *texts):
    return table(spark, list(enumerate(texts)), "qid long, query string")


def brute_bm25(texts, query, k1=1.5, b=0.75):
    docs, n = [t.split() for t in texts], len(texts)
    mean = sum(map(len, docs)) / n
    out = {}
    for i, d in enumerate(docs):
        s = 0
        for t in query:
            df, tf = sum(t in x for x in docs), d.count(t)
            s += math.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * len(d) / mean)) if tf else 0
        if s:
            out[i] = s
    return out


def test_bm25_by_hand(spark):
    i = corpus(spark)
    texts = ["rust search engine", "vector search", "rust rust rust", "", "engine room engine oil"]
    for q in (["rust"], ["rust", "engine"], ["engine", "engine", "search"], ["unknown"]):
        found = lanes.bm25(queries(spark, " ".join(q)), i.postings, i.lengths, None).collect()
        assert {r.chunk_id: pytest.approx(r.score) for r in found} == brute_bm25(texts, q)


def test_bm25_edges(spark):
    i = corpus(spark)
    assert lanes.bm25(queries(spark, "", "the of", "zzz"), i.postings, i.lengths).count() == 0
    assert lanes.bm25(queries(spark, "rust"), i.postings, i.lengths, 0).count() == 0
    with pytest.raises(InvalidInput):
        lanes.bm25(queries(spark, "rust"), i.postings, i.lengths, -1)
    some = table(spark, [(0,)], "chunk_id long")
    whole = {r.chunk_id: r.score for r in lanes.bm25(queries(spark, "rust"), i.postings, i.lengths).collect()}
    part = lanes.bm25(queries(spark, "rust"), i.postings, i.lengths, candidates=some).collect()
    assert [(r.chunk_id, r.score, r.rank) for r in part] == [(0, pytest.approx(whole[0]), 1)]  # statistics of all


def test_exact_vectors(spark):
    rng = np.random.default_rng(5)
    x, q = rng.normal(size=(300, 8)), rng.normal(size=(7, 8))
    rows = table(spark, [(i, v.tolist()) for i, v in enumerate(x)] + [(300, [0.0] * 8)], "chunk_id long, vector array<double>")
    asked = table(spark, [(i, v.tolist()) for i, v in enumerate(q)] + [(99, None)], "qid long, qvec array<double>")
    found = lanes.exact_vectors(asked, rows, 5)
    cosine = (q / np.linalg.norm(q, axis=1, keepdims=True)) @ (x / np.linalg.norm(x, axis=1, keepdims=True)).T
    assert ids(found) == [int(i) for row in cosine for i in np.argsort(-row)[:5]]
    assert lanes.exact_vectors(asked, rows, 0).count() == 0
    few = lanes.exact_vectors(asked, rows, 5, table(spark, [(3,), (300,)], "chunk_id long"))
    assert few.groupBy("qid").count().select("count").distinct().collect() == [(2,)]
    with pytest.raises(Exception, match="dimensions"):
        lanes.exact_vectors(asked.withColumn("qvec", F.slice("qvec", 1, 3)), rows, 5).collect()


def test_approximate_vectors_recall(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"))
    asked = rows.select(F.col("chunk_id").alias("qid"), F.col("vector").alias("qvec"))
    near = lanes.IvfIndex(rows).search(asked, 10)
    assert near.groupBy("qid").count().count() == rows.count()
    recall = lanes.overlap_at_k(near, lanes.exact_vectors(asked, rows, 10), 10).agg(F.avg("overlap")).first()[0]
    assert recall >= 0.9


def test_approximate_vectors_read_few_lists_of_clusters(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(60, 16)) * 3
    x = centres[rng.integers(0, 60, 6000)] + rng.normal(size=(6000, 16)) * 0.4
    x[:2000] = centres[0] + rng.normal(size=(2000, 16)) * 0.4  # a third in one place
    rows = table(spark, [(i, v.tolist()) for i, v in enumerate(x)], "chunk_id long, vector array<double>")
    asked = table(spark, [(i, x[i].tolist()) for i in range(0, 6000, 100)], "qid long, qvec array<double>")
    made = lanes.IvfIndex(rows, lists=80)
    assert made.probes <= 8  # a tenth of the lists
    exact = lanes.exact_vectors(asked, rows, 10)
    assert lanes.overlap_at_k(made.search(asked, 10), exact, 10).agg(F.avg("overlap")).first()[0] >= 0.9
    every = made.search(asked, 10, probes=80)
    assert sorted((r.qid, r.chunk_id) for r in every.collect()) == sorted((r.qid, r.chunk_id) for r in exact.collect())
    some = table(spark, [(i,) for i in range(0, 6000, 2)], "chunk_id long")
    assert all(r.chunk_id % 2 == 0 for r in made.search(asked, 10, candidates=some).collect())


def test_gates(spark):
    deltas = {"paraphrase": 0.02, "exact": 0.0, "natural": -0.002, "mixed": 0.0}
    rows = []
    for signal, good in (("a", {0.1, 0.15, 0.2}), ("b", {0.1, 0.2, 0.3}), ("c", set())):
        for i in range(9):
            theta = round(0.05 * i, 2)
            for kind, d in deltas.items():
                rows.append((signal, theta, kind, 10, d if theta in good else 0.0))
            rows.append((signal, theta, None, 40, 0.0045 if theta in good else 0.0))
    swept = table(spark, rows, "signal string, theta double, type string, n long, delta double")
    found = {(r.signal, r.theta): r for r in evaluate.gates(swept).collect()}
    assert [s for s in "abc" if found[s, 0.0].adopt] == ["a"]
    assert found["a", 0.15].run == 3 and found["b", 0.1].run == 1 and not found["c", 0.1].passed
    evaluate.check_sweep(swept)
    with pytest.raises(ValueError, match="not 4"):
        evaluate.check_sweep(swept.filter("type is null or type <> 'mixed'"))
    with pytest.raises(ValueError, match="without a switched"):
        evaluate.check_sweep(swept.withColumn("delta", F.lit(0.1)))


def test_postings_are_counted_in_their_rows(spark):
    rows = table(spark, [(1, "b a b c"), (2, ""), (3, None), (4, "a a"), (5, "of the")], "chunk_id long, text string")
    posted = ingest.postings(rows.coalesce(1), positions=True)
    found = {(r.chunk_id, r.term): (r.tf, r.positions) for r in posted.collect()}
    assert found == {(1, "b"): (2, [0, 1]), (1, "c"): (1, [2])}  # a is a stop word
    assert {r.chunk_id: r.dl for r in ingest.lengths(rows).collect()} == {1: 3, 2: 0, 3: 0, 4: 0, 5: 0}
    assert "Exchange" not in posted._jdf.queryExecution().executedPlan().toString()


def test_routes():
    assert lanes.route(True, 8192) == "exact" and lanes.route(True, 8193) == "ann" == lanes.route(False, 1)
    assert [lanes.overall_route(r) for r in ([], ["ann"], ["exact", "exact"], ["ann", "exact"])] == ["none", "ann", "exact", "mixed"]


TWO_LANES = [(1, 0, 10, 5.0, 1), (1, 0, 11, 4.0, 2), (1, 1, 11, 0.9, 1), (1, 1, 12, 0.8, 2)]


def test_rrf_by_hand(spark):
    found = {r.chunk_id: r.score for r in fusion.rrf(table(spark, TWO_LANES, LANES)).collect()}
    assert found == {10: pytest.approx(1 / 61), 11: pytest.approx(1 / 62 + 1.5 / 61), 12: pytest.approx(1.5 / 62)}
    plain = {r.chunk_id: r.score for r in fusion.rrf(table(spark, TWO_LANES, LANES), weights=()).collect()}
    assert plain[11] == pytest.approx(1 / 62 + 1 / 61)


def test_weighted_by_hand(spark):
    rows = [*TWO_LANES, (2, 0, 10, 0.0, 1)]
    found = {(r.qid, r.chunk_id): r.score for r in fusion.weighted(table(spark, rows, LANES)).collect()}
    assert found == {(1, 10): 1.0, (1, 11): pytest.approx(0.8 + 1.5), (1, 12): pytest.approx(1.5 * 0.8 / 0.9), (2, 10): 0.0}
    one = {r.chunk_id: r.score for r in fusion.weighted(table(spark, TWO_LANES, LANES), weights=(2.0,)).collect()}
    assert one[11] == pytest.approx(1.6 + 1.0)


def test_adaptive(spark):
    lanes_ = table(spark, TWO_LANES, LANES)
    signal = fusion.overlap_signal(lanes_, 2)
    assert signal.collect() == [(1, 0.5)]
    off = {r.chunk_id: r.score for r in fusion.adaptive_rrf(lanes_, signal, 0.6).collect()}
    assert off == {10: 0.0, 11: pytest.approx(1.5 / 61), 12: pytest.approx(1.5 / 62)}
    assert fusion.overlap_signal(lanes_.filter("lane_idx = 0"), 2).count() == 0
    with pytest.raises(InvalidInput):
        fusion.overlap_signal(lanes_, 0)


def hits(spark, rows):
    return table(spark, rows, "qid long, chunk_id long, score double, rank int, ts_ms long, text string")


def test_time_decay(spark):
    rows = hits(spark, [(1, 1, 1.0, 1, 0, "a"), (1, 2, 0.9, 2, 10_000, "b"), (1, 3, 0.1, 3, 99_000, "c")])
    found = post.TimeDecay(0.1, 10_000).process(rows, 3).orderBy("rank").collect()
    assert [(r.chunk_id, r.score) for r in found] == [(2, 0.9), (1, pytest.approx(math.exp(-1))), (3, 0.1)]
    assert [r.decay_factor for r in found] == [None, pytest.approx(math.exp(-1)), None]
    with pytest.raises(InvalidInput):
        post.TimeDecay(math.inf, 0)
    with pytest.raises(Exception, match="ts_ms"):
        post.TimeDecay(0.1, 0).process(hits(spark, [(1, 1, 1.0, 1, None, "a")]), 3).collect()


@pytest.mark.parametrize(("budget", "k", "expected"), [(3, 9, [1]), (5, 9, [1, 2]), (4, 9, [1]), (99, 2, [1, 2]), (0, 9, [])])
def test_token_budget_stops_at_the_first_that_exceeds(spark, budget, k, expected):
    rows = hits(spark, [(1, 1, 1.0, 1, 0, "aaa"), (1, 2, 0.9, 2, 0, "bb"), (1, 3, 0.8, 3, 0, "c")])
    assert ids(post.TokenBudget(budget).process(rows, k)) == expected


def greedy(items, k, balance):
    left, chosen = dict(items), []
    while left and len(chosen) < k:
        def gain(c):
            s, t = items[c]
            return round(balance * s - (1 - balance) * max((len(t & items[o][1]) / len(t | items[o][1]) if t and items[o][1] else 0 for o in chosen), default=0), 9)
        best = min(left, key=lambda c: (-gain(c), c))
        chosen.append(best)
        del left[best]
    return chosen


def test_mmr(spark):
    items = {1: (0.9, {"a", "b"}), 2: (0.85, {"a", "b"}), 3: (0.5, {"c"}), 4: (0.5, set()), 5: (0.4, {"a", "c"})}
    rows = table(spark, [(1, c, s, i + 1, sorted(t)) for i, (c, (s, t)) in enumerate(items.items())], "qid long, chunk_id long, score double, rank int, terms array<string>")
    for balance in (0.0, 0.3, 0.7, 1.0):
        assert ids(post.Mmr(balance).process(rows, 4)) == greedy(items, 4, balance)
    with pytest.raises(InvalidInput):
        post.Mmr(1.1)


def test_rerank(spark):
    rows = table(spark, [(1, 1, 0.2, 1), (1, 2, 0.6, 2), (1, 3, 0.4, 3)], HITS)
    logits = table(spark, [(1, 1, 2.0), (1, 3, -9.0)], "qid long, chunk_id long, logit double")
    found = post.rerank(rows, logits, 2).orderBy("rank").collect()
    assert [(r.chunk_id, r.score, r.rerank_score) for r in found] == [(1, pytest.approx(1 / (1 + math.exp(-2))), 2.0), (2, 0.6, None)]
    assert ids(post.rerank(rows, None, 2)) == [1, 2]
    with pytest.raises(RerankError):
        post.rerank(rows, rows, 2)


JUDGED = "qid long, source string, grade int"


def test_metrics_by_hand(spark):
    found = table(spark, [(1, "a", 1), (1, "b", 2), (1, "b", 3), (1, "c", 4), (2, "a", 1)], "qid long, source string, rank int")
    judged = table(spark, [(1, "b", 3), (1, "c", 1), (1, "x", 2), (2, "z", 0), (3, "a", 1)], JUDGED)
    rows = {r.qid: r for r in evaluate.metrics(found, judged).collect()}
    dcg, ideal = 7 / math.log2(3) + 1 / math.log2(5), 7 + 3 / math.log2(3) + 1 / 2
    assert (rows[1].recall, rows[1].mrr, rows[1].ndcg) == (pytest.approx(2 / 3), 0.5, pytest.approx(dcg / ideal))
    assert tuple(rows[2])[1:] == (0, 0, 0) == tuple(rows[3])[1:]
    strict = {r.qid: r for r in evaluate.metrics(found, judged, threshold=3).collect()}
    assert strict[1].recall == 1.0


def test_sign_test():
    assert evaluate.sign_test(0, 0) == 1.0 and evaluate.sign_test(5, 0) == pytest.approx(1 / 32)
    assert evaluate.sign_test(2, 2) == pytest.approx(11 / 16)
    assert 0 < evaluate.sign_test(1100, 900) < 1e-5  # beyond what binomials in floats can hold


def test_sign_counts(spark):
    a = table(spark, [(1, 0.5), (2, 0.5), (3, 0.1)], "qid long, ndcg double")
    b = table(spark, [(1, 0.4), (2, 0.5 + 1e-13), (3, 0.2), (4, 1.0)], "qid long, ndcg double")
    assert tuple(evaluate.sign_counts(a, b).first()) == (1, 1, 1)


def test_percentile_is_nearest_rank(spark):
    for n in (1, 3, 20, 101):
        for p in (50, 90, 99, 100):
            expected = math.ceil(p / 100 * n)
            assert evaluate.percentile(spark.range(1, n + 1), "id", p).first()[0] == expected
    with pytest.raises(InvalidInput):
        evaluate.percentile(spark.range(1), "id", 0)


def test_best_cell(spark):
    cells = table(spark, [(1.0, 0.3, 0.5), (1.2, 0.75, 0.5 - 1e-10), (2.0, 0.9, 0.4)], "k1 double, b double, ndcg double")
    assert tuple(evaluate.best_cell(cells).first())[:2] == (1.2, 0.75)


def test_filter_quality(spark):
    every = table(spark, [(1, c, 1.0 / c, c) for c in range(1, 9)], HITS)
    allowed = table(spark, [(2,), (4,), (6,)], "chunk_id long")
    found = table(spark, [(1, 2, 0.5, 1), (1, 6, 0.2, 2)], HITS)
    assert tuple(evaluate.filter_quality(found, every, allowed, 5).first()) == (1, 2, 3, pytest.approx(2 / 3), 3)


def test_jitter_and_timing(spark):
    runs = table(spark, [(1, 0.5), (1, 0.7), (2, 0.7), (2, 0.6)], "run int, ndcg double")
    assert evaluate.jitter(runs).first()[0] == pytest.approx(0.05)
    assert evaluate.latency(lambda: None, 1, 5)["p50"] >= 0
    assert set(evaluate.throughput(lambda: 1, (1, 2), 2)) == {1, 2}


@pytest.mark.parametrize(
    ("n_docs", "n_terms", "hit", "filtered", "n_hits", "final", "reason"),
    [
        (0, 1, False, False, 0, 0, "NoDocuments"), (5, 0, False, True, 0, 0, "AllTermsUnmatched"), (5, 1, False, True, 0, 0, "AllTermsUnmatched"), (5, 1, True, True, 0, 0, "FilteredOut"),
        (5, 1, True, False, 0, 0, "AllTermsUnmatched"), (5, 1, True, False, 3, 0, "PostEmptied"), (5, 1, True, False, 3, 2, None),
    ],
)
def test_empty_reasons(spark, n_docs, n_terms, hit, filtered, n_hits, final, reason):
    column = explain.empty_reason(*map(F.lit, (n_docs, n_terms, hit, filtered, 0, n_hits, final)))
    assert spark.range(1).select(column).first()[0] == reason


def test_upsert(spark):
    rows = table(spark, [(1, "a"), (2, "a"), (3, "b"), (4, None)], "doc_id long, text string")
    live = ingest.content_hash(table(spark, [(9, "b")], "doc_id long, text string"))
    found = ingest.upsert(ingest.content_hash(rows), live)
    assert sorted(r.doc_id for r in found.collect()) == [1, 4]
    zero = ingest.content_hash(rows).withColumn("content_hash", F.lit(0).cast("long"))
    assert ingest.upsert(zero).count() == 4


def test_renumber(spark):
    found = ingest.renumber(spark.range(1000).select((F.col("id") * 7).alias("k")), "k", "n").collect()
    assert all(r.n == r.k // 7 for r in found)
    assert ingest.renumber(spark.range(0), "id", "n").count() == 0


def test_compaction_hint():
    assert ingest.should_compact(1024, 0.2) and not ingest.should_compact(1023, 0.9) and not ingest.should_compact(5000, 0.19)
