import json
import math

import pytest
from pyspark.sql import functions as F

from heronry.errors import Busy, ChunkNotFound, ConfigMismatch, DecodeError, InvalidInput, NoEmbedder, SnapshotCorrupted, SnapshotVersionMismatch, StorageError
from heronry.functions.filters import Eq
from heronry.functions.text import LemmaAnalyzer
from heronry.operators import lanes, post
from heronry.plans.engine import Adaptive, Mode, Searcher, candidate_budget, take_n
from heronry.plans.index import Config, Index
from heronry.sources import files
from heronry.sources.store import Store
from heronry.streaming import ingest as streaming

TEXTS = ["rust search engine", "vector search in rust", "cooking with oil", "engine oil", "search search search", "a vector engine"]


def docs(spark, texts=TEXTS):
    rows = [(i, t, f"s{i}", json.dumps({"topic": "car" if "oil" in t else "ir", "ts_ms": i * 1000})) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, metadata string")


def vectors(spark, n=len(TEXTS)):
    return spark.createDataFrame([(i, [math.cos(i), math.sin(i)]) for i in range(n)], "chunk_id long, vector array<double>")


def index(spark, **kw):
    return Index.of_texts(docs(spark), source=F.col("source"), metadata=F.col("metadata"), vectors=vectors(spark), **kw)


def asked(spark, *texts):
    return spark.createDataFrame([(i, t, [math.cos(i), math.sin(i)]) for i, t in enumerate(texts)], "qid long, query string, qvec array<double>")


def rows(df):
    return [(r.qid, r.rank, r.chunk_id, round(r.score, 9)) for r in df.orderBy("qid", "rank").collect()]


def test_modes(spark):
    s, q = Searcher(index(spark)), asked(spark, "rust search", "oil")
    for mode in ("bm25", "vector", "hybrid"):
        found = s.search(q).mode(mode).top_n(3).exec()
        compared = s.compare(q, 3).filter(F.col("mode") == mode)
        assert rows(found) == rows(compared)
    assert rows(s.search(q).exec()) == rows(s.search(q).mode("fusion").exec())  # the default with vectors
    assert [Mode.parse(n) for n in ("keyword", "Lexical", "semantic", "embedding", "fusion")] == ["bm25", "bm25", "vector", "vector", "hybrid"]
    with pytest.raises(InvalidInput):
        Mode.parse("other")
    with pytest.raises(NoEmbedder):
        Searcher(Index.of_texts(docs(spark))).search(q).mode("vector").exec()


def test_budgets():
    assert candidate_budget(1) == 10 and candidate_budget(10) == 30 and candidate_budget(5, 20) == 20 and candidate_budget(5, 0, 50) == 50
    assert take_n(0, 9) == 0 and take_n(5, 3) == 3 and take_n(5, 90, 20) == 20


def test_filter_and_explain(spark):
    found = Searcher(index(spark)).search(asked(spark, "engine oil")).mode("bm25").filter("topic=car").top_n(5).exec().collect()
    assert {r.chunk_id for r in found} == {2, 3}
    top = min(found, key=lambda r: r["rank"])
    assert top.matched_terms == ["engine", "oil"] and top.source == "s3" and top.bm25_rank == 1 and top.score == pytest.approx(top.fused_score)


def test_blank_queries_and_zero(spark):
    s = Searcher(index(spark))
    assert s.search(asked(spark, " ")).mode("vector").exec().count() == 0
    assert s.search(asked(spark, "rust")).top_n(0).exec().count() == 0
    with pytest.raises(InvalidInput):
        s.search(asked(spark, "rust")).top_n(-1)


def test_multi_query(spark):
    q = asked(spark, "rust", "oil")
    groups = spark.createDataFrame([(0, 7, 0), (1, 7, 1)], "qid long, gid long, position int")
    found = Searcher(index(spark)).search(q).mode("bm25").fused(groups).exec().collect()
    assert {r.qid for r in found} == {7} and {r.chunk_id for r in found} == {0, 1, 2, 3}
    with pytest.raises(InvalidInput):
        Searcher(index(spark), adaptive=Adaptive()).search(q).mode("hybrid").fused(groups).exec()


@pytest.mark.parametrize("signal", ["overlap", "coverage", "shape"])
def test_adaptive_signals(spark, signal):
    q = asked(spark, "rust search")
    off = Searcher(index(spark), adaptive=Adaptive(signal, 1.1)).search(q).mode("hybrid").top_n(6).exec().collect()
    only = Searcher(index(spark), weights=(0.0, 1.5)).search(q).mode("hybrid").top_n(6).exec().collect()
    assert {(r.chunk_id, r.score) for r in off} == {(r.chunk_id, r.score) for r in only}


def test_post_and_rerank(spark):
    stamp = {"ts_ms": F.get_json_object("metadata", "$.ts_ms").cast("long")}
    q = asked(spark, "search engine")
    aged = Searcher(index(spark), post=post.TimeDecay(0.5, 6000), hit_columns=stamp).search(q).mode("bm25").exec().orderBy("rank").collect()
    plain = {r.chunk_id: r.score for r in Searcher(index(spark)).search(q).mode("bm25").exec().collect()}
    assert all(r.score == pytest.approx(plain[r.chunk_id] * r.decay_factor) for r in aged) and "matched_terms" in aged[0].asDict()
    spent = Searcher(index(spark), post=post.TokenBudget(30)).search(q).mode("bm25").exec().collect()
    assert sum(r.budget_units for r in spent) <= 30
    terms = {"terms": F.split("text", " ")}
    diverse = Searcher(index(spark), post=post.Mmr(1.0), hit_columns=terms).search(q).mode("bm25").top_n(3).exec()
    assert rows(diverse) == rows(Searcher(index(spark)).search(q).mode("bm25").top_n(3).exec())
    by_length = post.FunctionReranker(lambda query, text: F.length(text).cast("double"))
    best = Searcher(index(spark), reranker=by_length).search(q).mode("bm25").top_n(1).exec().first()
    assert best.rerank_score == len(best.text)


def test_approximate_lane(spark):
    i = index(spark)
    s = Searcher(i, ann=lanes.IvfIndex(i.vectors))
    assert s.route(None) == "ann" and s.route(Eq("topic", "car")) == "exact" and Searcher(i).route(None) == "exact"
    assert s.search(asked(spark, "x")).mode("vector").top_n(3).exec().count() == 3


def test_segments_are_one_index(spark):
    whole, d = index(spark), docs(spark)
    parts = [Index.of_texts(d.filter(f"doc_id % 2 = {i}"), source=F.col("source"), metadata=F.col("metadata"), vectors=vectors(spark).filter(f"chunk_id % 2 = {i}")) for i in (0, 1)]
    q = asked(spark, "rust search engine", "oil")
    for mode in ("bm25", "vector", "hybrid"):
        assert rows(Searcher(parts[0].union(parts[1])).search(q).mode(mode).exec()) == rows(Searcher(whole).search(q).mode(mode).exec())


def test_tombstones_count_until_merged(spark):
    dead = spark.createDataFrame([(4,)], "doc_id long")
    q = asked(spark, "search")
    whole = {r.chunk_id: r.score for r in Searcher(index(spark)).search(q).mode("bm25").exec().collect()}
    marked = {r.chunk_id: r.score for r in Searcher(index(spark).without(dead)).search(q).mode("bm25").exec().collect()}
    assert marked == {c: pytest.approx(s) for c, s in whole.items() if c != 4}
    merged = Searcher(index(spark).without(dead).merged()).search(q).mode("bm25").exec().collect()
    fresh = Searcher(Index.of_texts(docs(spark).filter("doc_id <> 4"))).search(q).mode("bm25").exec().collect()
    assert {(r.chunk_id, round(r.score, 9)) for r in merged} == {(r.chunk_id, round(r.score, 9)) for r in fresh}
    assert Searcher(index(spark).without(dead)).search(q).mode("vector").exec().filter("chunk_id = 4").count() == 0


def test_compaction_renumbers(spark):
    i = index(spark).without(spark.createDataFrame([(0,), (3,)], "doc_id long")).compacted()
    assert sorted(r.doc_id for r in i.docs.collect()) == [0, 1, 2, 3] == sorted(r.chunk_id for r in i.chunks.collect()) == sorted(r.chunk_id for r in i.vectors.collect())
    assert index(spark).chunk(2)["text"] == TEXTS[2]
    with pytest.raises(ChunkNotFound):
        index(spark).chunk(99)


def test_empty_reasons(spark):
    s = Searcher(index(spark))
    q = asked(spark, "rust", "zzz", "the")
    assert {r.qid: r.reason for r in s.empty_reasons(q).collect()} == {0: None, 1: "AllTermsUnmatched", 2: "AllTermsUnmatched"}
    assert {r.qid: r.reason for r in s.empty_reasons(q, where=Eq("topic", "none")).collect()} == {0: "FilteredOut", 1: "AllTermsUnmatched", 2: "AllTermsUnmatched"}
    none = Searcher(Index.of_texts(docs(spark).limit(0)))
    assert {r.reason for r in none.empty_reasons(q).collect()} == {"NoDocuments"}


def test_build_drops_duplicates_and_is_dense(spark):
    i = Index.build(docs(spark, ["b", "a", "b", "c" * 600]))
    assert sorted((r.doc_id, r.source) for r in i.docs.collect()) == [(0, "s0"), (1, "s1"), (2, "s3")]
    assert sorted((r.chunk_id, r.doc_id, r.ordinal) for r in i.chunks.collect()) == [(0, 0, 0), (1, 1, 0), (2, 2, 0), (3, 2, 1)]
    with pytest.raises(InvalidInput):
        Index.build(spark.range(1))


# the store


def fill(spark, root, **kw):
    store = Store(spark, str(root), **kw)
    store.writer().add(docs(spark).filter("doc_id < 4").withColumnRenamed("doc_id", "doc_order")).commit()
    store.writer().add(docs(spark).filter("doc_id >= 3").withColumnRenamed("doc_id", "doc_order")).commit()
    return store


def test_store_life(spark, tmp_path):
    store = fill(spark, tmp_path / "s")
    m = store.manifest()
    assert m.generation == 2 and len(m.segments) == 2 and m.next_doc == 6  # the repeated text was there
    assert sorted(r.source for r in store.view().docs.collect()) == [f"s{i}" for i in range(6)]
    before = store.view(m)
    store.writer().remove(spark.createDataFrame([(1,), (77,)], "doc_id long")).commit()
    assert tuple(store.tombstone_stats().first())[:3] == (6, 1, 5)
    assert before.tombstones is None and store.view().merged().docs.count() == 5
    store.writer().add(docs(spark).filter("doc_id = 1").withColumnRenamed("doc_id", "doc_order")).commit()
    assert store.view().merged().docs.count() == 6  # a removed text may come again
    assert store.merge(1).segments and store.view().docs.count() == 6
    _, moved = store.compact()
    assert not moved
    store.writer().remove(spark.createDataFrame([(0,)], "doc_id long")).commit()
    m, moved = store.compact()
    assert moved and sorted(r.doc_id for r in store.view().docs.collect()) == [0, 1, 2, 3, 4]
    store.verify()
    assert store.vacuum() and store.view().docs.count() == 5


def test_store_refuses(spark, tmp_path):
    store = fill(spark, tmp_path / "s")
    late = store.writer().add(docs(spark, ["new"]))
    store.writer().add(docs(spark, ["other"])).commit()
    with pytest.raises(Busy):
        late.commit()
    with pytest.raises(ConfigMismatch):
        Store(spark, str(tmp_path / "s"), Config(analyzer=LemmaAnalyzer())).manifest()
    with pytest.raises(StorageError):
        Store(spark, str(tmp_path / "none")).view()
    entry = store.manifest().segments[0]
    files.remove(spark, f"{tmp_path}/s/segments/{entry['id']}/docs")
    with pytest.raises(SnapshotCorrupted):
        store.verify()
    files.write_new(spark, f"{tmp_path}/v/manifests/1.json", {"version": 99})
    with pytest.raises(SnapshotVersionMismatch):
        Store(spark, f"{tmp_path}/v").manifest()
    assert not files.remove(spark, f"{tmp_path}/nothing")


def test_store_with_vectors(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), Config(embedder="test", dim=2))
    store.writer().add(docs(spark).withColumnRenamed("doc_id", "doc_order")).embed(lambda c: c.select("chunk_id", F.array(F.cos("chunk_id"), F.sin("chunk_id")).alias("vector"))).commit()
    assert Searcher(store.view()).search(asked(spark, "rust")).mode("vector").top_n(2).exec().count() == 2


def test_streaming_ingest(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    store = Store(spark, str(tmp_path / "s"))
    for n, texts in enumerate((["one", "two"], ["two", "three"])):
        (folder / f"{n}.json").write_text("\n".join(json.dumps({"source": t, "text": t}) for t in texts))
        streaming.ingest(streaming.documents(spark, str(folder)), store, str(tmp_path / "c")).awaitTermination()
    assert sorted(r.source for r in store.view().docs.collect()) == ["one", "three", "two"]
    streaming.ingest(streaming.documents(spark, str(folder)), store, str(tmp_path / "again")).awaitTermination()
    assert store.view().docs.count() == 3  # played again from the start


# files


def test_corpus(spark, tmp_path):
    good = tmp_path / "c.jsonl"
    good.write_text('{"source": "a", "text": "x", "metadata": {"k": 2021.0}}\n\n{"text": "y"}\n')
    assert sorted((r.source, r.text, r.metadata) for r in files.read_corpus(spark, str(good)).collect()) == [("<unknown>", "y", "{}"), ("a", "x", '{"k":2021.0}')]
    for bad in ('{"source": "a"}\n', "nonsense\n", "[1]\n"):
        (tmp_path / "b.jsonl").write_text(bad)
        with pytest.raises(DecodeError):
            files.read_corpus(spark, str(tmp_path / "b.jsonl"))
    (tmp_path / "e.jsonl").write_text("\n\n")
    with pytest.raises(InvalidInput):
        files.read_corpus(spark, str(tmp_path / "e.jsonl"))


def test_judgments(spark, tmp_path):
    path = tmp_path / "j.jsonl"
    path.write_text('{"qid": "1", "query": "q", "type": "t", "relevance": [{"source": "s0", "grade": 3}, {"source": "zz", "grade": 0}]}\n')
    queries, judged = files.read_judgments(spark, str(path))
    assert queries.collect() == [("1", "q", "t")] and sorted(judged.collect()) == [("1", "s0", 3), ("1", "zz", 0)]
    i = index(spark)
    assert files.unknown_sources(judged, i.docs).collect() == [("zz",)]
    assert files.repeated_sources(judged, i.docs, i.chunks).count() == 0
    for n, bad in enumerate(('{"qid": "1", "query": "q", "relevance": []}', '{"qid": "1", "query": "q", "relevance": [{"source": "a", "grade": 4}]}', "x")):
        (tmp_path / f"b{n}.jsonl").write_text(bad + "\n")
        with pytest.raises(DecodeError):
            files.read_judgments(spark, str(tmp_path / f"b{n}.jsonl"))


def test_reports(spark):
    df = spark.createDataFrame([("a", 0.5), ("b", None)], "name string, v double").orderBy("name")
    assert files.markdown_table(df) == "| name | v |\n| --- | --- |\n| a | 0.5000 |\n| b |  |"
    assert json.loads(files.json_report({"t": df}, {"k": 10}))["t"][0] == {"name": "a", "v": 0.5}
    made = files.synthetic_corpus(spark, 100)
    assert made.count() == 100 and made.select("text").distinct().count() > 90
