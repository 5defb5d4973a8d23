import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from heronry.__main__ import main
from heronry.errors import Busy, EmbeddingError, GraphStale, InvalidInput, NoEmbedder, SnapshotCorrupted
from heronry.operators import evaluate, lanes
from heronry.plans.embed import CachedEmbedder, HashEmbedder, RemoteEmbedder, embed_chunks, embed_queries
from heronry.sources import benchmark, files, report


def test_command_line(spark, tmp_path, capsys):
    corpus = tmp_path / "c.jsonl"
    corpus.write_text("\n".join(json.dumps({"source": f"s{i}", "text": t, "metadata": {"lang": l}}) for i, (t, l) in enumerate([("rust engine", "en"), ("vector search", "en"), ("rust search", "de"), ("rust engine", "en")])))
    store = str(tmp_path / "store")
    assert main(["build", store, str(corpus), "--dim", "16"]) == 0
    assert json.loads(capsys.readouterr().out)["docs"] == 3
    assert main(["build", store, str(corpus), "--dim", "16"]) == 0  # nothing new
    assert json.loads(capsys.readouterr().out)["docs"] == 3
    assert main(["search", store, "rust engine", "--dim", "16", "--json", "--filter", "lang=en", "--mode", "hybrid"]) == 0
    hits = [json.loads(x) for x in capsys.readouterr().out.splitlines()]
    assert hits[0]["source"] == "s0" and "(matched: engine, rust)" in hits[0]["block"]
    assert main(["compare", store, "rust", "--dim", "16", "-k", "2"]) == 0
    assert capsys.readouterr().out.count("| hybrid |") == 2
    assert main(["compact", store, "--dim", "16", "--dry-run", "--json"]) == 0
    assert json.loads(capsys.readouterr().out)["docs_total"] == 3
    judged = tmp_path / "j.jsonl"
    judged.write_text(json.dumps({"qid": "a", "query": "vector", "type": "t", "relevance": [{"source": "s1", "grade": 3}]}) + "\n")
    assert main(["bench", store, str(judged), "--dim", "16", "--modes", "bm25", "hybrid"]) == 0
    report = json.loads(capsys.readouterr().out)
    assert report["bm25"][0]["recall"] == 1.0 and report["config"]["signs"]["hybrid vs bm25"]["p"] == 1.0
    assert main(["search", store, "x", "--dim", "8"]) == 1 and "built otherwise" in capsys.readouterr().err


def test_embedders(spark):
    e = CachedEmbedder(HashEmbedder(8), 2)
    a = e.encode(["one two", "two one", "one two"])
    assert np.allclose(a[0], a[1]) and e.hits == 1
    e.encode(["three"])
    assert len(e._kept) == 2 and "one two" in e._kept
    chunks = spark.createDataFrame([(i, f"word{i}") for i in range(200)] + [(200, None)], "chunk_id long, text string")
    found = {r.chunk_id: r.vector for r in embed_chunks(chunks, HashEmbedder(8)).collect()}
    assert len(found) == 201 and np.allclose(found[7], HashEmbedder(8).encode(["word7"])[0]) and not any(found[200])
    assert embed_queries(spark, {1: "x", 2: " "}, e).orderBy("qid").collect()[1].qvec is None
    with pytest.raises(NoEmbedder):
        RemoteEmbedder().encode(["x"])
    bad = HashEmbedder(8)
    bad.dim = 9
    with pytest.raises(EmbeddingError):
        embed_queries(spark, {1: "x"}, type("E", (), {"query_prefix": "", "dim": 9, "encode": lambda self, t: np.zeros((1, 8))})())


def test_saved_approximate_index(spark, tmp_path):
    rows = spark.range(100).select(F.col("id").alias("chunk_id"), F.array(F.cos("id"), F.sin("id")).alias("vector"))
    asked = rows.limit(5).select(F.col("chunk_id").alias("qid"), F.col("vector").alias("qvec"))
    made = lanes.IvfIndex(rows)
    made.save(str(tmp_path / "ivf"), 3)
    again = lanes.IvfIndex.load(spark, str(tmp_path / "ivf"), 3)
    assert sorted(again.search(asked, 3).collect()) == sorted(made.search(asked, 3).collect())
    with pytest.raises(GraphStale):
        lanes.IvfIndex.load(spark, str(tmp_path / "ivf"), 4)
    with pytest.raises(GraphStale):
        lanes.IvfIndex.load(spark, str(tmp_path / "ivf"), 3, dim=5)
    made.rows.limit(3).write.mode("append").parquet(str(tmp_path / "ivf" / "rows"))
    with pytest.raises(SnapshotCorrupted):
        lanes.IvfIndex.load(spark, str(tmp_path / "ivf"), 3)


def test_locks(spark, tmp_path, monkeypatch):
    path = f"{tmp_path}/m/1.json"
    files.write_new(spark, path, {"a": 1})
    with pytest.raises(Busy):
        files.write_new(spark, path, {"a": 2})
    assert files.names(spark, f"{tmp_path}/m") == ["1.json"] and files.read_json(spark, path) == {"a": 1}
    held = tmp_path / "m" / "2.json.lock"
    held.touch()
    with pytest.raises(Busy):
        files.write_new(spark, f"{tmp_path}/m/2.json", {})
    monkeypatch.setattr(files, "STALE_SECONDS", -1)  # its writer has died
    files.write_new(spark, f"{tmp_path}/m/2.json", {})
    assert files.names(spark, f"{tmp_path}/m") == ["1.json", "2.json"]


def test_report(spark):
    rows = [(m, str(q), ("exact", "mixed")[q % 2], 0.5, 0.5, (0.9 if m == "hybrid" and q < 9 else 0.5)) for m in ("hybrid", "bm25") for q in range(12)]
    found = report.cells(spark.createDataFrame(rows, "mode string, qid string, type string, recall double, mrr double, ndcg double"))
    assert found["signs", "hybrid over bm25 all", "better"] == 9 and found["signs", "hybrid over bm25 all", "p"] == pytest.approx(2**-9)
    assert found["means", "hybrid exact", "ndcg"] == pytest.approx((5 * 0.9 + 0.5) / 6) and found["means", "bm25 all", "n"] == 12
    assert report.markdown(found).startswith("| means | n | recall | mrr | ndcg |")
    written = dict(found)
    assert report.differences(found, written) == []
    written["signs", "hybrid over bm25 all", "p"] = 0.004
    del written["means", "bm25 all", "n"]
    assert len(report.differences(found, written)) == 2


def test_filter_costs(spark):
    assert set(evaluate.filter_costs({"a": spark.range(10).filter("id < 3"), "b": spark.range(3)}, 2)) == {"a", "b"}
    with pytest.raises(InvalidInput):
        evaluate.filter_costs({"a": spark.range(10), "b": spark.range(3)})


def test_benchmark_assembly(spark):
    queries = spark.createDataFrame([(i, t) for i, t in enumerate(["检索引擎", "检索 v2 引擎", "检" * 20, "引擎", "无关内容呢"])], "qid long, query string")
    qrels = spark.createDataFrame([(0, 10, 3), (1, 10, 2), (2, 11, 2), (3, 10, 3), (4, 12, 2), (4, 13, 0)], "qid long, pid long, grade int")
    collection = spark.createDataFrame([(10, "检索引擎"), (11, "别的"), (12, "另外"), (13, "x"), (14, "y"), (15, "z")], "pid long, text string")
    chosen = benchmark.sample(queries, qrels, collection)
    assert {r.qid: r.bucket for r in chosen.collect()} == {0: "exact", 1: "mixed", 2: "natural", 4: "paraphrase"}
    assert benchmark.sample(queries, qrels, collection, 0).count() == 0
    picked = {r.pid for r in benchmark.corpus(chosen, qrels, collection, 5).collect()}
    assert {10, 11, 12, 13} < picked and len(picked) == 5
    assert benchmark.corpus(chosen, qrels, collection, 1).count() == 4
