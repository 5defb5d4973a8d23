"""The pipeline against plain versions of its stages."""

import re
from collections import Counter

import corpus_pipeline
import public_tokenizers
import sentencepiece
from test_llm_operators import ODD, frame, plain_groups, prose, rows_of
from test_resemblance import plain_representatives

from heronry.llm import mixing, toxicity


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "exact_dedup", "near_dedup", "mixing", "encoding"]
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")

    clean = stages["toxicity"](spark, docs, sf_dir).cache()
    bad = {r.doc_id for r in toxicity.score(docs, labels).filter("predicted = 1").collect()}
    assert clean.columns == docs.columns and sorted(clean.collect()) == sorted(r for r in docs.collect() if r.doc_id not in bad)

    exact = stages["exact_dedup"](spark, clean, sf_dir).cache()
    keep = {g[1] for g in plain_groups(rows_of(clean))}
    assert exact.columns == docs.columns and sorted(exact.collect()) == sorted(r for r in clean.collect() if r.doc_id in keep)

    near = stages["near_dedup"](spark, exact, sf_dir).cache()
    stays = plain_representatives(rows_of(exact))
    assert near.columns == docs.columns and sorted(near.collect()) == sorted(r for r in exact.collect() if r.doc_id in stays)

    mixed = stages["mixing"](spark, near, sf_dir).cache()
    times = {r.doc_id: r.taken // r.size for r in mixing.mixed(near).collect() if r.taken}
    assert mixed.columns == docs.columns and Counter(r.doc_id for r in mixed.collect()) == times

    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    texts = dict(rows_of(mixed))
    for r in stages["encoding"](spark, mixed, sf_dir).collect():
        assert r.ids == library.encode(texts[r.doc_id]) and r.round_trip

    whole = corpus_pipeline.run(spark, sf_dir)
    digest = lambda df: sorted((r.doc_id, r.ids_sha256) for r in df.select("doc_id", "ids_sha256").collect())
    assert digest(whole) == digest(stages["encoding"](spark, mixed, sf_dir))


def test_odd_tables(spark, sf_dir):
    for docs in (frame(spark, ODD), frame(spark, [prose(30)] * 5, ids=[1, 1, None, None, 2]), frame(spark, ["x"]).limit(0)):
        got = docs
        for _, stage in corpus_pipeline.STAGES[:-1]:
            got = stage(spark, got, sf_dir)
            assert got.columns == docs.columns
            got = got.cache()
        assert corpus_pipeline.STAGES[-1][1](spark, got, sf_dir).count() == got.count()


def test_nothing_else_imports_the_operators():
    from pathlib import Path

    top = Path(corpus_pipeline.__file__).parent
    for f in (top / "heronry").rglob("*.py"):
        if "llm" not in f.parts:
            assert not re.search(r"(from|import) .*\bllm\b", f.read_text()), f

