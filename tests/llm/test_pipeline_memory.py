"""What the pipeline's stages keep small: Arrow batches, and what the driver gathers."""

import random

import corpus_pipeline
import pyarrow as pa
import pytest
from test_llm_operators import frame, prose

from heronry.llm import common, simhash

BATCH, BROADCAST = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.autoBroadcastJoinThreshold"


@pytest.mark.parametrize(("given", "most"), [("10000", common.TEXT_ROWS), ("0", common.TEXT_ROWS), ("50", 50)])
def test_small_batches(spark, sf_dir, given, most):
    before = spark.conf.get(BATCH)
    spark.conf.set(BATCH, given)
    try:
        kept = dict(corpus_pipeline.STAGES)["near_dedup"](spark, frame(spark, ["a b c", "a b c", "d e f"]), sf_dir)
        sizes = lambda batches: (pa.RecordBatch.from_pydict({"n": [b.num_rows]}) for b in batches)
        rows = spark.range(0, 2 * common.TEXT_ROWS + 1, 1, 1).mapInArrow(sizes, "n long").collect()
        assert max(r.n for r in rows) == most and sum(r.n for r in rows) == 2 * common.TEXT_ROWS + 1
        assert kept.count() == 2
    finally:
        spark.conf.set(BATCH, before)


def test_near_dedup_broadcasts_nothing(spark, monkeypatch):
    plans, write = [], common.written

    def written(df, name, *more):
        plans.append((name, df._jdf.queryExecution().executedPlan().toString()))
        return write(df, name, *more)

    for module in ("simhash", "resemblance", "graph"):
        monkeypatch.setattr(f"heronry.llm.{module}.written", written)
    before = spark.conf.get(BROADCAST)
    spark.conf.set(BROADCAST, "1g")
    try:
        texts = [prose(40, random.Random(seed)) + end for seed in range(30) for end in ("", " more")]
        kept = simhash.representatives(frame(spark, texts))
        plans.append(("returned", kept._jdf.queryExecution().executedPlan().toString()))
        assert kept.count() == 30
    finally:
        spark.conf.set(BROADCAST, before)
    assert len(plans) > 10 and [name for name, plan in plans if "BroadcastExchange" in plan] == []
