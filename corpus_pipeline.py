"""A training corpus from raw documents: stages that each apply one operator to all that the one before has kept.

Toxic documents go, exact copies and near duplicates leave one document each, the sources are mixed to their targets
(a document that is taken k times has k rows from there on), and what is left is encoded.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from heronry.llm import exact_dedup, mixing, pieces, simhash, toxicity
from heronry.llm.common import removed_after, small_batches, table, written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.clean(docs, table(spark, sf_dir, "labels"))


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.deduplicated(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.representatives(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.repeated(docs)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_pieces, ids, ids_sha256 and round_trip of every row."""
    return pieces.encode(docs, public_tokenizers.path("piece_bpe_32k.model"), keep=("doc_id", "source"))


def _with_small_batches(stage: Stage) -> Stage:
    """All stages share their executors, whose workers keep what they have once needed: so none takes large batches."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        small_batches(spark)
        return stage(spark, docs, sf_dir)

    return run


STAGES: list[tuple[str, Stage]] = [
    (name, _with_small_batches(stage))
    for name, stage in [
        ("toxicity", toxicity_stage),
        ("exact_dedup", exact_dedup_stage),
        ("near_dedup", near_dedup_stage),
        ("mixing", mixing_stage),
        ("encoding", encoding_stage),
    ]
]

#: The first, third and last stage are beyond SQL; tests hold every stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; of what the others write, only the input of the last is left behind."""
    docs = table(spark, sf_dir, "documents")
    with removed_after(spark) as keep:
        for name, stage in STAGES[:-1]:
            with removed_after(spark) as keep_stage:
                docs = keep_stage(written(stage(spark, docs, sf_dir), f"stage-{name}"))
        keep(docs)
    return STAGES[-1][1](spark, docs, sf_dir)
