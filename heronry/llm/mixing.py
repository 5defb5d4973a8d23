"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Each source gets a target in words. It is taken whole as often as that fits (complete epochs); the rest comes from one
weighted sample without replacement: documents in the order of their exponential keys -ln(u)/quality until the words
are reached. Running totals are taken in three steps (coarse bins, fine bins, documents of a bin), so that a source
with a third of all rows is no single task's work. Bins have equal width in the logarithm of the keys: whatever the
qualities, no more than a share of 0.37 times that width of a source's keys is expected in one.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, columns, fresh, quoted, removed_after, written

#: No source is taken more often than this.
MAX_EPOCHS = 3
SEED = 17
#: The least quality that a document counts as.
LEAST_QUALITY = 0.05
#: Rows that a fine bin of a source's keys is meant for.
BIN_ROWS = 128


def sizes(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs` with size (words) and quality: the share of letters among the text's characters, 0.05 at least."""
    body = F.coalesce(F.col(text), F.lit(""))
    letters = F.length(F.regexp_replace(body, r"\P{L}+", ""))
    quality = F.greatest(F.lit(LEAST_QUALITY), letters.cast("double") / F.greatest(F.length(body), F.lit(1)))
    return docs.withColumn("size", F.regexp_count(body, F.lit(WORD)).cast("long")).withColumn("quality", quality)


def _ranked(totals: DataFrame) -> DataFrame:
    """`totals` with rank, from 0 in the order of the sources' code points, null last: sorted by range, each partition's
    rows numbered after those of the partitions before it."""
    ranged = written(totals.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id()), "sources")
    before, rows = 0, []
    for part, n in sorted(tuple(r) for r in ranged.groupBy("part").count().collect()):  # a row per partition
        rows.append((part, before))
        before += n
    offsets = F.broadcast(totals.sparkSession.createDataFrame(rows, "part int, before long"))
    within = F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last())) - 1
    return ranged.withColumn("within", within).join(offsets, "part").withColumn("rank", F.col("before") + F.col("within")).drop("part", "within", "before")


def targets(totals: DataFrame, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """source, source_size, target from (source, source_size).

    Sources weigh 1, 2, 3, 1, ... in the order of their names (code points, null last) and share the sum of all
    sizes; none gets more than `max_epochs` times its size, and what is above goes to the others by weight. So targets
    are min(cap, level * weight): the level rises with each round in which sources turn out to be full, until none
    does. Each round is two sums. No sources: no rows; sources without words have a target of 0.
    """
    weighed = _ranked(totals.select("source", "source_size")).withColumn("weight", (F.col("rank") % 3 + 1).cast("long"))
    weighed = written(weighed.withColumn("cap", F.col("source_size") * max_epochs).drop("rank"), "weighed")
    whole, weights = weighed.agg(F.sum("source_size"), F.sum("weight")).first()
    level, before = (whole or 0) / (weights or 1), None
    while level != before:
        before = level
        full = F.col("cap") / F.col("weight") <= F.lit(level)
        caps, weights = weighed.agg(F.sum(F.when(full, F.col("cap"))), F.sum(F.when(~full, F.col("weight")))).first()
        if weights:
            level = (whole - (caps or 0)) / weights
    full = F.col("cap") / F.col("weight") <= F.lit(level)
    return weighed.select("source", "source_size", F.when(full, F.col("cap").cast("double")).otherwise(F.col("weight") * F.lit(level)).alias("target"))


def mix(sized: DataFrame, doc_id: str = "doc_id", seed: int = SEED, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(doc_id, size, source_size, target, taken) for rows of (doc_id, source, size, quality).

    taken is the number of the document's words in the mix, repeats counted: whole epochs, and once more if the
    sample has it. The document at the edge of the sample is in if that brings the source nearer to its target. Keys
    hang on doc_id, quality and the seed alone, so reruns agree; ties (repeated or null doc_id) go by size, and equal
    rows stand for one another. A null source is a source of its own. Empty documents take nothing; a table of empty
    texts has targets of 0; an empty table gives no rows.
    """
    with removed_after(sized.sparkSession) as keep:
        return keep(written(_mix(sized, doc_id, seed, max_epochs), "mix"))


def _mix(sized: DataFrame, doc_id: str, seed: int, max_epochs: int) -> DataFrame:
    # 52 bits of a digest as a number in (0, 1)
    digest = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))).cast("binary")), 1, 13), 16, 10)
    u = (digest.cast("double") + 0.5) / float(1 << 52)
    rows = sized.select(F.col(doc_id).cast("long").alias("doc_id"), "source", "size", (-F.log(u) / F.col("quality")).alias("key"))
    rows = written(rows, "sizes")
    totals = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    goal = targets(totals.select("source", "source_size"), max_epochs)
    epochs = F.least(F.floor(F.col("target") / F.greatest("source_size", F.lit(1))), F.lit(max_epochs)).cast("long")
    goal = written(goal.withColumn("epochs", epochs).withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size")), "targets")

    # the logarithm of a key of any quality has a density of 1/e at most: bins so narrow hold about BIN_ROWS rows at most
    largest = totals.agg(F.max("n")).first()[0] or 1
    per_unit = max(1.0, largest / math.e / BIN_ROWS)
    side = max(1, math.ceil(math.sqrt(per_unit)))
    binned = rows.withColumn("fine", F.floor(F.log("key") * per_unit).cast("long"))
    by_bin = binned.groupBy("source", "fine").agg(F.sum("size").alias("words")).withColumn("coarse", F.floor(F.col("fine") / side))
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    within = before(Window.partitionBy("source", "coarse").orderBy("fine"))
    across = before(Window.partitionBy("source").orderBy("coarse"))
    coarse = by_bin.groupBy("source", "coarse").agg(F.sum("words").alias("words"))
    coarse = coarse.select(F.col("source").alias("s"), F.col("coarse").alias("c"), F.coalesce(F.sum("words").over(across), F.lit(0)).alias("far"))
    fine = by_bin.withColumn("near", F.coalesce(F.sum("words").over(within), F.lit(0)))
    fine = fine.join(coarse, F.col("source").eqNullSafe(F.col("s")) & (F.col("coarse") == F.col("c")))
    fine = fine.select(F.col("source").alias("s"), F.col("fine").alias("f"), (F.col("far") + F.col("near")).alias("before"))

    placed = binned.join(fine, F.col("source").eqNullSafe(F.col("s")) & (F.col("fine") == F.col("f"))).drop("s", "f")
    order = before(Window.partitionBy("source", "fine").orderBy("key", "doc_id", "size"))
    placed = placed.withColumn("before", F.col("before") + F.coalesce(F.sum("size").over(order), F.lit(0)))
    goal = goal.withColumnRenamed("source", "s")
    joined = placed.join(goal, F.col("source").eqNullSafe(F.col("s")))
    sampled = F.when(F.col("before") + F.col("size") / 2 <= F.col("rest"), 1).otherwise(0)
    taken = F.col("size") * F.least(F.col("epochs") + sampled, F.lit(max_epochs))
    return joined.select("doc_id", "source", "size", "source_size", "target", taken.cast("long").alias("taken"))


def mixed(docs: DataFrame, text: str = "text", **options) -> DataFrame:
    """The mix of a documents table (doc_id, source, text): doc_id, source, size, source_size, target, taken of every
    row; see `mix` for ties, repeated rows and empty tables. Null texts are empty, texts of any length count whole,
    further columns are not looked at."""
    return mix(sizes(docs.select("doc_id", "source", text), text), **options)


def repeated(docs: DataFrame, text: str = "text", **options) -> DataFrame:
    """The mixed corpus itself: every row of `docs` as often as the mix takes it, with all its columns, of whatever names.

    Rows alike in doc_id, source and size (null texts have none, as empty ones) are taken as often as the first of
    them; a null doc_id or source is a value like any other. Texts of any length are counted whole. An empty table
    gives no rows.
    """
    ident, name, size, times, copy = fresh(docs, "ident", "name", "size", "times", "copy")
    taken = mixed(docs, text, **options).filter("taken > 0")
    taken = taken.groupBy(F.col("doc_id").alias(ident), F.col("source").alias(name), F.col("size").alias(size)).agg(F.max(F.round(F.col("taken") / F.col("size"))).cast("int").alias(times))
    words = F.regexp_count(F.coalesce(docs[quoted(text)], F.lit("")), F.lit(WORD))
    same = docs["doc_id"].cast("long").eqNullSafe(F.col(ident)) & docs["source"].eqNullSafe(F.col(name)) & (words == F.col(size))
    return docs.join(taken, same).withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(times)))).select(columns(docs))
