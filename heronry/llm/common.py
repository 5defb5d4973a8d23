"""What the corpus operators share: text rules, folds, Arrow mapping and written stages."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..sources.scratch import scratch_dir as shared_dir

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
WORD_RE = re.compile(WORD)
#: The six ASCII white space bytes that separate words.
WHITE = b"\x20\x09\x0a\x0b\x0c\x0d"
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(text: str) -> str:
    """A-Z become a-z; other letters stay as they are."""
    return text.lower() if text.isascii() else text.encode().translate(_LOWER).decode()


def fold(column: str, modulus: int) -> Column:
    """crc32 of the value as text, modulo `modulus`; null counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus


def quoted(name: str) -> str:
    """A column's name as an expression, whatever it is made of."""
    return "`" + name.replace("`", "``") + "`"


def columns(docs: DataFrame) -> list[Column]:
    return [F.col(quoted(c)) for c in docs.columns]


def fresh(docs: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores as it takes to be unlike any column of `docs`."""
    taken, out = {c.lower() for c in docs.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


#: Spark's setting by which an action removes the shuffle files that it has made.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Actions within leave no shuffle files behind; otherwise these stay until the driver collects its garbage."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


#: Of each `removed_after` that is open: the folders written within.
_open: list[list[str]] = []


def removed(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def removed_after(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """What is written within is deleted at the end, but for the tables that the given function was called with."""
    _open.append([])
    kept: list[str] = []

    def keep(df: DataFrame) -> DataFrame:
        kept.append(df.__dict__["written_to"])
        return df

    try:
        yield keep
    finally:
        paths = _open.pop()
        if _open:
            _open[-1] += kept
        for path in set(paths) - set(kept):
            removed(spark, path)


def written(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """`df` written as Parquet to the shared folder and read again: later steps neither recompute it nor lose it with
    an executor."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with shuffles_removed(spark):
        df.write.option("compression", compression).parquet(path)
    if _open:
        _open[-1].append(path)
    back = spark.read.schema(df.schema).parquet(path)
    back.__dict__["written_to"] = path
    return back


#: Rows of an Arrow batch for whole texts, of which a task's JVM side and its worker hold a few at once.
TEXT_ROWS = 1000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession) -> None:
    """From now on the session's Arrow batches have TEXT_ROWS rows at most; a lower setting stays. It can't end with the
    call that sets it: what a stage returns is only run when the caller writes it."""
    if not 0 < int(spark.conf.get(_BATCH)) <= TEXT_ROWS:
        spark.conf.set(_BATCH, str(TEXT_ROWS))


def merged(df: DataFrame) -> DataFrame:
    """`df` as a side of a join that sorts and merges, whatever its size: a table that grows with the corpus is not
    gathered by the driver, as a broadcast would."""
    return df.hint("merge")


#: From so many rows on a key counts as hot.
HOT_ROWS = 1 << 20


def with_owners(rows: DataFrame, owners: DataFrame, key: str, size: str, spread: str) -> DataFrame:
    """`rows` inner-joined on `key` (a string) with `owners`, which have one row per key and in `size` how many rows do.

    A key that a third of all rows have would be one task's work. Owners of HOT_ROWS and more are therefore broadcast (at
    most one for each HOT_ROWS rows), and the rows of theirs go through the shuffle by `spread` instead.
    """
    names = [c for c in owners.columns if c != key]
    hot = owners.filter(F.col(size) >= HOT_ROWS).select(F.col(key), *(F.col(c).alias(f"hot_{c}") for c in names), F.lit(True).alias("is_hot"))
    cold = owners.filter(F.col(size) < HOT_ROWS).select(F.col(key).alias("cold_key"), *(F.col(c).alias(f"cold_{c}") for c in names), F.lit(True).alias("is_cold"))
    marked = rows.join(F.broadcast(hot), key, "left")
    place = F.when(F.col("is_hot"), F.concat(F.lit("hot "), F.xxhash64(spread).cast("string"))).otherwise(F.col(key))
    found = marked.withColumn("place", place).join(cold, F.col("place") == F.col("cold_key"), "left").filter("is_hot or is_cold")
    return found.select(*rows.columns, *(F.when(F.col("is_hot"), F.col(f"hot_{c}")).otherwise(F.col(f"cold_{c}")).alias(c) for c in names))


def map_streams(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """mapInArrow for columns of any names."""
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return fn(batch.rename_columns(names) for batch in batches)

    return df.toDF(*(f"c{i}" for i in range(len(names)))).mapInArrow(run, schema)


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str | StructType) -> DataFrame:
    """One Arrow batch in, one out, without keeping any."""
    return map_streams(df, lambda batches: (fn(batch) for batch in batches if batch.num_rows), schema)


def texts_of(batch: pa.RecordBatch, name: str = "text", rows: int = 256) -> Iterator[str]:
    """The column's strings, null as the empty one; only `rows` of them are Python objects at a time."""
    column = batch.column(name)
    for at in range(0, len(column), rows):
        for text in column.slice(at, rows).to_pylist():
            yield text or ""
