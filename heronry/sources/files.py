"""Corpus and judgment files, reports, and small files on whatever file system a path names."""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import Busy, DecodeError, InvalidInput, StorageError

_CORPUS = "source string, text string, metadata string, dedup_key string, _corrupt_record string"
_JUDGMENTS = "qid string, query string, type string, relevance array<struct<source: string, grade: int>>, _corrupt_record string"
MAX_GRADE = 3


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, value) of the lines that are not blank; numbers are those of the file where there is one file."""
    rows = spark.read.text(path).withColumn("at", F.col("_metadata.file_path"))
    return rows.filter(F.trim("value") != "")


def _refuse(bad: DataFrame, what: str) -> None:
    first = bad.limit(1).collect()
    if first:
        raise DecodeError(f"{what}: {first[0]['value'][:200]}")


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """(source, text, metadata as JSON text, dedup_key) of JSON lines.

    Blank lines are skipped, a missing source is <unknown>; a line that is no JSON object or has no text, and a corpus
    without documents, are errors.
    """
    lines = _lines(spark, path)
    text = lambda name: F.get_json_object("value", f"$.{name}")
    parsed = F.try_parse_json("value")
    bad = lines.filter(parsed.isNull() | ~F.trim("value").startswith("{") | text("text").isNull())
    _refuse(bad, "a line without a JSON document that has a text")
    rows = lines.select(F.coalesce(text("source"), F.lit("<unknown>")).alias("source"), text("text").alias("text"), F.coalesce(text("metadata"), F.lit("{}")).alias("metadata"), text("dedup_key").alias("dedup_key"))
    if rows.isEmpty():
        raise InvalidInput("the corpus has no documents")
    return rows


def read_judgments(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(queries, judgments): (qid, query, type) and (qid, source, grade); grades are 0 to 3, and none may be empty."""
    rows = spark.read.schema(_JUDGMENTS).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(path).cache()
    grades = F.transform("relevance", lambda r: r["grade"])
    wrong = F.exists(grades, lambda g: g.isNull() | (g < 0) | (g > MAX_GRADE))
    bad = rows.filter(F.col("_corrupt_record").isNotNull() | F.col("qid").isNull() | F.col("query").isNull() | F.coalesce(F.size("relevance") < 1, F.lit(True)) | wrong)
    _refuse(bad.select(F.coalesce("_corrupt_record", F.to_json(F.struct("qid", "query", "relevance"))).alias("value")), "not a judgment")
    if rows.isEmpty():
        raise InvalidInput("there are no judgments")
    judged = rows.select("qid", F.explode("relevance").alias("r")).select("qid", "r.source", "r.grade")
    return rows.select("qid", "query", "type"), judged


def unknown_sources(judgments: DataFrame, docs: DataFrame) -> DataFrame:
    """(source) that is judged and not in the corpus."""
    return judgments.select("source").distinct().join(docs.select("source"), "source", "left_anti")


def repeated_sources(judgments: DataFrame, docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """(source, n_chunks) of judged sources with more than one chunk, of which evaluation takes the best."""
    counts = chunks.select("doc_id").join(docs.select("doc_id", "source"), "doc_id").groupBy("source").agg(F.count("*").alias("n_chunks"))
    return counts.filter("n_chunks > 1").join(judgments.select("source").distinct(), "source", "left_semi")


def hash_sample(rows: DataFrame, n: int, key: str, keep: Column | None = None) -> DataFrame:
    """The n rows (of those kept) with the smallest digests of `key`: the same ones in every run."""
    chosen = rows if keep is None else rows.filter(keep)
    return chosen.orderBy(F.md5(F.col(key).cast("string").cast("binary")), key).limit(n)


def synthetic_corpus(spark: SparkSession, n: int, topics: int = 20, words: int = 8, seed: int = 20) -> DataFrame:
    """Documents of invented topic words, with metadata of known selectivity, made where they are needed."""
    pick = lambda salt, m: F.pmod(F.xxhash64("id", F.lit(seed), F.lit(salt)), F.lit(m))
    topic = pick("topic", topics)
    body = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(23)), lambda i: F.concat(F.lit("t"), topic, F.lit("w"), F.pmod(F.xxhash64("id", i, F.lit(seed)), F.lit(words)))), " ")
    meta = F.to_json(
        F.struct(
            F.concat(F.lit("tenant"), pick("tenant", 10)).alias("tenant"), F.concat(F.lit("c"), pick("category", 50)).alias("category"), pick("score", 1000).alias("score"),
            (pick("sel", 1000) < 1).alias("sel_001"), (pick("sel", 1000) < 10).alias("sel_01"), (pick("sel", 1000) < 100).alias("sel_10"), F.concat(F.lit("topic"), topic).alias("topic"),
        )
    )
    return spark.range(n).select(F.col("id").alias("doc_id"), F.concat(F.lit("doc-"), F.col("id")).alias("source"), body.alias("text"), meta.alias("metadata"))


def _file_system(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


#: Seconds after which the lock of a writer that has not finished counts as left behind.
STALE_SECONDS = 600


def _locked(fs, lock, now_ms: int) -> bool:
    """Takes the lock; one that is older than STALE_SECONDS is taken over."""
    if fs.createNewFile(lock):
        return True
    try:
        old = now_ms - fs.getFileStatus(lock).getModificationTime() > 1000 * STALE_SECONDS
    except Exception:  # released meanwhile
        return fs.createNewFile(lock)
    return bool(old and fs.delete(lock, False) and fs.createNewFile(lock))


def write_new(spark: SparkSession, path: str, value: dict) -> None:
    """Creates a JSON file; raises Busy if it is there already, which makes it a compare-and-swap.

    The bytes are flushed to disk before the file gets its name. A lock lets one writer at a time through and goes with
    it, whether it succeeds or fails; that of a writer that died is taken over after STALE_SECONDS.
    """
    fs, at = _file_system(spark, path)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    scratch, lock = hadoop(f"{path}.{uuid.uuid4().hex}.tmp"), hadoop(f"{path}.lock")
    out = fs.create(scratch, True)
    out.write(bytearray(json.dumps(value, sort_keys=True).encode()))
    out.hsync()
    out.close()
    mine = False
    try:
        mine = not fs.exists(at) and _locked(fs, lock, int(time.time() * 1000))
        if not mine or fs.exists(at):
            raise Busy(f"{path} has been written by another writer")
        if not fs.rename(scratch, at):
            raise StorageError(f"{path} could not be written")
    finally:
        fs.delete(scratch, False)
        if mine:
            fs.delete(lock, False)


def read_json(spark: SparkSession, path: str) -> dict:
    fs, at = _file_system(spark, path)
    if not fs.exists(at):
        raise StorageError(f"there is no {path}")
    stream = fs.open(at)
    try:
        return json.loads(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    except ValueError as e:
        raise DecodeError(f"{path} is no JSON") from e
    finally:
        stream.close()


def stamps(spark: SparkSession, path: str) -> tuple:
    """(name, bytes, time) of a file or of a folder's files: another tuple means other contents."""
    fs, at = _file_system(spark, path)
    return tuple(sorted((s.getPath().getName(), s.getLen(), s.getModificationTime()) for s in fs.listStatus(at)))


def names(spark: SparkSession, folder: str) -> list[str]:
    fs, at = _file_system(spark, folder)
    return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []


def remove(spark: SparkSession, path: str) -> bool:
    """False if there was nothing."""
    fs, at = _file_system(spark, path)
    return fs.delete(at, True)


def json_report(tables: dict[str, DataFrame], config: dict) -> str:
    """Small result tables and their configuration as one JSON text."""
    return json.dumps({"config": config, **{name: [json.loads(r) for r in df.toJSON().collect()] for name, df in tables.items()}}, sort_keys=True, ensure_ascii=False)


def markdown_rows(names: list[str], rows: list[list], digits: int = 4) -> str:
    show = lambda v: "" if v is None else f"{v:.{digits}f}" if isinstance(v, float) else str(v)
    every = [names, ["---"] * len(names), *([show(v) for v in r] for r in rows)]
    return "\n".join("| " + " | ".join(r) + " |" for r in every)


def markdown_table(df: DataFrame, digits: int = 4) -> str:
    """A small result table as Markdown, rows in its own order."""
    return markdown_rows(df.columns, [list(r) for r in df.collect()], digits)
