"""A retrieval benchmark cut from a larger collection: stable query sample by bucket, judged passages, and filler."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import Analyzer, StandardAnalyzer, coverage, query_bucket

#: Queries have so many code points, and at least one passage of this grade.
QUERY_CHARS, MIN_GRADE = (4, 40), 2
PER_BUCKET, CORPUS = 80, 12_000


def candidates(queries: DataFrame, qrels: DataFrame) -> DataFrame:
    """The queries (qid, query) of usable length that have a good passage."""
    good = qrels.filter(F.col("grade") >= MIN_GRADE).select("qid").distinct()
    return queries.filter(F.length(F.trim("query")).between(*QUERY_CHARS)).join(good, "qid", "left_semi")


def term_overlap(queries: DataFrame, qrels: DataFrame, collection: DataFrame, analyzer: Analyzer | None = None) -> DataFrame:
    """(qid, overlap): the largest share of a query's terms that a relevant passage has; 0 without one."""
    a = analyzer or StandardAnalyzer()
    judged = qrels.filter("grade >= 1").join(collection, "pid").join(queries, "qid")
    best = judged.groupBy("qid").agg(F.max(coverage(a.query(F.col("query")), a.document(F.col("text")))).alias("overlap"))
    return queries.select("qid").join(best, "qid", "left").select("qid", F.coalesce("overlap", F.lit(0.0)).alias("overlap"))


def sample(queries: DataFrame, qrels: DataFrame, collection: DataFrame, per_bucket: int = PER_BUCKET) -> DataFrame:
    """(qid, query, bucket): of each bucket the queries with the smallest digests, the same in every run."""
    usable = candidates(queries, qrels)
    bucketed = usable.join(term_overlap(usable, qrels, collection), "qid").withColumn("bucket", query_bucket(F.col("query"), F.col("overlap")))
    order = Window.partitionBy("bucket").orderBy(F.md5(F.col("qid").cast("string").cast("binary")), "qid")
    return bucketed.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= per_bucket).select("qid", "query", "bucket")


def corpus(chosen: DataFrame, qrels: DataFrame, collection: DataFrame, size: int = CORPUS) -> DataFrame:
    """(pid, text): all passages judged for the chosen queries, filled up by smallest digest to `size` (more, if more
    are judged)."""
    judged = qrels.join(chosen.select("qid"), "qid", "left_semi").select("pid").distinct().withColumn("judged", F.lit(True))
    marked = collection.join(judged, "pid", "left")
    needed = size - marked.filter("judged").count()
    rest = marked.filter("judged IS NULL").orderBy(F.md5(F.col("pid").cast("string").cast("binary")), "pid").limit(max(0, needed))
    return marked.filter("judged").unionByName(rest).select("pid", "text")
