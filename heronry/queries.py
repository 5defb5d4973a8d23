"""Every operator as a query over the driver's tables, with SQL that gives the same rows.

The corpus is `documents`, one chunk each, with `embeddings` as vectors of the chunks of the same number. All
`benchmark` texts are queries, their vectors those of the same number. Scores are given to six digits.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import filters, text, vectors
from .functions.filters import And, Eq, Or, Range
from .operators import evaluate, explain, fusion, ingest, lanes, post
from .plans.engine import Adaptive, Mode, Searcher
from .plans.index import Index
from .sources import files
from .sources.scratch import kept, scratch_dir
from .sources.store import Store

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

NOW_MS = 1_750_000_000_000


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def named(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return named


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents")


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"))


def _queries(spark: SparkSession, sf_dir: str, with_vectors: bool = True) -> DataFrame:
    asked = _table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("query"))
    if not with_vectors:
        return asked
    return asked.join(_vectors(spark, sf_dir).select(F.col("chunk_id").alias("qid"), F.col("vector").alias("qvec")), "qid", "left")


def _build(spark: SparkSession, sf_dir: str) -> Index:
    meta = F.to_json(F.struct("lang", "source", "n_chars"))
    docs = _docs(spark, sf_dir)
    held = _vectors(spark, sf_dir).join(docs.select(F.col("doc_id").alias("chunk_id")), "chunk_id", "left_semi")
    return Index.of_texts(docs, source=F.col("source"), metadata=meta, vectors=held)


_opened: dict[tuple, Index] = {}


def _index(spark: SparkSession, sf_dir: str) -> Index:
    """The index of a folder's documents, whose forward table is written by the first query of a session that needs it
    and read by the others, as long as the documents stay the files they were."""
    found = files.stamps(spark, f"{sf_dir}/documents.parquet")
    key = (spark.sparkContext.applicationId, sf_dir, found)
    if key not in _opened:
        _opened[key] = _build(spark, sf_dir).saved()
    return _opened[key]


def _six(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names or ("score",)})


def _hits(df: DataFrame) -> DataFrame:
    return _six(df.select("qid", F.col("rank").cast("int").alias("rank"), "chunk_id", "score"))


# SQL building blocks

_STOPS = "[" + ", ".join(f"'{w}'" for w in text.STOP_WORDS) + "]"


def _terms(column: str) -> str:
    return rf"list_filter(regexp_extract_all(lower(coalesce({column}, '')), '[\p{{L}}\p{{N}}]+'), lambda t: length(t) <= 32 AND NOT list_contains({_STOPS}, t))"


_CORPUS = f"""tok AS (SELECT doc_id AS chunk_id, unnest({_terms("text")}) AS term FROM documents),
post AS (SELECT chunk_id, term, count(*) AS tf FROM tok GROUP BY ALL),
dl AS (SELECT doc_id AS chunk_id, len({_terms("text")}) AS dl FROM documents),
df AS (SELECT term, count(*) AS df FROM post GROUP BY term),
st AS (SELECT count(*) AS n, sum(dl) AS total_len, sum(dl) / count(*) AS avgdl FROM dl)"""
_Q = f"""q AS (SELECT item_id AS qid, text AS query FROM benchmark),
qt AS (SELECT qid, term, count(*) AS qtf FROM (SELECT qid, unnest({_terms("query")}) AS term FROM q) GROUP BY ALL)"""


def _bm25(name: str = "bm", qt: str = "qt", where: str = "", k: int | None = 30, k1: str = "1.5", b: str = "0.75", extra: str = "", source: str = "") -> str:
    group = f"{extra}qid, chunk_id"
    cut = f" QUALIFY rank <= {k}" if k else ""
    return f"""{name}_s AS (SELECT {group}, sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * ({k1}::DOUBLE + 1) / (tf + {k1}::DOUBLE * (1 - {b}::DOUBLE + {b}::DOUBLE * dl / avgdl))) AS score
  FROM {qt} JOIN post USING (term) JOIN df USING (term) JOIN dl USING (chunk_id), st{source} {where} GROUP BY {group}),
{name} AS (SELECT *, row_number() OVER (PARTITION BY {extra}qid ORDER BY round(score, 9) DESC, chunk_id)::INTEGER AS rank FROM {name}_s{cut})"""


_UNIT = """unit AS (SELECT vec_id AS chunk_id, label, CASE WHEN n = 0 OR abs(n - 1) <= 1e-6 THEN e ELSE list_transform(e, lambda x: x / n) END AS v
  FROM (SELECT vec_id, label, embedding::DOUBLE[] AS e, sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings))"""


def _vec(name: str = "vec", where: str = "", k: int = 30, asked: str = "SELECT qid, v AS qv FROM q JOIN unit ON qid = chunk_id") -> str:
    return f"""{name}_q AS ({asked}),
{name} AS (SELECT qid, chunk_id, score, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, chunk_id)::INTEGER AS rank
  FROM (SELECT qid, chunk_id, list_inner_product(v, qv) AS score FROM {name}_q, unit {where}) QUALIFY rank <= {k})"""


def _fuse(name: str = "fused", weight: str = "CASE lane_idx WHEN 0 THEN 1.0 ELSE 1.5 END", k: int | None = 10, lanes_sql: str = "lanes", rrf_k: int = 60) -> str:
    cut = f" QUALIFY rank <= {k}" if k else ""
    return f"""{name} AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, chunk_id)::INTEGER AS rank
  FROM (SELECT qid, chunk_id, sum(({weight})::DOUBLE / ({rrf_k} + rank)) AS score FROM {lanes_sql} GROUP BY ALL){cut})"""


_LANES = "lanes AS (SELECT qid, 0 AS lane_idx, chunk_id, score, rank FROM bm UNION ALL SELECT qid, 1, chunk_id, score, rank FROM vec)"
_HYBRID = ",\n".join([_CORPUS, _Q, _bm25(), _UNIT, _vec(where="WHERE chunk_id IN (SELECT doc_id FROM documents)"), _LANES])
_OUT = "SELECT qid, rank, chunk_id, round(score, 6) AS score FROM"


def _sql(*parts: str, select: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n" + select


def _both_lanes(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Searcher(_index(spark, sf_dir))
    return fusion.stacked(list(s.lanes(_queries(spark, sf_dir), Mode.HYBRID, 30)))


# text analysis and statistics


@query(_sql(f"t AS (SELECT doc_id, {_terms('text')} AS terms FROM documents)", select="SELECT doc_id, len(terms)::INTEGER AS n_terms, len(list_distinct(terms))::INTEGER AS n_distinct FROM t"))
def tokenize_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ingest.analyzed(_docs(spark, sf_dir), chunk_id="doc_id")
    return found.select(F.col("chunk_id").alias("doc_id"), F.col("dl").cast("int").alias("n_terms"), F.size("terms").alias("n_distinct"))


@query(_sql(_CORPUS, select="SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf FROM post GROUP BY term"))
def term_df(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _index(spark, sf_dir).postings.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


@query(
    _sql(
        f"t AS (SELECT doc_id, {_terms('text')} AS terms FROM documents), p AS (SELECT doc_id, unnest(terms) AS term, unnest(range(len(terms))) AS pos FROM t)",
        select="SELECT doc_id AS chunk_id, term, count(*) AS tf, min(pos)::INTEGER AS first_position, max(pos)::INTEGER AS last_position FROM p GROUP BY ALL",
    )
)
def term_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    posted = ingest.postings(_docs(spark, sf_dir), positions=True, chunk_id="doc_id")
    return posted.select("chunk_id", "term", "tf", F.element_at("positions", 1).alias("first_position"), F.element_at("positions", -1).alias("last_position"))


@query(_sql(_CORPUS, select="SELECT chunk_id, dl::BIGINT AS dl FROM dl"))
def chunk_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _index(spark, sf_dir).lengths


@query(_sql(_CORPUS, select="SELECT (SELECT count(*) FROM documents) AS num_docs, n AS num_chunks, total_len::BIGINT AS total_len, round(avgdl, 6) AS avgdl FROM st"))
def corpus_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _six(_index(spark, sf_dir).counters(), "avgdl")


@query(
    _sql(
        rf"t AS (SELECT lang, len(regexp_extract_all(lower(coalesce(text, '')), '[\p{{L}}\p{{N}}]+')) AS r, len({_terms('text')}) AS k FROM documents)",
        select="SELECT lang, sum(r)::BIGINT AS n_raw, sum(k)::BIGINT AS n_kept FROM t GROUP BY lang",
    )
)
def stopword_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw, kept = F.size(text.latin_terms(F.lower(F.coalesce("text", F.lit(""))))), F.size(text.StandardAnalyzer().document(F.col("text")))
    return _docs(spark, sf_dir).groupBy("lang").agg(F.sum(raw).alias("n_raw"), F.sum(kept).alias("n_kept"))


@query()
def nfkc_analyzer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n_terms, n_lemmas) by the normalising and by the second analyzer."""
    n = lambda a: F.size(a.document(F.col("text")))
    return _docs(spark, sf_dir).select("doc_id", n(text.StandardAnalyzer(normalize=True)).alias("n_terms"), n(text.LemmaAnalyzer()).alias("n_lemmas"))


# filters

_CHARS = "n_chars >= 1000 AND n_chars < 3000"
_RANGE = Range("n_chars", 1000, 3000)


def _kept(spark: SparkSession, sf_dir: str, where: filters.Filter) -> DataFrame:
    docs = _docs(spark, sf_dir)
    return docs.filter(filters.predicate(where, columns={c: F.col(c) for c in docs.columns})).select("doc_id")


@query("SELECT doc_id FROM documents WHERE lang = 'de'")
def filter_eq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _kept(spark, sf_dir, filters.parse("lang=de"))


@query(f"SELECT doc_id FROM documents WHERE {_CHARS}")
def filter_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _kept(spark, sf_dir, filters.parse("n_chars>=1000,n_chars<3000"))


@query(f"SELECT doc_id FROM documents WHERE (lang = 'fr' OR lang = 'es') AND ({_CHARS})")
def filter_and_or(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _kept(spark, sf_dir, And((Or((Eq("lang", "fr"), Eq("lang", "es"))), _RANGE)))


@query("SELECT event_id FROM events WHERE json_extract_string(props, '$.k') = '69'")
def filter_json_eq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "events").filter(filters.predicate(Eq("k", "69"), F.col("props"))).select("event_id")


@query("SELECT event_id FROM events WHERE json_type(props, '$.k') IN ('UBIGINT', 'BIGINT', 'DOUBLE') AND CAST(json_extract_string(props, '$.k') AS DOUBLE) >= 20 AND CAST(json_extract_string(props, '$.k') AS DOUBLE) < 40")
def filter_json_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "events").filter(filters.predicate(Range("k", 20, 40), F.col("props"))).select("event_id")


@query("SELECT p_partkey FROM part WHERE p_brand = 'Brand#13'")
def namespace_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = _table(spark, sf_dir, "part")
    return part.filter(filters.predicate(filters.namespace("Brand#13"), columns={"namespace": F.col("p_brand")})).select("p_partkey")


@query(f"SELECT lang, count(*) AS allowed FROM documents WHERE {_CHARS} GROUP BY lang")
def allowed_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    return docs.filter(filters.predicate(_RANGE, columns={"n_chars": F.col("n_chars")})).groupBy("lang").agg(F.count("*").alias("allowed"))


@query("SELECT 'k' AS field, count(DISTINCT json_extract_string(props, '$.k')) > 1024 AS degraded FROM events")
def field_degraded(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = _table(spark, sf_dir, "events").select(filters.json_text(F.col("props"), "k").alias("v")).filter("v is not null").distinct().limit(filters.MAX_KEYS + 1)
    return values.agg(F.lit("k").alias("field"), (F.count("v") > filters.MAX_KEYS).alias("degraded"))


# lanes


@query(_sql(_CORPUS, _Q, _bm25(k=10), select=f"{_OUT} bm"))
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = _index(spark, sf_dir)
    return _hits(lanes.bm25(_queries(spark, sf_dir, False), i.postings, i.lengths))


@query(_sql(_CORPUS, _Q, "qd AS (SELECT qid, term, 2 * qtf AS qtf FROM qt)", _bm25(qt="qd", k=10), select=f"{_OUT} bm"))
def bm25_dup_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = _index(spark, sf_dir)
    twice = _queries(spark, sf_dir, False).withColumn("query", F.concat_ws(" ", "query", "query"))
    return _hits(lanes.bm25(twice, i.postings, i.lengths))


@query(_sql(_CORPUS, _Q, _bm25(k=10, where="WHERE chunk_id IN (SELECT doc_id FROM documents WHERE lang = 'en' AND n_chars >= 1000)"), select=f"{_OUT} bm"))
def bm25_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = _index(spark, sf_dir)
    allowed = i.candidates(And((Eq("lang", "en"), Range("n_chars", gte=1000))))
    return _hits(lanes.bm25(_queries(spark, sf_dir, False), i.postings, i.lengths, candidates=allowed))


@query(_sql(_CORPUS, _Q, select="SELECT q.qid, count(qt.term) AS n_terms, count(df.term) AS n_hit, count(df.term) > 0 AS any_hit FROM q LEFT JOIN qt USING (qid) LEFT JOIN df USING (term) GROUP BY q.qid"))
def term_hit_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lanes.term_hits(_queries(spark, sf_dir, False), _index(spark, sf_dir).postings)


@query(_sql(_UNIT, select="SELECT chunk_id AS vec_id, round(list_sum(v), 6) AS total, round(sqrt(list_inner_product(v, v)), 6) AS norm FROM unit"))
def l2_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    unit = _vectors(spark, sf_dir).select("chunk_id", vectors.normalize(F.col("vector")).alias("v"))
    total = F.aggregate("v", F.lit(0.0), lambda s, x: s + x)
    return unit.select(F.col("chunk_id").alias("vec_id"), F.round(total, 6).alias("total"), F.round(F.sqrt(vectors.dot(F.col("v"), F.col("v"))), 6).alias("norm"))


@query(
    _sql(
        _UNIT, "p AS (SELECT a.chunk_id, a.v, b.v AS w FROM unit a JOIN unit b ON b.chunk_id = a.chunk_id + 1)",
        select="SELECT chunk_id, round(list_inner_product(v, w), 6) AS cosine, round(1 - list_sum(list_transform(list_zip(v, w), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) / 2, 6) AS from_distance FROM p",
    )
)
def score_conversion(spark: SparkSession, sf_dir: str) -> DataFrame:
    unit = _vectors(spark, sf_dir).select("chunk_id", vectors.normalize(F.col("vector")).alias("v"))
    pairs = unit.join(unit.select((F.col("chunk_id") - 1).alias("chunk_id"), F.col("v").alias("w")), "chunk_id")
    a, b = F.col("v"), F.col("w")
    return pairs.select("chunk_id", F.round(vectors.dot(a, b), 6).alias("cosine"), F.round(vectors.score_of_distance(vectors.squared_distance(a, b)), 6).alias("from_distance"))


@query(_sql(_Q, _UNIT, _vec(k=10), select=f"{_OUT} vec"))
def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hits(lanes.exact_vectors(_queries(spark, sf_dir), _vectors(spark, sf_dir), 10))


@query(_sql(_Q, _UNIT, _vec(k=10, where="WHERE label IN (1, 3)"), select=f"{_OUT} vec"))
def vector_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings")
    allowed = rows.filter(filters.predicate(Or((Eq("label", "1"), Eq("label", "3"))), columns={"label": F.col("label")})).select(F.col("vec_id").alias("chunk_id"))
    return _hits(lanes.exact_vectors(_queries(spark, sf_dir), _vectors(spark, sf_dir), 10, allowed))


@query(_sql(_UNIT, _vec(k=5, asked="SELECT chunk_id AS qid, v AS qv FROM unit"), select=f"{_OUT} vec"))
def vector_batch_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _vectors(spark, sf_dir)
    return _hits(lanes.exact_vectors(rows.select(F.col("chunk_id").alias("qid"), F.col("vector").alias("qvec")), rows, 5))


@query(
    """SELECT label, count(*) AS allowed, CASE WHEN count(*) <= 200 THEN 'exact' ELSE 'ann' END AS vector_route FROM embeddings GROUP BY label
UNION ALL SELECT NULL, count(*), 'ann' FROM embeddings"""
)
def route_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The route of a filter on each label, with a threshold that these tables reach, and that without a filter."""
    counts = _table(spark, sf_dir, "embeddings").rollup("label").agg(F.count("*").alias("allowed"), F.grouping("label").alias("g"))
    exact = F.lit(lanes.route(True, 1, 200))
    return counts.select("label", "allowed", F.when((F.col("g") == 0) & (F.col("allowed") <= 200), exact).otherwise(lanes.route(False, 0)).alias("vector_route"))


@query()
def ann_ivf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hits(lanes.IvfIndex(_vectors(spark, sf_dir)).search(_queries(spark, sf_dir), 10))


@query()
def ann_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    exact = lanes.exact_vectors(_queries(spark, sf_dir), _vectors(spark, sf_dir), 10)
    return lanes.overlap_at_k(lanes.IvfIndex(_vectors(spark, sf_dir)).search(_queries(spark, sf_dir), 10), exact, 10)


# fusion


@query(_sql(_HYBRID, _fuse(), select=f"{_OUT} fused"))
def rrf_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hits(fusion.rrf(_both_lanes(spark, sf_dir)))


@query(_sql(_HYBRID, _fuse(weight="2.0", rrf_k=20), select=f"{_OUT} fused"))
def rrf_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One weight for all lanes, and another constant."""
    return _hits(fusion.rrf(_both_lanes(spark, sf_dir), rrf_k=20, weights=(2.0,)))


@query(
    _sql(
        _HYBRID, "top AS (SELECT qid, lane_idx, CASE WHEN abs(score) < 1.1920929e-07 THEN 1.0 ELSE score END AS top FROM lanes WHERE rank = 1)",
        "w AS (SELECT qid, chunk_id, sum(CASE lane_idx WHEN 0 THEN 1.0::DOUBLE ELSE 1.5::DOUBLE END * score / top) AS score FROM lanes JOIN top USING (qid, lane_idx) GROUP BY ALL)",
        select=f"{_OUT} (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, chunk_id)::INTEGER AS rank FROM w QUALIFY rank <= 10)",
    )
)
def weighted_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hits(fusion.weighted(_both_lanes(spark, sf_dir)))


_SIGNAL = "sig AS (SELECT qid, count(b.chunk_id) / 10.0::DOUBLE AS signal FROM (SELECT * FROM lanes WHERE lane_idx = 0 AND rank <= 10) a FULL JOIN (SELECT DISTINCT qid FROM lanes) USING (qid) LEFT JOIN (SELECT * FROM lanes WHERE lane_idx = 1 AND rank <= 10) b USING (qid, chunk_id) GROUP BY qid)"
_TWO = "two AS (SELECT qid FROM lanes GROUP BY qid HAVING count(DISTINCT lane_idx) > 1)"


@query(_sql(_HYBRID, _SIGNAL, select="SELECT qid, signal AS overlap FROM sig"))
def lane_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = _both_lanes(spark, sf_dir)
    return lanes.overlap_at_k(both.filter("lane_idx = 0"), both.filter("lane_idx = 1"), 10)


@query(_sql(_CORPUS, _Q, select="SELECT q.qid, CASE WHEN count(qt.term) > 0 THEN count(df.term) / count(qt.term) ELSE 0.0 END::DOUBLE AS signal FROM q LEFT JOIN qt USING (qid) LEFT JOIN df USING (term) GROUP BY q.qid"))
def df_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.coverage_signal(term_hit_probe(spark, sf_dir))


@query("SELECT item_id AS qid, regexp_matches(text, '[A-Za-z0-9]')::INTEGER::DOUBLE AS signal FROM benchmark")
def shape_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.shape_signal(_queries(spark, sf_dir, False))


@query(_sql(_HYBRID, _SIGNAL, _TWO, "ls AS (SELECT lanes.*, CASE WHEN two.qid IS NULL THEN NULL ELSE signal END AS signal FROM lanes LEFT JOIN sig USING (qid) LEFT JOIN two USING (qid))", _fuse(weight="CASE WHEN lane_idx = 0 AND signal < 0.1 THEN 0.0 WHEN lane_idx = 0 THEN 1.0 ELSE 1.5 END", lanes_sql="ls"), select=f"{_OUT} fused"))
def adaptive_rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = Searcher(_index(spark, sf_dir), adaptive=Adaptive("overlap", 0.1)).search(_queries(spark, sf_dir)).mode("fusion").exec()
    return _hits(found)


_GROUPS = "g AS (SELECT item_id AS qid, item_id // 4 AS gid, item_id % 4 AS position FROM benchmark), gl AS (SELECT gid AS qid, 2 * position + lane_idx AS lane_idx, chunk_id, score, rank FROM lanes JOIN g USING (qid))"


def _groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _queries(spark, sf_dir, False).select("qid", F.floor(F.col("qid") / 4).alias("gid"), (F.col("qid") % 4).alias("position"))


@query(_sql(_HYBRID, _GROUPS, _fuse(weight="CASE lane_idx % 2 WHEN 0 THEN 1.0 ELSE 1.5 END", lanes_sql="gl"), select=f"{_OUT} fused"))
def multi_query_rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hits(Searcher(_index(spark, sf_dir)).search(_queries(spark, sf_dir)).fused(_groups(spark, sf_dir)).exec())


@query(
    _sql(
        _HYBRID, _GROUPS, "r AS (SELECT qid AS gid, CASE WHEN lane_idx % 2 = 0 THEN 'bm25' ELSE 'vector' END AS lane, chunk_id, rank, score FROM gl)",
        select="SELECT gid, lane, chunk_id, min(rank) AS rank, round(max(score) FILTER (rank = m), 6) AS score FROM (SELECT *, min(rank) OVER (PARTITION BY gid, lane, chunk_id) AS m FROM r) GROUP BY gid, lane, chunk_id",
    )
)
def best_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _six(fusion.best_ranks(_both_lanes(spark, sf_dir), _groups(spark, sf_dir)))


@query(_sql(_HYBRID, _fuse(), select="SELECT 'bm25' AS mode, qid, chunk_id, round(score, 6) AS score, rank FROM bm WHERE rank <= 10 UNION ALL SELECT 'vector', qid, chunk_id, round(score, 6), rank FROM vec WHERE rank <= 10 UNION ALL SELECT 'hybrid', qid, chunk_id, round(score, 6), rank FROM fused"))
def compare_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _six(Searcher(_index(spark, sf_dir)).compare(_queries(spark, sf_dir)))


# response


@query(
    _sql(
        _HYBRID, _fuse(),
        select="""SELECT f.qid, f.rank, f.chunk_id, d.source, round(f.score, 6) AS score, round(bm.score, 6) AS bm25_score, bm.rank AS bm25_rank, round(vec.score, 6) AS vector_score, vec.rank AS vector_rank
FROM fused f JOIN documents d ON d.doc_id = f.chunk_id LEFT JOIN bm ON bm.qid = f.qid AND bm.chunk_id = f.chunk_id LEFT JOIN vec ON vec.qid = f.qid AND vec.chunk_id = f.chunk_id""",
    )
)
def explain_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = Searcher(_index(spark, sf_dir)).search(_queries(spark, sf_dir)).mode("hybrid").exec()
    out = found.select("qid", F.col("rank").cast("int").alias("rank"), "chunk_id", "source", "score", "bm25_score", "bm25_rank", "vector_score", "vector_rank")
    return _six(out, "score", "bm25_score", "vector_score")


_MATCHED = f"list_sort(list_intersect({_terms('q.query')}, {_terms('d.text')}))"


@query(_sql(_CORPUS, _Q, _bm25(k=10), select=f"SELECT qid, chunk_id, array_to_string({_MATCHED}, ' ') AS matched_terms FROM bm JOIN q USING (qid) JOIN documents d ON d.doc_id = chunk_id"))
def matched_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = Searcher(_index(spark, sf_dir)).search(_queries(spark, sf_dir)).mode("keyword").exec()
    return found.select("qid", "chunk_id", F.array_join("matched_terms", " ").alias("matched_terms"))


@query(
    _sql(
        _CORPUS, _Q, _bm25(k=3), f"b AS (SELECT qid, rank, '[' || d.source || E']\\n' || d.text || CASE WHEN len({_MATCHED}) > 0 THEN E'\\n(matched: ' || array_to_string({_MATCHED}, ', ') || ')' ELSE '' END AS block FROM bm JOIN q USING (qid) JOIN documents d ON d.doc_id = chunk_id)",
        select="SELECT qid, rank, length(block) AS n_chars, md5(block) AS digest FROM b",
    )
)
def context_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = Searcher(_index(spark, sf_dir)).search(_queries(spark, sf_dir)).mode("bm25").top_n(3).exec()
    block = explain.context_block(F.col("source"), F.col("text"), F.col("matched_terms"))
    return found.select("qid", F.col("rank").cast("int").alias("rank"), F.length(block).cast("long").alias("n_chars"), F.md5(block.cast("binary")).alias("digest"))


_ODD = "(VALUES (-1::BIGINT, 'zzqqxx notaword'), (-2, 'the of and'), (-3, ''))"


@query(
    _sql(
        _CORPUS, f"q AS (SELECT item_id AS qid, text AS query FROM benchmark UNION ALL SELECT * FROM {_ODD})", _Q.split(",\n", 1)[1], _bm25(k=10, where="WHERE chunk_id IN (SELECT doc_id FROM documents WHERE lang = 'xx')"),
        select="SELECT q.qid, 0::BIGINT AS n_hits, CASE WHEN count(df.term) > 0 THEN 'FilteredOut' ELSE 'AllTermsUnmatched' END AS reason FROM q LEFT JOIN qt USING (qid) LEFT JOIN df USING (term) GROUP BY q.qid",
    )
)
def empty_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    odd = spark.createDataFrame([(-1, "zzqqxx notaword"), (-2, "the of and"), (-3, "")], "qid long, query string")
    asked = _queries(spark, sf_dir, False).unionByName(odd)
    return Searcher(_index(spark, sf_dir)).empty_reasons(asked, Mode.BM25, where=Eq("lang", "xx"))


@query(
    _sql(
        _HYBRID, "c AS (SELECT qid, chunk_id FROM lanes)",
        select="""SELECT q.qid, (SELECT count(*) FROM bm WHERE bm.qid = q.qid) AS n_bm25, (SELECT count(*) FROM vec WHERE vec.qid = q.qid) AS n_vector, (SELECT count(DISTINCT chunk_id) FROM c WHERE c.qid = q.qid) AS n_fused,
(SELECT count(*) FROM documents) AS allowed, greatest(0, 30 - least((SELECT count(*) FROM bm WHERE bm.qid = q.qid), (SELECT count(*) FROM vec WHERE vec.qid = q.qid))) AS shortfall FROM q""",
    )
)
def search_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = Searcher(_index(spark, sf_dir)).metrics(_queries(spark, sf_dir), Mode.HYBRID)
    return out.withColumn("shortfall", F.col("shortfall").cast("long"))


# post-processing and rerank


@query(
    f"""WITH e AS (SELECT event_type AS qid, event_id AS chunk_id, value, exp(-1e-7::DOUBLE * greatest(0, {NOW_MS} - epoch_ms(ts)) / 1000) AS f FROM events),
r AS (SELECT qid, chunk_id, value * f AS score, f, row_number() OVER (PARTITION BY qid ORDER BY round(value * f, 9) DESC, chunk_id)::INTEGER AS rank FROM e QUALIFY rank <= 20)
SELECT qid, rank, chunk_id, round(score, 6) AS score, round(f, 6) AS decay_factor FROM r"""
)
def time_decay(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "events").select(F.col("event_type").alias("qid"), F.col("event_id").alias("chunk_id"), F.col("value").alias("score"), F.timestamp_diff("MILLISECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col("ts")).alias("ts_ms"), F.lit(0).alias("rank"))
    decayed = post.TimeDecay(1e-7, NOW_MS).process(rows, 20)
    return _six(decayed.select("qid", F.col("rank").cast("int").alias("rank"), "chunk_id", "score", "decay_factor"), "score", "decay_factor")


@query(
    _sql(
        _CORPUS, _Q, _bm25(k=30), "s AS (SELECT qid, rank, chunk_id, length(text)::BIGINT AS budget_units, sum(length(text)) OVER (PARTITION BY qid ORDER BY rank)::BIGINT AS spent FROM bm JOIN documents ON doc_id = chunk_id)",
        select="SELECT qid, rank, chunk_id, budget_units, spent FROM s WHERE spent <= 20000 AND rank <= 20",
    )
)
def token_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = _index(spark, sf_dir)
    hits = lanes.bm25(_queries(spark, sf_dir, False), i.postings, i.lengths, 30).join(i.chunks.select("chunk_id", "text"), "chunk_id")
    kept = post.TokenBudget(20_000).process(hits, 20)
    return kept.select("qid", F.col("rank").cast("int").alias("rank"), "chunk_id", "budget_units", "spent")


_POOL = f"pool AS (SELECT qid, rank, chunk_id, score, list_distinct({_terms('text')}) AS terms FROM bm JOIN documents ON doc_id = chunk_id)"
_PAIRS = "pair AS (SELECT a.qid, a.chunk_id AS a, b.chunk_id AS b, CASE WHEN len(a.terms) > 0 AND len(b.terms) > 0 THEN len(list_intersect(a.terms, b.terms)) / (len(a.terms) + len(b.terms) - len(list_intersect(a.terms, b.terms))) ELSE 0.0 END AS sim FROM pool a JOIN pool b ON a.qid = b.qid AND a.chunk_id <> b.chunk_id)"


def _pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = _index(spark, sf_dir)
    hits = lanes.bm25(_queries(spark, sf_dir, False), i.postings, i.lengths, 10).join(i.chunks.select("chunk_id", "text"), "chunk_id")
    return hits.select("qid", "chunk_id", "rank", "score", F.array_distinct(text.StandardAnalyzer().document(F.col("text"))).alias("terms"))


@query(_sql(_CORPUS, _Q, _bm25(k=10), _POOL, _PAIRS, select="SELECT qid, a, b, round(sim, 6) AS jaccard FROM pair WHERE a < b"))
def jaccard_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _six(post.pair_similarities(_pool(spark, sf_dir)), "jaccard")


def _mmr_step(n: int) -> str:
    chosen = " UNION ALL ".join(f"SELECT * FROM m{i}" for i in range(1, n))
    return f"""m{n} AS (SELECT qid, chunk_id, {n} AS rank FROM (SELECT p.qid, p.chunk_id, round(0.5 * p.score - 0.5 * coalesce(max(s.sim), 0), 9) AS gain
  FROM pool p JOIN ({chosen}) c ON c.qid = p.qid LEFT JOIN pair s ON s.qid = p.qid AND s.a = p.chunk_id AND s.b = c.chunk_id
  WHERE (p.qid, p.chunk_id) NOT IN (SELECT (qid, chunk_id) FROM ({chosen})) GROUP BY p.qid, p.chunk_id, p.score) QUALIFY row_number() OVER (PARTITION BY qid ORDER BY gain DESC, chunk_id) = 1)"""


@query(
    _sql(
        _CORPUS, _Q, _bm25(k=10), _POOL, _PAIRS, "m1 AS (SELECT qid, chunk_id, 1 AS rank FROM pool WHERE rank = 1)", _mmr_step(2), _mmr_step(3),
        select="SELECT qid, rank, chunk_id FROM (SELECT * FROM m1 UNION ALL SELECT * FROM m2 UNION ALL SELECT * FROM m3)",
    )
)
def mmr_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    return post.Mmr(0.5, pool=10).process(_pool(spark, sf_dir), 3).select("qid", "rank", "chunk_id")


@query(
    _sql(
        _CORPUS, _Q, _bm25(k=30), "l AS (SELECT qid, chunk_id, CASE WHEN rank <= 20 THEN length(text) % 7 - 3.0::DOUBLE END AS logit, score FROM bm JOIN documents ON doc_id = chunk_id)",
        "r AS (SELECT qid, chunk_id, logit, coalesce(1 / (1 + exp(-logit)), score) AS score FROM l)",
        select="SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, chunk_id)::INTEGER AS rank, chunk_id, round(score, 6) AS score, round(logit, 6) AS rerank_score FROM r QUALIFY rank <= 10",
    )
)
def rerank_scatter(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = _index(spark, sf_dir)
    hits = lanes.bm25(_queries(spark, sf_dir, False), i.postings, i.lengths, 30).join(i.chunks.select("chunk_id", "text"), "chunk_id").withColumn("query", F.lit(""))
    scorer = post.FunctionReranker(lambda _, t: (F.length(t) % 7 - 3).cast("double"))
    found = post.rerank(hits, scorer.logits(hits), 10)
    return _six(found.select("qid", F.col("rank").cast("int").alias("rank"), "chunk_id", "score", "rerank_score"), "score", "rerank_score")


# index maintenance


@query(
    """WITH c AS (SELECT doc_id, text, length(coalesce(text, '')) AS n, unnest(range(greatest(0, ceil((length(coalesce(text, '')) - 512) / 448.0))::BIGINT + 1)) AS ordinal FROM documents WHERE length(coalesce(text, '')) > 0)
SELECT doc_id, ordinal::INTEGER AS ordinal, (448 * ordinal)::INTEGER AS char_start, least(448 * ordinal + 512, n)::INTEGER AS char_end, md5(substring(text, 448 * ordinal + 1, 512)) AS digest FROM c"""
)
def chunk_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.chunk(_docs(spark, sf_dir)).select("doc_id", "ordinal", "char_start", "char_end", F.md5(F.col("text").cast("binary")).alias("digest"))


@query(
    """WITH c AS (SELECT doc_id, text, unnest(range(greatest(0, ceil((length(coalesce(text, '')) - 512) / 448.0))::BIGINT + 1)) AS ordinal FROM documents WHERE length(coalesce(text, '')) > 0),
b AS (SELECT doc_id, ordinal::INTEGER AS ordinal, octet_length(encode(substring(text, 1, 448 * ordinal)))::BIGINT AS byte_start, octet_length(encode(substring(text, 448 * ordinal + 1, 512))) AS n FROM c)
SELECT doc_id, ordinal, byte_start, byte_start + n AS byte_end FROM b"""
)
def chunk_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.byte_offsets(ingest.chunk(_docs(spark, sf_dir))).select("doc_id", "ordinal", "byte_start", "byte_end")


@query("SELECT min(doc_id) AS doc_id FROM documents GROUP BY text")
def dedup_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.upsert(ingest.content_hash(_docs(spark, sf_dir))).select("doc_id")


_DEAD = "dead AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 0)"


def _dead(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "labels").filter("quality = 0").select("doc_id")


@query(_sql(_CORPUS, _Q, _DEAD, _bm25(k=10, where="WHERE chunk_id NOT IN (SELECT doc_id FROM dead)"), select=f"{_OUT} bm"))
def tombstone_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics still count what is dead."""
    index = _index(spark, sf_dir).without(_dead(spark, sf_dir))
    return _hits(Searcher(index).search(_queries(spark, sf_dir, False)).exec())


@query(_sql(_CORPUS.replace("FROM documents", "FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0)"), _Q, _bm25(k=10), select=f"{_OUT} bm"))
def merged_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of two segments that were merged: statistics count the living."""
    docs = _docs(spark, sf_dir)
    one, other = (Index.of_texts(docs.filter(F.col("lang") == "en" if en else F.col("lang") != "en"), source=F.col("source")) for en in (True, False))
    index = one.union(other).without(_dead(spark, sf_dir)).merged()
    return _hits(Searcher(index).search(_queries(spark, sf_dir, False)).exec())


@query(_sql(_DEAD, f"m AS (SELECT doc_id, len({_terms('text')}) AS dl FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM dead))", select="SELECT count(*) AS num_docs, count(*) AS num_chunks, sum(dl)::BIGINT AS total_len, round(avg(dl), 6) AS avgdl FROM m"))
def segment_merge_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _six(_index(spark, sf_dir).without(_dead(spark, sf_dir)).merged().counters(), "avgdl")


@query(_sql(_DEAD, select="SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS new_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM dead)"))
def compact_renumber(spark: SparkSession, sf_dir: str) -> DataFrame:
    alive = ingest.alive(_docs(spark, sf_dir).select("doc_id"), _dead(spark, sf_dir))
    return ingest.renumber(alive, "doc_id", "new_id")


@query(
    _sql(
        _DEAD, "t AS (SELECT count(*) AS n, count(dead.doc_id) AS d FROM documents LEFT JOIN dead USING (doc_id))",
        select="SELECT n AS docs_total, d AS docs_dead, n - d AS docs_alive, n AS chunks_total, d AS chunks_dead, round(d / n, 6) AS ratio FROM t",
    )
)
def tombstone_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = _index(spark, sf_dir)
    return _six(ingest.tombstone_stats(i.docs, i.chunks, _dead(spark, sf_dir)), "ratio")


def _counted(kept: str) -> str:
    """Counters of an index with chunks of 512 characters, 64 of them shared, over the texts of a query."""
    return f"""k AS ({kept}),
c AS (SELECT substring(text, 448 * ordinal + 1, 512) AS chunk FROM (SELECT text, unnest(range(greatest(0, ceil((length(text) - 512) / 448.0))::BIGINT + 1)) AS ordinal FROM k WHERE length(text) > 0)),
l AS (SELECT len({_terms("chunk")}) AS dl FROM c)
SELECT (SELECT count(*) FROM k) AS num_docs, count(*) AS num_chunks, sum(dl)::BIGINT AS total_len, round(avg(dl), 6) AS avgdl FROM l"""


@query(
    """WITH u AS (SELECT text, coalesce(lang = 'en', false) AS en, doc_id FROM documents),
a AS (SELECT text, min(doc_id) AS first FROM u WHERE en GROUP BY text),
b AS (SELECT u.text, min(doc_id) AS first FROM u WHERE NOT en AND NOT EXISTS (SELECT 1 FROM a WHERE a.text IS NOT DISTINCT FROM u.text) GROUP BY u.text),
n AS (SELECT text, row_number() OVER (ORDER BY first) - 1 AS id FROM a UNION ALL SELECT text, (SELECT count(*) FROM a) + row_number() OVER (ORDER BY first) - 1 FROM b),
"""
    + _counted("SELECT coalesce(text, '') AS text FROM n WHERE id % 10 <> 0")
)
def store_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in two commits, some removed, merged, compacted and counted."""
    store = Store(spark, f"{scratch_dir(spark)}/store-{uuid.uuid4().hex}")
    docs = _docs(spark, sf_dir).withColumnRenamed("doc_id", "doc_order")
    english = F.coalesce(F.col("lang") == "en", F.lit(False))
    for part in (english, ~english):
        store.writer().add(docs.filter(part).select("doc_order", "source", "text")).commit()
    store.writer().remove(store.view().docs.select("doc_id").filter("doc_id % 10 = 0")).commit()
    store.compact()
    store.verify()
    return _six(store.view().counters(), "avgdl")


@query("WITH " + _counted("SELECT DISTINCT text FROM documents WHERE text IS NOT NULL"))
def stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that come in as files into a store, and the whole stream a second time, which adds nothing."""
    from .streaming import ingest as streaming

    at = f"{scratch_dir(spark)}/stream-{uuid.uuid4().hex}"
    store = Store(spark, f"{at}/store")
    for turn in range(2):
        rows = spark.readStream.schema(_docs(spark, sf_dir).schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/documents.parquet*")
        streaming.ingest(rows.select("source", "text"), store, f"{at}/checkpoint{turn}").awaitTermination()
    return _six(store.view().counters(), "avgdl")


# evaluation

_JUDGED = "j AS (SELECT q.qid, e.vec_id::VARCHAR AS source, 1 + 2 * l.quality AS grade FROM q JOIN embeddings m ON m.vec_id = q.qid JOIN embeddings e ON e.label = m.label JOIN labels l ON l.doc_id = e.vec_id)"


def _judgments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A labelled document is relevant to a query whose vector has the same label; good ones are of grade 3."""
    rows = _table(spark, sf_dir, "embeddings").select("vec_id", "label")
    mine = _queries(spark, sf_dir, False).join(rows.withColumnRenamed("vec_id", "qid"), "qid").select("qid", "label")
    labelled = rows.join(_table(spark, sf_dir, "labels").select(F.col("doc_id").alias("vec_id"), "quality"), "vec_id")
    return mine.join(labelled, "label").select("qid", F.col("vec_id").cast("string").alias("source"), (1 + 2 * F.col("quality")).alias("grade"))


def _eval(name: str, lane: str, extra: str = "") -> str:
    """Metrics of a lane (qid, chunk_id, rank); extra: more columns that rows are told apart by."""
    cells = f", (SELECT DISTINCT {extra[:-2]} FROM {lane})" if extra else ""
    return f"""{name}_i AS (SELECT qid, sum(CASE WHEN place <= 10 AND grade > 0 THEN (pow(2, grade) - 1) / log2(place + 1) END) AS ideal, count(*) FILTER (grade >= 1) AS relevant
  FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY grade DESC, source) AS place FROM j) GROUP BY qid),
{name}_f AS (SELECT {extra}qid, count(*) FILTER (grade >= 1) AS found, min(rank) FILTER (grade >= 1) AS first, sum((pow(2, grade) - 1) / log2(rank + 1)) AS dcg FROM {lane} JOIN j ON j.qid = {lane}.qid AND j.source = {lane}.chunk_id::VARCHAR WHERE rank <= 10 GROUP BY {extra}{lane}.qid),
{name} AS (SELECT {extra}qid, CASE WHEN relevant > 0 THEN coalesce(found / relevant, 0) ELSE 0.0 END AS recall, coalesce(1 / first, 0.0) AS mrr, CASE WHEN ideal > 0 THEN coalesce(dcg / ideal, 0) ELSE 0.0 END AS ndcg FROM (SELECT * FROM {name}_i{cells}) LEFT JOIN {name}_f USING ({extra}qid))""".replace("SELECT " + extra + "qid, count(*) FILTER (grade >= 1) AS found", f"SELECT {extra}{lane}.qid, count(*) FILTER (grade >= 1) AS found")


def _judged_hits(lane: DataFrame) -> DataFrame:
    return lane.withColumn("source", F.col("chunk_id").cast("string"))


def _metric_rows(spark: SparkSession, sf_dir: str, lane_idx: int | None = None) -> DataFrame:
    both = _both_lanes(spark, sf_dir)
    hits = fusion.rrf(both) if lane_idx is None else both.filter(F.col("lane_idx") == lane_idx)
    return evaluate.metrics(_judged_hits(hits), _judgments(spark, sf_dir))


@query(_sql(_HYBRID, _fuse(), _JUDGED, _eval("ev", "fused"), select="SELECT qid, round(recall, 6) AS recall, round(mrr, 6) AS mrr, round(ndcg, 6) AS ndcg FROM ev"))
def recall_mrr_ndcg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _six(_metric_rows(spark, sf_dir), "recall", "mrr", "ndcg")


@query(
    _sql(
        _HYBRID, _fuse(), _JUDGED, _eval("ev", "fused"),
        select="SELECT label AS type, count(*) AS n, round(avg(recall), 6) AS recall, round(avg(mrr), 6) AS mrr, round(avg(ndcg), 6) AS ndcg FROM ev JOIN embeddings ON vec_id = qid GROUP BY ROLLUP (label)",
    )
)
def eval_by_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    bucket = _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("qid"), F.col("label").alias("type"))
    return _six(evaluate.means(_metric_rows(spark, sf_dir).join(bucket, "qid")), "recall", "mrr", "ndcg")


@query("SELECT lang, quantile_disc(n_chars, 0.99) AS p99 FROM documents GROUP BY lang")
def percentile_nearest_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.percentile(_docs(spark, sf_dir), "n_chars", 99, ("lang",)).withColumn("p99", F.col("p99").cast("long"))


@query(
    _sql(
        _HYBRID, _fuse(), _JUDGED, _eval("a", "fused"), _eval("b", "bm"),
        select="SELECT count(*) FILTER (a.ndcg - b.ndcg > 1e-12) AS better, count(*) FILTER (abs(a.ndcg - b.ndcg) <= 1e-12) AS equal, count(*) FILTER (a.ndcg - b.ndcg < -1e-12) AS worse FROM a JOIN b USING (qid)",
    )
)
def paired_sign_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.sign_counts(_metric_rows(spark, sf_dir), _metric_rows(spark, sf_dir, 0))


@query(
    _sql(
        _CORPUS, _Q, "cell AS (SELECT k1::DOUBLE AS k1, b::DOUBLE AS b FROM (VALUES (1.0), (1.2), (1.5), (2.0)) x(k1), (VALUES (0.3), (0.5), (0.75), (0.9)) y(b))",
        _bm25(k=10, k1="k1", b="b", extra="k1, b, ", source=", cell"), _JUDGED, _eval("ev", "bm", "k1, b, "),
        select="SELECT k1, b, round(avg(recall), 6) AS recall, round(avg(mrr), 6) AS mrr, round(avg(ndcg), 6) AS ndcg FROM ev GROUP BY k1, b",
    )
)
def bm25_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = _index(spark, sf_dir)
    hits = evaluate.bm25_grid(_queries(spark, sf_dir, False), i.postings, i.lengths)
    grid = spark.createDataFrame([(k1, b) for k1 in evaluate.K1_GRID for b in evaluate.B_GRID], "k1 double, b double")
    cells = evaluate.metrics(_judged_hits(hits), _judgments(spark, sf_dir), by=("k1", "b", "qid"), cells=grid)
    return _six(cells.groupBy("k1", "b").agg(*(F.avg(m).alias(m) for m in ("recall", "mrr", "ndcg"))), "recall", "mrr", "ndcg")


@query(
    _sql(
        _CORPUS, _Q, _bm25("f", k=10, where="WHERE chunk_id IN (SELECT doc_id FROM documents WHERE lang = 'en')"),
        select="SELECT qid, count(*) AS n_hits, count(*) AS n_oracle, 1.0::DOUBLE AS recall, greatest(0, 10 - count(*)) AS shortfall FROM f GROUP BY qid",
    )
)
def filter_oracle_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = _index(spark, sf_dir)
    asked, allowed = _queries(spark, sf_dir, False), i.candidates(Eq("lang", "en"))
    filtered = lanes.bm25(asked, i.postings, i.lengths, 10, allowed)
    out = evaluate.filter_quality(filtered, lanes.bm25(asked, i.postings, i.lengths, None), allowed)
    return out.withColumn("shortfall", F.col("shortfall").cast("long"))


@query(
    _sql(
        _HYBRID, _fuse("f1"), _fuse("f2", weight="CASE lane_idx WHEN 0 THEN 0.0 ELSE 1.5 END"), _JUDGED, _eval("a", "f1"), _eval("b", "f2"), _SIGNAL, _TWO,
        "p AS (SELECT qid, a.mrr AS x, b.mrr AS y, signal FROM a JOIN b USING (qid) JOIN sig USING (qid) JOIN two USING (qid))",
        select="SELECT t::DOUBLE AS theta, count(*) FILTER (signal < t) AS n_switched, round(avg(CASE WHEN signal < t THEN y - x ELSE 0.0 END), 6) AS delta FROM p, (VALUES (0.0::DOUBLE), (0.25::DOUBLE), (0.5::DOUBLE), (0.75::DOUBLE), (1.0::DOUBLE)) v(t) GROUP BY t",
    )
)
def theta_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    both, judged = _both_lanes(spark, sf_dir), _judgments(spark, sf_dir)
    full = evaluate.metrics(_judged_hits(fusion.rrf(both)), judged)
    without = evaluate.metrics(_judged_hits(fusion.rrf(both, weights=(0.0, 1.5))), judged)
    return _six(evaluate.theta_sweep(full, without, fusion.overlap_signal(both, 10), (0.0, 0.25, 0.5, 0.75, 1.0)), "delta")


_KINDS = "CASE label % 4 WHEN 0 THEN 'exact' WHEN 1 THEN 'natural' WHEN 2 THEN 'mixed' ELSE 'paraphrase' END"


@query(
    _sql(
        _HYBRID, _fuse("f1"), _fuse("f2", weight="CASE lane_idx WHEN 0 THEN 0.0 ELSE 1.5 END"), _JUDGED, _eval("a", "f1"), _eval("b", "f2"), _SIGNAL, _TWO,
        "cov AS (SELECT q.qid, CASE WHEN count(qt.term) > 0 THEN count(df.term) / count(qt.term) ELSE 0.0 END::DOUBLE AS value FROM q LEFT JOIN qt USING (qid) LEFT JOIN df USING (term) GROUP BY q.qid)",
        "s AS (SELECT 'overlap' AS signal, qid, signal AS value FROM sig JOIN two USING (qid) UNION ALL SELECT 'coverage', qid, value FROM cov UNION ALL SELECT 'shape', qid, regexp_matches(query, '[A-Za-z0-9]')::INTEGER::DOUBLE FROM q)",
        f"p AS (SELECT qid, b.mrr - a.mrr AS d, {_KINDS} AS type FROM a JOIN b USING (qid) JOIN embeddings ON vec_id = qid)",
        "g AS (SELECT v.signal, i / 20.0::DOUBLE AS theta, type, CASE WHEN value < i / 20.0::DOUBLE THEN d ELSE 0.0 END AS change FROM p, (SELECT DISTINCT signal FROM s) v, range(21) r(i) LEFT JOIN s ON s.qid = p.qid AND s.signal = v.signal)",
        "m AS (SELECT signal, theta, type, avg(change) + 1e-12 AS low FROM g GROUP BY GROUPING SETS ((signal, theta, type), (signal, theta)))",
        "o AS (SELECT signal, theta, coalesce(bool_and(low >= 0.01) FILTER (type = 'paraphrase'), false) AS gain_ok, coalesce(bool_and(low >= -0.0024) FILTER (type <> 'paraphrase'), false) AS others_ok, coalesce(bool_and(low >= 0) FILTER (type IS NULL), false) AS all_ok FROM m GROUP BY ALL)",
        "w AS (SELECT *, gain_ok AND others_ok AND all_ok AS passed FROM o)",
        "x AS (SELECT *, row_number() OVER (PARTITION BY signal ORDER BY theta) - row_number() OVER (PARTITION BY signal, passed ORDER BY theta) AS island FROM w)",
        "y AS (SELECT *, CASE WHEN passed THEN count(*) OVER (PARTITION BY signal, passed, island) ELSE 0 END AS run FROM x)",
        select="SELECT signal, theta, gain_ok, others_ok, all_ok, passed, run, max(run) OVER (PARTITION BY signal) >= 3 AS adopt FROM y",
    )
)
def theta_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three signals, 21 values each, and whether any is to be adopted."""
    both, judged, index = kept(_both_lanes(spark, sf_dir), "lanes"), _judgments(spark, sf_dir), _index(spark, sf_dir)
    asked = _queries(spark, sf_dir, False)
    full = evaluate.metrics(_judged_hits(fusion.rrf(both)), judged)
    without = evaluate.metrics(_judged_hits(fusion.rrf(both, weights=(0.0, 1.5))), judged)
    found = {"overlap": fusion.overlap_signal(both, 10), "coverage": fusion.coverage_signal(lanes.term_hits(asked, index.postings)), "shape": fusion.shape_signal(asked)}
    signals = reduce(DataFrame.union, (df.select(F.lit(name).alias("signal"), "qid", F.col("signal").alias("value")) for name, df in found.items()))
    kind = F.element_at(F.array(*map(F.lit, ("exact", "natural", "mixed", "paraphrase"))), F.col("label") % 4 + 1)
    buckets = _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("qid"), kind.alias("type"))
    return evaluate.gates(evaluate.bucket_sweep(full, without, signals, buckets))


# dataset tools


@query("SELECT DISTINCT l.doc_id::VARCHAR AS source FROM labels l WHERE NOT EXISTS (SELECT 1 FROM embeddings e WHERE e.vec_id = l.doc_id)")
def judgment_ref_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = _table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("source"))
    return files.unknown_sources(judged, _table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("source")))


@query("SELECT doc_id, text IS NULL AS empty FROM documents WHERE n_chars >= 500 ORDER BY md5(doc_id::VARCHAR), doc_id LIMIT 100")
def hash_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sampling operator: 100 documents of 500 characters and more."""
    return files.hash_sample(_docs(spark, sf_dir), 100, "doc_id", F.col("n_chars") >= 500).select("doc_id", F.col("text").isNull().alias("empty"))


_BIGRAMS = r"list_distinct(list_transform(range(1, length(regexp_replace({c}, '\s+', '', 'g'))), lambda i: substring(regexp_replace({c}, '\s+', '', 'g'), i, 2)))"


@query(
    _sql(
        f"p AS (SELECT b.item_id AS qid, {_BIGRAMS.format(c='b.text')} AS q, {_BIGRAMS.format(c='d.text')} AS s FROM benchmark b JOIN documents d ON d.doc_id = b.item_id)",
        select="SELECT qid, round(len(list_intersect(q, s)) / len(q), 6) AS coverage FROM p",
    )
)
def bigram_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = _queries(spark, sf_dir, False).join(_docs(spark, sf_dir).select(F.col("doc_id").alias("qid"), "text"), "qid")
    return _six(pairs.select("qid", text.coverage(text.char_bigrams(F.col("query")), text.char_bigrams(F.col("text"))).alias("coverage")), "coverage")


@query(
    _sql(
        f"p AS (SELECT b.item_id AS qid, b.text AS query, list_distinct({_terms('b.text')}) AS q, {_terms('d.text')} AS s FROM benchmark b JOIN documents d ON d.doc_id = b.item_id)",
        "o AS (SELECT qid, query, CASE WHEN len(q) > 0 THEN len(list_intersect(q, s)) / len(q) ELSE 0.0 END AS overlap FROM p)",
        select="SELECT qid, round(overlap, 6) AS overlap, CASE WHEN regexp_matches(query, '[A-Za-z0-9]') THEN 'mixed' WHEN length(query) >= 16 THEN 'natural' WHEN overlap >= 0.5 THEN 'exact' ELSE 'paraphrase' END AS bucket FROM o",
    )
)
def query_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = _queries(spark, sf_dir, False).join(_docs(spark, sf_dir).select(F.col("doc_id").alias("qid"), "text"), "qid")
    a = text.StandardAnalyzer()
    overlap = text.coverage(a.query(F.col("query")), a.document(F.col("text")))
    return pairs.select("qid", F.round(overlap, 6).alias("overlap"), text.query_bucket(F.col("query"), overlap).alias("bucket"))


@query(_sql(_CORPUS.replace("FROM documents", "FROM (SELECT p_partkey AS doc_id, p_name AS text FROM part)"), "q AS (SELECT n_nationkey::BIGINT AS qid, (SELECT min(p_name) FROM part) AS query FROM nation)", _Q.split(",\n", 1)[1], _bm25(k=5), select=f"{_OUT} bm"))
def short_text_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A corpus of short names."""
    part = _table(spark, sf_dir, "part")
    index = Index.of_texts(part, "p_partkey", "p_name")
    name = part.agg(F.min("p_name").alias("query"))
    asked = _table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("qid")).crossJoin(F.broadcast(name))
    return _hits(lanes.bm25(asked, index.postings, index.lengths, 5))


_EN = "WHERE chunk_id IN (SELECT doc_id FROM documents WHERE lang = 'en')"


@query(
    _sql(
        _CORPUS, _Q, _bm25(where=_EN), _UNIT, _vec(where=_EN), _LANES, _fuse(),
        select=f"""SELECT f.qid, f.rank, f.chunk_id, f.chunk_id AS doc_id, d.source, round(f.score, 6) AS score, array_to_string({_MATCHED}, ' ') AS matched_terms, round(bm.score, 6) AS bm25_score, round(vec.score, 6) AS vector_score
FROM fused f JOIN documents d ON d.doc_id = f.chunk_id JOIN q ON q.qid = f.qid LEFT JOIN bm ON bm.qid = f.qid AND bm.chunk_id = f.chunk_id LEFT JOIN vec ON vec.qid = f.qid AND vec.chunk_id = f.chunk_id""",
    )
)
def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: all benchmark texts with their vectors, filtered, fused and explained."""
    found = Searcher(_index(spark, sf_dir)).search(_queries(spark, sf_dir)).filter("lang=en").top_n(10).exec()
    out = found.select("qid", F.col("rank").cast("int").alias("rank"), "chunk_id", "doc_id", "source", "score", F.array_join("matched_terms", " ").alias("matched_terms"), "bm25_score", "vector_score")
    return _six(out, "score", "bm25_score", "vector_score")
