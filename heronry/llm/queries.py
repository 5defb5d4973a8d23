"""The corpus operators as queries over the driver's tables, and SQL for those that it can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact_dedup, mixing, pieces, secrets, simhash, suffix_tree, token_counts, topk, toxicity, warc
from .common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_tree.scores(table(spark, sf_dir, "documents"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = warc.round_trip(table(spark, sf_dir, "pages"))
    return rows.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mixed(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op8_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op9_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def queries() -> dict[str, Query]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


_OP3_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, min(page_id) AS owner FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT p.page_id, CAST(p.payload_bytes AS BIGINT) AS payload_bytes, p.payload_digest,
       CASE WHEN f.owner < p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN f.owner < p.page_id THEN f.owner END AS refers_to
FROM p LEFT JOIN f USING (payload_digest)
"""

_OP6_SQL = r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS points,
                  sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, count(*) AS group_size FROM d GROUP BY text_sha256),
k AS (SELECT text_sha256, doc_id AS keep_id, points AS keep_points FROM d
      QUALIFY row_number() OVER (PARTITION BY text_sha256 ORDER BY points DESC, doc_id NULLS LAST) = 1)
SELECT d.doc_id, k.keep_id, g.group_size, d.doc_id IS NOT DISTINCT FROM k.keep_id AND points = keep_points AS kept, text_sha256
FROM d JOIN g USING (text_sha256) JOIN k USING (text_sha256)
"""

_OP8_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""

_OP5_SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
                  greatest(0.05, length(regexp_replace(coalesce(text, ''), '\P{L}+', '', 'g')) / greatest(length(coalesce(text, '')), 1)::DOUBLE) AS quality,
                  (('0x' || substr(md5('17:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496::DOUBLE AS u FROM documents),
t AS (SELECT source, sum(size)::BIGINT AS source_size, 3 * sum(size)::BIGINT AS cap,
             ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::BIGINT AS weight FROM d GROUP BY source),
c AS (SELECT *, cap / weight::DOUBLE AS ratio, sum(source_size) OVER () AS total,
             sum(cap) OVER w - cap AS caps, sum(weight) OVER () - (sum(weight) OVER w - weight) AS weights FROM t
      WINDOW w AS (ORDER BY cap / weight::DOUBLE, source NULLS LAST)),
l AS (SELECT *, (total - caps)::DOUBLE / weights::DOUBLE AS here FROM c),
o AS (SELECT (SELECT here FROM l WHERE ratio > here ORDER BY ratio, here DESC LIMIT 1) AS lvl),
g AS (SELECT source AS s, source_size, CASE WHEN ratio > here THEN weight * lvl ELSE cap::DOUBLE END AS target FROM l, o),
e AS (SELECT *, least(floor(target / greatest(source_size, 1)), 3)::BIGINT AS epochs FROM g),
p AS (SELECT doc_id, size, source_size, target, epochs, target - epochs * source_size AS rest,
             coalesce(sum(size) OVER (PARTITION BY source ORDER BY -ln(u) / quality, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.s)
SELECT doc_id, size::BIGINT AS size, source_size, target::DOUBLE AS target,
       (size * least(epochs + CASE WHEN before + size / 2::DOUBLE <= rest THEN 1 ELSE 0 END, 3))::BIGINT AS taken FROM p
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_warc": _OP3_SQL, "op5_mixing": _OP5_SQL, "op6_exact_dedup": _OP6_SQL, "op8_topk": _OP8_SQL}
