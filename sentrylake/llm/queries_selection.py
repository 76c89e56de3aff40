"""Queries that choose rows: draws towards a target, hard negatives."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import bond, importance
from .common import table


def op13_importance_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


# CRC-32 of a word: its bytes as pairs of hex digits, folded with the table of the reversed polynomial
OP13_SQL = r"""
WITH crc AS (
  SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)),
    lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS t
), d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), dw AS (
  SELECT r, unnest(w) AS word FROM d
), bw AS (
  SELECT unnest(w) AS word FROM b
), v AS (
  SELECT word, xor(list_reduce(list_prepend(4294967295::BIGINT,
      list_transform(range(1, length(hex(encode(word))), 2), lambda i: ('0x' || substr(hex(encode(word)), i, 2))::BIGINT)),
    lambda c, x: xor(c // 256, t[xor(c % 256, x) + 1])), 4294967295::BIGINT) % 10000 AS bucket
  FROM (SELECT word FROM dw UNION SELECT word FROM bw), crc
), s AS (
  SELECT bucket, count(*) AS n FROM dw JOIN v USING (word) GROUP BY bucket
), t AS (
  SELECT bucket, count(*) AS n FROM bw JOIN v USING (word) GROUP BY bucket
), totals AS (
  SELECT (SELECT count(*) FROM dw) + 10000 AS s_all, (SELECT count(*) FROM bw) + 10000 AS t_all
), g AS (
  SELECT s.bucket, CAST(floor(1000 * ln(((coalesce(t.n, 0) + 1)::DOUBLE * s_all::DOUBLE)
    / ((s.n + 1)::DOUBLE * t_all::DOUBLE))) AS BIGINT) AS gain
  FROM s LEFT JOIN t ON s.bucket = t.bucket, totals
), m AS (
  SELECT r, CAST(floor(sum(gain)::DOUBLE / count(*)) AS BIGINT) AS weight FROM dw JOIN v USING (word) JOIN g USING (bucket) GROUP BY r
), e AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln(
    (('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score
  FROM d LEFT JOIN m USING (r)
), p AS (
  SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id NULLS LAST) AS place,
    count(*) OVER (PARTITION BY n_features >= 20) AS n FROM e
)
SELECT doc_id, n_features, weight, score,
  CASE WHEN n_features >= 20 AND place <= 10 * n // 100 THEN place END AS rank
FROM p
"""


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select(
        "vec_id", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label"),
        F.transform("embedding", lambda x: F.when(F.abs(x) < float("inf"), F.floor(256 * x.cast("double")))).alias("vector"),
    )
    return bond.hard_negatives(rows, F.col("vec_id") % 100 == 0, positives=5, negatives=5, low=80, high=100)


OP12_SQL = r"""
WITH e AS (
  SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.r AS ar, a.vec_id AS anchor_id, b.r, b.vec_id, a.label = b.label AS same,
    CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
  FROM e a, e b WHERE a.vec_id % 100 = 0 AND a.r <> b.r
), p AS (
  SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY ar ORDER BY score DESC, vec_id NULLS LAST, r) <= 5
), n AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
    row_number() OVER (PARTITION BY p.ar, p.r ORDER BY s.score DESC, s.vec_id NULLS LAST, s.r) AS rank
  FROM p JOIN s ON p.ar = s.ar AND NOT s.same AND 80 * p.score <= 100 * s.score AND 100 * s.score <= 100 * p.score
)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
"""

QUERIES = {"op12_hard_negatives": (op12_hard_negatives, OP12_SQL), "op13_importance_resample": (op13_importance_resample, OP13_SQL)}
