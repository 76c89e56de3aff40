"""Queries of the operators that stay within DataFrame functions: mixing, quality rules, secret scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import mixing, quality_rules, secret_scan
from .common import table


def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "source", "size", "source_size", "target", "copies", "taken")


OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
    1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS weight
  FROM d GROUP BY source
), r AS (
  SELECT *, row_number() OVER (ORDER BY 3.0::DOUBLE * source_size / weight, source NULLS LAST) AS k,
    sum(source_size) OVER () AS words, sum(weight) OVER () AS weights FROM s
), c AS (
  SELECT a.k, a.source_size, a.weight,
    (any_value(a.words) - coalesce(sum(3 * b.source_size), 0))::DOUBLE
      / (any_value(a.weights) - coalesce(sum(b.weight), 0))::DOUBLE AS level
  FROM r a LEFT JOIN r b ON b.k < a.k GROUP BY a.k, a.source_size, a.weight
), f AS (
  SELECT coalesce(min_by(level, k), 0.0) AS level FROM c WHERE 3 * source_size >= weight * level
), t AS (
  SELECT s.source, s.source_size, least(CAST(3 * s.source_size AS DOUBLE), s.weight * f.level) AS target,
    (('0x' || substr(md5('mix:' || coalesce(s.source, chr(10))), 1, 8))::BIGINT % 1024) / 1024.0::DOUBLE AS start
  FROM s, f
), p AS (
  SELECT d.doc_id, d.source, d.size, t.source_size, t.target, t.start,
    least(CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0::DOUBLE END, 3.0::DOUBLE) AS rate,
    row_number() OVER (PARTITION BY d.source ORDER BY d.size DESC, d.doc_id NULLS LAST) AS place
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), e AS (
  SELECT *, CAST(floor(place * rate + start) - floor((place - 1) * rate + start) AS BIGINT) AS copies FROM p
)
SELECT doc_id, source, size, source_size, target, copies, copies * size AS taken FROM e
"""


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.assess(table(spark, sf_dir, "documents"))


OP3_SQL = r"""
WITH d AS (
  SELECT doc_id, lang, source, coalesce(text, '') AS t,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines
  FROM documents
), windows AS (
  SELECT doc_id, unnest(range(1, len(words) - 1)) AS i,
    unnest(list_transform(range(1, len(words) - 1), lambda j: words[j] || ' ' || words[j + 1] || ' ' || words[j + 2])) AS w
  FROM d WHERE len(words) >= 3
), repeated AS (
  SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, w) > 1
), covered AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM repeated) GROUP BY doc_id
), m AS (
  SELECT d.doc_id, lang, source, CAST(len(words) AS BIGINT) AS n_words,
    CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
    CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(covered.n, 0) AS BIGINT) AS n_repeat_words, CAST(len(lines) AS BIGINT) AS n_lines,
    CAST(len(regexp_extract_all(t, '\p{Lu}')) AS BIGINT) AS n_capitals
  FROM d LEFT JOIN covered ON d.doc_id = covered.doc_id
), v AS (
  SELECT doc_id, lang, source, unnest([
    {'rate': 'symbols', 'v': CASE WHEN n_words > 0 THEN 10000 * n_symbols // n_words ELSE 0 END},
    {'rate': 'repeated', 'v': CASE WHEN n_words > 0 THEN 10000 * n_repeat_words // n_words ELSE 0 END},
    {'rate': 'dup_lines', 'v': CASE WHEN n_lines > 0 THEN 10000 * n_dup_lines // n_lines ELSE 0 END},
    {'rate': 'word_length', 'v': CASE WHEN n_words > 0 THEN 1000 * word_chars // n_words ELSE 0 END},
    {'rate': 'capitals', 'v': CASE WHEN word_chars > 0 THEN 10000 * n_capitals // word_chars ELSE 0 END}
  ], recursive := true) FROM m
), b AS (
  SELECT *, v - v % CAST(pow(2, greatest(length(bin(v)) - 7, 0)) AS BIGINT) AS bucket FROM v
), own AS (
  SELECT lang, source, rate, count(*) AS docs, quantile_disc(bucket, 0.25) AS q1, quantile_disc(bucket, 0.75) AS q3
  FROM b GROUP BY lang, source, rate
), by_lang AS (
  SELECT lang, rate, count(*) AS docs, quantile_disc(bucket, 0.25) AS q1, quantile_disc(bucket, 0.75) AS q3
  FROM b GROUP BY lang, rate
), overall AS (
  SELECT rate, quantile_disc(bucket, 0.25) AS q1, quantile_disc(bucket, 0.75) AS q3 FROM b GROUP BY rate
), l AS (
  SELECT by_lang.lang, by_lang.rate, (docs * by_lang.q1 + 200 * a.q1::DOUBLE) / (docs + 200) AS q1,
    (docs * by_lang.q3 + 200 * a.q3::DOUBLE) / (docs + 200) AS q3
  FROM by_lang JOIN overall a ON a.rate = by_lang.rate
), f AS (
  SELECT own.lang, own.source, own.rate, (own.docs * own.q1 + 200 * l.q1) / (own.docs + 200) AS q1,
    (own.docs * own.q3 + 200 * l.q3) / (own.docs + 200) AS q3
  FROM own JOIN l ON own.rate = l.rate AND own.lang IS NOT DISTINCT FROM l.lang
), g AS (
  SELECT lang, source, rate,
    q3 + 3 * greatest(q3 - q1, CASE rate WHEN 'symbols' THEN 300 WHEN 'repeated' THEN 1200 WHEN 'dup_lines' THEN 2000
      WHEN 'word_length' THEN 400 ELSE 300 END) AS high,
    CASE WHEN rate = 'word_length' THEN q1 - 3 * greatest(q3 - q1, 400) END AS low
  FROM f
), ok AS (
  SELECT v.doc_id, bool_and(v.v <= g.high AND (g.low IS NULL OR v.v >= g.low)) AS fits
  FROM v JOIN g ON v.rate = g.rate AND v.lang IS NOT DISTINCT FROM g.lang AND v.source IS NOT DISTINCT FROM g.source
  GROUP BY v.doc_id
)
SELECT m.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_capitals,
  (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
  (NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND ok.fits) AS kept
FROM m JOIN ok ON m.doc_id = ok.doc_id
"""

def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.secrets(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", *[secret_scan.number_of(F.col("base"), kind).alias(f"n_{kind}") for kind in secret_scan.KINDS[:3]],
        F.sha2(secret_scan.written(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        secret_scan.written(F.col("spans")).alias("spans"),
    )


QUERIES = {
    "op2_source_mix": (op2_source_mix, OP2_SQL),
    "op3_quality_rules": (op3_quality_rules, OP3_SQL),
    "op9_secret_scan": (op9_secret_scan, None),
}
