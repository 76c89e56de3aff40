"""Queries of the operators over whole texts: extraction, encoding, fingerprints, chats, scores."""

from __future__ import annotations

from collections.abc import Sequence

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import bpe, chat, html_diff, iblt, quality_model, toxicity
from .common import table

VOCABULARY = "word_bpe_49k.json"


def encoded_documents(documents: DataFrame, path: str | None = None, carry: Sequence[str] = ()) -> DataFrame:
    """Digests of the ids and of the decoded text of every document, and the columns of ``carry``."""
    vocabulary = bpe.Vocabulary.load(path or public_tokenizers.path(VOCABULARY))
    given = [c for c in carry if c != "ids"]
    decoded = bpe.round_trip(documents.select("doc_id", "text", *given), vocabulary, bpe.build_lexicon(documents, vocabulary))
    return decoded.select(
        "doc_id", *carry, F.size("ids").cast("long").alias("n_tokens"),
        bpe.digest(F.concat_ws(" ", F.col("ids").cast("array<string>"))).alias("ids_sha256"),
        bpe.digest(F.col("decoded")).alias("decoded_sha256"),
    )


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded_documents(table(spark, sf_dir, "documents"))


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iblt.fingerprints(table(spark, sf_dir, "documents"))


def op1_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_diff.extract(table(spark, sf_dir, "pages"))


def op7_chat_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.rotate(table(spark, sf_dir, "conversations"))


OP7_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, role AS speaker, row_number() OVER () AS n,
    regexp_replace(coalesce(text, ''), '<\|im_(start|end)\|>', '<im_\1>', 'g') AS body,
    regexp_replace(coalesce(role, 'unknown'), '[\x00-\x20<>|]', '_', 'g') AS name
  FROM conversations
), people AS (
  SELECT DISTINCT conv_id, speaker AS perspective FROM t WHERE speaker <> 'system'
), s AS (
  SELECT t.*, p.perspective, '<|im_start|>' || CASE WHEN speaker = 'system' THEN 'system'
    WHEN speaker = p.perspective THEN 'assistant' ELSE 'user name=' || name END || chr(10) AS header
  FROM t JOIN people p ON t.conv_id IS NOT DISTINCT FROM p.conv_id
), r AS (
  SELECT *, header || body || '<|im_end|>' || chr(10) AS segment, (speaker IS NOT DISTINCT FROM perspective) AS trained,
  FROM s
), o AS (
  SELECT *, CAST(sum(length(segment)) OVER (
    PARTITION BY conv_id, perspective ORDER BY turn NULLS LAST, speaker NULLS LAST, body, n ROWS UNBOUNDED PRECEDING
  ) AS BIGINT) AS stop FROM r
)
SELECT conv_id, perspective, turn, speaker, segment, stop - length(segment) AS start, stop, trained,
  CASE WHEN trained THEN stop - length(segment) + length(header) ELSE stop END AS mask_start,
  CASE WHEN trained THEN stop - 1 ELSE stop END AS mask_stop
FROM o
"""


def op8_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return quality_model.score(documents, quality_model.train(documents, table(spark, sf_dir, "labels")))


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return toxicity.score(documents, toxicity.train(documents, table(spark, sf_dir, "labels")))


QUERIES = {
    "op1_html_extract": (op1_html_extract, None),
    "op4_bpe": (op4_bpe, None),
    "op6_fingerprints": (op6_fingerprints, None),
    "op7_chat_perspectives": (op7_chat_perspectives, OP7_SQL),
    "op8_quality_model": (op8_quality_model, None),
    "op11_toxicity": (op11_toxicity, None),
}
