"""Hashes of content and files, custody records, and the evidence bundle of every alert."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..schema import ecs_names
from ..sources.files import empty_files, open_file

BLOCK = 8 * 1024 * 1024
PART_DIGITS = 3


def content_hashes(df: DataFrame, content: str) -> DataFrame:
    """Add ``sha256`` and ``size`` (bytes) of a text or binary column."""
    data = F.col(content).cast("binary")
    return df.withColumn("sha256", F.sha2(data, 256)).withColumn("size", F.length(data).cast("long"))


def file_hashes(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """``path``, ``sha256``, ``size`` of every file below a folder (partition folders included).

    Files are read in blocks inside the tasks, so no file has to fit into memory. Spark's file sources
    leave out files of zero bytes; these are listed apart.
    """
    files = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", pattern)
        .option("recursiveFileLookup", True)
        .load(path)
        .select("path", F.col("length").alias("size"))
    )
    return hashed(files).unionByName(hashed_empty(spark, path, pattern))


def hashed_empty(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """The files of zero bytes as ``file_hashes`` gives them."""
    return empty_files(spark, path, pattern).withColumn("sha256", F.lit(hashlib.sha256().hexdigest()))


def hashed(files: DataFrame) -> DataFrame:
    """``path``, ``sha256``, ``size`` of the files listed by path and size, which are read here."""

    def in_blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            digests = []
            for uri in batch["path"]:
                digest = hashlib.sha256()
                with open_file(uri) as stream:
                    while block := stream.read(BLOCK):
                        digest.update(block)
                digests.append(digest.hexdigest())
            yield pd.DataFrame({"path": batch["path"], "sha256": digests, "size": batch["size"]})

    return files.select("path", "size").mapInPandas(in_blocks, "path string, sha256 string, size bigint")


@dataclass(frozen=True)
class Run:
    """Who ran the analysis, when and where; nothing is read from clock or environment."""

    created_at: str
    operator: str = "unknown"
    hostname: str = "unknown"
    platform: str = "unknown"
    app_env: str = "development"
    tz: str = "UTC"


def custody_records(inputs: DataFrame, outputs: DataFrame, run: Run) -> DataFrame:
    """Chain of custody: every input and output (path, sha256, size) with its role and the run."""
    columns = ["path", "sha256", "size"]
    rows = (
        inputs.select(F.lit("input").alias("role"), *columns)
        .unionByName(outputs.select(F.lit("output").alias("role"), *columns))
    )
    return rows.select(*[F.lit(value).alias(name) for name, value in vars(run).items()], "role", *columns)


def context_lines(context: DataFrame) -> DataFrame:
    """``alert_id``, ``event_uid``, ``content``: each context row as a JSON line of its non-null fields."""
    fields = [c for c in context.columns if c not in ("alert_id", "alert_ts")]
    record = ecs_names(context.select(*fields)).columns
    columns = [F.col(c).alias(name) for c, name in zip(fields, record)]
    options = {"timestampFormat": "yyyy-MM-dd HH:mm:ss.SSSSSSxxx"}
    return context.select("alert_id", "event_uid", F.to_json(F.struct(*columns), options).alias("content"))


def bundle_manifest(files: DataFrame) -> DataFrame:
    """One row per alert and file: number of lines, bytes, and the SHA-256 of its lines.

    For bundle content before it is written, where lines have no order yet: lines stand in the order of
    their own SHA-256. Line hashes are dealt to parts by their first digits, each part is hashed
    over its sorted line hashes, and the file over the hashes of its parts, so a long context is never brought
    together. The hashes of the written files come from ``file_hashes``.
    """
    line = F.sha2("content", 256)
    parts = (
        files.withColumn("_line", line)
        .groupBy("alert_id", "file_name", F.substring("_line", 1, PART_DIGITS).alias("_part"))
        .agg(
            F.count("*").alias("_n"), F.sum(F.octet_length("content") + 1).alias("_size"),
            F.sha2(F.array_join(F.sort_array(F.collect_list("_line")), ""), 256).alias("_digest"),
        )
    )
    ordered = F.sort_array(F.collect_list(F.struct("_part", "_digest")))  # 16 ** PART_DIGITS at most
    return parts.groupBy("alert_id", "file_name").agg(
        F.sum("_n").cast("long").alias("n_lines"),
        F.sum("_size").cast("long").alias("size"),
        F.sha2(F.array_join(F.transform(ordered, lambda p: p["_digest"]), ""), 256).alias("sha256"),
    )


def manifest_documents(manifest: DataFrame) -> DataFrame:
    """The manifest of each alert as a file of its bundle: one JSON line per file."""
    return manifest.select(
        "alert_id", F.lit("manifest.json").alias("file_name"),
        F.to_json(F.struct("file_name", "n_lines", "size", "sha256")).alias("content"),
    )


def bundle_documents(
    triaged: DataFrame, features: list[str], score: str = "anom_score", algorithm: str = "IsolationForest",
    params: str = "{}",
) -> DataFrame:
    """``alert_id``, ``file_name``, ``content``: the single documents of each alert's bundle.

    Expects the columns of ``triage``. ``params`` is the model's settings as JSON text.
    """
    ids = ("event_ts", "host_name", "user_name", "source_ip", "destination_ip", "session_id")
    row = triaged.select(*[c for c in ids if c in triaged.columns], *features)
    options = {"timestampFormat": "yyyy-MM-dd HH:mm:ss.SSSSSSxxx"}
    named = [F.col(c).alias(name) for c, name in zip(row.columns, ecs_names(row).columns)]
    feature_row = F.struct(*named, F.col(score).alias("anom.score"))
    explanation = F.struct(*[F.col(c) for c in ("top_features", "note") if c in triaged.columns])
    meta = F.struct(
        F.lit(algorithm).alias("algorithm"), F.lit(params).alias("params"),
        F.col("threshold").alias("score_threshold"), F.col(score).alias("alert_score"),
    )
    analysis = F.struct(
        "created_at", "risk_level", F.col(score).alias("score"), "reason", "iocs", "actions", "markdown"
    )
    documents = F.array(
        *[
            F.struct(F.lit(name).alias("file_name"), content.alias("content"))
            for name, content in {
                "features.json": F.to_json(feature_row, options),
                "shap_explanation.json": F.to_json(explanation),
                "model_meta.json": F.to_json(meta),
                "ai_analysis.json": F.to_json(analysis),
                "ai_analysis.md": F.col("markdown"),
            }.items()
        ]
    )
    return triaged.select("alert_id", F.inline(documents))


def run_records(hashes: DataFrame, file_name: str) -> DataFrame:
    """File records as JSON lines of the run.

    They are written once, under alert ``run``: the records of a store of many files are the same
    for every alert.
    """
    return hashes.select(
        F.lit("run").alias("alert_id"), F.lit(file_name).alias("file_name"),
        F.to_json(F.struct(*[F.col(c) for c in hashes.columns])).alias("content"),
    )


def write_bundle(files: DataFrame, path: str, mode: str = "append", rows_per_file: int = 1_000_000) -> None:
    """Write ``alert_id``, ``file_name``, ``content`` as text folders, one per alert and file.

    A long context is many part files: REBALANCE splits what is larger than the advisory size.
    """
    (
        files.select("alert_id", "file_name", F.col("content").alias("value"))
        .hint("rebalance", "alert_id", "file_name")
        .write.mode(mode)
        .option("maxRecordsPerFile", rows_per_file)
        .partitionBy("alert_id", "file_name")
        .text(path)
    )
