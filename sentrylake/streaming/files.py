"""JSON lines and logs as streams of arriving files, written exactly once into the store of batches.

The readers are the same as for whole folders. Spark's file source notes in the checkpoint which files a
micro-batch has; a micro-batch that is repeated after a loss has the same number, and the ledger of the store knows
it, so its rows are there once. ``available`` takes up all files that have come since the last call and ends.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import new_folder
from ..sources.batches import append_batch
from ..sources.jsonl import JsonSource, map_records, parse_json_lines
from ..sources.logs import parse_log_lines
from ..sources.store import union_sources

Reader = Callable[[DataFrame], DataFrame]


def arriving_lines(spark: SparkSession, path: str, pattern: str | None = None, files_per_batch: int | None = None) -> DataFrame:
    """Lines of the files below a folder, as a stream, with ``value`` and ``file_path``."""
    reader = spark.readStream.format("text").option("recursiveFileLookup", True)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path).select("value", F.col("_metadata.file_path").alias("file_path"))


def json_reader(source: JsonSource) -> Reader:
    return lambda lines: map_records(parse_json_lines(lines, source), source)


def log_reader(default_year: int, tz: str = "UTC", host: str | None = None) -> Reader:
    return lambda lines: parse_log_lines(lines, default_year, tz, host)


def available(
    spark: SparkSession, name: str, path: str, reader: Reader, store: str, checkpoint: str, pattern: str | None = None,
    files_per_batch: int | None = None,
) -> list[str]:
    """Read the files below ``path`` that are new since the last call into ``store``; the batches written.

    ``checkpoint`` must outlast the call: it says which files have been read. A folder that is not there yet has
    no files.
    """
    written: list[str] = []

    def write(rows: DataFrame, number: int) -> None:
        # written by the stream's own session, then read by the caller's, whose settings (adaptive plans) hold for the store
        path = new_folder(spark, "micro-batch")
        rows.write.parquet(path)
        batch = f"{name}-{number:09d}"
        append_batch(union_sources({name: spark.read.schema(rows.schema).parquet(path)}), store, batch)
        written.append(batch)

    try:
        events = reader(arriving_lines(spark, path, pattern, files_per_batch))
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return written
    query = (
        events.writeStream.queryName(f"{name}-files").foreachBatch(write).trigger(availableNow=True)
        .option("checkpointLocation", f"{checkpoint}/{name}").start()
    )
    query.awaitTermination()
    return written
