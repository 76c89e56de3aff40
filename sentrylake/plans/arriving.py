"""The first stages of the analysis for files that keep arriving: nothing old is read again."""

from __future__ import annotations

import datetime as dt

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.entropy import char_entropy
from ..functions.values import micros
from ..operators.carried import advance, versions
from ..operators.features import event_flags
from ..schema import ENTROPY, FLAGS, FLOW_KEYS, ID_COLUMNS, WINDOW_MINUTES
from ..sources.batches import ledger, read_batches
from ..sources.jsonl import SYSMON, WINDOWS_EVTX, ZEEK_CONN
from ..streaming.files import available, json_reader, log_reader
from .run import Settings

TAKEN = "batch string, until_us bigint"


def ingest_arriving(spark: SparkSession, settings: Settings) -> dict[str, list[str]]:
    """Read what has arrived below the raw folder since the last call into the store of batches; the batches by source.

    JSON lines come in a folder per source (``<raw>/windows_evtx/…``), logs in ``<raw>/logs/…`` as ``*.log``.
    """
    raw, store, checkpoint = settings.raw.rstrip("/"), settings.path("batches"), settings.path("checkpoints")
    found = {
        source.name: available(spark, source.name, f"{raw}/{source.name}", json_reader(source), store, checkpoint)
        for source in (WINDOWS_EVTX, SYSMON, ZEEK_CONN)
    }
    reader = log_reader(settings.default_year, settings.tz, settings.host)
    found["syslog_auth"] = available(spark, "syslog_auth", f"{raw}/logs", reader, store, checkpoint, "*.log")
    return found


def _taken(spark: SparkSession, settings: Settings, before: int) -> list[str]:
    """The batches that earlier calls of ``featurize_arrived`` have seen."""
    try:
        rows = spark.read.schema(TAKEN).parquet(settings.path("taken"))
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return []
    return [r["batch"] for r in rows.filter(F.col("until_us") < before).select("batch").distinct().collect()]  # one per batch


def featurize_arrived(spark: SparkSession, settings: Settings, until: dt.datetime, timeout_seconds: float = 120) -> DataFrame:
    """Features of the events from the last call's ``until`` to this one, with sessions and counts carried across days.

    Of the store only the days since then are read, and batches that are new, whose earlier events come too late and
    are kept apart (``carried.late_rows``). A repeated call gives the same rows.
    """
    root, stop = settings.path("carried"), micros(until)
    since = versions(spark, root).filter(F.col("until_us") < stop).agg(F.max("until_us")).first()[0]
    names = [r["batch"] for r in ledger(spark, settings.path("batches")).select("batch").collect()]
    old = set(_taken(spark, settings, stop))
    new = [name for name in names if name not in old]
    spark.createDataFrame([(name, stop) for name in new], TAKEN).coalesce(1).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic").partitionBy("until_us").parquet(settings.path("taken"))
    rows, time = read_batches(spark, settings.path("batches")), F.unix_micros("event_ts")
    if since is not None:
        rows = rows.filter(((F.col("dt") >= F.to_date(F.timestamp_micros(F.lit(since)))) & (time >= since)) | F.col("batch").isin(new))
    rows = rows.filter((F.col("dt") <= F.to_date(F.timestamp_micros(F.lit(stop)))) & (time < stop))
    flagged = event_flags(rows).withColumn(ENTROPY, char_entropy(F.col("process_command_line")))
    ids = [c for c in ID_COLUMNS if c != "session_id"]
    narrow = flagged.select(*dict.fromkeys(ids + FLOW_KEYS), *FLAGS, ENTROPY)
    return advance(narrow, root, f"until-{stop}", until, timeout_seconds=timeout_seconds, windows=WINDOW_MINUTES)
