"""Sessions and rolling counts of new events without reading the old ones.

A folder holds what the next batch needs to know: per flow key the time of its last event and the number of its last
session, and per user the flagged times that a window can still reach. ``advance`` labels one batch of events
with it and writes the state after it, under a new version; ``versions`` lists what is complete. A batch that is
listed is not worked out again, a killed one is overwritten. The labels equal those of all events at once
with ``reset_daily=False``, however the time is cut into batches.
"""

from __future__ import annotations

import datetime as dt

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.values import micros
from ..schema import FLAGS, FLOW_KEYS, WINDOW_MINUTES
from ..session import stage
from .rolling import MINUTE, rolling_counts
from .sessions import SECOND, key_text, sessionize

VERSIONS_SCHEMA = "version bigint, batch string, until_us bigint, n_rows bigint, n_late bigint"


def versions(spark: SparkSession, root: str) -> DataFrame:
    """One row per batch that is complete, with the time up to which events have been seen."""
    try:
        return spark.read.schema(VERSIONS_SCHEMA).parquet(f"{root}/versions")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], VERSIONS_SCHEMA)


def _table(spark: SparkSession, root: str, version: int, name: str, schema) -> DataFrame:
    """A table of a version; before the first one it is empty."""
    if not version:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{root}/{name}/version={version}")


def _keep(df: DataFrame, root: str, version: int, name: str) -> None:
    df.write.mode("overwrite").option("compression", "zstd").parquet(f"{root}/{name}/version={version}")


def labelled_rows(spark: SparkSession, root: str) -> DataFrame:
    """The labelled events of all complete batches."""
    numbers = [row["version"] for row in versions(spark, root).select("version").collect()]  # one per batch
    return spark.read.option("basePath", f"{root}/rows").parquet(*[f"{root}/rows/version={n}" for n in numbers]).drop("version")


def late_rows(spark: SparkSession, root: str) -> DataFrame:
    """Events that came after their time had been closed: they have no labels."""
    numbers = [row["version"] for row in versions(spark, root).select("version").collect()]
    return spark.read.option("basePath", f"{root}/late").parquet(*[f"{root}/late/version={n}" for n in numbers]).drop("version")


def _session_bases(local: DataFrame, state: DataFrame, timeout_seconds: float) -> DataFrame:
    """Per key of the batch what its session numbers start from, and the state after it.

    The first session of the batch goes on with the last one of the state unless the gap is longer than the timeout.
    """
    own = local.groupBy("_key").agg(F.min("_us").alias("first"), F.max("_us").alias("last_us"), F.max("session_ordinal").alias("n"))
    goes_on = F.col("first") - F.col("before_us") <= int(timeout_seconds * SECOND)
    base = F.when(F.col("before_us").isNull(), 0).when(goes_on, F.col("before_n") - 1).otherwise(F.col("before_n"))
    before = state.select("_key", F.col("last_us").alias("before_us"), F.col("ordinal").alias("before_n"))
    return own.join(before, "_key", "left").select("_key", "last_us", base.alias("base"), (base + F.col("n")).alias("ordinal"))


def advance(
    events: DataFrame, root: str, batch: str, until: dt.datetime, keys: list[str] | None = None, timeout_seconds: float = 120,
    count_keys: list[str] | None = None, flags: list[str] | None = None, windows: list[int] | None = None,
) -> DataFrame:
    """Label one batch: the events before ``until`` that are not before the last batch's ``until``.

    Adds ``session_ordinal``, ``session_id`` and the counts of ``rolling_counts``. Events earlier than that are
    kept in a table of their own (``late_rows``), events without a time are left out, events at or after
    ``until`` are an error. All batches of a folder must use the same keys, timeout and windows.
    """
    spark = events.sparkSession
    keys, flags = FLOW_KEYS if keys is None else keys, FLAGS if flags is None else flags
    count_keys, windows = ["user_name"] if count_keys is None else count_keys, WINDOW_MINUTES if windows is None else windows
    done = versions(spark, root)
    known = done.filter(F.col("batch") == batch).first()
    if known is None:
        last = done.orderBy(F.col("version").desc()).first()
        version, start, stop = last["version"] if last else 0, last["until_us"] if last else None, micros(until)
        rows = stage(events.filter(F.col("event_ts").isNotNull()), "carried-batch")
        time = F.unix_micros("event_ts")
        if not rows.filter(time >= stop).isEmpty():
            raise ValueError(f"events at or after {until}")
        is_late = F.lit(False) if start is None else time < start
        late, on_time = rows.filter(is_late), rows.filter(~is_late)

        state = _table(spark, root, version, "sessions", "_key string, last_us bigint, ordinal bigint")
        local = sessionize(on_time, keys, timeout_seconds, reset_daily=False).drop("session_id")
        local = stage(local.withColumn("_key", key_text(keys)).withColumn("_us", F.unix_micros("event_ts")), "carried-sessions")
        bases = stage(_session_bases(local, state, timeout_seconds), "carried-bases")
        numbered = local.join(bases.select("_key", "base"), "_key").withColumn("session_ordinal", F.col("base") + F.col("session_ordinal"))
        label = [F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys] + [F.col("session_ordinal")]
        numbered = numbered.withColumn("session_id", F.concat_ws("|", *label)).drop("_key", "_us", "base")
        after = state.join(bases, "_key", "left_anti").unionByName(bases.select("_key", "last_us", "ordinal"))

        point = [*count_keys, "event_ts", *flags]
        fields = [rows.schema[c] for c in point]
        schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fields)
        earlier = _table(spark, root, version, "points", schema)
        points = earlier.unionByName(on_time.select(*point))
        counted = rolling_counts(numbered, count_keys, flags, windows, reset_daily=False, source=points)
        reach = time > stop - max(windows) * MINUTE
        flagged = F.greatest(*[F.coalesce(F.abs(F.col(f)), F.lit(0)) for f in flags], F.lit(0)) > 0
        kept = points.filter(reach & flagged).groupBy(*count_keys, "event_ts").agg(
            *[F.sum(f).cast(rows.schema[f].dataType).alias(f) for f in flags]
        )
        _keep(counted, root, version + 1, "rows")
        _keep(late, root, version + 1, "late")
        _keep(after, root, version + 1, "sessions")
        _keep(kept.select(*point), root, version + 1, "points")
        written = spark.read.parquet(f"{root}/rows/version={version + 1}").count()
        record = [(version + 1, batch, stop, written, rows.count() - written)]
        spark.createDataFrame(record, VERSIONS_SCHEMA).coalesce(1).write.mode("append").parquet(f"{root}/versions")
        known = {"version": version + 1}
    return spark.read.parquet(f"{root}/rows/version={known['version']}")
