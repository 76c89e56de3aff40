"""The event store and the day-partitioned tables derived from it."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from ..schema import EVENT_SCHEMA, STORE_SCHEMA, conform
from ..session import stage

SPREAD = 64


def union_sources(frames: dict[str, DataFrame], columns: T.StructType = EVENT_SCHEMA) -> DataFrame:
    """All sources under one schema, with the source name and the UTC day."""
    parts = [conform(df).withColumn("source", F.lit(name)) for name, df in frames.items()]
    return reduce(DataFrame.unionByName, parts).withColumn("dt", F.to_date("event_ts"))


def with_event_uid(events: DataFrame) -> DataFrame:
    """Add ``event_uid``: content hash and the row's number among exact copies, whatever the file splits.

    The events are written once with their hash. Only rows whose hash occurs again are numbered: in SPREAD
    parts, whose sizes say where each part's numbers begin, so that a mass of copies is no hot group.
    """
    content = F.lower(F.hex(F.xxhash64(*[F.col(name) for name in EVENT_SCHEMA.names])))
    hashed = stage(events.withColumn("_content", content), "events")
    again = stage(hashed.groupBy("_content").agg(F.count("*").alias("_n")).filter("_n > 1").select("_content"), "copies")
    single = hashed.join(again, "_content", "left_anti").withColumn("_copy", F.lit(0).cast("long"))
    part = F.pmod(F.monotonically_increasing_id(), F.lit(SPREAD))
    copies = stage(hashed.join(again, "_content").withColumn("_part", part), "copied-events")
    earlier = Window.partitionBy("_content").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = copies.groupBy("_content", "_part").agg(F.count("*").alias("_n")).select(
        "_content", "_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start")
    )
    inside = Window.partitionBy("_content", "_part").orderBy("_content")
    numbered = copies.withColumn("_row", F.row_number().over(inside)).join(starts, ["_content", "_part"])
    numbered = numbered.withColumn("_copy", F.col("_start") + F.col("_row") - 1)
    columns = [*events.columns, "_content", "_copy"]
    return (
        single.select(*columns).unionByName(numbered.select(*columns))
        .withColumn("event_uid", F.concat_ws("-", "_content", F.col("_copy").cast("string")))
        .drop("_content", "_copy")
    )


def write_days(
    df: DataFrame,
    path: str,
    partitions: list[str],
    order: list[str] | None = None,
    mode: str = "overwrite",
    compression: str = "zstd",
) -> None:
    """Write by partition columns; ``overwrite`` replaces only the partitions in ``df``.

    REBALANCE clusters the rows of a day so that it gives few files, but AQE splits a day (or a
    source) that is larger than the advisory size, so no day is one task's work. Sorting by time
    inside the files lets row-group statistics prune time filters.
    """
    rows = df.hint("rebalance", *partitions)
    if order:
        rows = rows.sortWithinPartitions(*partitions, *order)
    (
        rows.write.mode(mode)
        .option("partitionOverwriteMode", "dynamic")
        .option("compression", compression)
        .partitionBy(*partitions)
        .parquet(path)
    )


def write_store(
    events: DataFrame, path: str, mode: str = "overwrite", compression: str = "zstd"
) -> None:
    """Write events with ``source`` and ``dt`` as the store; rows without a day are dropped."""
    if "event_uid" not in events.columns:
        events = with_event_uid(events)
    rows = events.filter(F.col("dt").isNotNull()).select(*STORE_SCHEMA.names)
    write_days(rows, path, ["source", "dt"], ["event_ts"], mode, compression)


def read_store(spark: SparkSession, path: str, skip_unreadable: bool = False) -> DataFrame:
    """The whole store; filters on ``source`` and ``dt`` prune partitions."""
    reader = spark.read.schema(STORE_SCHEMA).option("ignoreCorruptFiles", skip_unreadable)
    return reader.parquet(path)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A feature or score table; an empty one is an error."""
    df = spark.read.parquet(path)
    if df.isEmpty():
        raise ValueError(f"table is empty: {path}")
    return df


def available_days(events: DataFrame) -> DataFrame:
    """Rows per source and day."""
    return events.groupBy("source", "dt").agg(F.count("*").alias("n_rows"))


def isolated(readers: dict[str, Callable[[], DataFrame]]) -> tuple[dict[str, DataFrame], dict[str, str]]:
    """Run each reader; a failing one is reported by name instead of stopping the others."""
    frames: dict[str, DataFrame] = {}
    failures: dict[str, str] = {}
    for name, reader in readers.items():
        try:
            frames[name] = reader()
        except Exception as error:  # noqa: BLE001 - a broken source must not stop the rest
            failures[name] = str(error)
    return frames, failures
