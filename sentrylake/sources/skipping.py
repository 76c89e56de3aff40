"""Which files of a store can hold a host or a time, so that the others are not read.

Per file the index has the first and last time, and per indexed column a Bloom filter: the values of the column set
HASHES bits each, out of ``bits``, kept as bitmaps of 32,768 bits. A file whose bits are not all set does not hold
the value; one whose bits are set nearly always does. Files that came after the index was built are read in
any case, so no row is missed. Files of a store are never changed, only added and removed.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.values import micros
from ..schema import STORE_SCHEMA
from ..session import stage
from .files import list_files

HASHES = 5
BITS = 1 << 18  # per file and column: 1 % false hits at 27,000 different values
MOST_PATHS = 20_000  # files that are named one by one; beyond it the whole store is read with the same filters


def cluster_by_host(events: DataFrame, path: str, files: int, column: str = "host_name", compression: str = "zstd") -> None:
    """Write a store in which a file holds neighbouring hosts: by ranges of host and time, so that a hot host is split."""
    order = ["dt", column, "event_ts"]
    rows = events.filter(F.col("dt").isNotNull()).select(*STORE_SCHEMA.names).repartitionByRange(files, *order)
    rows.sortWithinPartitions("source", *order).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option(
        "compression", compression
    ).partitionBy("source", "dt").parquet(path)


def _positions(value: Column, bits: int) -> Column:
    return F.array(*[F.pmod(F.xxhash64(value, F.lit(seed)), F.lit(bits)) for seed in range(HASHES)])


def build_index(spark: SparkSession, store: str, index: str, columns: tuple[str, ...] = ("host_name",), bits: int = BITS) -> None:
    """Write the index of all files of a store."""
    rows = spark.read.schema(STORE_SCHEMA).parquet(store).select("event_ts", *columns, F.col("_metadata.file_path").alias("file"))
    spans = rows.groupBy("file").agg(
        F.min("event_ts").alias("first_ts"), F.max("event_ts").alias("last_ts"), F.count("*").alias("n_rows"),
        *[F.bool_or(F.col(c).isNull()).alias(f"null_{c}") for c in columns],
    )
    spans.write.mode("overwrite").parquet(f"{index}/spans")
    for column in columns:
        values = rows.filter(F.col(column).isNotNull()).select("file", column).distinct()
        at_bits = values.select("file", F.explode(_positions(F.col(column), bits)).alias("at"))
        maps = at_bits.groupBy("file", F.expr("bitmap_bucket_number(at)").alias("part")).agg(
            F.expr("bitmap_construct_agg(bitmap_bit_position(at))").alias("bitmap")
        )
        folder = f"{index}/values/column={column}"
        maps.withColumn("bits", F.lit(bits)).write.mode("overwrite").partitionBy("part").parquet(folder)


def _time(moment: dt.datetime) -> Column:
    return F.timestamp_micros(F.lit(micros(moment)))


def _is_set(bitmap: Column, at: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bitmap, F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.getbit(byte, (at % 8).cast("int")) == 1


def _holding(spark: SparkSession, index: str, column: str, value: str) -> DataFrame:
    """Files whose filter has all bits of the value."""
    maps = spark.read.parquet(f"{index}/values/column={column}")
    bits = maps.select("bits").first()
    if bits is None:
        return spark.createDataFrame([], "file string")
    sought = spark.range(1).select(F.explode(_positions(F.lit(value), bits[0])).alias("at"))
    sought = sought.select(F.expr("bitmap_bucket_number(at)").alias("part"), F.expr("bitmap_bit_position(at)").alias("at")).distinct()
    n = sought.count()  # HASHES at most
    hits = maps.join(F.broadcast(sought), "part").filter(_is_set(F.col("bitmap"), F.col("at")))
    return hits.groupBy("file").agg(F.count("*").alias("n")).filter(F.col("n") == n).select("file")


def files_to_read(
    spark: SparkSession, store: str, index: str, column: str | None = None, value: str | None = None,
    start: dt.datetime | None = None, end: dt.datetime | None = None,
) -> DataFrame:
    """``file``: those that may hold a row of the column's value (None: null) between ``start`` and ``end``, both included."""
    spans = spark.read.parquet(f"{index}/spans")
    found = spans
    if start is not None:
        found = found.filter(F.col("last_ts").isNull() | (F.col("last_ts") >= _time(start)))
    if end is not None:
        found = found.filter(F.col("first_ts").isNull() | (F.col("first_ts") <= _time(end)))
    if column is not None and value is None:
        found = found.filter(F.col(f"null_{column}"))
    elif column is not None:
        found = found.join(_holding(spark, index, column, value), "file", "left_semi")
    there = list_files(spark, store, "*.parquet").select(F.col("file_path").alias("file"))
    there = there.filter(~F.substring_index("file", "/", -1).rlike("^[._]"))
    new = there.join(spans, "file", "left_anti")
    return found.select("file").join(there, "file", "left_semi").unionByName(new)


def read_files(spark: SparkSession, store: str, files: DataFrame) -> DataFrame:
    """The rows of some files of a store."""
    paths = [row["file"] for row in stage(files, "files").limit(MOST_PATHS + 1).collect()]
    if len(paths) > MOST_PATHS:
        return spark.read.schema(STORE_SCHEMA).parquet(store)
    if not paths:
        return spark.createDataFrame([], STORE_SCHEMA)
    return spark.read.schema(STORE_SCHEMA).option("basePath", store).parquet(*paths)


def host_rows_indexed(
    spark: SparkSession, store: str, index: str, host: str | None, start: dt.datetime | None = None, end: dt.datetime | None = None
) -> DataFrame:
    """The rows of one host (None: those without) between two times, both included, from the files that may hold them."""
    rows = read_files(spark, store, files_to_read(spark, store, index, "host_name", host, start, end))
    own = F.col("host_name").isNull() if host is None else F.col("host_name") == host
    if start is not None:
        own = own & (F.col("event_ts") >= _time(start)) & (F.col("dt") >= F.to_date(_time(start)))
    if end is not None:
        own = own & (F.col("event_ts") <= _time(end)) & (F.col("dt") <= F.to_date(_time(end)))
    return rows.filter(own)
